"""Queries of trajectories, tries, losses and sampling (T, C, J, X rows) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compressed_trie as C
from ..operators import losses as L
from ..operators import sampling as S
from ..operators import tries as T
from ..operators.positions import placed
from ..sources.relations import ANSWERS, ROLLOUTS, TRAJECTORIES, answers, rollouts, table, trajectories
from .registry import query

_DEDUP = """deduped AS (SELECT question_id, rollout_index, tokens, success, reward, exp(least(greatest(least(greatest(reward, -5), 5) / 0.1, -50), 125)) AS weight FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id, tokens ORDER BY rollout_index) AS rn FROM trajectories WHERE len(tokens) > 0) WHERE rn = 1)"""
_STEPS = """steps AS (SELECT question_id, rollout_index, success, reward, weight, depth, token, concat(s1 - h1, '-', s2 - h2) AS prefix, concat(s1, '-', s2) AS child FROM
  (SELECT *, CAST(sum(h1) OVER w AS BIGINT) AS s1, CAST(sum(h2) OVER w AS BIGINT) AS s2 FROM
    (SELECT *, CAST(concat('0x', substr(m, 1, 10)) AS BIGINT) AS h1, CAST(concat('0x', substr(m, 11, 10)) AS BIGINT) AS h2 FROM
      (SELECT *, md5(concat(depth, ':', token)) AS m FROM (SELECT question_id, rollout_index, success, reward, weight, CAST(unnest(range(len(tokens))) AS INTEGER) AS depth, unnest(tokens) AS token FROM deduped)))
   WINDOW w AS (PARTITION BY question_id, rollout_index ORDER BY depth)))"""
_NODES = """nodes AS (SELECT question_id, depth, prefix, sum(weight) AS weight, count(*) AS visits, CAST(sum(success::INT) AS BIGINT) AS successes FROM
  (SELECT question_id, weight, success, 0 AS depth, '0-0' AS prefix FROM deduped UNION ALL SELECT question_id, weight, success, depth + 1, child FROM steps) GROUP BY 1, 2, 3)"""
_EDGES = "edges AS (SELECT question_id, depth, prefix, token, child, sum(weight) AS weight, count(*) AS visits FROM steps GROUP BY 1, 2, 3, 4, 5)"
_RELIABLE = "reliable AS (SELECT n.* FROM nodes n WHERE successes >= 2 AND EXISTS (SELECT 1 FROM edges e WHERE e.question_id = n.question_id AND e.depth = n.depth AND e.prefix = n.prefix))"
_FRONTIER = """frontier AS (SELECT e.question_id, e.depth, e.prefix, e.token, e.child, e.visits AS edge_visits, p.visits AS parent_visits, p.successes AS parent_successes, c.visits AS child_visits, 1.0::DOUBLE AS negative_weight
  FROM edges e JOIN nodes p ON p.question_id = e.question_id AND p.depth = e.depth AND p.prefix = e.prefix AND p.successes >= 1
  JOIN nodes c ON c.question_id = e.question_id AND c.depth = e.depth + 1 AND c.prefix = e.child AND c.successes = 0 AND c.visits >= 1)"""
_TRIE = (TRAJECTORIES, _DEDUP, _STEPS, _NODES, _EDGES)


def _deduped(spark, sf):
    return T.deduplicated(trajectories(spark, sf)).withColumn("weight", T.reward_weight(F.col("reward")))


def _trie(spark, sf):
    return C.compressed_trie(_deduped(spark, sf))


def _log(weight):
    return F.round(F.ln(weight), 6)


@query("SELECT question_id, count(*) AS kept, min(rollout_index) AS first_rollout, max(len(tokens)) AS longest FROM deduped GROUP BY 1", TRAJECTORIES, _DEDUP)
def dedup_rollouts(spark, sf):
    """T1."""
    return _deduped(spark, sf).groupBy("question_id").agg(F.count("*").alias("kept"), F.min("rollout_index").alias("first_rollout"), F.max(F.size("tokens")).cast("bigint").alias("longest"))


@query("SELECT question_id, rollout_index, round(ln(exp(least(greatest(least(greatest(reward, -5), 5) / 0.1, -50), 125))), 6) AS log_weight FROM trajectories", TRAJECTORIES)
def reward_weight(spark, sf):
    """T2, T3."""
    return trajectories(spark, sf).select("question_id", "rollout_index", F.round(F.ln(T.reward_weight(F.col("reward"))), 6).alias("log_weight"))


@query("SELECT question_id, depth, prefix, round(ln(weight), 6) AS log_weight, visits, successes FROM nodes", *_TRIE[:4])
def trie_node_stats(spark, sf):
    """T4."""
    return C.node_stats(_trie(spark, sf), _log).select("question_id", "depth", "prefix", F.col("weight").alias("log_weight"), "visits", "successes")


@query("SELECT question_id, depth, prefix, token, round(ln(weight), 6) AS log_weight, visits FROM edges", *_TRIE)
def trie_edge_stats(spark, sf):
    """T5."""
    return C.edge_stats(_trie(spark, sf), _log).select("question_id", "depth", "prefix", "token", F.col("weight").alias("log_weight"), "visits")


@query("SELECT question_id, depth, prefix, visits, successes FROM reliable", *_TRIE, _RELIABLE)
def reliable_prefixes(spark, sf):
    """T6."""
    return C.reliable_prefixes(_trie(spark, sf), 2).select("question_id", "depth", "prefix", "visits", "successes")


@query("SELECT e.question_id, e.depth, e.prefix, e.token, round(e.weight / sum(e.weight) OVER (PARTITION BY e.question_id, e.depth, e.prefix), 6) AS prob FROM edges e JOIN reliable r ON r.question_id = e.question_id AND r.depth = e.depth AND r.prefix = e.prefix", *_TRIE, _RELIABLE)
def teacher_distribution(spark, sf):
    """T7."""
    return C.teacher_distribution(_trie(spark, sf), 2).withColumn("prob", F.round("prob", 6))


@query("SELECT question_id, depth, prefix, token, child_visits, negative_weight FROM frontier", *_TRIE, _FRONTIER)
def failure_frontier(spark, sf):
    """T8, J8."""
    return C.failure_frontier(_trie(spark, sf), 1, 1).select("question_id", "depth", "prefix", "token", "child_visits", "negative_weight")


@query("SELECT question_id, depth, token, parent_visits, parent_successes, child_visits, edge_visits FROM frontier", *_TRIE, _FRONTIER)
def bad_frontier_edges(spark, sf):
    """T10."""
    return C.failure_frontier(_trie(spark, sf), 1, 1).select("question_id", "depth", "token", "parent_visits", "parent_successes", "child_visits", "edge_visits")


_EXAMPLES = "examples AS (SELECT question_id, depth, prefix, 'pos' AS example_kind FROM reliable UNION ALL SELECT question_id, depth, prefix, 'neg' FROM frontier)"


def _examples(spark, sf):
    trie = _trie(spark, sf)
    pos = C.reliable_prefixes(trie, 2).select("question_id", "depth", "prefix", F.lit("pos").alias("example_kind"))
    neg = C.failure_frontier(trie, 1, 1).select("question_id", "depth", "prefix", "token", F.lit("neg").alias("example_kind"))
    return pos.unionByName(neg, allowMissingColumns=True)


@query("SELECT question_id, example_kind, depth, prefix, round(1.0::DOUBLE / count(*) OVER (PARTITION BY question_id, example_kind), 6) AS sample_weight FROM examples", *_TRIE, _RELIABLE, _FRONTIER, _EXAMPLES)
def sample_weights(spark, sf):
    """T9."""
    return T.sample_weights(_examples(spark, sf)).select("question_id", "example_kind", "depth", "prefix", F.round("sample_weight", 6).alias("sample_weight"))


@query("SELECT example_kind, count(*) AS n, count(DISTINCT question_id) AS questions FROM examples GROUP BY 1", *_TRIE, _RELIABLE, _FRONTIER, _EXAMPLES)
def union_examples(spark, sf):
    """X2."""
    return _examples(spark, sf).groupBy("example_kind").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("questions"))


@query("""SELECT d.question_id, count(*) AS trajectories, CAST(sum(success::INT) AS BIGINT) AS successes, coalesce(max(p.n), 0) AS positives, coalesce(max(f.n), 0) AS negatives FROM deduped d
  LEFT JOIN (SELECT question_id, count(*) AS n FROM reliable GROUP BY 1) p ON p.question_id = d.question_id LEFT JOIN (SELECT question_id, count(*) AS n FROM frontier GROUP BY 1) f ON f.question_id = d.question_id GROUP BY 1""", *_TRIE, _RELIABLE, _FRONTIER)
def teacher_batch(spark, sf):
    """Per question what the trie gives."""
    return C.question_summary(_trie(spark, sf), 2, 1, 1)


@query("""SELECT count(*) AS questions, CAST(sum(t) AS BIGINT) AS trajectories, CAST(sum(s) AS BIGINT) AS successes, round(avg(t), 6) AS trajectories_per_question, round(avg(s), 6) AS successes_per_question FROM (SELECT question_id, count(*) AS t, sum(success::INT) AS s FROM deduped GROUP BY 1)""", TRAJECTORIES, _DEDUP)
def teacher_metrics(spark, sf):
    """A18."""
    per = _deduped(spark, sf).groupBy("question_id").agg(F.count("*").alias("t"), F.sum(F.col("success").cast("long")).alias("s"))
    return per.agg(F.count("*").alias("questions"), F.sum("t").alias("trajectories"), F.sum("s").alias("successes"), F.round(F.avg("t"), 6).alias("trajectories_per_question"), F.round(F.avg("s"), 6).alias("successes_per_question"))


@query("""SELECT question_id, rollout_index, round((reward - avg(reward) OVER w) / sqrt(greatest(var_pop(reward) OVER w, 1e-6)), 5) AS advantage FROM rollouts WINDOW w AS (PARTITION BY question_id) QUALIFY count(*) OVER w > 1""", ROLLOUTS)
def group_advantage(spark, sf):
    """The flagship query."""
    return T.group_advantage(rollouts(spark, sf)).select("question_id", "rollout_index", F.round("advantage", 5).alias("advantage"))


_VALID = """flagged AS (SELECT s.*, r.question_id IS NOT NULL AS is_reliable, f.question_id IS NOT NULL AS is_frontier FROM steps s LEFT JOIN reliable r ON r.question_id = s.question_id AND r.depth = s.depth AND r.prefix = s.prefix
  LEFT JOIN frontier f ON f.question_id = s.question_id AND f.depth = s.depth AND f.prefix = s.prefix AND f.token = s.token),
valid AS (SELECT *, NOT is_reliable AND NOT is_frontier AND NOT coalesce(max(is_frontier) OVER (PARTITION BY question_id, rollout_index ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS valid FROM flagged)"""


@query("SELECT question_id, rollout_index, depth, token, valid FROM valid", *_TRIE, _RELIABLE, _FRONTIER, _VALID)
def token_valid_mask(spark, sf):
    """T12, J3."""
    return C.token_valid_mask(_trie(spark, sf))


@query("SELECT question_id, rollout_index, list(valid::INT ORDER BY depth) AS valid_mask, round(avg(valid::INT), 6) AS valid_fraction FROM valid GROUP BY 1, 2", *_TRIE, _RELIABLE, _FRONTIER, _VALID)
def grpo_example_stats(spark, sf):
    """T13."""
    mask = F.transform("valid", lambda v: v.cast("int"))
    share = F.size(F.filter("valid", lambda v: v)) / F.size("valid")
    return C.valid_masks(_trie(spark, sf)).select("question_id", "rollout_index", mask.alias("valid_mask"), F.round(share, 6).alias("valid_fraction"))


@query("""SELECT question_id, rollout_index, list(valid::INT ORDER BY depth) AS valid_mask, rollout_index % 5 <> 0 AND rollout_index % 40 >= count(*) AS has_old FROM valid WHERE depth < 32 GROUP BY 1, 2""", *_TRIE, _RELIABLE, _FRONTIER, _VALID)
def grpo_examples(spark, sf):
    """Responses cut to 32 tokens; a fifth of them has no log probabilities, others may have too few."""
    n = F.when(F.col("rollout_index") % 5 != 0, (F.col("rollout_index") % 40).cast("int"))
    return C.response_examples(_trie(spark, sf), n, 32)


_ARRAYS = """arrays AS (SELECT r.question_id, r.rollout_index, list_concat(list_resize([]::INTEGER[], nq, 0), list_resize([]::INTEGER[], rl, 1)) AS response_mask, list_concat(list_resize([]::INTEGER[], nq, 0), v.m[1:rl]) AS valid_mask,
  list_concat(list_resize([]::DOUBLE[], nq, 0.0), CASE WHEN has_old THEN list_transform(range(rl), lambda i: -(i % 10) / 10.0::DOUBLE) ELSE list_resize([]::DOUBLE[], rl, 0.0) END) AS old_logprobs, has_old, rl FROM
  (SELECT *, rollout_index % 5 <> 0 AND CASE WHEN rollout_index % 3 = 0 THEN n // 2 ELSE n END >= rl AS has_old FROM (SELECT question_id, rollout_index, rollout_index % 7 AS nq, len(tokens) AS n, least(len(tokens), 300 - rollout_index % 7) AS rl FROM deduped)) r
  JOIN (SELECT question_id, rollout_index, list(valid::INT ORDER BY depth) AS m FROM valid GROUP BY 1, 2) v ON v.question_id = r.question_id AND v.rollout_index = r.rollout_index WHERE rl > 0)"""


def _arrays(spark, sf):
    i, n = F.col("rollout_index"), F.size("tokens")
    made = F.transform("tokens", lambda _, d: -(d % 10) / 10)
    known = F.when(i % 5 != 0, F.slice(made, F.lit(1), F.when(i % 3 == 0, F.floor(n / 2).cast("int")).otherwise(n)))
    rows = _deduped(spark, sf).withColumns({"n_query": (i % 7).cast("int"), "logprobs": known})
    return C.training_rows(C.compressed_trie(rows), most=300)


@query("SELECT question_id, rollout_index, response_mask, valid_mask, old_logprobs, has_old FROM arrays", *_TRIE, _RELIABLE, _FRONTIER, _VALID, _ARRAYS)
def grpo_training_rows(spark, sf):
    """Masks and log probabilities over query and response, cut to 300 tokens."""
    return _arrays(spark, sf).select("question_id", "rollout_index", "response_mask", "valid_mask", "old_logprobs", "has_old")


@query("SELECT count(*) AS examples, CAST(sum(rl) AS BIGINT) AS response_tokens, CAST(sum(list_sum(valid_mask)) AS BIGINT) AS valid_tokens, round(sum(list_sum(valid_mask)) / sum(rl), 6) AS valid_fraction, CAST(sum((NOT has_old)::INT) AS BIGINT) AS without_logprob FROM arrays", *_TRIE, _RELIABLE, _FRONTIER, _VALID, _ARRAYS)
def grpo_training_metrics(spark, sf):
    """T13."""
    return C.training_metrics(_arrays(spark, sf)).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query("SELECT 'pos' AS example_kind, count(*) AS n, CAST(max(depth) AS INTEGER) AS deepest FROM reliable WHERE depth + 1 <= 8 UNION ALL SELECT 'neg', count(*), CAST(max(depth) AS INTEGER) FROM frontier WHERE depth + 1 <= 8", *_TRIE, _RELIABLE, _FRONTIER)
def guarded_examples(spark, sf):
    """Only prefixes that one more token keeps within the longest sequence."""
    trie = _trie(spark, sf)
    count = lambda df, kind: df.agg(F.lit(kind).alias("example_kind"), F.count("*").alias("n"), F.max("depth").alias("deepest"))
    return count(C.reliable_prefixes(trie, 2, most=8), "pos").unionByName(count(C.failure_frontier(trie, 1, 1, most=8), "neg"))


@query("""SELECT question_id, rollout_index, round((reward - avg(reward) OVER w) / sqrt(greatest(var_pop(reward) OVER w, 1e-6)), 5) AS advantage FROM deduped WINDOW w AS (PARTITION BY question_id) QUALIFY count(*) OVER w > 1""", TRAJECTORIES, _DEDUP)
def advantage_deduplicated(spark, sf):
    """T11, after T1: the advantages of the trajectories that are left."""
    return T.group_advantage(_deduped(spark, sf)).select("question_id", "rollout_index", F.round("advantage", 5).alias("advantage"))


@query("SELECT t.question_id, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM trajectories t JOIN (SELECT DISTINCT source AS question_id FROM documents WHERE lang = 'en') q ON q.question_id = t.question_id GROUP BY 1", TRAJECTORIES)
def join_questions_trajectories(spark, sf):
    """Questions without trajectories are skipped."""
    q = table(spark, sf, "documents").where("lang = 'en'").select(F.col("source").alias("question_id")).distinct()
    return trajectories(spark, sf).join(q, "question_id").groupBy("question_id").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens"))


_TOKENS = """tokens AS (SELECT n.vec_id AS sequence_id, u.i, round(u.a, 6) AS new_logprob, CASE WHEN n.vec_id % 11 <> 0 THEN round(u.b, 6) END AS old_logprob, (n.label - 4.5) / 3 AS advantage, (u.i + n.vec_id) % 3 <> 0 AS valid
  FROM embeddings n JOIN embeddings o ON o.vec_id = n.vec_id + 1, LATERAL (SELECT unnest(range(64)) AS i, unnest(n.embedding)::DOUBLE AS a, unnest(o.embedding)::DOUBLE AS b) u)"""


def _tokens(spark, sf):
    e = table(spark, sf, "embeddings")
    old = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("old"))
    rows = e.join(old, "vec_id").select("vec_id", "label", F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.col("old").alias("b"))).alias("i", "u"))
    return rows.select(F.col("vec_id").alias("sequence_id"), "i", F.round(F.col("u.a").cast("double"), 6).alias("new_logprob"), F.when(F.col("vec_id") % 11 != 0, F.round(F.col("u.b").cast("double"), 6)).alias("old_logprob"), ((F.col("label") - 4.5) / 3).alias("advantage"), ((F.col("i") + F.col("vec_id")) % 3 != 0).alias("valid"))


_R = "exp(new_logprob - coalesce(old_logprob, new_logprob))"
_CLIP = "-least({r} * advantage, least(greatest({r}, {lo}), {hi}) * advantage)"


def _loss(name, **options):
    return lambda spark, sf: L.loss(_tokens(spark, sf), name, **options).withColumn("loss", F.round("loss", 6))


@query(f"SELECT round(avg({_CLIP.format(r=_R, lo=0.8, hi=1.2)}), 6) AS loss FROM tokens WHERE valid", _TOKENS)
def loss_grpo(spark, sf):
    """T15, T20."""
    return _loss("grpo")(spark, sf)


@query(f"SELECT round(avg({_CLIP.format(r=_R, lo=0.8, hi=1.28)}), 6) AS loss FROM tokens WHERE valid", _TOKENS)
def loss_dapo(spark, sf):
    """The band is wider above."""
    return _loss("dapo", high=0.28)(spark, sf)


@query(f"SELECT round(avg(s) / greatest(max(n), 1), 6) AS loss FROM (SELECT sequence_id, coalesce(sum({_CLIP.format(r=_R, lo=0.8, hi=1.2)}) FILTER (valid), 0) AS s, sum(valid::INT) AS n FROM tokens GROUP BY 1)", _TOKENS)
def loss_dr_grpo(spark, sf):
    """T16."""
    return _loss("dr_grpo")(spark, sf)


@query(f"SELECT round(avg({_CLIP.format(r='r', lo=0.8, hi=1.2)}), 6) AS loss FROM (SELECT *, exp(sum(CASE WHEN valid THEN new_logprob - coalesce(old_logprob, new_logprob) ELSE 0 END) OVER w / greatest(sum(valid::INT) OVER w, 1)) AS r FROM tokens WINDOW w AS (PARTITION BY sequence_id)) WHERE valid", _TOKENS)
def loss_gspo(spark, sf):
    """T17."""
    return _loss("gspo")(spark, sf)


@query(f"SELECT round(avg(-(1 + tanh({_R} - 1)) * advantage), 6) AS loss FROM tokens WHERE valid", _TOKENS)
def loss_sapo(spark, sf):
    """T18."""
    return _loss("sapo")(spark, sf)


@query(f"SELECT round(avg(({_R} < 0.8 OR {_R} > 1.2)::INT), 6) AS clip_fraction FROM tokens WHERE valid", _TOKENS)
def clip_fraction(spark, sf):
    """T19."""
    return L.clip_fraction(_tokens(spark, sf)).withColumn("clip_fraction", F.round("clip_fraction", 6))


@query("SELECT sequence_id, i, round(greatest(abs(new_logprob), 0.05) / sum(greatest(abs(new_logprob), 0.05)) OVER (PARTITION BY sequence_id), 6) AS prob FROM tokens", _TOKENS)
def prob_floor_renorm(spark, sf):
    """T14."""
    rows = _tokens(spark, sf).withColumn("p", F.abs("new_logprob"))
    total = rows.groupBy("sequence_id").agg(F.sum(F.greatest("p", F.lit(0.05))).alias("total"))
    return rows.join(total, "sequence_id").select("sequence_id", "i", F.round(L.floor_renormalised(F.col("p"), 0.05, F.col("total")), 6).alias("prob"))


@query("SELECT round(avg(-0.5 * ln(1 - least(greatest(abs(new_logprob), 1e-6), 1 - 1e-6))), 6) AS neg_loss, round(avg(-abs(advantage) * new_logprob), 6) AS pos_loss FROM tokens", _TOKENS)
def pos_neg_loss(spark, sf):
    """T21."""
    return _tokens(spark, sf).agg(F.round(F.avg(L.negative_loss(F.abs("new_logprob"), F.lit(0.5))), 6).alias("neg_loss"), F.round(F.avg(-F.abs("advantage") * F.col("new_logprob")), 6).alias("pos_loss"))


@query("SELECT event_id AS step, round(1e-3 * CASE WHEN event_id < 200 THEN 0.1 + 0.9 * event_id / 200 ELSE 1 - 0.9 * least(greatest((event_id - 200) / 1800.0, 0), 1) END, 9) AS lr FROM events")
def lr_schedule(spark, sf):
    """Events as optimizer steps."""
    step = F.col("event_id")
    return table(spark, sf, "events").select(step.alias("step"), F.round(L.learning_rate(step, 1e-3, 2000, 200, 0.1), 9).alias("lr"))


@query("SELECT round(avg(p), 6) AS p_bad, count(*) AS edges, max(total) > 50 AS capped FROM (SELECT abs(new_logprob) AS p, row_number() OVER (ORDER BY sequence_id, i) AS rn, count(*) OVER () AS total FROM tokens WHERE NOT valid) WHERE rn <= 50", _TOKENS)
def bad_action_stats(spark, sf):
    """The mean probability of the first edges; the limit is the operator's own."""
    rows = _tokens(spark, sf).where("NOT valid")
    first = rows.orderBy("sequence_id", "i").limit(51).withColumn("nth", F.row_number().over(Window.orderBy("sequence_id", "i")))  # 51 rows
    used = F.col("nth") <= 50
    return first.agg(F.round(F.avg(F.when(used, F.abs("new_logprob"))), 6).alias("p_bad"), F.count(F.when(used, 1)).alias("edges"), (F.max("nth") > 50).alias("capped"))


@query("SELECT vec_id, n, CASE WHEN abs(n - 64) > 2 THEN NULL WHEN n > 64 THEN list_concat(e, list_resize([]::DOUBLE[], n - 64, 0.0)) ELSE list_slice(e, 1, n) END AS logprobs FROM (SELECT vec_id, CAST(61 + vec_id % 7 AS BIGINT) AS n, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS e FROM embeddings)")
def align_logprobs(spark, sf):
    """P15."""
    rows = table(spark, sf, "embeddings").select("vec_id", (61 + F.col("vec_id") % 7).alias("n"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("e"))
    return rows.select("vec_id", "n", T.align_logprobs(F.col("e"), F.col("n")).alias("logprobs"))


@query("""SELECT question_id, rollout_index, CAST(longest AS INTEGER) AS n_padded, md5(array_to_string(list_concat(tokens, list_resize([]::VARCHAR[], longest - len(tokens), '<pad>')), ' ')) AS padded FROM
  (SELECT *, max(len(tokens)) OVER (PARTITION BY rollout_index // 8) AS longest FROM trajectories)""", TRAJECTORIES)
def pad_batch(spark, sf):
    """To the longest of a batch, of eight rollouts each."""
    rows = trajectories(spark, sf).withColumn("batch", F.floor(F.col("rollout_index") / 8))
    longest = rows.groupBy("batch").agg(F.max(F.size("tokens")).alias("n_padded"))
    return rows.join(longest, "batch").select("question_id", "rollout_index", "n_padded", F.md5(F.array_join(T.padded(F.col("tokens"), F.col("n_padded"), F.lit("<pad>")), " ")).alias("padded"))


@query("SELECT question_id, rollout_index, list_slice(tokens, greatest(1, len(tokens) - 4), len(tokens)) AS ids, CASE WHEN success THEN 'pos' ELSE 'neg' END AS example_kind, CASE WHEN success THEN NULL ELSE reward END AS negative_weight, list_resize([]::INTEGER[], least(5, len(tokens)), 0) AS mask FROM trajectories", TRAJECTORIES)
def example_defaults(spark, sf):
    """Ids keep their tail, masks are zeros, what a kind lacks is null."""
    return trajectories(spark, sf).select("question_id", "rollout_index", F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - 4), F.lit(5)).alias("ids"), F.when(F.col("success"), "pos").otherwise("neg").alias("example_kind"), F.when(~F.col("success"), F.col("reward")).alias("negative_weight"), F.array_repeat(F.lit(0), F.least(F.lit(5), F.size("tokens"))).alias("mask"))


_WEIGHTS = [("a", 0.40), ("b", 0.35), ("c", 0.15), ("d", 0.05), ("e", 0.05)]
_VALUES = ", ".join(f"('{k}', {w}::DOUBLE, {i})" for i, (k, w) in enumerate(_WEIGHTS))
_QUOTAS = f"""quotas AS (SELECT total, key, weight, nth, CAST(w + CASE WHEN row_number() OVER (PARTITION BY total ORDER BY round(raw - w, 9) DESC, weight DESC, key DESC) <= total - sum(w) OVER (PARTITION BY total) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM
  (SELECT *, floor(raw) AS w FROM (SELECT total, key, weight, nth, total * weight / sum(weight) OVER (PARTITION BY total) AS raw FROM totals, (VALUES {_VALUES}) t(key, weight, nth))))"""


@query("""SELECT total, key, CAST(w + CASE WHEN row_number() OVER (PARTITION BY total ORDER BY round(raw - w, 9) DESC, weight DESC, key DESC) <= total - sum(w) OVER (PARTITION BY total) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM
  (SELECT *, floor(raw) AS w FROM (SELECT total, key, weight, total * weight / sum(weight) OVER (PARTITION BY total) AS raw FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) * 7 AS total FROM lineitem), (SELECT p_type AS key, count(*)::DOUBLE AS weight FROM part GROUP BY 1)))""")
def apportion_counts(spark, sf):
    """Batches of the sizes that orders have, split by how many parts each type has."""
    totals = table(spark, sf, "lineitem").select((F.col("l_quantity").cast("bigint") * 7).alias("stage")).distinct()
    weights = table(spark, sf, "part").groupBy(F.col("p_type").alias("key")).agg(F.count("*").cast("double").alias("weight"))
    return S.apportioned(totals.crossJoin(weights), "stage", F.col("stage")).select(F.col("stage").alias("total"), "key", "quota")  # dozens of either


_BUCKETS = """buckets AS (SELECT row_id, key AS bucket FROM (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) - 1 AS position FROM answers) a JOIN (SELECT key, sum(quota) OVER (ORDER BY nth) - quota AS lo, sum(quota) OVER (ORDER BY nth) AS hi FROM quotas) q ON position >= lo AND position < hi)"""
_ALL = "totals AS (SELECT count(*) AS total FROM answers)"


@query("SELECT row_id, bucket FROM buckets", ANSWERS, _ALL, _QUOTAS, _BUCKETS)
def ranked_buckets(spark, sf):
    """C2."""
    return S.ranked_buckets(answers(spark, sf), "score", "row_id", _WEIGHTS).select("row_id", "bucket")


_GROUPS = {"light": ["PROMO", "ECONOMY "], "heavy": ["STANDARD", "LARGE"]}


@query("SELECT grp, count(*) AS n FROM (SELECT CASE WHEN trim(p_type) IN ('PROMO', 'ECONOMY') THEN 'light' WHEN trim(p_type) IN ('STANDARD', 'LARGE') THEN 'heavy' ELSE '<unmatched>' END AS grp FROM part) GROUP BY 1")
def group_by_value_lookup(spark, sf):
    """Unmatched values are counted."""
    return S.grouped_by_value(table(spark, sf, "part"), "p_type", _GROUPS).groupBy(F.coalesce("group", F.lit("<unmatched>")).alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, iteration, name FROM (SELECT o_orderkey, CAST(o_orderkey % 500 + 1 AS BIGINT) AS iteration FROM orders) i JOIN (VALUES ('one', 1, 100), ('two', 101, 350), ('three', 351, 500)) s(name, a, b) ON iteration BETWEEN a AND b")
def stage_range_join(spark, sf):
    """Orders as questions of an iteration."""
    stages = S.validated_stages([{"name": n, "start": a, "end": b, "weights": {"x:y": 1.0}} for n, a, b in (("one", 1, 100), ("two", 101, 350), ("three", 351, 500))], 500)
    dim = spark.createDataFrame([(s["name"], s["start"], s["end"]) for s in stages], "name string, start int, end int")
    asked = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 500 + 1).cast("bigint").alias("iteration"))
    return S.stage_of(asked, dim).select("o_orderkey", "iteration", "name")


@query("SELECT row_id, split_part(trim(k), ':', 1) AS source, substr(trim(k), instr(trim(k), ':') + 1) AS grp FROM (SELECT p_partkey AS row_id, concat(' ', lower(p_brand), ':', p_type, ':x ') AS k FROM part)")
def parse_group_key(spark, sf):
    """P9."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), S.parsed_group_key(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(":"), F.col("p_type"), F.lit(":x "))).alias("k"))
    return rows.select("row_id", "k.source", F.col("k.group").alias("grp"))


_MD5 = "md5(concat_ws('|', {seed}, {it}, {rep}, row_id))"


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {_MD5.format(seed=7, it=3, rep=0)}, row_id) AS rn FROM answers) WHERE rn <= 16", ANSWERS)
def sample_batch(spark, sf):
    """C4, C19."""
    return S.sampled(answers(spark, sf), 16, 7, 3).select("row_id")


@query(f"SELECT row_id FROM answers ORDER BY {_MD5.format(seed=11, it=0, rep=0)}, row_id LIMIT 50", ANSWERS)
def subsample(spark, sf):
    """C9."""
    return S.sampled(answers(spark, sf), 50, 11, 0).select("row_id")


@query("SELECT row_id, score FROM answers ORDER BY row_id LIMIT 25", ANSWERS)
def head_limit(spark, sf):
    """C10, F15."""
    return answers(spark, sf).orderBy("row_id").limit(25).select("row_id", "score")


@query("""SELECT CAST(floor(pos / 16) AS INTEGER) AS iteration, CAST(e AS INTEGER) AS epoch, row_id FROM (SELECT *, e * (SELECT count(*) FROM pool) + row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws('|', 5, e, row_id)), row_id) - 1 AS pos
  FROM pool, (SELECT unnest(range(20)) AS e)) WHERE pos < 16 * 200""", "pool AS (SELECT p_partkey AS row_id FROM part)")
def sample_epochs(spark, sf):
    """200 batches of 16."""
    return S.epoch_batches(table(spark, sf, "part").select(F.col("p_partkey").alias("row_id")), 16, 5, 200)


@query(f"SELECT bucket AS key, row_id, concat(bucket, ':', row_id) AS question_id FROM (SELECT b.*, row_number() OVER (PARTITION BY bucket ORDER BY {_MD5.format(seed=9, it=4, rep=0)}, row_id) AS rn, q.quota FROM buckets b JOIN (SELECT key, quota FROM quotas16) q ON q.key = b.bucket) WHERE rn <= quota", ANSWERS, _ALL, _QUOTAS, _BUCKETS, _QUOTAS.replace("quotas AS", "quotas16 AS").replace("FROM totals,", "FROM (SELECT 16 AS total),"))
def mixture_batch(spark, sf):
    """C6, C19."""
    pools = S.ranked_buckets(answers(spark, sf), "score", "row_id", _WEIGHTS).select(F.col("bucket").alias("key"), "row_id")
    weights = spark.createDataFrame([("s", k, w) for k, w in _WEIGHTS], "stage string, key string, weight double")
    return S.mixture(pools, S.apportioned(weights, "stage", F.lit(16)), 9, 4)


@query("""SELECT p_type AS key, quota FROM (SELECT p_type, CAST(w + CASE WHEN row_number() OVER (ORDER BY round(raw - w, 9) DESC, n DESC, p_type DESC) <= 16 - sum(w) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT *, floor(raw) AS w FROM (SELECT p_type, n, 16.0 * n / sum(n) OVER () AS raw FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1))))""")
def mixture_legacy(spark, sf):
    """Quotas in proportion to the pools' sizes."""
    sizes = table(spark, sf, "part").groupBy(F.col("p_type").alias("key")).agg(F.count("*").cast("double").alias("weight")).withColumn("stage", F.lit("s"))
    return S.apportioned(sizes, "stage", F.lit(16)).select("key", "quota")


_STAGE = """stage AS (SELECT 'ranked' AS source_dataset, a.row_id, bucket AS part, NULL AS grp FROM buckets b JOIN answers a ON a.row_id = b.row_id WHERE bucket = 'b' AND trim(completion) <> ''
  UNION ALL SELECT 'grouped', row_id, NULL, 'light' FROM answers WHERE p_type IN ('PROMO', 'ECONOMY') AND trim(completion) <> '')"""


def _stage(spark, sf):
    said = F.trim("completion") != ""
    ranked = S.ranked_buckets(answers(spark, sf), "score", "row_id", _WEIGHTS).where((F.col("bucket") == "b") & said)
    grouped = S.grouped_by_value(answers(spark, sf).where(said), "p_type", _GROUPS).where("group = 'light'")
    return S.built_stage([S.stage_records("ranked", ranked, part="bucket"), S.stage_records("grouped", grouped, group="group")], 42, 1)


@query("SELECT source_dataset, row_id, part, grp, md5(concat_ws('|', 42 + 1009, 0, 0, concat(source_dataset, ':', row_id))) AS shuffle_key FROM stage", ANSWERS, _ALL, _QUOTAS, _BUCKETS, _STAGE)
def build_stage(spark, sf):
    """The seed moves by 1009 a stage."""
    return _stage(spark, sf)


@query("SELECT source_dataset, count(*) AS n FROM stage GROUP BY 1", ANSWERS, _ALL, _QUOTAS, _BUCKETS, _STAGE)
def stage_source_counts(spark, sf):
    """A2."""
    return S.source_counts(_stage(spark, sf))


@query("SELECT row_id % 4 AS rank, (row_id - row_id % 4) / 4 * 4 + row_id % 4 AS global_index, row_id FROM (SELECT p_partkey AS row_id FROM part)")
def strided_shards(spark, sf):
    """Shard [rank::world] and the index it came from."""
    r = F.col("p_partkey")
    return table(spark, sf, "part").select((r % 4).alias("rank"), (F.floor(r / 4) * 4 + r % 4).cast("double").alias("global_index"), r.alias("row_id"))


@query("SELECT CAST(floor((rn - 1) / 4) AS BIGINT) AS batch, count(*) AS n, min(row_id) AS first_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn FROM answers WHERE trim(completion) <> '') GROUP BY 1", ANSWERS)
def chunk_batches(spark, sf):
    """C14."""
    rows = S.chunked(answers(spark, sf).where(F.trim("completion") != "").select("row_id"), 4, F.col("row_id"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"))


@query("""SELECT CAST(row_number() OVER (ORDER BY s, id) - 1 AS BIGINT) AS global_index, s AS source, id, CAST(row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS BIGINT) AS local_index FROM (SELECT 0 AS s, s_suppkey AS id FROM supplier UNION ALL SELECT 1, c_custkey FROM customer)""")
def mixed_union_index(spark, sf):
    """Concatenation with offsets."""
    parts = [table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))]
    return S.concatenated(parts, "id").select("global_index", "source", "id", "local_index")


@query("SELECT batch, bool_and(e IS NOT NULL AND r IS NOT NULL) AS complete FROM (SELECT coalesce(e.batch, r.batch) AS batch, e.i AS e, r.i AS r FROM (SELECT doc_id // 4 AS batch, doc_id AS i FROM documents) e FULL JOIN (SELECT doc_id // 4 AS batch, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS i FROM documents) r ON e.batch = r.batch AND e.i = r.i) GROUP BY 1")
def batch_integrity(spark, sf):
    """Whether exactly the expected indices came back."""
    docs = table(spark, sf, "documents").select((F.floor(F.col("doc_id") / 4)).alias("batch"), "doc_id")
    sets = docs.groupBy("batch").agg(F.array_sort(F.collect_set("doc_id")).alias("e"), F.array_sort(F.collect_set(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")))).alias("r"))
    return sets.select("batch", (F.col("e") == F.col("r")).alias("complete"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_ids_anti(spark, sf):
    """F6."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS pool_index FROM answers WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD', 'LARGE')", ANSWERS)
def pool_index(spark, sf):
    """Rows without a group go, the others are indexed anew."""
    rows = S.grouped_by_value(answers(spark, sf), "p_type", _GROUPS).where("group IS NOT NULL").select("row_id")
    return placed(rows, F.col("row_id"), name="pool_index")
