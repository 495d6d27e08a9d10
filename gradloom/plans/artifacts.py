"""Queries of artifacts, registries and joins of model outputs (S10-S12, J1, J9, K7, K8, A28, X5, U24, F2, F6, T10, P28) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..operators import artifacts as R
from ..operators import compressed_trie as C
from ..operators import preparation as P
from ..operators import sampling as S
from ..sources.relations import ANSWERS, ROLLOUTS, RUNS, answers, rollouts, runs, table, trajectories
from .answers import _SAID
from .registry import query
from .training import _FRONTIER, _TRIE, _trie

_FILES = """files AS (SELECT CASE s % 4 WHEN 0 THEN concat('/x/', checkpoint, '/model.safetensors') WHEN 1 THEN concat('/x/', e, '/checkpoints/iter_', s, '_actor/model-00001-of-00002.safetensors') WHEN 2 THEN concat('/x/', checkpoint, '/config.json')
  ELSE concat('/x/', e, '/checkpoints/anchor_ema/pytorch_model.bin') END AS path, e, s FROM (SELECT checkpoint, split_part(checkpoint, '/', 1) AS e, CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS BIGINT) AS s FROM runs))"""


@query("""SELECT DISTINCT concat('/x/', e) AS experiment, regexp_replace(path, '/[^/]*$', '') AS path, CASE s % 4 WHEN 0 THEN concat('checkpoint-', s) WHEN 1 THEN concat('iter_', s, '_actor') ELSE 'anchor_ema' END AS name,
  CASE s % 4 WHEN 0 THEN 'trainer_checkpoint' WHEN 1 THEN 'iter_actor' ELSE 'anchor_ema' END AS type, CASE WHEN s % 4 < 2 THEN s END AS step FROM files WHERE s % 4 <> 2""", RUNS, _FILES)
def discover_checkpoints(spark, sf):
    """Folders with weights, their types and steps."""
    e, s = F.split_part("checkpoint", F.lit("/"), F.lit(1)), F.regexp_extract("checkpoint", "([0-9]+)$", 1)
    below = lambda *parts: F.concat(F.lit("/x/"), *parts)
    k = s.cast("int") % 4
    path = F.when(k == 0, below("checkpoint", F.lit("/model.safetensors"))).when(k == 1, below(e, F.lit("/checkpoints/iter_"), s, F.lit("_actor/model-00001-of-00002.safetensors"))).when(k == 2, below("checkpoint", F.lit("/config.json"))).otherwise(below(e, F.lit("/checkpoints/anchor_ema/pytorch_model.bin")))
    return R.checkpoints(runs(spark, sf).select(path.alias("path")))


_PRESENT = """named AS (SELECT checkpoint, dataset_key, run_index, concat(checkpoint, '/', dataset_key, '/best_per_example_scores.jsonl') AS copy, concat(checkpoint, '/', dataset_key, '/run-', run_index, '.jsonl') AS own, concat('eval/', dataset_key, '/', run_index, '.jsonl') AS other, event_id FROM runs),
present AS (SELECT copy AS path FROM named WHERE event_id % 11 = 0 UNION SELECT own FROM named WHERE event_id % 3 = 0 UNION SELECT other FROM named WHERE event_id % 5 = 0)"""


@query("""SELECT n.checkpoint, n.dataset_key, n.run_index, coalesce(a.path, b.path, c.path) AS found FROM named n LEFT JOIN present a ON a.path = n.copy LEFT JOIN present b ON b.path = n.own LEFT JOIN present c ON c.path = n.other""", RUNS, _PRESENT)
def path_fallback(spark, sf):
    """The first candidate path that is there."""
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c, d, i = F.col("checkpoint"), F.col("dataset_key"), F.col("run_index").cast("string")
    named = runs(spark, sf).select("checkpoint", "dataset_key", "run_index", "event_id", join(c, "/", d, "/best_per_example_scores.jsonl").alias("copy"), join(c, "/", d, "/run-", i, ".jsonl").alias("own"), join("eval/", d, "/", i, ".jsonl").alias("other"))
    there = [named.where(F.col("event_id") % n == 0).select(F.col(name).alias("path")) for name, n in (("copy", 11), ("own", 3), ("other", 5))]
    rows = named.select("checkpoint", "dataset_key", "run_index", F.array("copy", F.lit(None), F.lit(" "), "own", "other").alias("candidates"))
    return R.first_existing(rows, "candidates", there[0].unionByName(there[1]).unionByName(there[2])).drop("candidates")


@query("""SELECT checkpoint, dataset_key, kind, run_index, n_examples, concat('eval_step_', lpad(CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS VARCHAR), 6, '0'), '_', kind, '_per_example_scores.jsonl') AS name FROM (
  SELECT r.*, q.kind FROM (SELECT checkpoint, dataset_key, run_index, CAST(floor(eval_seconds) AS BIGINT) AS n_examples, row_number() OVER (PARTITION BY checkpoint, dataset_key ORDER BY accuracy DESC, run_index) AS b, row_number() OVER (PARTITION BY checkpoint, dataset_key ORDER BY accuracy, run_index) AS w FROM runs) r,
  (VALUES ('best'), ('worst')) q(kind) WHERE (kind = 'best' AND b = 1) OR (kind = 'worst' AND w = 1))""", RUNS)
def best_worst_artifacts(spark, sf):
    """K7, K8: what is copied of the best and the worst run of a step, and under which name."""
    rows = runs(spark, sf)
    examples = rows.select("checkpoint", "dataset_key", "run_index", F.floor("eval_seconds").alias("n_examples"))
    found = R.extrema_examples(examples, rows, "checkpoint", "dataset_key")
    return found.withColumn("name", R.artifact_name(F.regexp_extract("checkpoint", "([0-9]+)$", 1), F.col("kind"), R.FILES[1]))


@query("""SELECT DISTINCT CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS BIGINT) AS step, concat('eval_step_', lpad(CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS VARCHAR), 6, '0')) AS step_dir_name, checkpoint, split_part(checkpoint, '/', 2) AS checkpoint_name,
  'missing_source_per_example_scores' AS reason FROM runs WHERE checkpoint NOT IN (SELECT checkpoint FROM runs WHERE accuracy > 0.97)""", RUNS)
def skipped_steps(spark, sf):
    """Steps without scores."""
    rows = runs(spark, sf)
    steps = rows.select("checkpoint", F.regexp_extract("checkpoint", "([0-9]+)$", 1).cast("bigint").alias("step")).distinct()
    return R.skipped_steps(steps, rows.where("accuracy > 0.97"))


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS place FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 8) OR n_regionkey = 1 ORDER BY place")
def registry_selection(spark, sf):
    """Chosen entries in the registry's order."""
    nation = table(spark, sf, "nation")
    registry = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("place"))
    asked = table(spark, sf, "supplier").where("s_suppkey < 8").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return R.selected(registry, asked, nation.where("n_regionkey = 1").select(F.col("n_name").alias("name"))).orderBy("place")


@query("""SELECT o_orderkey AS prompt_id, CAST(count(question_id) AS BIGINT) AS n_choices, CAST(count(*) FILTER (finish_reason = 'stop') AS BIGINT) AS n_stopped, min_by(response_text, rollout_index) AS first_text FROM orders LEFT JOIN (SELECT * FROM rollouts WHERE n_tokens > 12) r ON question_id = o_orderkey GROUP BY 1""", ROLLOUTS)
def join_generations(spark, sf):
    """Prompts and their generations by id."""
    made = rollouts(spark, sf).where("n_tokens > 12").select(F.col("question_id").alias("prompt_id"), F.col("rollout_index").alias("choice_idx"), F.col("response_text").alias("text"), "finish_reason")
    rows = R.with_generations(table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id")), made)
    stopped = F.size(F.filter("choices", lambda c: c["finish_reason"] == "stop"))
    return rows.select("prompt_id", F.size("choices").cast("bigint").alias("n_choices"), stopped.cast("bigint").alias("n_stopped"), F.try_element_at("choices", F.lit(1))["text"].alias("first_text"))


@query("SELECT position * 3 + j AS position, gold AS answer FROM (SELECT gold, row_number() OVER (ORDER BY row_id) - 1 AS position FROM answers), (VALUES (0), (1), (2)) t(j)", ANSWERS)
def broadcast_answers(spark, sf):
    """Three completions to an answer."""
    golds = S.placed(answers(spark, sf), F.col("row_id").asc()).select("position", F.col("gold").alias("answer"))
    completions = golds.select(F.explode(F.sequence(F.col("position") * 3, F.col("position") * 3 + 2)).alias("position"))
    return R.with_answers(completions, golds)


@query("SELECT row_id, p_type FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM answers) WHERE position NOT IN (0, 3, 7, 150)", ANSWERS)
def exclude_positions(spark, sf):
    """rows left out by position; one beyond the table would be an error."""
    return R.without_rows(S.placed(answers(spark, sf), F.col("row_id").asc()), [0, 3, 7, 150, 3]).select("row_id", "p_type")


@query("""SELECT row_id, CASE form WHEN 3 THEN s WHEN 6 THEN concat('$', s, ',000') WHEN 10 THEN '' WHEN 11 THEN concat('No marker ', s) ELSE answer END AS answer, CASE WHEN form = 10 THEN 'empty_answer' WHEN form IN (5, 7, 8, 11) THEN 'answer_equals_solution' ELSE 'kept' END AS reason FROM said""", ANSWERS, _SAID)
def competition_reasons(spark, sf):
    """Answers taken from solutions, and why they are dropped."""
    rows = answers(spark, sf).select("row_id", X.strip(F.col("completion")).alias("solution"))
    rows = rows.withColumn("answer", P.sanitized(A.gold_answer(F.col("solution"))))
    return rows.select("row_id", "answer", F.coalesce(P.competition_reason(F.col("answer"), F.col("solution")), F.lit("kept")).alias("reason"))


@query("SELECT conv_id, turn, concat('Turn ', turn, ' {of} ', conv_id, chr(10), 'Text: ', coalesce(text, 'None'), chr(10), 'Verdict:') AS prompt FROM conversations")
def judge_prompts(spark, sf):
    """One prompt a case."""
    prompt = X.render("Turn {turn} {{of}} {conv_id}\nText: {text}\nVerdict:", {c: F.col(c) for c in ("turn", "conv_id", "text")})
    return table(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query("""SELECT q AS num_questions, n AS num_rollouts_total, b AS num_bad_edges, round(b / greatest(q, 1), 6) AS avg_bad_edges_per_question, e AS empty_response_count, n - e - k AS duplicate_rollout_count FROM
  (SELECT count(DISTINCT question_id) AS q, count(*) AS n, CAST(coalesce(sum((len(tokens) = 0)::INT), 0) AS BIGINT) AS e FROM trajectories), (SELECT count(*) AS k FROM deduped), (SELECT count(*) AS b FROM frontier)""", *_TRIE, _FRONTIER)
def bad_edge_averages(spark, sf):
    """The report's counts and averages."""
    trie = _trie(spark, sf)
    rows = R.bad_edge_report(trajectories(spark, sf), trie.sequences, C.failure_frontier(trie, 1, 1))
    return rows.withColumn("avg_bad_edges_per_question", F.round("avg_bad_edges_per_question", 6))
