"""Queries of preparation, text functions and judging (P, F, J, A13-A28 rows) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import judging as J
from ..operators import preparation as P
from ..sources.relations import ANSWERS, ROLLOUTS, RUNS, answers, rollouts, runs, table
from ..sources.storage import scratch
from .registry import query

_RAW = r"""raw AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE concat(' ', p_name, ' ') END AS problem, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'proof' ELSE concat('$ ', p_size, '$') END AS answer,
  CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 5 = 1 THEN NULL WHEN p_partkey % 5 = 2 THEN 'olympiads' ELSE p_type END AS source, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS domain,
  CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(p_size / 50.0 AS VARCHAR) END AS solve_rate, CASE WHEN p_partkey % 6 = 0 THEN 'MCQ' ELSE 'math-word-problem' END AS question_type FROM part)"""


def _raw(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("row_id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("problem"), F.when(k % 7 == 0, None).when(k % 13 == 0, "proof").otherwise(F.concat(F.lit("$ "), size.cast("string"), F.lit("$"))).alias("answer"),
        F.when(k % 5 == 0, " ").when(k % 5 == 1, None).when(k % 5 == 2, "olympiads").otherwise(F.col("p_type")).alias("source"), F.when(k % 3 == 0, None).otherwise(F.col("p_brand")).alias("domain"),
        F.when(k % 4 == 0, "n/a").otherwise((size / 50.0).cast("string")).alias("solve_rate"), F.when(k % 6 == 0, "MCQ").otherwise("math-word-problem").alias("question_type"),
    )


@query("SELECT row_id, trim(coalesce(problem, '')) AS problem, trim(coalesce(answer, '')) AS answer, coalesce(nullif(trim(source), ''), 'big_math') AS source, CASE WHEN domain IS NULL THEN [] ELSE [domain] END AS domain, coalesce(TRY_CAST(solve_rate AS DOUBLE), -1.0) AS solve_rate FROM raw", _RAW)
def prep_normalize(spark, sf):
    """P1."""
    return P.normalized_problem(_raw(spark, sf))


@query(r"SELECT row_id, CASE WHEN answer IS NULL THEN '' WHEN answer = 'proof' THEN answer ELSE regexp_extract(answer, '([0-9]+)', 1) END AS answer FROM raw", _RAW)
def prep_sanitize_answer(spark, sf):
    """P2."""
    return _raw(spark, sf).select("row_id", P.sanitized(F.coalesce("answer", F.lit(""))).alias("answer"))


_REASON = "CASE WHEN trim(problem) = '' THEN 'empty_problem' WHEN trim(coalesce(answer, '')) = '' THEN 'empty_answer' WHEN question_type <> 'math-word-problem' THEN 'question_type_mismatch' WHEN answer = 'proof' THEN 'answer_proof' WHEN coalesce(trim(source), '') <> 'olympiads' THEN 'source_not_allowed' ELSE 'kept' END"


def _reasons(spark, sf):
    raw = _raw(spark, sf)
    clean = raw.withColumns({c: X.or_empty(F.col(c)) for c in ("problem", "answer", "source", "question_type")})
    return P.with_drop_reason(clean, P.contest_reason(F.col("answer"), F.col("question_type"), F.col("source")))


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM raw GROUP BY 1", _RAW)
def prep_drop_reasons(spark, sf):
    """F1, F4, A1, P3."""
    return P.drop_counts(_reasons(spark, sf))


@query(f"SELECT row_id, trim(problem) AS problem, n_tokens FROM (SELECT *, CAST(len(list_filter(string_split(trim(problem), ' '), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM raw WHERE {_REASON} = 'kept') WHERE n_tokens <= 2", _RAW)
def prep_pipeline(spark, sf):
    """normalise, validate, measure, filter."""
    kept = _reasons(spark, sf).where("drop_reason IS NULL").withColumn("n_tokens", X.token_count(F.col("problem")))
    return kept.where("n_tokens <= 2").select("row_id", "problem", "n_tokens")


@query(r"""SELECT row_id, length(t) > 80 AND NOT contains(t, '\begin{pmatrix}') AND len(regexp_extract_all(regexp_replace(t, '\\[A-Za-z]+', ' ', 'g'), '[A-Za-z]{2,}')) >= 8 AS verbose FROM (SELECT doc_id AS row_id, concat(CASE WHEN doc_id % 3 = 0 THEN '\begin{pmatrix} ' ELSE '\frac ' END, text) AS t FROM documents)""")
def verbose_filter(spark, sf):
    """F3."""
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "\\begin{pmatrix} ").otherwise("\\frac "), F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), t.alias("t")).select("row_id", P.is_verbose(F.col("t")).alias("verbose"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens FROM documents".replace("\\\\", "\\"))
def token_lengths(spark, sf):
    """P14."""
    return table(spark, sf, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT CAST(sum((n <= 300)::INT) AS BIGINT) AS kept, CAST(sum((n > 300)::INT) AS BIGINT) AS removed, max(n) AS max_seen, max(n) FILTER (n <= 300) AS max_kept, min(n) AS min_seen FROM (SELECT CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n FROM documents)".replace("\\\\", "\\"))
def length_filter_summary(spark, sf):
    """F5."""
    return P.length_summary(table(spark, sf, "documents").select(X.token_count(F.col("text")).alias("n")), "n", 300)


@query("SELECT doc_id, concat('Q: ', source, ' {', lang, '} {missing} ', doc_id) AS prompt FROM documents")
def render_prompt(spark, sf):
    """P4, P29, S16."""
    own = {"problem": F.col("source"), "lang": F.col("lang"), "id": F.col("doc_id")}
    return table(spark, sf, "documents").select("doc_id", X.render("Q: {problem} {{{lang}}} {missing} {id}", own).alias("prompt"))


@query("SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE concat(substr(t, 1, 400), '...<truncated>') END AS preview FROM (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents)")
def text_preview(spark, sf):
    """P5, F15."""
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT row_id, concat('Solve: ', row_id, chr(10), completion, CASE WHEN contains(lower(completion), lower(concat('final answer: ', gold))) THEN '' ELSE concat(chr(10), chr(10), 'Final Answer: ', gold) END) AS example FROM answers", ANSWERS)
def sft_format(spark, sf):
    """P6, S14."""
    prompt = F.concat(F.lit("Solve: "), F.col("row_id").cast("string"), F.lit("\n"))
    return answers(spark, sf).select("row_id", P.sft_example(prompt, F.col("completion"), F.col("gold")).alias("example"))


@query("""SELECT row_id, list_concat(head, resp) AS ids, list_concat(list_transform(head, lambda x: CAST(-100 AS BIGINT)), resp) AS labels FROM (SELECT row_id, resp, CASE WHEN len(prompt) > 10 - len(resp) THEN list_slice(prompt, len(prompt) - (10 - len(resp)) + 1, len(prompt)) ELSE prompt END AS head FROM
  (SELECT p_partkey AS row_id, range(100, 100 + p_size % 12) AS prompt, list_concat(range(200, 201 + p_size % 5), [CAST(7 AS BIGINT)]) AS resp FROM part))""")
def sft_truncate_pair(spark, sf):
    """P7."""
    n, m = F.col("p_size") % 12, F.col("p_size") % 5
    ids = lambda lo, count: F.transform(F.filter(F.sequence(F.lit(0), F.lit(12)), lambda i: i < count), lambda i: (i + lo).cast("bigint"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), P.truncated_pair(ids(100, n), ids(200, m + 1), 10, 7).alias("p")).select("row_id", "p.ids", "p.labels")


@query("SELECT p_partkey AS row_id, CASE WHEN trim(k, '_') = '' THEN 'eval' ELSE trim(k, '_') END AS key FROM (SELECT p_partkey, lower(regexp_replace(CASE WHEN p_partkey % 9 = 0 THEN '--' ELSE concat('/', p_name, ' ', p_brand, '//') END, '[^A-Za-z0-9]+', '_', 'g')) AS k FROM part)")
def dataset_key_slug(spark, sf):
    """P10, F8."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), X.slug(F.when(F.col("p_partkey") % 9 == 0, "--").otherwise(F.concat(F.lit("/"), "p_name", F.lit(" "), "p_brand", F.lit("//")))).alias("key"))


@query("SELECT p_partkey AS row_id, p_brand AS base, CAST(p_size AS VARCHAR) AS parent FROM part")
def path_parts(spark, sf):
    """P11, J9."""
    path = F.concat(F.lit("C:\\runs/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "\\").otherwise("/"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "//").otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), X.base_name(path).alias("base"), X.parent_name(path).alias("parent"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n, first(role ORDER BY turn) FILTER (role <> 'system') AS finish_reason FROM conversations GROUP BY 1")
def flatten_conversations(spark, sf):
    """P12, P13."""
    rows = table(spark, sf, "conversations").withColumn("reason", F.when(F.col("role") != "system", F.col("role")))
    return P.flattened(rows, "conv_id", "turn", "text", "reason")


@query("SELECT row_id, p_type AS prompt, gold AS answer FROM (SELECT * FROM answers ORDER BY row_id LIMIT 30)", ANSWERS)
def train_projection(spark, sf):
    """P25: two columns after a head limit."""
    return answers(spark, sf).orderBy("row_id").limit(30).select("row_id", F.col("p_type").alias("prompt"), F.col("gold").alias("answer"))


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''), nullif(trim(CASE WHEN event_id % 2 = 0 THEN props END), ''), 'prompt') AS question FROM events")
def question_text(spark, sf):
    """P29."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.coalesce(X.blank_to_null(F.when(e % 3 == 0, " ").otherwise(F.col("event_type"))), X.blank_to_null(F.when(e % 2 == 0, F.col("props"))), F.lit("prompt")).alias("question"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS verdict FROM events")
def parse_verdict(spark, sf):
    """P18."""
    said = F.element_at(F.array(*map(F.lit, ("No, wait. **YES**", "yes or NO.", "I know nothing", "`Yes`"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", X.verdict(said).alias("verdict"))


@query(r"""SELECT row_id, lower(regexp_replace(regexp_replace(regexp_replace(k, '\$+|\\[()\[\]]|\\[,!;]|\\left|\\right', '', 'g'), '\s+', '', 'g'), '[.,;:!?]+$', '')) AS key FROM (SELECT row_id, regexp_replace(regexp_replace(completion, '\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}', '\1', 'g'), '\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}', '\1', 'g') AS k FROM answers)""", ANSWERS)
def cache_key(spark, sf):
    """P19."""
    return answers(spark, sf).select("row_id", X.cache_key(F.col("completion")).alias("key"))


@query("SELECT conv_id, turn, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fingerprint FROM conversations".replace("\\\\", "\\"))
def response_fingerprint(spark, sf):
    """P20."""
    return table(spark, sf, "conversations").select("conv_id", "turn", X.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT checkpoint, dataset_key, run_index, 42 + CAST(concat('0x', substr(sha256(concat(checkpoint, '::', dataset_key, '::', run_index)), 1, 12)) AS BIGINT) % 1000000000 AS seed FROM runs", RUNS)
def stable_run_seed(spark, sf):
    """P21."""
    return runs(spark, sf).select("checkpoint", "dataset_key", "run_index", X.run_seed(F.lit(42), F.col("checkpoint"), F.col("dataset_key"), F.col("run_index")).alias("seed"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN replace(props, ' ', '') END AS object FROM events")
def extract_json_object(spark, sf):
    """P17."""
    props = F.col("props")
    said = F.element_at(F.array(props, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```")), F.concat(F.lit("It is "), props, F.lit(" I think")), F.lit("none")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.to_json(X.json_object(said)).alias("object"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_correct, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS VARCHAR) END AS final_answer, CASE WHEN event_id % 3 < 2 THEN '' END AS reason FROM events")
def judge_parse(spark, sf):
    """A string for a boolean is no verdict."""
    flag = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "false").otherwise('"false"')
    said = F.concat(F.lit('```json\n{"is_correct": '), flag, F.lit(', "final_answer": "'), F.col("event_id").cast("string"), F.lit('", "reason": null}\n```'))
    return table(spark, sf, "events").select("event_id", J.judge_response(said).alias("j")).select("event_id", "j.*")


_WORK = """work AS (SELECT d.doc_id AS index, d.source, coalesce(d.doc_id % 3 = 0, false) AS correct FROM documents d),
results AS (SELECT doc_id AS index, CASE WHEN quality = 1 THEN 'ok' ELSE 'error' END AS status, toxic = 0 AS is_correct FROM labels)"""


def _work(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("index"), "source", (F.col("doc_id") % 3 == 0).alias("correct"))


def _results(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("index"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"), (F.col("toxic") == 0).alias("is_correct"))


@query("SELECT index FROM work w WHERE NOT correct AND NOT EXISTS (SELECT 1 FROM results r WHERE r.index = w.index AND status = 'ok')", _WORK)
def pending_judge_work(spark, sf):
    """F9."""
    return J.pending(_work(spark, sf), _results(spark, sf)).select("index")


_RECOVERED = """SELECT {by}, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS original_correct, CAST(sum((NOT correct AND coalesce(status = 'ok', false))::INT) AS BIGINT) AS rejudged_ok, CAST(sum((NOT correct AND coalesce(status <> 'ok', false))::INT) AS BIGINT) AS rejudged_errors,
  CAST(sum((NOT correct AND coalesce(status = 'ok' AND is_correct, false))::INT) AS BIGINT) AS recovered, CAST(sum((NOT correct AND NOT coalesce(status = 'ok', false))::INT) AS BIGINT) AS unresolved, round(avg(correct::INT), 6) AS original_acc,
  round(avg((correct OR coalesce(status = 'ok' AND is_correct, false))::INT), 6) AS accurate_acc FROM work w LEFT JOIN results r ON r.index = w.index GROUP BY 1"""


@query(_RECOVERED.format(by="source"), _WORK)
def rejudge_recovery(spark, sf):
    """A13, J6, X4."""
    rows = J.recovery(_work(spark, sf), _results(spark, sf), ["source"])
    return rows.withColumn("original_acc", F.round("original_acc", 6)).withColumn("accurate_acc", F.round("accurate_acc", 6))


@query(_RECOVERED.format(by="CAST(w.index // 100 AS BIGINT) AS step"), _WORK)
def step_recovery(spark, sf):
    """By step."""
    rows = J.recovery(_work(spark, sf).withColumn("step", F.floor(F.col("index") / 100)), _results(spark, sf), ["step"])
    return rows.withColumn("original_acc", F.round("original_acc", 6)).withColumn("accurate_acc", F.round("accurate_acc", 6))


@query("SELECT w.index, coalesce(r.status, 'none') AS status, coalesce(r.is_correct, false) AS is_correct FROM work w LEFT JOIN results r ON r.index = w.index", _WORK)
def judge_left_join(spark, sf):
    """J6."""
    return _work(spark, sf).join(_results(spark, sf), "index", "left").select("index", F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN reward > 0 THEN 'not_judged' WHEN trim(response_text) = '' THEN 'empty' ELSE 'judge' END AS state FROM rollouts) GROUP BY 1", ROLLOUTS)
def rejudge_candidates(spark, sf):
    """F10."""
    rows = J.candidates(rollouts(spark, sf).withColumn("gold", F.lit("1")), "gold")
    return rows.groupBy("state").agg(F.count("*").alias("n"))


_CACHE = """keyed AS (SELECT *, CASE WHEN reward > 0 THEN 'not_judged' WHEN trim(response_text) = '' THEN 'empty' ELSE 'judge' END AS state, concat(question_id % 50, '||', n_tokens) AS cache_key FROM rollouts),
cache AS (SELECT cache_key, bool_or(correct) AS verdict FROM keyed WHERE n_tokens % 3 = 0 GROUP BY 1), verdicts AS (SELECT cache_key, bool_or(rescued) AS verdict FROM keyed WHERE n_tokens % 5 <> 0 GROUP BY 1)"""


def _cached(spark, sf):
    rows = J.candidates(rollouts(spark, sf).withColumn("gold", F.lit("1")), "gold").withColumn("cache_key", F.concat_ws("||", (F.col("question_id") % 50).cast("string"), F.col("n_tokens").cast("string")))
    cache = rows.where("n_tokens % 3 = 0").groupBy("cache_key").agg(F.bool_or("correct").alias("verdict"))
    return rows, cache, rows.where("n_tokens % 5 <> 0").groupBy("cache_key").agg(F.bool_or("rescued").alias("verdict"))


@query("SELECT k.question_id, k.rollout_index, c.verdict, c.cache_key IS NOT NULL AS hit FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key WHERE state = 'judge'", ROLLOUTS, _CACHE)
def cache_lookup_join(spark, sf):
    """J7."""
    rows, cache, _ = _cached(spark, sf)
    return rows.where("state = 'judge'").join(cache.withColumn("hit", F.lit(True)), "cache_key", "left").select("question_id", "rollout_index", "verdict", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("""SELECT count(DISTINCT k.cache_key) FILTER (c.cache_key IS NULL) AS called, CAST(sum((c.cache_key IS NOT NULL)::INT) AS BIGINT) AS cache_hits, CAST(sum(coalesce(c.verdict, v.verdict, false)::INT) AS BIGINT) AS flipped, count(DISTINCT k.cache_key) FILTER (c.cache_key IS NULL AND v.cache_key IS NULL) AS api_failures,
  (SELECT count(*) FROM keyed WHERE state = 'empty') AS short_circuit_empty, (SELECT count(*) FROM keyed WHERE state <> 'not_judged') AS total_zero_reward FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key LEFT JOIN verdicts v ON v.cache_key = k.cache_key WHERE state = 'judge'""", ROLLOUTS, _CACHE)
def rejudge_metrics(spark, sf):
    """A17."""
    return J.rejudge_metrics(*_cached(spark, sf))


@query("SELECT cache_key, arg_max(verdict, seq) AS verdict FROM (SELECT concat(user_id, '|', event_type) AS cache_key, event_id % 3 = 0 AS verdict, event_id AS seq FROM events) GROUP BY 1")
def verdict_cache_latest(spark, sf):
    """A33, D12."""
    rows = table(spark, sf, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("cache_key"), (F.col("event_id") % 3 == 0).alias("verdict"), F.col("event_id").alias("seq"))
    return J.latest(rows, "cache_key", "seq").select("cache_key", "verdict")


@query("SELECT user_id AS index, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def latest_judge_result(spark, sf):
    """A25."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("index"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return J.latest(rows, "index", "seq")


@query("""SELECT p_partkey AS index, CASE WHEN p_partkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status, p_name AS answer_raw, p_type AS response, p_partkey % 3 = 0 AS is_correct, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS reason, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS attempts FROM part""")
def upgrade_judge_records(spark, sf):
    """Nested records where the key is even, flat ones where it is odd."""
    k, even = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    reason = F.when(k % 4 != 0, F.col("p_brand"))
    records = table(spark, sf, "part").select(
        k.alias("index"), F.when(k % 5 != 0, "ok").alias("status"), F.when(even, F.struct(F.col("p_name").alias("answer_raw"))).alias("gold"), F.when(even, F.struct(F.col("p_type").alias("response"))).alias("candidate"),
        F.when(even, F.struct((k % 3 == 0).alias("is_correct"), reason.alias("reason"), F.col("p_size").alias("attempts"))).alias("judge"), F.when(~even, F.col("p_name")).alias("gold_answer_raw"), F.when(~even, F.col("p_type")).alias("candidate_response"),
        F.when(~even, k % 3 == 0).alias("judge_is_correct"), F.when(~even, reason).alias("judge_reason"), F.lit(None).cast("int").alias("attempts"),
    )
    return J.upgraded(records)


@query("SELECT index, status, is_correct, concat('judged ', status) AS reason FROM results", _WORK)
def judge_result_struct(spark, sf):
    """P33."""
    rows = _results(spark, sf).select("index", "status", F.struct("is_correct", F.concat(F.lit("judged "), "status").alias("reason")).alias("judge"))
    return rows.select("index", "status", "judge.is_correct", "judge.reason")


@query("SELECT CAST(conv_id // 4 AS BIGINT) AS chunk, string_agg(concat('Case ', conv_id, '.', turn, ': ', text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY conv_id, turn) AS prompt, count(*) AS n FROM conversations GROUP BY 1")
def judge_prompt_batches(spark, sf):
    """P28, C14."""
    rows = table(spark, sf, "conversations").withColumn("o", F.struct("conv_id", "turn"))
    text = F.concat(F.lit("Case "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(": "), "text")
    return J.prompt_batches(rows, F.floor(F.col("conv_id") / 4), "o", text)


@query("SELECT checkpoint FROM (SELECT DISTINCT checkpoint FROM runs) WHERE (contains(checkpoint, 'exp1') OR contains(checkpoint, 'exp2')) AND NOT contains(checkpoint, '-3')", RUNS)
def token_path_filter(spark, sf):
    """F7, F8."""
    return runs(spark, sf).select("checkpoint").distinct().where(J.token_filter(F.col("checkpoint"), ["EXP1", "exp2"], ["-3"]))


@query(f"""SELECT what, n FROM (SELECT count(*) AS input, coalesce(sum((r = 'kept' AND n <= 2)::INT), 0) AS kept, coalesce(sum((r = 'empty_problem')::INT), 0) AS empty_problem, coalesce(sum((r = 'empty_answer')::INT), 0) AS empty_answer,
  coalesce(sum((r NOT IN ('kept', 'empty_problem', 'empty_answer'))::INT), 0) AS other, coalesce(sum((r = 'kept' AND n > 2)::INT), 0) AS too_long, coalesce(max(n) FILTER (r = 'kept'), 0) AS max_seen, coalesce(max(n) FILTER (r = 'kept' AND n <= 2), 0) AS max_kept
  FROM (SELECT {_REASON} AS r, CAST(len(list_filter(string_split(trim(problem), ' '), lambda w: w <> '')) AS BIGINT) AS n FROM raw)) UNPIVOT (n FOR what IN (input, kept, empty_problem, empty_answer, other, too_long, max_seen, max_kept))""", _RAW)
def prep_accounting(spark, sf):
    """The counts of a preparation, from the pass that writes what is kept."""
    rows = _reasons(spark, sf).withColumn("n_tokens", X.token_count(F.col("problem")))
    kept, counts = P.prepared(rows, scratch(spark, "prepared"), ("empty_problem", "empty_answer"), "n_tokens", 2)
    there = kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n")  # the table says itself how many there are
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items() if k != "kept"], "what string, n long").unionByName(there)
