"""Queries of the evaluation statistics (A3-A31, C11-C17) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.relations import ROLLOUTS, RUNS, rollouts, runs, table
from .registry import query


@query("""SELECT count(*) AS n, CAST(sum((reward > 0.5)::INT) AS BIGINT) AS n_rule, CAST(sum((NOT reward > 0.5 AND rescued)::INT) AS BIGINT) AS n_rescued,
  round(avg((reward > 0.5)::INT::DOUBLE), 6) AS rule_accuracy, round(avg((reward > 0.5 OR rescued)::INT::DOUBLE), 6) AS accuracy FROM rollouts WHERE rollout_index = 1""", ROLLOUTS)
def pass_at_1(spark, sf):
    """A3."""
    return E.pass_at_1(rollouts(spark, sf)).withColumn("rule_accuracy", F.round("rule_accuracy", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT finish_reason, count(*) AS n, CAST(sum((reward > 0.5)::INT) AS BIGINT) AS n_rule, CAST(sum((NOT reward > 0.5 AND rescued)::INT) AS BIGINT) AS n_rescued,
  round(avg((reward > 0.5)::INT::DOUBLE), 6) AS rule_accuracy, round(avg((reward > 0.5 OR rescued)::INT::DOUBLE), 6) AS accuracy FROM rollouts WHERE rollout_index = 1 GROUP BY 1""", ROLLOUTS)
def accuracy_rule_vs_rescued(spark, sf):
    """A7."""
    return E.pass_at_1(rollouts(spark, sf), ["finish_reason"]).withColumn("rule_accuracy", F.round("rule_accuracy", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT k, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, round(avg(hit::DOUBLE), 6) AS pass_at_k FROM
  (SELECT question_id, k, max((reward > 0.5 AND rollout_index <= k)::INT) AS hit FROM rollouts, (VALUES (1), (2), (4), (8)) t(k) GROUP BY 1, 2) GROUP BY k""", ROLLOUTS)
def pass_at_k(spark, sf):
    """A4."""
    return E.pass_at_k(rollouts(spark, sf), (1, 2, 4, 8)).withColumn("pass_at_k", F.round("pass_at_k", 6))


@query("""SELECT 'missing' AS mode, count(*) AS questions, CAST(sum(greatest(0, 6 - n)) AS BIGINT) AS empty FROM (SELECT count(*) AS n FROM rollouts GROUP BY question_id)
  UNION ALL SELECT 'text', count(DISTINCT question_id), CAST(sum((trim(response_text) = '')::INT) AS BIGINT) FROM rollouts""", ROLLOUTS)
def empty_predictions(spark, sf):
    """A5."""
    rows = rollouts(spark, sf)
    both = [E.empty_predictions(rows, 6, m).withColumn("mode", F.lit(m)) for m in ("missing", "text")]
    return both[0].unionByName(both[1]).select("mode", "questions", "empty")


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("reward", "format_reward", "answer_reward", "length_reward", "n_tokens")) + " FROM rollouts", ROLLOUTS)
def reward_component_means(spark, sf):
    """A6."""
    means = E.reward_component_means(rollouts(spark, sf))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("""SELECT dataset_key, checkpoint, metric, count(*) AS n, min(value) AS min, max(value) AS max, floor(avg(value) * 10000 + 0.5000001) / 10000 AS mean, floor(var_pop(value) * 10000 + 0.5000001) / 10000 AS variance,
  floor(stddev_pop(value) * 10000 + 0.5000001) / 10000 AS std, arg_max(value, run_index) AS latest FROM
  (SELECT dataset_key, checkpoint, run_index, 'accuracy' AS metric, accuracy AS value FROM runs UNION ALL SELECT dataset_key, checkpoint, run_index, 'eval_seconds', eval_seconds FROM runs
   UNION ALL SELECT dataset_key, checkpoint, run_index, 'randomized', randomized::INT::DOUBLE FROM runs) GROUP BY 1, 2, 3""", RUNS)
def run_metric_summary(spark, sf):
    """A8, A9, A26."""
    rows = E.run_metric_summary(runs(spark, sf), ("accuracy", "eval_seconds", "randomized"), ("dataset_key", "checkpoint"), ("run_index",))
    up = lambda c: (F.floor(F.col(c) * 10000 + 0.5000001) / 10000).alias(c)  # noqa: E731  ties, which these means have, go up
    return rows.withColumns({c: up(c) for c in ("mean", "variance", "std")})


@query("""SELECT dataset_key, checkpoint, CAST(first(run_index ORDER BY accuracy DESC, run_index) AS INTEGER) AS best_run, CAST(first(run_index ORDER BY accuracy, run_index) AS INTEGER) AS worst_run,
  max(run_index) AS latest_run, max(accuracy) AS best_accuracy, min(accuracy) AS worst_accuracy FROM runs GROUP BY 1, 2""", RUNS)
def best_worst_run(spark, sf):
    """A10."""
    return E.best_worst_run(runs(spark, sf), ("dataset_key", "checkpoint"))


@query("""SELECT checkpoint, count(*) AS datasets, round(avg(mean), 6) AS macro_mean, bool_and(n >= 10) AS completed FROM
  (SELECT checkpoint, dataset_key, avg(accuracy) AS mean, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1""", RUNS)
def checkpoint_macro_mean(spark, sf):
    """A11."""
    return E.checkpoint_macro_mean(runs(spark, sf), 10).withColumn("macro_mean", F.round("macro_mean", 6))


@query("""SELECT dataset_key, checkpoint, round(mean_accuracy, 6) AS mean_accuracy, n_runs, CAST(row_number() OVER (PARTITION BY dataset_key ORDER BY mean_accuracy DESC, checkpoint) AS INTEGER) AS place FROM
  (SELECT dataset_key, checkpoint, round(avg(accuracy), 9) AS mean_accuracy, count(*) AS n_runs FROM runs GROUP BY 1, 2)""", RUNS)
def leaderboard(spark, sf):
    """A12."""
    return E.leaderboard(runs(spark, sf)).withColumn("mean_accuracy", F.round("mean_accuracy", 6))


@query("""SELECT round(avg(correct / n), 6) AS macro, round(sum(correct) / sum(n), 6) AS micro, count(*) AS groups FROM
  (SELECT question_id, count(*)::DOUBLE AS n, sum(correct::INT)::DOUBLE AS correct FROM rollouts GROUP BY 1)""", ROLLOUTS)
def macro_micro_accuracy(spark, sf):
    """A14."""
    counts = rollouts(spark, sf).groupBy("question_id").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("correct").cast("double")).alias("correct"))
    return E.macro_micro(counts).withColumn("macro", F.round("macro", 6)).withColumn("micro", F.round("micro", 6))


@query("SELECT checkpoint, " + ", ".join(f"""round(avg(accuracy) FILTER (dataset_key = '{d}'), 6) AS {d}_acc,
  round(arg_max(accuracy, run_index) FILTER (dataset_key = '{d}') - arg_min(accuracy, run_index) FILTER (dataset_key = '{d}'), 6) AS {d}_delta""" for d in ("click", "view")) + " FROM runs GROUP BY 1", RUNS)
def pivot_dataset_metrics(spark, sf):
    """A15."""
    return E.pivot_metrics(runs(spark, sf), ["click", "view"])


@query("SELECT count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS correct, max(n_tokens) AS elapsed FROM rollouts", ROLLOUTS)
def distributed_eval_counts(spark, sf):
    """One global aggregation where ranks would reduce counts."""
    return rollouts(spark, sf).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"), F.max("n_tokens").alias("elapsed"))


@query("SELECT count(DISTINCT question_id) AS questions FROM rollouts", ROLLOUTS)
def distinct_questions(spark, sf):
    """A19."""
    return rollouts(spark, sf).agg(F.countDistinct("question_id").alias("questions"))


_PLAN = "plan AS (SELECT DISTINCT checkpoint, d AS dataset_key FROM runs, (VALUES ('click'), ('view'), ('never_run')) t(d))"


@query("""SELECT p.checkpoint, p.dataset_key, least(coalesce(n, 0), 10)::BIGINT AS runs, CASE WHEN coalesce(n, 0) >= 10 THEN 'completed' WHEN coalesce(n, 0) > 0 THEN 'partial' ELSE 'pending' END AS state,
  concat(least(coalesce(n, 0), 10) * 10, '.0%') AS percent FROM plan p LEFT JOIN (SELECT checkpoint, dataset_key, count(*) AS n FROM runs GROUP BY 1, 2) r ON p.checkpoint = r.checkpoint AND p.dataset_key = r.dataset_key""", RUNS, _PLAN)
def eval_progress(spark, sf):
    """A20, A30, P23."""
    rows = runs(spark, sf)
    plan = rows.select("checkpoint").distinct().withColumn("dataset_key", F.explode(F.array(*map(F.lit, ("click", "view", "never_run")))))
    return E.progress(rows, plan, 10)


@query("""SELECT checkpoint, dataset_key, best_run, path, path IS NULL AS missing FROM (
  SELECT b.*, a.path FROM (SELECT checkpoint, dataset_key, CAST(first(run_index ORDER BY accuracy DESC, run_index) AS INTEGER) AS best_run FROM runs GROUP BY 1, 2) b
  LEFT JOIN (SELECT checkpoint, dataset_key, run_index, concat(checkpoint, '/', dataset_key, '/run-', run_index, '.jsonl') AS path FROM runs WHERE event_id % 5 <> 0) a
  ON a.checkpoint = b.checkpoint AND a.dataset_key = b.dataset_key AND a.run_index = b.best_run)""", RUNS)
def export_index(spark, sf):
    """The best run's artifact, or that it is missing."""
    rows = runs(spark, sf)
    best = E.best_worst_run(rows, ("checkpoint", "dataset_key")).select("checkpoint", "dataset_key", F.col("best_run"))
    path = F.concat_ws("", "checkpoint", F.lit("/"), "dataset_key", F.lit("/run-"), "run_index", F.lit(".jsonl"))
    artifacts = rows.where("event_id % 5 <> 0").select("checkpoint", "dataset_key", F.col("run_index").alias("best_run"), path.alias("path"))
    return best.join(artifacts, ["checkpoint", "dataset_key", "best_run"], "left").select("checkpoint", "dataset_key", "best_run", "path", F.isnull("path").alias("missing"))


@query("""SELECT step, max(batch_loss) AS max_batch_loss, round(avg(batch_loss), 6) AS loss_per_batch, round(sum(total) / sum(n), 6) AS loss_per_example, CAST(sum(n) AS BIGINT) AS examples FROM (
  SELECT question_id % 10 AS step, question_id, round(avg(reward), 6) AS batch_loss, sum(reward) AS total, count(*) AS n FROM rollouts GROUP BY 1, 2) GROUP BY 1""", ROLLOUTS)
def loss_breakdown(spark, sf):
    """Terms averaged per batch against per example."""
    batches = rollouts(spark, sf).groupBy((F.col("question_id") % 10).alias("step"), "question_id").agg(F.round(F.avg("reward"), 6).alias("batch_loss"), F.sum("reward").alias("total"), F.count("*").alias("n"))
    return batches.groupBy("step").agg(F.max("batch_loss").alias("max_batch_loss"), F.round(F.avg("batch_loss"), 6).alias("loss_per_batch"), F.round(F.sum("total") / F.sum("n"), 6).alias("loss_per_example"), F.sum("n").alias("examples"))


@query("SELECT question_id, round(sum(reward * correct::INT) / greatest(sum(correct::INT), 1), 6) AS masked_mean FROM rollouts GROUP BY 1", ROLLOUTS)
def masked_mean(spark, sf):
    """A31."""
    mask = F.col("correct").cast("int")
    return rollouts(spark, sf).groupBy("question_id").agg(F.round(F.sum(F.col("reward") * mask) / F.greatest(F.sum(mask), F.lit(1)), 6).alias("masked_mean"))


@query("""SELECT world, CAST(ceil(ceil(n / world) / 8) AS BIGINT) AS optimizer_steps FROM (SELECT count(*)::DOUBLE AS n FROM rollouts), (VALUES (1), (2), (8)) t(world)""", ROLLOUTS)
def step_estimate(spark, sf):
    """ceil(ceil(n / world) / (micro batch * accumulation))."""
    n = rollouts(spark, sf).agg(F.count("*").cast("double").alias("n"))
    return n.select("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(8))).alias("world")).select("world", F.ceil(F.ceil(F.col("n") / F.col("world")) / 8).cast("bigint").alias("optimizer_steps"))


@query("""SELECT dataset_key, checkpoint, run_index, accuracy, prev AS previous_best, prev IS NULL OR accuracy > prev AS is_best FROM (
  SELECT *, max(accuracy) OVER (PARTITION BY dataset_key, checkpoint ORDER BY run_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM runs)""", RUNS)
def best_so_far(spark, sf):
    """C16."""
    rows = runs(spark, sf).withColumn("k", F.struct("dataset_key", "checkpoint"))
    return E.best_so_far(rows, "k", "run_index", "accuracy").select("dataset_key", "checkpoint", "run_index", "accuracy", "previous_best", "is_best")


@query("""SELECT dataset_key, checkpoint, run_index, age FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_key, checkpoint ORDER BY run_index DESC) AS INTEGER) AS age FROM runs) WHERE age > 3""", RUNS)
def retention(spark, sf):
    """C15, C20."""
    rows = runs(spark, sf).withColumn("k", F.struct("dataset_key", "checkpoint"))
    return E.retention(rows, "k", "run_index", 3).select("dataset_key", "checkpoint", "run_index", "age")


@query("""SELECT checkpoint, dataset_key, run_index, accuracy FROM runs WHERE run_index % 4 <> 0 UNION ALL SELECT checkpoint, dataset_key, run_index, accuracy + 1 FROM runs WHERE run_index % 4 = 0""", RUNS)
def history_upsert(spark, sf):
    """New records replace those of the same step."""
    rows = runs(spark, sf).select("checkpoint", "dataset_key", "run_index", "accuracy").withColumn("step", F.struct("checkpoint", "dataset_key", "run_index"))
    new = rows.where("run_index % 4 = 0").withColumn("accuracy", F.col("accuracy") + 1)
    return E.history_upsert(rows, new).drop("step")


@query("SELECT i, (i + 1) % 50 = 0 OR i = last AS save, (i + 1) % 20 = 0 OR i = last AS evaluate FROM (SELECT event_id AS i, max(event_id) OVER () AS last FROM events) WHERE (i + 1) % 50 = 0 OR (i + 1) % 20 = 0 OR i = last")
def schedule_steps(spark, sf):
    """C17: events as iterations; the last always counts."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("i"))
    rows = events.join(F.broadcast(events.agg(F.max("i").alias("last"))))  # one row
    due = lambda k: ((F.col("i") + 1) % k == 0) | (F.col("i") == F.col("last"))
    return rows.withColumns({"save": due(50), "evaluate": due(20)}).where("save OR evaluate").drop("last")


@query("""SELECT experiment, checkpoint, step FROM (SELECT split_part(checkpoint, '/', 1) AS experiment, checkpoint, CAST(regexp_extract(checkpoint, 'checkpoint-([0-9]+)', 1) AS INTEGER) AS step,
  row_number() OVER (PARTITION BY split_part(checkpoint, '/', 1) ORDER BY CAST(regexp_extract(checkpoint, 'checkpoint-([0-9]+)', 1) AS INTEGER) DESC) AS rn FROM (SELECT DISTINCT checkpoint FROM runs)) WHERE rn = 1""", RUNS)
def latest_checkpoint_per_experiment(spark, sf):
    """S10."""
    found = runs(spark, sf).select("checkpoint").distinct().select(F.split_part("checkpoint", F.lit("/"), F.lit(1)).alias("experiment"), "checkpoint", F.regexp_extract("checkpoint", "checkpoint-([0-9]+)", 1).cast("int").alias("step"))
    return found.groupBy("experiment").agg(F.max_by("checkpoint", "step").alias("checkpoint"), F.max("step").alias("step"))


@query("""SELECT checkpoint, source FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY p, s DESC) AS rn FROM (
  SELECT split_part(checkpoint, '/', 1) AS e, checkpoint, CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS INTEGER) AS s, CASE WHEN s % 5 = 1 THEN 'anchor_ema' WHEN s % 2 = 0 THEN 'iter' ELSE 'initial' END AS source,
  CASE WHEN s % 5 = 1 THEN 0 WHEN s % 2 = 0 THEN 1 ELSE 2 END AS p FROM (SELECT DISTINCT checkpoint FROM runs))) WHERE rn = 1""", RUNS)
def source_priority(spark, sf):
    """Averaged weights before the newest iteration before the initial model."""
    step = F.regexp_extract("checkpoint", "([0-9]+)$", 1).cast("int")
    source = F.when(step % 5 == 1, "anchor_ema").when(step % 2 == 0, "iter").otherwise("initial")
    order = F.when(source == "anchor_ema", 0).when(source == "iter", 1).otherwise(2)
    found = runs(spark, sf).select("checkpoint").distinct().select("checkpoint", F.split_part("checkpoint", F.lit("/"), F.lit(1)).alias("e"), source.alias("source"), F.struct(-order, step).alias("o"))
    return found.groupBy("e").agg(F.max_by(F.struct("checkpoint", "source"), "o").alias("m")).select("m.checkpoint", "m.source")


@query("""SELECT checkpoint, 2048 + 10 * (row_number() OVER (ORDER BY checkpoint) - 1) + CASE WHEN contains(checkpoint, 'exp3') THEN 512 ELSE 0 END AS max_tokens FROM (SELECT DISTINCT checkpoint FROM runs)""", RUNS)
def token_budget(spark, sf):
    """Base + step * (index - 1) + extra where the name matches.  The window is over the few checkpoints."""
    nth = F.row_number().over(Window.orderBy("checkpoint"))
    return runs(spark, sf).select("checkpoint").distinct().select("checkpoint", (2048 + 10 * (nth - 1) + F.when(F.contains("checkpoint", F.lit("exp3")), 512).otherwise(0)).cast("bigint").alias("max_tokens"))


@query("""SELECT max(n + 1024 + 16) AS needed, arg_max(doc_id, n * 1000000 - doc_id) AS row_id, max(n + 1024 + 16) <= 4096 AS fits FROM (SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents)""")
def context_budget(spark, sf):
    """the longest prompt, with what is generated and a margin, against the context."""
    rows = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", " ", -1)).cast("bigint").alias("n"))
    return rows.agg((F.max("n") + 1024 + 16).alias("needed"), F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("row_id")).select("needed", "row_id", (F.col("needed") <= 4096).alias("fits"))


@query("""SELECT o_orderkey AS model_id, greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)) AS capacity FROM (SELECT o_orderkey, CASE WHEN x > 0 AND x < 1000000 THEN x END AS a,
  CASE WHEN x * 4 > 0 AND x * 4 < 1000000 AND o_orderkey % 2 = 0 THEN x * 4 END AS b, CASE WHEN y > 0 AND y < 1000000 THEN y END AS c FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS x, CAST(floor(o_totalprice / 3) * 10 AS BIGINT) AS y FROM orders))""")
def context_capacity(spark, sf):
    """The largest plausible of the configured context sizes."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("model_id"), F.floor("o_totalprice").alias("x"), (F.floor(F.col("o_totalprice") / 3) * 10).alias("y"))
    plausible = lambda c, also=F.lit(True): F.coalesce(F.when((c > 0) & (c < 1_000_000) & also, c), F.lit(0))
    return rows.select("model_id", F.greatest(plausible(F.col("x")), plausible(F.col("x") * 4, F.col("model_id") % 2 == 0), plausible(F.col("y"))).cast("bigint").alias("capacity"))


@query("""SELECT row_id, coalesce(p1, CASE WHEN flag THEN pk END, 1.0::DOUBLE) AS temperature, coalesce(p1, CASE WHEN flag THEN pk END, 1.0::DOUBLE) > 0 OR coalesce(top, 1.0::DOUBLE) < 1 AS randomized FROM (
  SELECT p_partkey AS row_id, CASE WHEN p_size % 3 = 0 THEN p_size / 50.0::DOUBLE END AS p1, CASE WHEN p_size % 2 = 0 THEN 0.6::DOUBLE END AS pk, p_partkey % 2 = 0 AS flag, CASE WHEN p_size % 5 = 0 THEN 0.9::DOUBLE END AS top FROM part)""")
def pass1_param_resolution(spark, sf):
    """Explicit, else that of pass@k where randomised, else the default."""
    size, key = F.col("p_size"), F.col("p_partkey")
    temperature = F.coalesce(F.when(size % 3 == 0, size / 50.0), F.when((key % 2 == 0) & (size % 2 == 0), 0.6), F.lit(1.0))
    return table(spark, sf, "part").select(key.alias("row_id"), temperature.alias("temperature"), ((temperature > 0) | (F.coalesce(F.when(size % 5 == 0, 0.9), F.lit(1.0)) < 1)).alias("randomized"))


@query("""SELECT question_id, rollout_index, concat('[', question_id, '#', rollout_index, '] ', CASE WHEN correct THEN 'OK' ELSE 'WRONG' END, ' reward=', printf('%.3f', reward), chr(10), coalesce(nullif(trim(response_text), ''), '<empty>')) AS line FROM rollouts""", ROLLOUTS)
def render_outcome_log(spark, sf):
    """K5."""
    line = F.concat(F.lit("["), F.col("question_id").cast("string"), F.lit("#"), F.col("rollout_index").cast("string"), F.lit("] "), F.when(F.col("correct"), "OK").otherwise("WRONG"), F.lit(" reward="), F.format_string("%.3f", "reward"), F.lit("\n"), F.coalesce(F.nullif(F.trim("response_text"), F.lit("")), F.lit("<empty>")))
    return rollouts(spark, sf).select("question_id", "rollout_index", line.alias("line"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45")
def scan_parquet_pushdown(spark, sf):
    """Filters and columns reach the scan."""
    return table(spark, sf, "lineitem").where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_quantity")


@query("""SELECT name, CAST(nullif(regexp_extract(name, '^eval_step_([0-9]+)_summary\\.json$', 1), '') AS BIGINT) AS step FROM (SELECT concat(CASE WHEN event_id % 3 = 0 THEN 'other_' ELSE '' END, 'eval_step_', event_id * 10, '_summary.json') AS name FROM events)""".replace("\\\\", "\\"))
def parse_step_from_name(spark, sf):
    """S9."""
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "other_").otherwise(""), F.lit("eval_step_"), (F.col("event_id") * 10).cast("string"), F.lit("_summary.json"))
    return table(spark, sf, "events").select(name.alias("name")).select("name", F.nullif(F.regexp_extract("name", r"^eval_step_([0-9]+)_summary\.json$", 1), F.lit("")).cast("bigint").alias("step"))
