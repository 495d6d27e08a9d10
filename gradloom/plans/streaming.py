"""The continuous evaluator over files that arrive one by one (R rows)."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..sources.relations import RUNS, runs, table
from ..sources.storage import exists, scratch
from ..streaming import evaluator as V
from .registry import query


_STEPS = """steps AS (SELECT CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS INTEGER) * 1000 + ascii(dataset_key) AS step, accuracy,
  run_index + 1000000 * CAST(substr(checkpoint, 4, 1) AS INTEGER) AS run_index FROM runs)"""


def _steps(spark, sf):
    """Runs of all data sets: a step is a checkpoint's number and its data set."""
    rows = runs(spark, sf)
    step = (F.regexp_extract("checkpoint", "([0-9]+)$", 1).cast("int") * 1000 + F.ascii("dataset_key")).alias("step")
    unique = F.col("run_index") + 1_000_000 * F.substring("checkpoint", 4, 1).cast("int")
    return rows.select(step, unique.cast("int").alias("run_index"), "dataset_key", "checkpoint", "accuracy", "eval_seconds", F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT step, count(*) AS n, round(avg(accuracy), 6) AS mean, max(accuracy) AS best_accuracy, arg_max(accuracy, run_index) AS latest FROM steps GROUP BY 1", RUNS, _STEPS)
def stream_run_summaries(spark, sf):
    """Parts arrive, one of them twice, each taken in by a start of the stream; the summary is as if read at once."""
    top = scratch(spark, "stream")
    rows = _steps(spark, sf)
    for i in (0, 1, 2, 0):
        rows.where(F.col("run_index") % 3 == i).write.mode("append").parquet(f"{top}/in")
        V.evaluate(V.run_stream(spark, f"{top}/in", files=1000), f"{top}/out", f"{top}/log").awaitTermination()
    return V.current(spark, f"{top}/out").select("step", "n", F.round("mean", 6).alias("mean"), "best_accuracy", "latest")


@query("SELECT step, count(*) AS n, max(accuracy) AS best_accuracy, arg_max(accuracy, run_index) AS latest_accuracy FROM steps GROUP BY 1", RUNS, _STEPS)
def stream_latest_per_step(spark, sf):
    """Stateful aggregation in update mode; each batch's changed steps replace their rows."""
    top = scratch(spark, "stream")
    rows = _steps(spark, sf)

    def publish(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/part={number}")

    for i in range(2):
        rows.where(F.col("run_index") % 2 == i).write.mode("append").parquet(f"{top}/in")
        state = V.latest_per_step(V.run_stream(spark, f"{top}/in", files=1000))
        state.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{top}/log").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{top}/out").drop("part")
    last = changes.groupBy("step").agg(F.max_by(F.struct("n", "best_accuracy", "latest_accuracy"), "batch").alias("s"))
    return last.select("step", "s.n", "s.best_accuracy", "s.latest_accuracy")


@query("SELECT step, n, best_accuracy FROM (SELECT step, count(*) AS n, max(accuracy) AS best_accuracy FROM steps GROUP BY 1) WHERE step >= 10000", RUNS, _STEPS)
def stream_controlled(spark, sf):
    """A control file names the generation's first step and ends the work; older steps are recorded as skipped."""
    top = scratch(spark, "stream")
    rows = _steps(spark, sf)
    for generation, i, stop in ((1, 0, False), (2, 1, False), (2, 2, False), (3, 0, True)):
        V.write_control(spark, f"{top}/control", stop=stop, generation=generation, step=10_000)
        rows.where(F.col("run_index") % 3 == i).write.mode("append").parquet(f"{top}/in")
        V.evaluate(V.run_stream(spark, f"{top}/in", files=1000), f"{top}/out", f"{top}/log", control=f"{top}/control").awaitTermination()
    return V.current(spark, f"{top}/out").select("step", "n", "best_accuracy")


@query("""SELECT step, run_index, seed, count(*) AS n, round(avg((md5(concat_ws('|', seed, l_orderkey, l_linenumber)) < '8')::INT), 6) AS accuracy FROM lineitem,
  (VALUES (3, 1, 100008), (3, 2, 100009), (7, 1, 200008), (9, 1, 400008)) r(step, run_index, seed) WHERE l_orderkey % 10 = step GROUP BY 1, 2, 3""")
def stream_served(spark, sf):
    """One start over many triggers: two repeats of a step, the next generation, one without a checkpoint, a stop after the run in hand."""
    top = scratch(spark, "served")

    def once(session, checkpoint, step, seed):
        rows = table(session, sf, "lineitem").where(F.col("l_orderkey") % 10 == step)
        return rows.select("l_orderkey", "l_linenumber", (F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))) < "8").alias("answer_correct"))

    def until(done, seconds=180):
        began = time.monotonic()
        while not done():
            if time.monotonic() - began > seconds or not served.query.isActive:
                raise TimeoutError("the evaluator doesn't follow its control table")
            time.sleep(0.1)

    n = lambda step: V.served_runs(spark, f"{top}/out").where(F.col("step") == step).count()
    V.write_control(spark, f"{top}/control", stop=False, generation=1, step=3, checkpoint_dir="there")
    served = V.serve(spark, f"{top}/control", f"{top}/out", f"{top}/log", once, seed=7, most_repeats=2, pause="200 milliseconds", present=lambda _, path: path == "there")
    try:
        until(lambda: n(3) == 2)
        V.write_control(spark, f"{top}/control", stop=False, generation=2, step=7, checkpoint_dir="there")
        until(lambda: n(7) >= 1)
        V.write_control(spark, f"{top}/control", stop=False, generation=3, step=8, checkpoint_dir="missing")
        until(lambda: exists(spark, f"{top}/out/skipped/generation=3/_SUCCESS"))
        V.write_control(spark, f"{top}/control", stop=True, generation=4, step=9, checkpoint_dir="there")
        served.wait(180)
    finally:
        served.query.stop()
    runs_ = V.served_runs(spark, f"{top}/out").where("step <> 7 OR run_index = 1")  # how often generation 2 ran before the next came isn't fixed
    scores = spark.read.option("basePath", f"{top}/out/runs").parquet(f"{top}/out/runs/step=*/scores=*").withColumnsRenamed({"step": "s", "scores": "r"})
    joined = scores.join(runs_, (F.col("s") == F.col("step")) & (F.col("r") == F.col("run_index")))
    return joined.groupBy("step", "run_index", "seed").agg(F.count("*").alias("n"), F.round(F.avg(F.col("answer_correct").cast("int")), 6).alias("accuracy"))
