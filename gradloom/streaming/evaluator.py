"""A continuous evaluator: run records arrive as files, summaries follow.

Every micro-batch upserts its runs by (step, run_index), so a batch that is replayed after a failure changes nothing, and
recomputes the summaries of the steps it touched, which it publishes under its own number; readers take the newest of each
step, so a summary is never missing.  A control table names the generation and its first step, and ends the work; what is
not taken in is recorded with its reason.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.artifacts import FILES, extrema, step_name
from ..operators.evaluation import best_worst_run, run_metric_summary
from ..sources.publishing import publish
from ..sources.storage import exists

RUN = "step int, run_index int, dataset_key string, checkpoint string, accuracy double, eval_seconds double, ts timestamp"
CONTROL = "stop boolean, generation int, step int, epoch double, checkpoint_dir string"


def run_stream(spark: SparkSession, path: str, schema: str = RUN, files: int = 1) -> DataFrame:
    """New Parquet files under ``path`` as they appear: R1."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def accepted(runs: DataFrame, most_repeats: int) -> DataFrame:
    """Runs under the repeat limit: R2."""
    return runs.where(F.col("run_index") <= most_repeats)


def latest_control(control: DataFrame) -> DataFrame:
    """The control row with the highest generation."""
    return control.groupBy().agg(F.max_by(F.struct(*control.columns), "generation").alias("c")).where("c IS NOT NULL").select("c.*")


def write_control(spark: SparkSession, path: str, stop: bool, generation: int, step: int, epoch: float = 0.0, checkpoint_dir: str = "") -> None:
    """Appends a control row; readers see it whole or not at all: R1, R5."""
    spark.createDataFrame([(stop, generation, step, epoch, checkpoint_dir)], CONTROL).coalesce(1).write.mode("append").parquet(path)


def obeyed(runs: DataFrame, control: DataFrame | None, most_repeats: int) -> DataFrame:
    """``runs`` with ``skipped``: why a run is not taken in (stopped, superseded, repeats), null if it is: R1, R2, R6.

    Of control rows the one with the highest generation holds; without any, all steps are taken in.
    """
    if control is None:
        return runs.withColumn("skipped", F.when(F.col("run_index") > most_repeats, "repeats"))
    now = latest_control(control).select(F.col("stop").alias("__stop"), F.col("step").alias("__step"))
    rows = runs.join(F.broadcast(now), F.lit(True), "left")  # one row at most
    reason = F.when(F.col("__stop"), "stopped").when(F.col("step") < F.col("__step"), "superseded").when(F.col("run_index") > most_repeats, "repeats")
    return rows.withColumn("skipped", reason).drop("__stop", "__step")


def latest_per_step(runs: DataFrame) -> DataFrame:
    """Best and latest accuracy per step as a stateful aggregation, for update mode: R3."""
    return runs.groupBy("step").agg(F.count("*").alias("n"), F.max("accuracy").alias("best_accuracy"), F.max_by("accuracy", "run_index").alias("latest_accuracy"), F.avg("accuracy").alias("mean_accuracy"))


def summaries(runs: DataFrame) -> DataFrame:
    """Batch summary of all runs of a step, which the stream's result must equal."""
    stats = run_metric_summary(runs, ("accuracy",), ("step",), ("run_index",)).drop("metric")
    return stats.join(best_worst_run(runs, ("step",)), "step")


def current(spark: SparkSession, store: str) -> DataFrame:
    """The newest summary of each step: R3, R5."""
    rows = spark.read.parquet(f"{store}/summary")
    names = [c for c in rows.columns if c not in ("step", "batch")]
    return rows.groupBy("step").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("step", "s.*")


def evaluate(stream: DataFrame, store: str, checkpoint: str, most_repeats: int = (1 << 31) - 1, control: str | None = None):
    """Starts the evaluator: a folder a batch under ``store``: runs, skipped and summary (of the steps it touched): R1, R4-R6.

    A batch's folders are overwritten when it is replayed, and of repeated (step, run_index) the first batch's counts, so
    at-least-once delivery has no effect on results.  ``control``: a table that ``write_control`` appends to.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        rules = None if control is None else spark.read.schema(CONTROL).parquet(control)
        rows = obeyed(batch, rules, most_repeats).persist()
        rows.where("skipped IS NOT NULL").write.mode("overwrite").parquet(f"{store}/skipped/batch={number}")
        rows.where("skipped IS NULL").drop("skipped").write.mode("overwrite").partitionBy("step").parquet(f"{store}/runs/batch={number}")
        rows.unpersist()
        everything = spark.read.schema(f"{RUN}, batch int").parquet(f"{store}/runs")
        touched = everything.where(F.col("batch") == number).select("step").distinct()
        everything = everything.join(touched, "step", "left_semi")  # folders of other steps are pruned
        names = [c for c in everything.columns if c not in ("step", "run_index", "batch")]
        first = everything.groupBy("step", "run_index").agg(F.min_by(F.struct(*names), F.struct("batch", *names)).alias("r")).select("step", "run_index", "r.*")
        summaries(first).write.mode("overwrite").parquet(f"{store}/summary/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SERVED = "step int, generation int, run_index int, seed long, checkpoint_dir string, accuracy double, batch long"


class Evaluator:
    """A running evaluator: ``query`` is its stream; ``wait`` returns when the control table has ended it, or fails with it."""

    def __init__(self) -> None:
        self.query, self.ended = None, threading.Event()

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the work has ended within ``seconds``; the stream is stopped then."""
        left = float("inf") if seconds is None else seconds
        while not self.ended.wait(min(0.2, max(left, 0))):
            left -= 0.2
            if self.query.exception() is not None:
                raise self.query.exception()
            if left <= 0:
                return False
        self.query.stop()
        return True


def serve(spark: SparkSession, control: str, store: str, checkpoint: str, once: Callable[[SparkSession, str, int, int], DataFrame], seed: int = 0, most_repeats: int | None = None, pause: str = "1 second", present: Callable[[SparkSession, str], bool] = exists) -> Evaluator:
    """Starts an evaluator that stays up: every trigger it obeys the control table and evaluates once more: R1, R2, R5, R6.

    ``once`` (spark, checkpoint_dir, step, seed) gives the scored examples of one evaluation, with ``answer_correct``.
    A new generation switches to its step, whose earlier runs are read again.  ``pause`` lies between evaluations; at
    ``most_repeats`` runs a step waits.  Where the checkpoint isn't ``present``, a skipped record says so, once a generation.
    A stop ends the work after the run in hand, if the generation hasn't changed meanwhile, or at once where there is
    nothing to run.

    Under ``store``: runs (a folder a step, so that only a step's own are read), skipped, and per step a published version
    with the summary and the best and the worst run's examples.  A trigger that is replayed finds its run by its number.
    """
    state = Evaluator()

    def now():
        rows = spark.read.schema(CONTROL).parquet(control) if exists(spark, f"{control}/*.parquet") else None
        return None if rows is None else latest_control(rows).first()

    def take(number: int) -> None:
        c = now()
        if c is None or state.ended.is_set():
            return
        if not c.checkpoint_dir:
            if c.stop:
                state.ended.set()
            return
        if not present(spark, c.checkpoint_dir):
            spark.createDataFrame([(c.step, c.generation, c.checkpoint_dir, "missing_checkpoint")], "step int, generation int, checkpoint_dir string, reason string").coalesce(1).write.mode("overwrite").parquet(f"{store}/skipped/generation={c.generation}")
            if c.stop:
                state.ended.set()
            return
        own = f"{store}/runs/step={c.step}"
        known = spark.read.schema(SERVED).parquet(f"{own}/run=*").select("run_index", "batch").collect() if exists(spark, f"{own}/run=*") else []  # a row a run
        if number not in {r.batch for r in known}:
            if most_repeats is not None and len(known) >= most_repeats:
                if c.stop:
                    state.ended.set()
                return
            index = len(known) + 1
            run_seed = seed + c.generation * 100_000 + index
            scores = f"{own}/scores={index}"
            once(spark, c.checkpoint_dir, c.step, run_seed).write.mode("overwrite").parquet(scores)
            accuracy = spark.read.parquet(scores).agg(F.coalesce(F.avg(F.col("answer_correct").cast("double")), F.lit(0.0)).alias("accuracy"))
            record = accuracy.select(F.lit(c.step).alias("step"), F.lit(c.generation).alias("generation"), F.lit(index).alias("run_index"), F.lit(run_seed).cast("long").alias("seed"), F.lit(c.checkpoint_dir).alias("checkpoint_dir"), "accuracy", F.lit(number).cast("long").alias("batch"))
            record.write.mode("overwrite").parquet(f"{own}/run={index}")
        publish_step(spark, store, c.step)
        after = now()
        if after.stop and after.generation == c.generation:
            state.ended.set()

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    state.query = ticks.writeStream.foreachBatch(lambda _, number: take(number)).option("checkpointLocation", checkpoint).trigger(processingTime=pause).start()
    return state


def served_runs(spark: SparkSession, store: str) -> DataFrame:
    """The run records of all steps."""
    return spark.read.schema(SERVED).parquet(f"{store}/runs/step=*/run=*") if exists(spark, f"{store}/runs/step=*/run=*") else spark.createDataFrame([], SERVED)


def publish_step(spark: SparkSession, store: str, step: int) -> None:
    """Publishes a step's summary and the examples of its best and worst run under their names, all at once: K7, K8, R5."""
    own = f"{store}/runs/step={step}"
    runs = spark.read.schema(SERVED).parquet(f"{own}/run=*")
    summary = summaries(runs.select("step", "run_index", "accuracy")).first().asDict(recursive=True)
    name = spark.range(1).select(step_name(F.lit(step))).first()[0]
    files = {f"{name}_summary.json": json.dumps(summary, indent=2, default=str)}
    for r in extrema(runs, "step").collect():  # the best and the worst
        files[f"{name}_{r.kind}_{FILES[1]}"] = spark.read.parquet(f"{own}/scores={r.run_index}")
    publish(spark, f"{store}/published/{name}", files)
