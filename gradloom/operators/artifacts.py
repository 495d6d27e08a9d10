"""Artifacts of evaluations: checkpoints in a file listing, names, the best and worst runs' files, reports of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that make a folder a checkpoint with weights.  Fixed values.
WEIGHTS = r"^(pytorch_model\.bin|model\.safetensors|pytorch_model\.bin\.index\.json|model\.safetensors\.index\.json|pytorch_model-.*\.bin|model-.*\.safetensors)$"
#: Names of checkpoint folders with their step.  Fixed values.
TRAINER, ACTOR, ANCHOR = r"^checkpoint-(\d+)$", r"^iter_(\d+)_actor$", "anchor_ema"
FILES = ("outcomes.log", "per_example_scores.jsonl")


def checkpoints(files: DataFrame, anchor: bool = True, most: int | None = None) -> DataFrame:
    """(experiment, path, name, type, step) of the folders in a listing (path) that hold weights, one row a folder: S10.

    A folder below ``checkpoints`` belongs to the experiment above that.  ``anchor``: whether averaged anchors count.
    With ``most``, the first by experiment, step (none: before all) and name.
    """
    part = F.split("path", "/")
    at = lambda n: F.try_element_at(part, F.lit(n))
    found = files.where(F.rlike(at(-1), F.lit(WEIGHTS))).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), at(-2).alias("name"), (at(-3) == "checkpoints").alias("below")).distinct()
    kind = F.when(F.rlike("name", F.lit(TRAINER)), "trainer_checkpoint").when(F.rlike("name", F.lit(ACTOR)), "iter_actor").when(F.col("name") == ANCHOR, ANCHOR).otherwise("weight_dir")
    step = F.nullif(F.coalesce(F.nullif(F.regexp_extract("name", TRAINER, 1), F.lit("")), F.regexp_extract("name", ACTOR, 1)), F.lit("")).cast("bigint")
    experiment = F.regexp_replace("path", F.when(F.coalesce("below", F.lit(False)), F.lit("/checkpoints/[^/]*$")).otherwise(F.lit("/[^/]*$")), F.lit(""))
    rows = found.select(experiment.alias("experiment"), "path", "name", kind.alias("type"), step.alias("step"))
    rows = rows if anchor else rows.where(F.col("type") != ANCHOR)
    return rows if most is None else rows.orderBy("experiment", F.coalesce("step", F.lit(-1)), "name").limit(most)


def first_existing(rows: DataFrame, candidates: str, present: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the first of the paths in array ``candidates`` that ``present`` (path) has, else null: J9.

    Null and blank candidates are passed over.  Rows are told apart by all their columns; equal rows stay one row.
    """
    keys = [c for c in rows.columns]
    paths = rows.select(*keys, F.posexplode_outer(candidates).alias("nth", "path"))
    there = present.select("path").distinct().withColumn("there", F.lit(True))
    joined = paths.join(there, "path", "left").withColumn("usable", F.when(F.col("there") & (F.trim("path") != ""), F.col("path")))
    return joined.groupBy(*keys).agg(F.min_by("usable", F.when(F.col("usable").isNotNull(), F.col("nth"))).alias("found"))


def step_name(step: Column) -> Column:
    """``eval_step_000012``; a step of more than six digits stays whole."""
    return F.concat(F.lit("eval_step_"), F.format_string("%06d", step.cast("bigint")))


def artifact_name(step: Column, kind: Column, file: str) -> Column:
    """``eval_step_000012_best_outcomes.log`` and the like: K8."""
    return F.concat(step_name(step), F.lit("_"), kind, F.lit("_"), F.lit(file))


def extrema(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, run_index): the best and the worst run by accuracy, the first of equals: K7."""
    by = F.coalesce("accuracy", F.lit(float("-inf")))
    sides = runs.groupBy(*keys).agg(F.max_by("run_index", F.struct(by, -F.col("run_index"))).alias("best"), F.min_by("run_index", F.struct(F.coalesce("accuracy", F.lit(float("inf"))), F.col("run_index"))).alias("worst"))
    return sides.select(*keys, F.stack(F.lit(2), F.lit("best"), "best", F.lit("worst"), "worst").alias("kind", "run_index"))


def extrema_examples(examples: DataFrame, runs: DataFrame, *keys: str) -> DataFrame:
    """The scored examples of each key's best and worst run, with ``kind``: what is copied beside the summary: K7.

    Write it partitioned by the keys and ``kind``.  A run that is both stands in both.
    """
    return examples.join(extrema(runs, *keys), [*keys, "run_index"])


def skipped_steps(steps: DataFrame, scores: DataFrame) -> DataFrame:
    """(step, step_dir_name, checkpoint, checkpoint_name, reason) of steps (step, checkpoint) without a row of ``scores``: A28."""
    lost = steps.join(scores.select("checkpoint").distinct(), "checkpoint", "left_anti")
    folder = step_name(F.col("step"))
    return lost.select("step", folder.alias("step_dir_name"), "checkpoint", F.element_at(F.split("checkpoint", "/"), -1).alias("checkpoint_name"), F.lit("missing_source_per_example_scores").alias("reason"))


def selected(registry: DataFrame, *selections: DataFrame) -> DataFrame:
    """The entries of a registry (name, place) that any selection (name) names, to be ordered by ``place``: S11, X5.

    Names that the registry lacks select nothing.
    """
    names = selections[0].select("name")
    for more in selections[1:]:
        names = names.unionByName(more.select("name"))
    return registry.join(names.distinct(), "name", "left_semi")


def with_generations(prompts: DataFrame, generations: DataFrame) -> DataFrame:
    """``prompts`` with ``choices``, their generations by index; a prompt that failed has none: J1, S12.

    They meet by ``prompt_id``, never by position.  ``generations``: prompt_id, choice_idx, text, finish_reason.
    """
    own = generations.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("choice_idx", "text", "finish_reason"))).alias("choices"))
    empty = F.array().cast(own.schema["choices"].dataType)
    return prompts.join(own, "prompt_id", "left").withColumn("choices", F.coalesce("choices", empty))


def with_answers(completions: DataFrame, answers: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Completions (position from 0) with their answers (position, answer), each serving as many in a row: U24.

    Numbers of completions that the answers don't divide are an error; without answers there is none for anyone.
    ``sizes``: how many of either there are, where the caller knows; else both are counted now.
    """
    n, m = sizes or (completions.count(), answers.count())
    if m == 0:
        return completions.withColumn("answer", F.lit(None).cast("string"))
    if n % m:
        raise ValueError(f"{n} completions for {m} answers")
    own = answers.select(F.col("position").alias("of"), "answer")
    return completions.withColumn("of", F.floor(F.col("position") / max(1, n // m))).join(own, "of", "left").drop("of")


def without_rows(rows: DataFrame, indices: list[int], position: str = "position", size: int | None = None) -> DataFrame:
    """``rows`` without those at the given positions; a position beyond the table is an error: F6.

    ``size``: how many rows there are, where the caller knows; else they are counted now.
    """
    n = rows.count() if size is None else size
    wrong = sorted(i for i in set(indices) if not 0 <= i < n)
    if wrong:
        raise ValueError(f"positions {wrong[:10]} are out of range of {n} rows")
    gone = rows.sparkSession.createDataFrame([(i,) for i in sorted(set(indices))], "__gone long")
    return rows.join(gone, F.col(position) == F.col("__gone"), "left_anti")


def bad_edge_report(rollouts: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and the bad edges a question (0 without questions): T10."""
    n = rollouts.agg(F.countDistinct("question_id").alias("num_questions"), F.count("*").alias("num_rollouts_total"), F.sum((F.size("tokens") == 0).cast("bigint")).alias("empty_response_count"))
    both = n.crossJoin(kept.agg(F.count("*").alias("kept"))).crossJoin(edges.agg(F.count("*").alias("num_bad_edges")))  # a row each
    empty = F.coalesce("empty_response_count", F.lit(0).cast("bigint"))
    return both.select(
        "num_questions", "num_rollouts_total", "num_bad_edges", (F.col("num_bad_edges") / F.greatest("num_questions", F.lit(1))).alias("avg_bad_edges_per_question"),
        empty.alias("empty_response_count"), (F.col("num_rollouts_total") - empty - F.col("kept")).alias("duplicate_rollout_count"),
    )
