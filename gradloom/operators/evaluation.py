"""Evaluation statistics over responses and repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _n(flag: Column) -> Column:
    return F.sum(flag.cast("long"))


def pass_at_1(rollouts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of first responses whose reward is over 0.5 (or that were rescued, where such a column is): A3, A7."""
    rescued = F.col("rescued") if "rescued" in rollouts.columns else F.lit(False)
    rule = F.col("reward") > 0.5
    grouped = rollouts.where("rollout_index = 1").groupBy(*(by or []))
    return grouped.agg(F.count("*").alias("n"), _n(rule).alias("n_rule"), _n(~rule & rescued).alias("n_rescued"), ratio(_n(rule), F.count("*")).alias("rule_accuracy"), ratio(_n(rule | rescued), F.count("*")).alias("accuracy"))


def pass_at_k(rollouts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per k the share of questions with a hit among their first k responses (empirical, not the unbiased estimate): A4.

    One aggregation for all k: a question's first hit decides for which k it counts.
    """
    first = rollouts.groupBy("question_id").agg(F.min(F.when(F.col("reward") > 0.5, F.col("rollout_index"))).alias("first_hit"))
    stats = first.agg(F.count("*").alias("n"), *[_n(F.col("first_hit") <= k).alias(f"hits_{k}") for k in ks])
    return stats.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"hits_{k}", F.lit(0)).alias("hits")) for k in ks])).alias("r")).select("r.k", "r.hits", "n", ratio(F.col("r.hits"), F.col("n")).alias("pass_at_k"))


def empty_predictions(rollouts: DataFrame, expected: int, empty_mode: str = "text") -> DataFrame:
    """Empty responses in either convention: blank texts, or responses missing from the ``expected`` of a question: A5."""
    per = rollouts.groupBy("question_id").agg(F.count("*").alias("n"), _n(F.trim("response_text") == "").alias("blank"))
    missing = F.greatest(F.lit(0), expected - F.col("n"))
    return per.agg(F.count("*").alias("questions"), F.sum(F.col("blank") if empty_mode == "text" else missing).alias("empty"))


def reward_component_means(rollouts: DataFrame) -> DataFrame:
    """Means of the reward's parts and of completion tokens: A6."""
    return rollouts.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("reward", "format_reward", "answer_reward", "length_reward", "n_tokens")])


def run_metric_summary(runs: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Minimum, maximum, mean, population variance and deviation, and latest value of each metric: A8, A9, A26.

    Booleans count as numbers.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    rows = runs.select(*keys, *order, stack).select(*keys, *order, "m.metric", "m.value").where("value IS NOT NULL")
    return rows.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("std"), F.max_by("value", F.struct(*order)).alias("latest"))


def best_worst_run(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Best, worst and latest run by accuracy, the first on ties; a null accuracy is neither best nor worst while there are others: A10."""
    acc = F.col("accuracy")
    best = F.struct(F.coalesce(acc, F.lit(float("-inf"))), -F.col("run_index"))
    worst = F.struct(F.coalesce(acc, F.lit(float("inf"))), F.col("run_index"))
    return runs.groupBy(*keys).agg(F.max_by("run_index", best).alias("best_run"), F.min_by("run_index", worst).alias("worst_run"), F.max("run_index").alias("latest_run"), F.max(acc).alias("best_accuracy"), F.min(acc).alias("worst_accuracy"))


def checkpoint_macro_mean(runs: DataFrame, target: int) -> DataFrame:
    """Mean of the datasets' mean accuracies of a checkpoint, and whether all datasets have ``target`` runs: A11."""
    per = runs.groupBy("checkpoint", "dataset_key").agg(F.avg("accuracy").alias("mean"), F.count("*").alias("n"))
    return per.groupBy("checkpoint").agg(F.count("*").alias("datasets"), F.avg("mean").alias("macro_mean"), F.bool_and(F.col("n") >= target).alias("completed"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Checkpoints of a dataset by mean accuracy, ties by path: A12.  Windows over one row per checkpoint."""
    means = runs.groupBy("dataset_key", "checkpoint").agg(F.round(F.avg("accuracy"), 9).alias("mean_accuracy"), F.count("*").alias("n_runs"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("dataset_key").orderBy(F.col("mean_accuracy").desc(), "checkpoint")))


def macro_micro(counts: DataFrame) -> DataFrame:
    """``counts`` (group, n, correct): mean of ratios against ratio of sums; null where there is nothing: A14."""
    return counts.agg(F.avg(F.try_divide(F.col("correct"), F.col("n"))).alias("macro"), F.try_divide(F.sum("correct"), F.sum("n")).alias("micro"), F.count("*").alias("groups"))


def pivot_metrics(runs: DataFrame, datasets: list[str]) -> DataFrame:
    """A row per checkpoint with mean accuracy and change from the first run, per dataset: A15."""
    per = runs.groupBy("checkpoint", "dataset_key").agg(F.avg("accuracy").alias("acc"), (F.max_by("accuracy", "run_index") - F.min_by("accuracy", "run_index")).alias("delta"))
    return per.groupBy("checkpoint").pivot("dataset_key", datasets).agg(F.round(F.first("acc"), 6).alias("acc"), F.round(F.first("delta"), 6).alias("delta"))


def progress(runs: DataFrame, plan: DataFrame, target: int) -> DataFrame:
    """State of each planned (checkpoint, dataset): completed, partial or pending, with runs capped at the target: A20, A30."""
    done = runs.groupBy("checkpoint", "dataset_key").agg(F.count("*").alias("n"))
    rows = plan.join(done, ["checkpoint", "dataset_key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") >= target, "completed").when(F.col("n") > 0, "partial").otherwise("pending")
    return rows.select("checkpoint", "dataset_key", F.least("n", F.lit(target)).alias("runs"), state.alias("state"), F.format_string("%.1f%%", F.least("n", F.lit(target)) * 100.0 / target).alias("percent"))


def history_upsert(history: DataFrame, updates: DataFrame, key: str = "step") -> DataFrame:
    """``history`` with the rows of ``updates`` in place of those with the same key: C12."""
    return history.join(updates.select(key), key, "left_anti").unionByName(updates)


def best_so_far(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Marks rows whose value is strictly over all before: C16."""
    before = F.max(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("previous_best", before).withColumn("is_best", before.isNull() | (F.col(value) > before))


def retention(rows: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    """What goes when only the newest ``keep`` of a group stay: C15, C20."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("age") > keep)
