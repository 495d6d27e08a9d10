"""Reconciliation with a judge: pending work, caches, recovered accuracy, record versions.

Verdicts are an input table; nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def candidates(rollouts: DataFrame, gold: str, when: str = "reward") -> DataFrame:
    """``rollouts`` with ``state``: what is to be judged, or why not: F10.

    ``when``: ``reward`` judges rewards of 0 or less, ``incorrect`` every wrong response.
    """
    wrong = F.col("reward") <= 0 if when == "reward" else ~F.col("correct")
    blank = (F.trim(F.coalesce("response_text", F.lit(""))) == "") | (F.trim(F.coalesce(gold, F.lit(""))) == "")
    return rollouts.withColumn("state", F.when(~wrong, "not_judged").when(blank, "empty").otherwise("judge"))


def pending(rows: DataFrame, results: DataFrame, most: int | None = None, key: str = "index") -> DataFrame:
    """Wrong rows without a result that is ok, the first ``most`` by key; 0 means none: F9."""
    left = rows.where("NOT correct").join(results.where("status = 'ok'").select(key), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key: A25, A33."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def recovery(rows: DataFrame, results: DataFrame, by: list[str], key: str = "index") -> DataFrame:
    """Original and corrected accuracy side by side: A13, A28, J6."""
    joined = rows.join(results.select(key, "status", "is_correct"), key, "left")
    n = lambda flag: F.sum(F.coalesce(flag, F.lit(False)).cast("long"))
    ok = ~F.col("correct") & (F.col("status") == "ok")
    stats = joined.groupBy(*by).agg(F.count("*").alias("n"), n(F.col("correct")).alias("original_correct"), n(ok).alias("rejudged_ok"), n(~F.col("correct") & (F.col("status") != "ok")).alias("rejudged_errors"), n(ok & F.col("is_correct")).alias("recovered"))
    share = lambda c: F.coalesce(F.try_divide(c, F.col("n")), F.lit(0.0))
    return stats.withColumns({"unresolved": F.col("n") - F.col("original_correct") - F.col("rejudged_ok"), "original_acc": share(F.col("original_correct")), "accurate_acc": share(F.col("original_correct") + F.col("recovered"))})


def rejudge_metrics(rows: DataFrame, cache: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Calls, cache hits, flips, failures and short cuts of a batch of candidates (state, cache_key): A17, J7."""
    judged = rows.where("state = 'judge'").join(cache.select("cache_key", F.col("verdict").alias("cached")), "cache_key", "left").join(verdicts.select("cache_key", "verdict"), "cache_key", "left")
    miss = F.col("cached").isNull()
    counts = judged.agg(F.countDistinct(F.when(miss, F.col("cache_key"))).alias("called"), F.sum((~miss).cast("long")).alias("cache_hits"), F.sum(F.coalesce("cached", "verdict", F.lit(False)).cast("long")).alias("flipped"), F.countDistinct(F.when(miss & F.col("verdict").isNull(), F.col("cache_key"))).alias("api_failures"))
    seen = rows.agg(F.sum((F.col("state") == "empty").cast("long")).alias("short_circuit_empty"), F.sum((F.col("state") != "not_judged").cast("long")).alias("total_zero_reward"))
    both = counts.unionByName(seen, allowMissingColumns=True)  # a row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def upgraded(records: DataFrame) -> DataFrame:
    """Flat and nested judge records as one shape: P22, D11."""
    either = lambda nested, flat: F.coalesce(F.col(nested), F.col(flat))
    return records.select(
        "index", F.coalesce("status", F.lit("error")).alias("status"), either("gold.answer_raw", "gold_answer_raw").alias("answer_raw"), either("candidate.response", "candidate_response").alias("response"),
        F.coalesce("judge.is_correct", "judge_is_correct", F.lit(False)).alias("is_correct"), F.coalesce("judge.reason", "judge_reason", F.lit("")).alias("reason"), F.coalesce("judge.attempts", "attempts", F.lit(0)).alias("attempts"),
    )


def judge_response(c: Column) -> Column:
    """struct(is_correct, final_answer, reason) of a judge's JSON; null unless is_correct is a JSON boolean: P30."""
    v = X.json_object(c)
    flag = F.try_variant_get(v, "$.is_correct", "boolean")
    typed = F.schema_of_variant(F.try_variant_get(v, "$.is_correct", "variant")) == "BOOLEAN"
    text = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")).alias(name)
    return F.when(F.coalesce(typed, F.lit(False)), F.struct(flag.alias("is_correct"), text("final_answer"), text("reason")))


def token_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of the included and none of the excluded in a path, in any case; no includes: all: F7, F8."""
    low = F.lower(path)
    hits = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))
    return (hits(include) if include else F.lit(True)) & (~hits(exclude) if exclude else F.lit(True))


def prompt_batches(rows: DataFrame, chunk: Column, order: str, text: Column, separator: str = "\n\n---\n\n") -> DataFrame:
    """Judge prompts of a chunk joined in order: P28."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t"))))
    return rows.groupBy(chunk.alias("chunk")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("prompt"), F.count("*").alias("n"))
