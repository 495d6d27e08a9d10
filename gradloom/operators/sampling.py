"""Curriculum sampling: apportionment, ranked buckets, value groups, stages, seeded orders.

Random orders are by md5 of (seed, iteration, repeat, id): the same in every run, wherever a row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import placed


def order_key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else (p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def apportioned(weights: DataFrame, by: str, total: Column) -> DataFrame:
    """``weights`` (by, key, weight) with ``quota``: largest remainders, ties by weight, then key, descending: C1.

    Weights of 0 or less get nothing.  Windows run over the few keys of a stage.
    """
    own, each = F.greatest("weight", F.lit(0.0)), Window.partitionBy(by)
    rows = weights.withColumn("total", total).withColumn("raw", F.col("total") * own / F.greatest(F.sum(own).over(each), F.lit(1e-12)))
    rows = rows.withColumn("whole", F.floor("raw")).withColumn("positive", F.col("weight") > 0)
    left = F.col("total") - F.sum("whole").over(each)
    nth = F.row_number().over(each.orderBy(F.col("positive").desc(), F.round(F.col("raw") - F.col("whole"), 9).desc(), F.col("weight").desc(), F.col("key").desc()))
    any_ = F.max("positive").over(each)
    return rows.withColumn("quota", F.when(any_ & (F.col("total") > 0), F.col("whole") + F.when(F.col("positive") & (nth <= left), 1).otherwise(0)).otherwise(0).cast("bigint")).drop("total", "raw", "whole", "positive")


def ranked(rows: DataFrame, score: str, row_id: str, descending: bool = True) -> DataFrame:
    """``rows`` with ``position`` from 0 by score, ties by id; a null score is the lowest."""
    score_ = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    return placed(rows, score_.desc() if descending else score_.asc(), F.col(row_id).asc())


def ranked_buckets(rows: DataFrame, score: str, row_id: str, weights: list[tuple[str, float]], descending: bool = True) -> DataFrame:
    """``rows`` with the ``bucket`` that their rank falls in, sized by the weights: C2.  Every row has one, if any weight is positive."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([("all", name, float(w), i) for i, (name, w) in enumerate(weights)], "stage string, key string, weight double, nth int")
    quotas = apportioned(parts, "stage", F.lit(rows.count()))
    upto = F.sum("quota").over(Window.orderBy("nth"))
    edges = quotas.select(F.col("key").alias("bucket"), (upto - F.col("quota")).alias("lo"), upto.alias("hi"))
    return ranked(rows, score, row_id, descending).join(F.broadcast(edges), (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi"))).drop("lo", "hi")


def grouped_by_value(rows: DataFrame, value: str, groups: dict[str, list[str]]) -> DataFrame:
    """``rows`` with the ``group`` that lists their trimmed value; others have null: C2's companion, J4."""
    lookup = {v.strip(): g for g, values in groups.items() for v in values}
    table = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    return rows.withColumn("group", table[F.trim(F.col(value).cast("string"))])


def group_key(source: Column, group: Column) -> Column:
    return F.concat_ws(":", F.trim(source), F.trim(group))


def parsed_group_key(key: Column) -> Column:
    """struct(source, group) of ``source:group``; anything else is an error: P9."""
    trimmed = F.trim(key)
    source, group = F.substring_index(trimmed, ":", 1), F.expr("1")
    group = F.substring(trimmed, F.length(source) + 2, F.length(trimmed))
    return F.when((F.instr(trimmed, ":") > 1) & (F.length(group) > 0), F.struct(source.alias("source"), group.alias("group"))).otherwise(F.raise_error(F.concat(F.lit("no source:group key: "), trimmed)))


def validated_stages(stages: list[dict], iterations: int) -> list[dict]:
    """Stages by start; each needs a positive weight and none below 0, and together they cover 1 .. iterations: C3."""
    out = sorted(stages, key=lambda s: s["start"])
    expected = 1
    for s in out:
        weights = s["weights"]
        if any(w < 0 for w in weights.values()) or not any(w > 0 for w in weights.values()):
            raise ValueError(f"stage {s['name']}: weights must not be negative, and one must be positive")
        if s["start"] != expected or s["end"] < s["start"]:
            raise ValueError(f"stage {s['name']}: starts at {s['start']}, expected {expected}")
        expected = s["end"] + 1
    if expected - 1 != iterations:
        raise ValueError(f"stages cover {expected - 1} of {iterations} iterations")
    return out


def stage_of(iterations: DataFrame, stages: DataFrame) -> DataFrame:
    """Joins the stage whose interval has the iteration; stages are few: J5."""
    return iterations.join(F.broadcast(stages), (F.col("iteration") >= F.col("start")) & (F.col("iteration") <= F.col("end")))


def sampled(pool: DataFrame, n: int, seed: int, iteration: int, row_id: str = "row_id") -> DataFrame:
    """``n`` rows of a pool in a seeded order; a pool smaller than n is gone through again in another order: C4, C9.

    No row comes twice before all have come.
    """
    size = pool.count()
    if not size or n <= 0:
        return pool.limit(0).withColumn("repeat", F.lit(0)).withColumn("place", F.lit(0).cast("bigint"))
    key = order_key(seed, iteration, F.col("repeat"), row_id)
    whole = n // size  # passes through the whole pool, then the first rows of one more
    last = pool.withColumn("repeat", F.lit(whole)).withColumn("__o", key).orderBy("__o", row_id).limit(n - whole * size)
    if whole:
        passes = pool.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))).withColumn("__o", key)
        last = passes.unionByName(last)
    return placed(last, F.col("repeat"), F.col("__o"), F.col(row_id)).withColumnRenamed("position", "place").drop("__o")


def epoch_batches(pool: DataFrame, n: int, seed: int, iterations: int, row_id: str = "row_id") -> DataFrame:
    """(iteration, epoch, row_id): batches of ``n`` from a cursor over orders that change every epoch: C5."""
    size = pool.count()
    if not size:
        return pool.select(F.lit(0).alias("iteration"), F.lit(0).alias("epoch"), row_id).limit(0)
    epochs = F.sequence(F.lit(0), F.lit(-(-n * iterations // size) - 1))
    ordered = pool.select(row_id, F.explode(epochs).alias("epoch")).withColumn("o", order_key(seed, "epoch", row_id))
    at = placed(ordered, F.col("epoch"), F.col("o"), F.col(row_id))  # every epoch has the whole pool, so this is the cursor
    return at.where(F.col("position") < n * iterations).select(F.floor(F.col("position") / n).cast("int").alias("iteration"), "epoch", row_id)


def mixture(pools: DataFrame, quotas: DataFrame, seed: int, iteration: int) -> DataFrame:
    """``pools`` (key, row_id, ...) joined to ``quotas`` (key, quota): that many rows of each key in a seeded order: C6, C7.

    A key's first rows are found in 64 parts and then among what these leave, so a hot pool is no hot task.
    """
    o = order_key(seed, iteration, 0, "row_id")
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("o", "row_id"))
    rows = pools.withColumn("o", o).join(F.broadcast(quotas.where("quota > 0").select("key", "quota")), "key")
    rows = rows.withColumn("nth", nth("key", F.pmod(F.hash("row_id"), F.lit(64)))).where(F.col("nth") <= F.col("quota"))
    return rows.withColumn("nth", nth("key")).where(F.col("nth") <= F.col("quota")).select(*[c for c in pools.columns], F.concat_ws(":", "key", F.col("row_id").cast("string")).alias("question_id"))


def chunked(rows: DataFrame, n: int, *order: Column, name: str = "batch") -> DataFrame:
    """``rows`` with the number of their batch of ``n`` in an order that has no ties; the last may be smaller: C14."""
    if n < 1:
        raise ValueError("a batch has a row at least")
    return placed(rows, *order, name=name).withColumn(name, F.floor(F.col(name) / n))


def concatenated(parts: list[DataFrame], row_id: str) -> DataFrame:
    """Sources one after another (X1): their columns with ``source`` (its number), ``local_index`` and ``global_index``, by id.

    All are dealt and numbered together, once; a source's offset is its first global index.
    """
    rows = parts[0].withColumn("source", F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        rows = rows.unionByName(more.withColumn("source", F.lit(i)))
    rows = placed(rows, F.col("source"), F.col(row_id), name="global_index")
    offsets = rows.groupBy("source").agg(F.min("global_index").alias("offset"))
    return rows.join(F.broadcast(offsets), "source").withColumn("local_index", F.col("global_index") - F.col("offset")).drop("offset")  # a row a source


def stage_records(source: str, rows: DataFrame, row_id: str = "row_id", part: str | None = None, group: str | None = None) -> DataFrame:
    """(source_dataset, row_id, part, grp) of rows that a stage takes from a source; what a source lacks is null: P8."""
    named = lambda c, as_: (F.lit(None) if c is None else F.col(c)).cast("string").alias(as_)
    return rows.select(F.lit(source).alias("source_dataset"), F.col(row_id).alias("row_id"), named(part, "part"), named(group, "grp"))


def built_stage(records: list[DataFrame], seed: int, number: int) -> DataFrame:
    """A stage's rows, of all its sources, with the ``shuffle_key`` that orders them; the seed moves by 1009 a stage: C8, P35."""
    rows = records[0]
    for more in records[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("shuffle_key", order_key(seed + 1009 * number, 0, 0, F.concat_ws(":", "source_dataset", F.col("row_id").cast("string"))))


def source_counts(stage: DataFrame) -> DataFrame:
    """A2."""
    return stage.groupBy("source_dataset").agg(F.count("*").alias("n"))
