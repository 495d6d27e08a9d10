"""Exact positions of rows in a total order, over all rows or within groups, from one shuffle.

Rows are dealt by ranges of the order, sorted within their ranges, numbered there and written once with these numbers, so
every later use sees the same ranges.  A row's position is its number in its range plus what the earlier ranges hold:
one small row a range (and group), never a sort or a window of all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch

_BITS = 33  # monotonically_increasing_id holds the partition above the row's number


def placed(rows: DataFrame, *order: Column, within: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """``rows`` with ``name`` (long, from 0): their place by ``order``, of all rows or of those with equal ``within``.

    Nulls of ``within`` are a value of their own.  Rows that ``order`` doesn't tell apart share a range, in any order.
    A column ``name`` is replaced; an empty table gives an empty result.  A group with most of the rows is as many ranges
    as its size asks for.
    """
    spark = rows.sparkSession
    groups = [F.col(c) for c in within]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *groups, *order).sortWithinPartitions(*groups, *order).withColumn("__at", F.monotonically_increasing_id())
    path = scratch(spark, "placed")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).withColumn("__part", F.shiftright("__at", _BITS)).withColumn("__nth", F.col("__at").bitwiseAND((1 << _BITS) - 1)).drop("__at")
    spans = dealt.groupBy("__part", *within).agg(F.min("__nth").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    spans = spans.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(within)], (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__before"))
    met = F.col("__part") == F.col("__of")
    for i, c in enumerate(within):
        met &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    joined = dealt.join(spans if within else F.broadcast(spans), met)  # without groups a row per range, else one per range and group
    return joined.withColumn(name, F.col("__before") + F.col("__nth")).select(*[c for c in rows.columns if c != name], name)
