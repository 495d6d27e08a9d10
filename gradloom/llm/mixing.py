"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source whose target is q times its size takes floor(q) copies of each of its documents and one more of some,
each with probability q - floor(q).  Which documents get the extra copy is settled by the pivotal method in units of
words: two undecided documents exchange expected words, in a random direction that leaves both probabilities unbiased,
until one of them is sure to be taken or left; the other stays undecided and meets the next.  Since expected words only
move, the words a source takes differ from its target by less than one document.

Documents are dealt by hash into chunks of about ``fan_in``; each chunk leaves one undecided document, and these meet
in chunks of ``fan_in`` again, level by level, until a source has one left, which a coin settles.  A source with a third
of all rows is as many chunks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, documents, unit, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    ``sizes``: (source, size).  Targets are min(most * source_size, level * weight), the level being the one at which
    they add up to ``share`` of all sizes: what iterated resharing of the excess ends at.
    The table has one row per source, so its windows run over a small dimension.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("weight", nth).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.col("capped_before")) / F.col("weight_from"))
        # the first source, by ratio, that the level doesn't fill marks where the capped ones end
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def _meet(state: Column, x: Column, salt: Column) -> Column:
    """Folds the undecided document ``x`` into a chunk's state (held: the undecided one so far; done: the decided)."""
    a, words = state["held"], lambda u, p: p * u["size"]
    up = F.least(words(a, 1 - a["p"]), words(x, x["p"]))  # words that can move to a
    down = F.least(words(a, a["p"]), words(x, 1 - x["p"]))  # words that can move to x
    to_a = unit(salt, a["tie"], x["tie"]) * (up + down) < down
    a_one = words(a, 1 - a["p"]) <= words(x, x["p"])
    a_zero = words(a, a["p"]) <= words(x, 1 - x["p"])
    done = lambda u, extra: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), F.lit(extra).alias("extra"))
    held = lambda u, p: F.struct(u["tie"].alias("tie"), u["doc_id"].alias("doc_id"), u["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))
    next_state = lambda keep, gone: F.struct(keep.alias("held"), F.concat(state["done"], F.array(gone)).alias("done"))
    return (
        F.when(a.isNull(), F.struct(held(x, x["p"]).alias("held"), state["done"].alias("done")))
        .when(to_a & a_one, next_state(held(x, x["p"] - up / x["size"]), done(a, 1)))
        .when(to_a, next_state(held(a, a["p"] + up / a["size"]), done(x, 0)))
        .when(a_zero, next_state(held(x, x["p"] + down / x["size"]), done(a, 0)))
        .otherwise(next_state(held(a, a["p"] - down / a["size"]), done(x, 1)))
    )


_UNIT = "struct<tie:bigint,doc_id:bigint,size:bigint,p:double>"
_STATE = f"struct<held:{_UNIT},done:array<struct<doc_id:bigint,size:bigint,extra:int>>>"


def _level(units: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, chunk, held, done): each chunk of ``units`` (source, chunk, u) folded."""
    empty = F.lit(None).cast(_STATE)
    empty = F.coalesce(empty, F.struct(F.lit(None).cast(_UNIT).alias("held"), F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>").alias("done")))
    folded = F.aggregate(F.array_sort(F.collect_list("u")), empty, lambda s, x: _meet(s, x, F.lit(seed * 64 + level)))
    return units.groupBy("source", "chunk").agg(folded.alias("f")).select("source", "chunk", "f.held", "f.done")


def pivotal_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, fan_in: int = 64) -> DataFrame:
    """``sizes`` (doc_id long, source string, size long; one row per document) with the copies the mix takes of each.

    Returns doc_id, source, size, source_size, target, copies (int).  Null sources are a source of their own, the last.
    Documents of size 0 get floor(q) copies of nothing; repeated rows are mixed as rows of their own; an empty table
    gives an empty result.  The result depends on the rows and ``seed`` alone, so reruns agree.
    """
    sizes = written(sizes.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("size").cast("long")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(q + 1e-12).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), q - whole))
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0

    docs = sizes.join(targets.withColumnRenamed("source", "source_of"), F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")
    settled = docs.where((F.col("size") <= 0) | (F.col("p") <= 1e-12)).select("doc_id", "source", "size", F.lit(0).alias("extra"))
    tie = F.xxhash64(F.lit(seed), "doc_id", "size")
    chunk = F.pmod(tie, F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / fan_in)))
    units = docs.where((F.col("size") > 0) & (F.col("p") > 1e-12)).select("source", chunk.alias("chunk"), F.struct(tie.alias("tie"), "doc_id", "size", "p").alias("u"))
    parts, n, level = [settled], max(1, -(-most_docs // fan_in)), 0
    while True:
        folded = written(_level(units, level, seed), f"mix-level{level}")
        parts.append(folded.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.extra"))
        if n == 1:
            break
        units = folded.where(F.col("held").isNotNull()).select("source", F.floor(F.col("chunk") / fan_in).alias("chunk"), F.col("held").alias("u"))
        n, level = -(-n // fan_in), level + 1
    coin = unit(F.lit(seed), F.lit(-1), F.col("held.tie")) < F.col("held.p")
    parts.append(folded.where(F.col("held").isNotNull()).select("held.doc_id", "source", "held.size", coin.cast("int").alias("extra")))
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.unionByName(part)
    about = targets.select(F.col("source").alias("source_of"), "source_size", "target", "whole")
    mixed = mixed.join(about, F.col("source").eqNullSafe(F.col("source_of")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def word_count(text: str) -> Column:
    """Words of a whole text; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every document."""
    return docs.select("doc_id", "source", word_count("text").alias("size"))


def op9_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = pivotal_mix(document_sizes(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source")
