"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of k-word shingles.  Shingles are ordered rare first: those that no other document has, then those
of few documents, then frequent ones (exact document counts decide, through a filter of bounded size), ties by hash.  Two
sets with a similarity of t or more share a shingle in the first n - ceil(t n) + 1 of each, so only prefix shingles that
two documents have are joined, and most documents have none.

Equal sets become one entity first.  Within the entities of a prefix shingle a pivot (the one with the largest share of
frequent shingles) is paired with all others, never all with all: pairs pass the length and positional filters, are made
distinct, bounded by the suffix filter, and verified once.  Entities that have become connected need no more pairs.
An entity is weak at a shingle if those it shares with anyone, from there on, are under 2t / (1 + t) of its own; two weak
ones can't be similar enough, so documents that merely have a popular passage in common aren't paired.  Rounds with
further pivots go on, three at most, while there are many unconnected pairs; then all left, of like length, that pass the
filters are verified, so that no link between components is missed.  Shingles and components that many rows have are dealt
over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import repeated_hashes
from .shared import bounded_batches, documents, spread_join, text_bytes, trimmed, written
from .text import mix, shingle_hashes, slices, text_buffer, word_bounds, word_hashes

#: Similarity that links, in hundredths.
LINK = 75


#: A shingle is hot if it has over one in ``HOT`` of all prefix rows; it is dealt over a task for each such share, ``SALTS``
#: at most.  All hot shingles together are dealt over 2 * ``HOT`` tasks at most, so what meets them there stays few rows.
HOT, SALTS = 1024, 64


def row_key() -> Column:
    """A row's id and text as one number, the same for repeated rows."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def batch_shingles(texts: pa.Array, k: int):
    """(first document, end, hashes, document from first) for runs of documents of a batch; repeats within one stay."""
    data, offsets = text_buffer(texts)
    for lo, hi in slices(offsets):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, doc = word_bounds(own, at)
        hashes, docs = shingle_hashes(word_hashes(own, starts, ends), doc, hi - lo, k)
        yield lo, hi, hashes, docs


def shingle_sets(docs: DataFrame, k: int, link: int) -> DataFrame:
    """row, doc_id, n, set_id (null for empty sets), c, often, prefix, places, shingles.

    row: a hash of id and text, one for repeated rows.
    c: how many shingles others have; often: the share of frequent ones; prefix: those of them in the prefix, places: where they stand among the c in order.

    ``shingles`` (packed, ascending) is null where the prefix has nothing in common with others.
    """
    spark = docs.sparkSession
    n_hashes = text_bytes(docs) / 5

    def hashes(batch):
        for _, _, h, doc in batch_shingles(batch.column(0), k):
            yield h, doc

    shared = spark.sparkContext.broadcast(repeated_hashes(docs.select("text"), hashes, n_hashes))
    bounded_batches(spark)

    def sets(batches):
        for batch in batches:
            for lo, hi, h, doc in batch_shingles(batch.column(2), k):
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                level, n = shared.value.level(h), np.bincount(doc, minlength=hi - lo)
                end = np.cumsum(n)
                start = end - n
                ids = np.bitwise_xor(np.add.reduceat(np.append(mix(h), np.uint64(0)), np.minimum(start, len(h))), n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)
                length = n - (-(-link * n // 100)) + 1
                alone = np.bincount(doc[level == 0], minlength=hi - lo)
                prefix, places, packed = [None] * len(n), [None] * len(n), [None] * len(n)
                for i in np.flatnonzero((n > 0) & (alone < length)):
                    own, rank = h[start[i] : end[i]], level[start[i] : end[i]]
                    by = np.argsort(rank, kind="stable")[: length[i]]
                    by = by[rank[by] > 0]
                    prefix[i], packed[i] = own[by].view(np.int64), own.tobytes()
                    places[i] = np.arange(len(by), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n), pa.array(mix(ids).view(np.int64), mask=n == 0), pa.array(n - alone), pa.array(np.bincount(doc[level > 1], minlength=hi - lo) / np.maximum(n, 1)), pa.array(prefix, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(packed, pa.binary())],
                    ["row", "doc_id", "n", "set_id", "c", "often", "prefix", "places", "shingles"],
                )

    schema = "row long, doc_id long, n long, set_id long, c long, often double, prefix array<long>, places array<int>, shingles binary"
    return docs.select(row_key(), F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(sets), schema)


def _passes(link: int) -> Column:
    """Length and positional filters of a pair x, y whose first common shingle is the one joined on.

    Only shingles that others have, from that one on, can be common: x_left and y_left of them.  Where a pair has an earlier
    common shingle, it passes there, which is in both prefixes.
    """
    at_most = F.least("x_left", "y_left")
    return (100 * F.least("x_n", "y_n") >= link * F.greatest("x_n", "y_n")) & (at_most * (100 + link) >= link * (F.col("x_n") + F.col("y_n")))


def _overlap(a: np.ndarray, b: np.ndarray, needed: int) -> int:
    """Size of the intersection of two ascending arrays, or something under ``needed`` if the suffix filter rules them out."""
    edges = np.arange(1, 8, dtype=np.uint64) << np.uint64(61)
    in_parts = [np.diff(np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])) for x in (a, b)]
    at_most = int(np.minimum(*in_parts).sum())
    if at_most < needed:
        return at_most
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def verified(pairs: DataFrame, entities: DataFrame, link: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough; each pair is compared once."""
    own = entities.select("set_id", "shingles")
    both = pairs.join(own.withColumnsRenamed({"set_id": "a", "shingles": "x"}), "a").join(own.withColumnsRenamed({"set_id": "b", "shingles": "y"}), "b").select("a", "b", "x", "y")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                needed = -(-link * (len(a) + len(b)) // (100 + link))
                keep.append(_overlap(a, b, needed) >= needed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(trimmed(compare), "a long, b long")


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("h", "salt", F.col("set_id").alias(side), F.col("component").alias(f"{side}_in"), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "left", "strong")])


def _by_length(rows: DataFrame, link: int, reach: int) -> DataFrame:
    """``rows`` with the class of their length as ``salt``, also those up to ``reach`` classes off; similar sets are one off at most."""
    own = F.floor(F.log(F.col("n")) * (0.999 / math.log(100 / link))).cast("int")
    return rows.withColumn("salt", F.explode(F.sequence(own - reach, own + reach)) if reach else own)


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spread``, how many tasks their shingle is dealt over, and ``salt``, which of these has the row."""
    counts = written(rows.groupBy("h").agg(F.count("*").alias("m")), "shingle-counts")
    total = counts.agg(F.sum("m")).first()[0] or 0
    shares = F.least(F.lit(SALTS), F.ceil(F.col("m") * HOT / total).cast("int"))
    hot = counts.where(F.col("m") * HOT > total).select("h", shares.alias("spread"))  # fewer than HOT rows
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("spread", F.coalesce("spread", F.lit(1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.col("spread")).cast("int"))


def _everywhere(rows: DataFrame) -> DataFrame:
    """``rows`` once in each of the tasks that their shingle is dealt over."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows whose shingle is in several components, a strong entity among them."""
    several = rows.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("strong").alias("any"), F.max("spread").alias("spread"))
    return rows.join(_everywhere(several.where("lo < hi AND any").select("h", "spread")).drop("spread"), ["h", "salt"])


def jaccard_components(docs: DataFrame, k: int = 5, link: int = LINK, rounds: int = 3, rows_too: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    Texts without words, and null texts, have empty sets, linked with nothing.  Shorter texts than ``k`` words are one
    shingle.  Repeated rows and copies share a component; an empty table gives an empty result; other columns are ignored.
    ``rows_too`` adds ``row``, as ``row_key`` has it, and ``component``, a component's own name (null for empty sets),
    which tells components apart where ids repeat.
    """
    sets = written(shingle_sets(docs.select("doc_id", "text"), k, link), "shingle-sets")
    entities = written(sets.where("shingles IS NOT NULL").dropDuplicates(["set_id"]), "shingle-entities")
    rows = entities.select("set_id", "n", "c", "often", F.explode(F.arrays_zip("prefix", "places")).alias("e"))
    rows = rows.select(F.col("e.prefix").alias("h"), "set_id", "n", "often", (F.col("c") - F.col("e.places")).alias("left"), F.col("set_id").alias("component"))
    rows = rows.withColumn("strong", (100 + link) * F.col("left") >= 2 * link * F.col("n"))
    rows, links, tried = written(_apart(_salted(rows)), "shingle-prefixes"), None, None
    for turn in range(rounds + 1):
        sizes = rows.groupBy("h", "component").agg(F.count("*").alias("m"), F.sum((~F.col("strong")).cast("long")).alias("w")).groupBy("h")
        squares = lambda c: F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))
        n_rows, n_pairs = sizes.agg(F.sum("m").alias("m"), (squares("m") - squares("w")).alias("p")).agg(F.sum("m"), F.sum("p") / 2).first()
        if not n_rows:
            break
        last = turn == rounds or turn > 0 and n_pairs <= 256 * n_rows  # comparisons of numbers, not of sets
        if last:  # one of a pair is strong
            x, y = _by_length(rows, link, 0), _by_length(rows.where("strong"), link, 1)
        else:
            best = F.max_by(F.struct("set_id", "n", "left", "strong", "component", "spread"), F.struct("often", "left", "set_id"))
            pivots = written(rows.groupBy("h").agg(best.alias("p")).select("h", "p.*"), "shingle-pivots")
            x, y = rows, _everywhere(pivots)
        fits = (F.col("x_in") != F.col("y_in")) & (F.col("x_strong") | F.col("y_strong")) & _passes(link)
        pairs = _side(x, "x").join(_side(y, "y"), ["h", "salt"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "shingle-pairs")
        found = written(verified(pairs, entities, link), "shingle-links")
        links = found if links is None else links.unionByName(found)
        if last:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        rows = rows.join(pivots.select("h", "set_id"), ["h", "set_id"], "left_anti").drop("component")
        rows = rows.join(components(links).withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        rows = written(_apart(rows), "shingle-prefixes")
    small = sets.select("row", "doc_id", "n", "set_id")
    if links is None:
        joined = small.withColumn("component", F.col("set_id"))
    else:
        joined = spread_join(small, components(links).withColumnRenamed("node", "set_id"), "set_id", "row").withColumn("component", F.coalesce("component", "set_id"))
    joined = written(joined, "shingle-labels")
    first = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = spread_join(joined, first, "component", "row")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["row", "component"] if rows_too else []))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
