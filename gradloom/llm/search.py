"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Every component of a chunk of vectors has a list of them sorted by that component.  A query reads its lists from the end
that helps it most, all in step and only sequentially.  A vector not met so far has at most the sum of the values read
last; when that is under the query's threshold, only vectors met can qualify.  Of these the lists' first components are
added up for a whole tile of queries by a matrix product; what the unread ones can still add is at most the product of
both rests' lengths (Cauchy and Schwarz), one more column of that product.  Vectors whose upper bound reaches the
threshold get their final scores.  Where vectors have no direction of their own, every vector is met and most components
must be read before a bound excludes anything; then the product is close to all scores, and nothing cheaper is exact.

A query's threshold is its k-th best score in any vectors looked at before: those of a first pass over a part of all
vectors, and of its own chunks so far.  It is a lower bound of the k-th best score of all, so it never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, trimmed

BLOCK = 4096  # vectors whose lists are sorted together
TILE = 768  # queries, and vectors, whose bounds are one product: few enough for a core's cache
PART = 1 << 24  # components, of queries or of vectors, that a task holds: 32 MB as they are packed
FIRST = 1 << 17  # vectors of the first pass, at most
_DEPTHS = (0, 64, 16, 4)  # lists are read to none, a 64th, a 16th, a quarter of a chunk, or to the end
_SCORED = 20000  # what a pair costs whose bound reaches a threshold, in components of a product
_WAITING = 1 << 16  # pairs whose final scores are taken at once


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))


def _where(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true flags; rows are looked at first, then words of eight."""
    some = np.flatnonzero(flags.any(axis=1))
    if not len(some):
        return some, some
    columns = flags.shape[1]
    flags = (flags if 2 * len(some) > len(flags) else flags[some]).reshape(-1)
    words = len(flags) // 8
    eights = np.flatnonzero(flags[: 8 * words].view(np.uint64))
    i, j = np.nonzero(flags[: 8 * words].reshape(words, 8)[eights])
    i, j = np.divmod(np.concatenate([8 * eights[i] + j, 8 * words + np.flatnonzero(flags[8 * words :])]), columns)
    return (i if len(flags) > columns * len(some) else some[i]), j


def _heads(rows: np.ndarray, head: int, kind: type) -> np.ndarray:
    """The first components, the length of the rest, and 1; queries have their threshold there instead, negative."""
    out = np.ones((len(rows), head + 2), kind)
    out[:, :head], out[:, head] = rows[:, :head], _lengths(rows[:, head:])
    return out


class _Chunk:
    """Some vectors (ascending ids) as lists: where reading may stop, and the rows that bounds are made of."""

    def __init__(self, first: int, vectors: np.ndarray, head: int, kind: type):
        self.first, n = first, len(vectors)
        lists = np.sort(vectors.T.astype(kind), axis=1)
        self.stops, highest, lowest = [], [], []  # of each depth the vectors met
        for share in _DEPTHS:
            depth = n // share if share else 0
            high, low = lists[:, n - 1 - depth], lists[:, depth]
            met = np.flatnonzero(((vectors > high) | (vectors < low)).any(axis=1)) if depth else np.zeros(0, np.int64)
            if 2 * len(met) < n:  # else reading to the end costs no more
                self.stops.append(met)
                highest.append(high)
                lowest.append(low)
        self.ends = np.concatenate([highest, lowest], axis=1).T.astype(np.float64)
        self.rows = _heads(vectors, head, kind)

    def reach(self, signed: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray | slice]]:
        """(rows of queries, places of vectors) that the lists leave: nothing else in the chunk comes to a query's limit.

        ``signed``: the queries' positive components, beside them the negative ones.
        """
        unmet = signed @ self.ends
        done = unmet + 1e-9 * np.abs(unmet) < limit[:, None]
        at = np.where(done.any(axis=1), done.argmax(axis=1), len(self.stops))
        if (at == len(self.stops)).all():
            yield slice(None), slice(None)
            return
        for stop in np.unique(at):
            places = slice(None) if stop == len(self.stops) else self.stops[stop]
            if stop == len(self.stops) or len(places):
                yield np.flatnonzero(at == stop), places


def _head(queries: np.ndarray, limit: np.ndarray, vectors: np.ndarray) -> int:
    """How many components to read before a vector's bound is judged, by the bounds of some of the pairs."""
    dim = vectors.shape[1]
    known = np.flatnonzero(np.isfinite(limit))
    if dim < 16 or 2 * len(known) < len(limit):
        return dim
    some = known[:: -(-len(known) // 256)]
    q, v, limit = queries[some].astype(np.float64), vectors[:: -(-len(vectors) // 512)].astype(np.float64), limit[some, None]
    costs = {dim: dim}
    for head in range(8, dim - 3, 4):
        bound = q[:, :head] @ v[:, :head].T + _lengths(q[:, head:])[:, None] * _lengths(v[:, head:])
        costs[head] = head + 1 + _SCORED * (bound >= limit).mean()
    return min(costs, key=costs.get)


def top_of_part(q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best vectors that don't have its own id and score ``floor`` at least.

    Both are queries by k, best first, ties by smaller ids; a score of minus infinity is none.
    """
    scores, best = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
    if not len(queries) or not len(vectors):
        return scores, best
    order = np.argsort(ids, kind="stable")  # ids ascend from chunk to chunk, so a later tie never goes first
    energy = [np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (queries, vectors)]
    axes = np.argsort(-energy[0] * energy[1], kind="stable")
    ids, vectors, queries = ids[order], vectors[order].take(axes, axis=1), queries.take(axes, axis=1)
    most = _lengths(queries).max() * _lengths(vectors).max()
    # sums of whole numbers under 2**24 are exact in single precision, in any order; a threshold is subtracted too
    exact = bool(queries.dtype == vectors.dtype == np.int16 and most < 1 << 23)
    kind, dim, head = np.float32 if exact else np.float64, queries.shape[1], _head(queries, floor, vectors)
    slack = 0.0 if exact and head == dim else 4 * (dim + 8) * float(np.finfo(kind).eps) * most
    step, chunks, at = min(block, 64), [], 0  # few at first: later ones must be better than the k best of these
    while at < len(vectors):
        chunks.append(_Chunk(at, vectors[at : at + step], head, kind))
        at, step = at + step, min(block, 2 * step)
    product, reached = np.empty(TILE * TILE, kind), np.empty(TILE * TILE, bool)
    for tile in range(0, len(queries), TILE):
        q, own, limit = queries[tile : tile + TILE], q_ids[tile : tile + TILE], floor[tile : tile + TILE].copy()
        top, top_ids, heads = scores[tile : tile + TILE], best[tile : tile + TILE], _heads(q, head, kind)
        signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1, dtype=np.float64)

        def settle(hits: list, q=q, own=own, top=top, top_ids=top_ids, limit=limit) -> None:
            """Final scores of vectors whose bounds reach a limit, in ascending order by query; raises the limits."""
            rows, places = (np.concatenate(x) for x in zip(*hits, strict=True))
            for lo in range(0, len(rows), _WAITING):
                i, j = rows[lo : lo + _WAITING], places[lo : lo + _WAITING]
                score = np.einsum("ij,ij->i", q[i].astype(kind), vectors[j].astype(kind)).astype(np.float64)
                keep = (score >= limit[i]) & (own[i] != ids[j])
                if keep.any():
                    _merge(top, top_ids, i[keep], ids[j[keep]], score[keep])
                    worst = top[:, -1]  # a later vector must be better; -inf while there are fewer than k
                    np.maximum(limit, worst + 1 if exact else np.where(np.isneginf(worst), worst, np.nextafter(worst, np.inf)), out=limit)

        for chunk in chunks:
            hits, waiting = [], 0
            heads[:, -1] = np.minimum(slack - limit, 2 * most + 1)  # without a threshold all bounds reach it
            for rows, places in chunk.reach(signed, limit):
                left, right = heads[rows], chunk.rows[places]
                for lo in range(0, len(right), TILE):
                    shape = len(left), len(right[lo : lo + TILE])
                    n = shape[0] * shape[1]
                    np.matmul(left, right[lo : lo + TILE].T, out=product[:n].reshape(shape))
                    i, j = _where(np.greater_equal(product[:n], 0, out=reached[:n]).reshape(shape))
                    hits.append((i if isinstance(rows, slice) else rows[i], chunk.first + (j + lo if isinstance(places, slice) else places[j + lo])))
                    waiting += len(i)
                    if waiting > _WAITING:  # many ties
                        settle(hits)
                        hits, waiting = [], 0
            if waiting:
                settle(hits)
    return scores, best


def _merge(scores: np.ndarray, best: np.ndarray, rows: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
    """Puts what was found of some queries into their k best; ties go to what is there, then to smaller ids."""
    k = scores.shape[1]
    order = np.lexsort((ids, -found, rows))
    rows, ids, found = rows[order], ids[order], found[order]
    owner, first, number = np.unique(rows, return_index=True, return_inverse=True)
    place = np.arange(len(rows)) - first[number]
    take = place < k
    both = np.full((len(owner), 2 * k), -np.inf)
    both_ids = np.zeros((len(owner), 2 * k), np.int64)
    both[:, :k], both_ids[:, :k] = scores[owner], best[owner]
    both[number[take], k + place[take]], both_ids[number[take], k + place[take]] = found[take], ids[take]
    order = np.argsort(-both, axis=1, kind="stable")[:, :k]
    scores[owner], best[owner] = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_ids, order, axis=1)


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """(dim, part, n, ids, block): vectors dealt to parts by what they are; those a task meets go as few binary values."""

    def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, part, v = (table.column(c).combine_chunks() for c in ("id", "part", "v"))
        ids, part = ids.to_numpy(zero_copy_only=False).astype("<i8"), part.to_numpy(zero_copy_only=False)
        dims, values = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(dims) - dims
        order = np.lexsort((part, dims))
        cuts = np.flatnonzero((np.diff(dims[order]) != 0) | (np.diff(part[order]) != 0)) + 1
        out = []
        for own in np.split(order, cuts):
            dim = int(dims[own[0]])
            block = values[starts[own][:, None] + np.arange(dim)]
            with np.errstate(invalid="ignore"):
                short = block.astype("<i2")
            out.append((dim, int(part[own[0]]), len(own), ids[own].tobytes(), (short if np.array_equal(short, block) else block.astype("<f8")).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["dim", "part", "n", "ids", "block"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > 32 << 20:
                yield from packs(held)
                held, size = [], 0
        if held:
            yield from packs(held)

    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"))
    return dealt.mapInArrow(trimmed(pack), "dim int, part int, n int, ids binary, block binary")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, thresholds): all packs of a table, which have one dimension."""
    ids, blocks, floors = [np.zeros(0, "<i8")], [], [np.zeros(0)]
    for r in table.to_batches(max_chunksize=1):
        dim, n, own, block = (r.column(c)[0] for c in ("dim", "n", "ids", "block"))
        n, dim = n.as_py(), dim.as_py()
        ids.append(np.frombuffer(own.as_buffer(), "<i8"))
        blocks.append(np.frombuffer(block.as_buffer(), "<f8" if len(block.as_buffer()) == 8 * n * dim else "<i2").reshape(n, dim))
        floors.append(np.frombuffer(r.column("floors")[0].as_buffer(), "<f8") if "floors" in table.column_names else np.full(n, -np.inf))
    return np.concatenate(ids), np.concatenate(blocks) if blocks else np.zeros((0, 0)), np.concatenate(floors)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """``vectors`` and ``queries``: (id long, v array<double> of whole numbers).  Returns query_id, rank, id, score.

    Each query's k best vectors that don't have its own id, ties to smaller ids; all of them where there are fewer.
    Vectors of another dimension than the query's don't meet it; repeated ids are rows of their own; empty tables give
    no rows.  A task holds a part of the vectors and a group of the queries, so every group is sent to every part; both
    are bounded (``PART``), whatever the tables' sizes.
    """
    bounded_batches(vectors.sparkSession)
    sizes = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("m")).first() for df in (vectors, queries)]
    (n, m), (_, q_m) = sizes
    parts, groups = max(1, -(-m // PART), min(64, -(-n // block))), max(1, -(-q_m // PART))
    fine = groups * max(1, -(-q_m // (groups * PART // 32)))  # groups of the first pass; a group of the second is some of them
    left, right = _packed(queries, fine), _packed(vectors, parts)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    if parts >= 16:
        share = max(16, n // FIRST)
        some = _packed(vectors.where(F.pmod(F.xxhash64("id", F.lit(share)), F.lit(share)) == 0), 1).withColumn("part", each(fine))

        def first(q: pa.Table, v: pa.Table) -> pa.Table:
            (q_ids, own, floors), (ids, others, _) = _unpacked(q), _unpacked(v)
            if len(ids):
                floors = top_of_part(q_ids, own, floors, ids, others, k, block)[0][:, -1]
            head = [[q.column(c)[0].as_py()] for c in ("dim", "part")] if len(q_ids) else [[], []]
            rest = [[len(q_ids)], [q_ids.tobytes()], [own.tobytes()], [floors.tobytes()]] if len(q_ids) else [[]] * 4
            return pa.table([pa.array(c, t) for c, t in zip(head + rest, (*[pa.int32()] * 3, *[pa.binary()] * 3), strict=True)], ["dim", "part", "n", "ids", "block", "floors"])

        keys = ["dim", "part"]
        left = left.repartition(2 * fine, *keys).groupBy(*keys).cogroup(some.repartition(2 * fine, *keys).groupBy(*keys)).applyInArrow(_task(first), "dim int, part int, n int, ids binary, block binary, floors binary")

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        (q_ids, own, floors), (ids, others, _) = _unpacked(q), _unpacked(v)
        scores, best = top_of_part(q_ids, own, floors, ids, others, k, block)
        rows, columns = np.nonzero(np.isfinite(scores))
        return pa.table({"query_id": q_ids[rows], "id": best[rows, columns], "score": scores[rows, columns].astype("int64")})

    keys, tasks = ["dim", "q_group", "part"], 4 * groups * parts  # more than there are pairs, so that few meet in one task
    left = left.withColumn("q_group", F.floor(F.col("part") * groups / fine).cast("int")).withColumn("part", each(parts))
    right = right.withColumn("q_group", each(groups))
    found = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(_task(search), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _task(function):
    """``function`` of two tables, giving memory back when it ends."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return list(trimmed(lambda pairs: [function(*pairs)])((left, right)))[0]

    return run


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * component) of vectors that have only finite components; others take no part."""
    finite = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(finite).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = exact_top_k(rows, rows.where("id % 50 = 0"))
    return found.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
