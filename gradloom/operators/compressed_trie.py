"""Path-compressed prefix tries: a row per chain of prefixes that the same sequences pass through, not per prefix.

Sequences are dealt by ranges of (question, tokens) and sorted; a task reads its range once, keeps how many tokens each
shares with the one before, and has a node only where sequences branch or end.  A chain is the depths ``lo`` to ``hi`` of
one of its sequences, with statistics that hold for all of them, so there are at most two chains a sequence.  It carries
the tokens of these depths and the key before them, so prefixes are written out from chains alone and every prefix's token
is kept once.  Tokens travel packed into one string; besides the shuffle that deals them only chains are written.

What a range shares with its neighbours lies on the paths of its first and its last sequence, its rims.  Their prefixes are
summed over all ranges; everything below them is complete where it is.  So a question with most of the rows is as many
ranges as its size asks for, and no prefix is a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import scratch
from .tries import END, ESCAPE, NULL, packed

_END, _ESCAPE = END.encode(), ESCAPE.encode()
_SAMPLES = ("spark.sql.execution.rangeExchange.sampleSizePerPartition", "10")  # a sample is a whole sequence, and the driver gets them all


@dataclass(frozen=True)
class Trie:
    """``sequences``: what was given.  ``chains``: question_id, rollout_index (one of the chain's sequences), lo, hi, visits,
    successes, weight, goes_on (whether a sequence goes on after ``hi``), text (the packed tokens that lead to the depths from
    lo), s1, s2 (the key's sums before them), up_visits, up_successes (of the prefix before lo).  ``own``: the chains without
    these two, for which they would meet the rims.
    ``fates``: per sequence the depth of its last reliable prefix (-1: none) and of its frontier edge (null: none).
    """

    sequences: DataFrame
    chains: DataFrame
    own: DataFrame
    fates: DataFrame


def _tokens(text: bytes) -> list[bytes | None]:
    out = text.split(_END)[:-1]
    if _ESCAPE in text:
        out = [None if t == NULL.encode() else t.replace(_ESCAPE + b"1", _END).replace(_ESCAPE + b"0", _ESCAPE) for t in out]
    return out


def _hashes(tokens: Iterable[bytes | None], depths: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """What a token at its depth adds to the two sums of a prefix's key, as in ``tries.steps``."""
    md5 = hashlib.md5
    own = np.frombuffer(b"".join([md5(b"%d:%b" % (d, t) if t is not None else b"%d" % d).digest() for d, t in zip(depths, tokens, strict=True)]), np.uint8).reshape(-1, 16)
    first = lambda at: (np.ascontiguousarray(own[:, at : at + 8]).view(">u8")[:, 0] >> 24).astype(np.int64)  # noqa: E731  five bytes
    return first(0), first(5)


class _Sequence:
    """A packed sequence, with the ends of its tokens and the sums of its first prefixes; ``shared`` tokens are those of the one before."""

    def __init__(self, text: bytes, before: _Sequence | None = None) -> None:
        self.text, codes = text, np.frombuffer(text, np.uint8)
        self.ends = np.flatnonzero(codes == END.encode()[0])
        self.n = len(self.ends)
        self.shared = text.count(_END, 0, _shared(np.frombuffer(before.text, np.uint8), codes)) if before else 0
        self.sums = [s[: self.shared + 1] for s in before.sums] if before else [np.zeros(1, np.int64)] * 2

    def start(self, i: int) -> int:
        return int(self.ends[i - 1]) + 1 if i else 0

    def sums_to(self, i: int) -> list[np.ndarray]:
        """The sums of prefixes of up to ``i`` tokens at least; only what chains begin after is hashed."""
        k = len(self.sums[0]) - 1
        if k < i:
            news = _hashes(_tokens(self.text[self.start(k) : self.start(i)]), range(k, i))
            self.sums = [np.concatenate([s, s[-1] + np.cumsum(h)]) for s, h in zip(self.sums, news, strict=True)]
        return self.sums


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes two sequences begin with alike; most differ soon."""
    n, done, step = min(len(a), len(b)), 0, 16
    while done < n:
        differs = np.flatnonzero(a[done : min(n, done + step)] != b[done : min(n, done + step)])
        if len(differs):
            return done + int(differs[0])
        done, step = done + step, step * 16
    return n


class _Range:
    """The trie of one range of sorted sequences."""

    def __init__(self) -> None:
        self.hi, self.up, self.rep, self.end, self.new = [], [], [], [], []  # nodes; a sequence's node; the first sequences of questions
        self.stack: list[int] = []

    def _node(self, hi: int, up: int, rep: int) -> int:
        self.hi.append(hi)
        self.up.append(up)
        self.rep.append(rep)
        return len(self.hi) - 1

    def _close(self, shared: int) -> list[int]:
        """Nodes of the last sequence beyond ``shared``, which no other will reach: the sequence is their chains'."""
        hi, up, stack, done = self.hi, self.up, self.stack, []
        while stack and hi[stack[-1]] > shared:
            v = stack.pop()
            if stack and hi[stack[-1]] < shared:  # the chain to v branches here
                up[v] = self._node(shared, stack[-1], -1)
                stack.append(up[v])
            self.rep[v] = len(self.end) - 1
            done.append(v)
        return done

    def add(self, n: int, shared: int) -> list[int]:
        """The next sequence, of ``n`` tokens; ``shared`` with the one before, -1 if the question is another.  Nodes that are closed."""
        done, stack = self._close(shared), self.stack
        if shared < 0:
            self.stack = stack = [self._node(0, -1, -1)]
            self.new.append(len(self.end))
            shared = 0
        if n > shared:
            stack.append(self._node(n, stack[-1], -1))
        self.end.append(stack[-1])
        return done

    def finish(self) -> list[int]:
        return self._close(-1)

    def sums(self, success: np.ndarray, weight: np.ndarray) -> None:
        n = len(self.hi)
        self.depth, self.parent = np.array(self.hi, np.int64), np.array(self.up, np.int64)
        end = np.array(self.end, np.int64)
        visits, wins, mass = np.bincount(end, minlength=n).tolist(), np.bincount(end, success, n).astype(np.int64).tolist(), np.bincount(end, weight, n).tolist()
        self.goes_on = np.zeros(n, bool)
        self.goes_on[self.parent[self.parent >= 0]] = True
        for v in np.argsort(-self.depth, kind="stable").tolist():  # children before parents
            u = self.up[v]
            if u >= 0:
                visits[u] += visits[v]
                wins[u] += wins[v]
                mass[u] += mass[v]
        self.visits, self.wins, self.mass = np.array(visits, np.int64), np.array(wins, np.int64), np.array(mass)
        self.lo = np.where(self.parent >= 0, self.depth[self.parent] + 1, 0)

    def path(self, i: int) -> list[int]:
        """Nodes of a sequence, the root first."""
        out, v = [], self.end[i]
        while v >= 0:
            out.append(v)
            v = self.up[v]
        return out[::-1]


_OUT = "kind string, part int, side int, lo long, hi long, visits long, successes long, weight double, goes_on boolean, up_visits long, up_successes long, text binary, s1 long, s2 long, k1 long, k2 long, reliable long, frontier long"


def _range_rows(batches: Iterable[pa.RecordBatch], m: int, k_min: int, n_min: int) -> Iterator[dict]:
    """Columns, as arrays, of the chains, rims and sequences of a range; ``at`` is the sequence whose ids go with a row."""
    trie, before, first, questions, rollouts, success, weight = _Range(), None, None, [], [], [], []
    part, led = 0, {}  # by node: the text and the sums of its chain

    def closed(nodes: list[int]) -> None:
        for v in nodes:
            at = trie.hi[trie.up[v]] if trie.up[v] >= 0 else 0
            s1, s2 = before.sums_to(at)
            led[v] = (before.text[before.start(at) : before.start(trie.hi[v])], s1[at], s2[at])

    for batch in batches:
        own = batch.column("question_id").to_pylist()
        part = batch.column("part")[0].as_py() if len(own) else part
        for q, text in zip(own, batch.column("text"), strict=True):
            goes_on = before is not None and q == questions[-1]
            sequence = _Sequence(text.as_py(), before if goes_on else None)
            closed(trie.add(sequence.n, sequence.shared if goes_on else -1))
            questions.append(q)
            before = sequence
            first = sequence if first is None else first
        rollouts.append(batch.column("rollout_index"))
        success += batch.column("success").to_pylist()
        weight.append(batch.column("weight").to_numpy(zero_copy_only=False))
    if not questions:
        return
    closed(trie.finish())
    trie.sums(np.array([bool(s) for s in success], np.float64), np.concatenate(weight))
    n, last = len(trie.hi), len(questions) - 1
    side = np.full(n, -1)
    paths = [trie.path(0), trie.path(last)]
    side[paths[1]] = 1
    side[paths[0]] = 0
    about = {"questions": questions, "rollouts": rollouts, "part": part}

    inner = np.flatnonzero(side < 0)
    up = trie.parent[inner]
    below = (up >= 0) & (side[up] >= 0)  # the parent is on a rim
    told = (up >= 0) & ~below
    text, s1, s2 = zip(*[led[v] for v in inner.tolist()], strict=True) if len(inner) else ((), (), ())
    yield about | {"kind": "chain", "at": np.array(trie.rep)[inner], "side": np.where(below, side[up], -1), "lo": trie.lo[inner], "hi": trie.depth[inner], "visits": trie.visits[inner], "successes": trie.wins[inner], "weight": trie.mass[inner], "goes_on": trie.goes_on[inner], "up_visits": np.where(told, trie.visits[up], -1), "up_successes": np.where(told, trie.wins[up], -1), "text": text, "s1": s1, "s2": s2}

    for s, (i, sequence) in enumerate(((0, first), (last, before))):
        path = np.array(paths[s], np.int64)
        size = trie.depth[path] - trie.lo[path] + 1
        node = np.repeat(path, size)
        depth = np.arange(len(node))
        seed = np.frombuffer(hashlib.blake2b(repr(questions[i]).encode(), digest_size=16).digest(), np.uint64)
        sums = sequence.sums_to(sequence.n)
        k1, k2 = (own.view(np.uint64) + x for own, x in zip(sums, seed, strict=True))
        text = [b"", *[sequence.text[sequence.start(d) : sequence.start(d + 1)] for d in range(sequence.n)]]
        s1, s2 = (np.concatenate([[0], own[:-1]]) for own in sums)  # before a depth's token
        mine = side[node] == s  # a node of both rims counts once
        zero = lambda x: np.where(mine, x, 0)  # noqa: B023, E731
        yield about | {"kind": "rim", "at": np.full(len(node), i), "side": np.full(len(node), s), "lo": depth, "hi": depth, "visits": zero(trie.visits[node]), "successes": zero(trie.wins[node]), "weight": zero(trie.mass[node]), "goes_on": (depth < trie.depth[node]) | trie.goes_on[node], "text": text, "s1": s1, "s2": s2, "k1": k1.view(np.int64), "k2": k2.view(np.int64)}

    # from the top, what holds at a node's end: the last reliable depth and the frontier edge (-2: the rims know), the last rim depth and the first node below it
    reliable, frontier, top, under = (np.full(n, x) for x in (-2, -2, 0, -1))
    for v in np.argsort(trie.depth, kind="stable").tolist():
        u = trie.up[v]
        if side[v] >= 0:
            top[v] = trie.hi[v]
            continue
        if u < 0:  # a question that has no part in the rims
            reliable[v], frontier[v], under[v] = 0 if trie.wins[v] >= m else -1, -1, v
            continue
        top[v], under[v] = top[u], v if side[u] >= 0 else under[u]
        reliable[v] = trie.hi[v] if trie.wins[v] >= m else reliable[u]
        if side[u] < 0:
            frontier[v] = frontier[u] if trie.wins[u] == 0 or trie.wins[v] > 0 else trie.lo[v] - 1 if trie.wins[u] >= k_min and trie.visits[v] >= n_min else -1
        elif trie.wins[v] > 0:
            frontier[v] = -1
    end = np.array(trie.end)
    rim_of = np.where(side >= 0, side, 0)
    for v in np.argsort(trie.depth, kind="stable").tolist():
        if side[v] < 0 and trie.up[v] >= 0:
            rim_of[v] = rim_of[trie.up[v]]
    u = under[end]
    yield about | {"kind": "sequence", "at": np.arange(last + 1), "side": rim_of[end], "lo": top[end], "visits": np.where(u >= 0, trie.visits[u], -1), "successes": np.where(u >= 0, trie.wins[u], -1), "reliable": reliable[end], "frontier": frontier[end]}


def compressed_trie(trajectories: DataFrame, m: int = 2, k_min: int = 1, n_min: int = 1) -> Trie:
    """The trie of ``trajectories`` (question_id, rollout_index, tokens, success, weight), with the fates of its sequences.

    ``m``, ``k_min``, ``n_min``: see ``Trie.fates``; a prefix is reliable from ``m`` successes, an edge is a frontier from
    ``k_min`` successes before it to none in ``n_min`` visits after it.  A rollout's index is unique within its question.
    Null questions are a question; null tokens are a token; a null ``success`` is none.  An empty table gives empty tables.
    Tokens are compared whole between neighbours; rims of different ranges meet by the keys of ``tries.steps``.
    """
    spark = trajectories.sparkSession
    kinds = trajectories.schema
    ids = [T.StructField(c, kinds[c].dataType) for c in ("question_id", "rollout_index")]
    text = F.coalesce(packed(F.col("tokens").cast("array<string>")), F.lit("")).cast("binary")
    given = trajectories.select("question_id", "rollout_index", F.coalesce("success", F.lit(False)).alias("success"), F.col("weight").cast("double").alias("weight"), text.alias("text"))
    path = scratch(spark, "trie")
    ranges, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ("question_id", "text", "rollout_index")
    dealt = given.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ids, *T.StructType.fromDDL(_OUT).fields])
    arrow = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _range_rows(batches, m, k_min, n_min):
            at, known = rows.pop("at"), pa.chunked_array(rows.pop("rollouts"))
            questions, n = pa.array(rows.pop("questions"), arrow.field("question_id").type), len(at)
            for lo in range(0, n, 4000):
                pick = slice(lo, lo + 4000)
                some = pa.array(at[pick])
                own = {"question_id": questions.take(some), "rollout_index": known.take(some).combine_chunks().cast(arrow.field("rollout_index").type)}
                columns = [own[f.name] if f.name in own else pa.array([rows[f.name]] * len(some), f.type) if f.name in ("kind", "part") else pa.array(rows[f.name][pick], f.type) if f.name in rows else pa.nulls(len(some), f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    before = spark.conf.get(_SAMPLES[0])
    spark.conf.set(*_SAMPLES)
    try:
        dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/rows")
    finally:
        spark.conf.set(_SAMPLES[0], before)
    rows = spark.read.schema(schema).parquet(f"{path}/rows")

    key, here, led = ["lo", "k1", "k2"], ["part", "side"], ["text", "s1", "s2"]
    rims = rows.where("kind = 'rim'").select("question_id", "rollout_index", *here, *key, *led, "visits", "successes", "weight", "goes_on")
    sums = rims.groupBy(*key).agg(F.sum("visits").alias("visits"), F.sum("successes").alias("successes"), F.sum("weight").alias("weight"), F.max("goes_on").alias("goes_on"), F.min(F.struct(*here)).alias("shown"))
    rims = rims.select("question_id", "rollout_index", *here, *key, *led).join(sums, key)
    before = Window.partitionBy(*here).orderBy("lo")  # one path
    rims = rims.withColumn("up_visits", F.lag("visits").over(before)).withColumn("up_successes", F.lag("successes").over(before))
    rims.write.parquet(f"{path}/rims")
    rims = spark.read.schema(rims.schema).parquet(f"{path}/rims")

    out = ["question_id", "rollout_index", "lo", "hi", "visits", "successes", "weight", "goes_on", *led, "up_visits", "up_successes"]
    chains = rows.where("kind = 'chain'")
    at_rim = rims.select(*here, (F.col("lo") + 1).alias("lo"), F.col("visits").alias("up_visits"), F.col("successes").alias("up_successes"))
    below = chains.where("side >= 0").drop("up_visits", "up_successes").join(at_rim, [*here, "lo"])
    shown = rims.where(F.struct(*here) == F.col("shown")).withColumn("hi", F.col("lo"))
    whole = chains.where("side < 0").withColumns({c: F.nullif(c, F.lit(-1)) for c in ("up_visits", "up_successes")})
    own = chains.select(*out[:-2]).unionByName(shown.select(*out[:-2]))
    chains = whole.select(*out).unionByName(below.select(*out)).unionByName(shown.select(*out))

    last = lambda least: F.max(F.when(F.col("successes") >= least, F.col("lo")))
    facts = rims.groupBy(*here).agg(F.coalesce(last(m), F.lit(-1)).alias("r"), last(1).alias("z"), last(k_min).alias("zk"), F.min(F.when(F.col("successes") == 0, F.struct("lo", "visits")))["visits"].alias("after"))
    found = rows.where("kind = 'sequence'").join(facts, here)
    on_rim = F.when((F.col("zk") >= F.col("z")) & (F.col("after") >= n_min), F.col("z"))  # the frontier is on the rim
    at_top = F.when((F.col("lo") <= F.col("zk")) & (F.col("visits") >= n_min), F.col("lo"))  # just below it
    above = F.when(F.col("z") < F.col("lo"), on_rim).when(F.col("visits") >= 0, at_top)
    frontier = F.when(F.col("frontier") >= 0, F.col("frontier")).when(F.col("frontier") == -2, above)
    reliable = F.when(F.col("reliable") >= -1, F.col("reliable")).otherwise(F.least("lo", "r"))
    return Trie(trajectories, chains, own, found.select("question_id", "rollout_index", reliable.alias("reliable"), frontier.alias("frontier")))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def prefixes(chains: DataFrame) -> DataFrame:
    """A row per prefix of ``chains`` of a trie, or of parts of them that begin where they do.

    question_id, depth, prefix, up (the prefix before its last token), token (its last), visits, successes, weight, goes_on,
    up_visits, up_successes (where the chains have them).  Prefixes have the keys of ``tries.steps``.
    """
    facts = ["visits", "successes", "weight", "goes_on", *[c for c in ("up_visits", "up_successes") if c in chains.columns]]
    rows = chains.select("question_id", "lo", "hi", "text", "s1", "s2", *facts)
    schema = T.StructType([rows.schema["question_id"], *T.StructType.fromDDL("depth int, s1 long, s2 long, h1 long, h2 long, token string").fields, *[rows.schema[c] for c in facts]])
    arrow = _arrow(schema)

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("hi").to_numpy() - batch.column("lo").to_numpy() + 1
            at = np.cumsum(sizes) // 50_000  # a batch out has about so many rows, or one chain
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield _expanded(batch.slice(a, b - a), arrow)

    found = rows.mapInArrow(expand, schema)
    key = lambda x, y: F.concat_ws("-", x.cast("string"), y.cast("string"))
    s1, s2, h1, h2 = (F.col(c) for c in ("s1", "s2", "h1", "h2"))
    return found.select("question_id", "depth", key(s1, s2).alias("prefix"), F.when(F.col("depth") > 0, key(s1 - h1, s2 - h2)).alias("up"), "token", *facts)


def _expanded(chains: pa.RecordBatch, arrow: pa.Schema) -> pa.RecordBatch:
    lo, hi = (chains.column(c).to_numpy() for c in ("lo", "hi"))
    size = hi - lo + 1
    of, begin = np.repeat(np.arange(len(lo)), size), np.cumsum(size) - size
    depth = lo[of] + np.arange(len(of)) - begin[of]
    tokens = []
    for text, a, n in zip(chains.column("text").to_pylist(), lo.tolist(), size.tolist(), strict=True):
        tokens += _tokens(text)[:n] if a else [None, *_tokens(text)[: n - 1]]  # nothing leads to the root
    hashes = [np.where(depth > 0, h, 0) for h in _hashes(tokens, (depth - 1).tolist())]
    sums = []
    for name, h in zip(("s1", "s2"), hashes, strict=True):
        total = np.cumsum(h)
        sums.append(chains.column(name).to_numpy()[of] + total - (total - h)[begin][of])
    each, first = pa.array(of), depth == lo[of]
    facts = {c: chains.column(c).take(each) for c in arrow.names if c in chains.schema.names and c not in ("s1", "s2")}
    facts["goes_on"] = pa.array((depth < hi[of]) | facts["goes_on"].to_numpy(zero_copy_only=False))
    for up, own in (("up_visits", "visits"), ("up_successes", "successes")):
        if up in facts:
            facts[up] = pc.if_else(pa.array(first), facts[up], facts[own])
    facts |= {"depth": pa.array(depth), "token": pa.array(tokens, pa.binary())} | {c: pa.array(x) for c, x in zip(("s1", "s2", "h1", "h2"), [*sums, *hashes], strict=True)}
    return pa.RecordBatch.from_arrays([facts[f.name].cast(f.type) for f in arrow], schema=arrow)


def node_stats(trie: Trie, weight: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """As ``tries.node_stats``, with a function of the weight, which is asked once a chain: T4."""
    return prefixes(trie.own.withColumn("weight", weight(F.col("weight")))).select("question_id", "depth", "prefix", "weight", "visits", "successes")


def _edges(rows: DataFrame) -> DataFrame:
    ups = [c for c in ("up_visits", "up_successes") if c in rows.columns]
    return rows.where("depth > 0").select("question_id", (F.col("depth") - 1).alias("depth"), F.col("up").alias("prefix"), "token", F.col("prefix").alias("child"), "weight", "visits", *ups)


def edge_stats(trie: Trie, weight: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """As ``tries.edge_stats``, with a function as in ``node_stats``: T5.  An edge has the sums of the prefix that it leads to."""
    return _edges(prefixes(trie.own.withColumn("weight", weight(F.col("weight")))))


def _within(chains: DataFrame, most: int | None, after: int) -> DataFrame:
    """Chains cut to the prefixes that ``after`` more tokens keep within ``most``."""
    if most is None:
        return chains
    end = F.lit(most - after)
    cut = F.col("hi") > end
    return chains.where(F.col("lo") <= end).withColumn("goes_on", F.col("goes_on") | cut).withColumn("hi", F.least("hi", end))


def reliable_prefixes(trie: Trie, m: int, most: int | None = None) -> DataFrame:
    """As ``tries.reliable_prefixes``: T6, T7."""
    rows = prefixes(_within(trie.own.where(F.col("successes") >= m), most, 1))
    return rows.where("goes_on").select("question_id", "depth", "prefix", "weight", "visits", "successes")


def teacher_distribution(trie: Trie, m: int) -> DataFrame:
    """As ``tries.teacher_distribution`` of the prefixes with ``m`` successes: T7."""
    rows = _edges(prefixes(trie.chains.where((F.col("successes") >= m) | (F.col("up_successes") >= m)))).where(F.col("up_successes") >= m)
    total = F.sum("weight").over(Window.partitionBy("question_id", "depth", "prefix"))
    return rows.select("question_id", "depth", "prefix", "token", (F.col("weight") / total).alias("prob"))


def failure_frontier(trie: Trie, k_min: int, n_min: int, negatives: bool = True, weight: str = "uniform", most: int | None = None) -> DataFrame:
    """As ``tries.failure_frontier``: T8, T10.  An edge to a prefix without successes is where a chain begins."""
    chains = trie.chains.where((F.col("successes") == 0) & (F.col("visits") >= n_min) & (F.col("up_successes") >= k_min)).withColumn("hi", F.col("lo"))
    rows = _edges(prefixes(_within(chains, most, 0)))
    own = F.lit(1.0) if weight == "uniform" else F.col("visits").cast("double")
    rows = rows.select("question_id", "depth", "prefix", "token", "child", F.col("visits").alias("edge_visits"), F.col("up_visits").alias("parent_visits"), F.col("up_successes").alias("parent_successes"), F.col("visits").alias("child_visits"), own.alias("negative_weight"))
    return rows.where(F.lit(negatives))


def valid_masks(trie: Trie, after_frontier: bool = True) -> DataFrame:
    """``sequences`` with ``valid``, a boolean per token: not at a reliable prefix, not a frontier edge, nor after one: T12, J3.

    A sequence's reliable prefixes are its first ones, and it has one frontier edge at most, so two depths say it all.
    """
    fates = trie.fates.select(F.col("question_id").alias("q"), F.col("rollout_index").alias("r"), "reliable", "frontier")
    rows = trie.sequences.join(fates, F.col("question_id").eqNullSafe(F.col("q")) & (F.col("rollout_index") == F.col("r")))
    r, f = F.col("reliable"), F.coalesce("frontier", F.lit(1 << 60))
    free = lambda d: d < f if after_frontier else d != f
    return rows.withColumn("valid", F.transform("tokens", lambda _, d: (d > r) & free(d))).drop("q", "r", "reliable", "frontier")


def token_valid_mask(trie: Trie, after_frontier: bool = True) -> DataFrame:
    """(question_id, rollout_index, depth, token, valid), a row per token."""
    rows = valid_masks(trie, after_frontier).select("question_id", "rollout_index", F.posexplode(F.arrays_zip("tokens", "valid")).alias("depth", "t"))
    return rows.select("question_id", "rollout_index", "depth", F.col("t.tokens").alias("token"), F.col("t.valid").alias("valid"))


def response_examples(trie: Trie, n_logprobs: Column, most: int | None = None) -> DataFrame:
    """As ``tries.response_examples``, in rows of responses throughout: T13."""
    rows = valid_masks(trie)
    mask = F.transform("valid", lambda v: v.cast("int"))
    mask = mask if most is None else F.slice(mask, 1, most)
    return rows.select("question_id", "rollout_index", mask.alias("valid_mask"), (F.coalesce(n_logprobs, F.lit(0)) >= F.size(mask)).alias("has_old"))


def training_rows(trie: Trie, n_query: str = "n_query", logprobs: str = "logprobs", most: int | None = None) -> DataFrame:
    """One row per response with the arrays a loss reads, over the query's tokens and the response's: T13.

    ``sequences`` also has ``n_query``, how many tokens the query has, and ``logprobs``, an array or null.  Query and
    response together are cut to ``most`` tokens; a response of which nothing is left has no row.  response_mask and
    valid_mask are 0 over the query; old_logprobs are 0.0 there, and throughout where there are fewer than the response
    has tokens left (has_old is false then).  Other columns pass.
    """
    rows, n = valid_masks(trie), F.col(n_query).cast("int")
    left = F.size("tokens") if most is None else F.least(F.size("tokens"), F.lit(most) - n)
    rows = rows.withColumn("__n", left).where(F.col("__n") > 0)
    n_left = F.col("__n")
    has_old = F.coalesce(F.size(logprobs) >= n_left, F.lit(False)) & F.col(logprobs).isNotNull()
    over = lambda zero, own: F.concat(F.array_repeat(zero, n), own)
    known = F.transform(F.slice(logprobs, F.lit(1), n_left), lambda x: x.cast("double"))
    zero, none = F.lit(0), F.lit(0.0)
    return rows.withColumns({
        "response_mask": over(zero, F.array_repeat(F.lit(1), n_left)), "valid_mask": over(zero, F.transform(F.slice("valid", F.lit(1), n_left), lambda v: v.cast("int"))),
        "old_logprobs": over(none, F.when(has_old, known).otherwise(F.array_repeat(none, n_left))), "has_old": has_old,
    }).drop("__n", "valid", "tokens", logprobs, n_query)


def training_metrics(rows: DataFrame) -> DataFrame:
    """One row: examples, response_tokens, valid_tokens, valid_fraction, without_logprob of ``training_rows``; zeros for none."""
    total = lambda c, name: F.coalesce(F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias(name)
    sums = rows.agg(F.count("*").alias("examples"), total("response_mask", "response_tokens"), total("valid_mask", "valid_tokens"), F.coalesce(F.sum(F.when(F.col("has_old"), 0).otherwise(1)), F.lit(0)).cast("long").alias("without_logprob"))
    return sums.withColumn("valid_fraction", F.col("valid_tokens") / F.greatest("response_tokens", F.lit(1)))


def question_summary(trie: Trie, m: int, k_min: int, n_min: int) -> DataFrame:
    """(question_id, trajectories, successes, positives, negatives) per question, from chains alone: T27."""
    own = trie.sequences.groupBy("question_id").agg(F.count("*").alias("trajectories"), F.sum(F.coalesce(F.col("success").cast("long"), F.lit(0))).alias("successes"))
    goes_on = F.col("hi") - F.col("lo") + F.col("goes_on").cast("long")  # prefixes of a chain that go on
    edge = (F.col("successes") == 0) & (F.col("visits") >= n_min) & (F.col("up_successes") >= k_min)
    found = trie.chains.groupBy(F.col("question_id").alias("q")).agg(F.sum(F.when(F.col("successes") >= m, goes_on).otherwise(0)).alias("positives"), F.sum(F.when(edge, 1).otherwise(0)).alias("negatives"))
    return own.join(found, F.col("question_id").eqNullSafe(F.col("q"))).drop("q")
