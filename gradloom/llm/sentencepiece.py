"""SentencePiece encoding and decoding: best-scoring segmentation by a max-plus parallel scan.

The vocabulary and scores are those of a public model file; a text is split so that the scores of its pieces add up to
the most (the unigram algorithm), which is a shortest path over code points.  Ties go to the longest last piece.

Every document of more than a chunk's code points is cut into chunks of that many, wherever the cuts fall, and these are
spread over all tasks.  A piece may cross a cut, so a chunk's effect is a max-plus transfer matrix: entry (i, j) is the
best score of a path that enters i code points behind the chunk's start and leaves j behind its end.  Matrices combine
associatively, in blocks and then over blocks; that gives the state in which every chunk is entered and left, and each
chunk is then backtraced by itself between its two states.

No piece of the vocabulary has a blank after another character, so every path has a joint before a blank that follows
something else.  Within a chunk, what lies between its first and its last joint is the same on all paths, so its words are
segmented by themselves, all distinct words of a batch in step; their sum and the paths of the two ends make the matrix.
A chunk without a joint has its matrix from all of its code points; where segmentations have the same score, a cut before
such a chunk may choose another one than an uncut text would.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, documents, shuffles_removed, trimmed, written

#: Path of the model file; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384  # code points
_BLANK = "▁"
_MASK = (1 << 64) - 1


@dataclass
class Pieces:
    """Vocabulary: scores and ids of normal pieces, ids of the 256 byte pieces, the unknown piece's id and score."""

    ids: dict[str, int]
    scores: list[float]
    names: list[str]
    byte_ids: list[int]
    unknown: int
    unknown_score: float
    longest: int

    def __post_init__(self):
        # a letter that is no piece costs the unknown score, whatever it is
        self.by_hash = {}
        keys, owners = [], []
        for piece, i in self.ids.items():
            keys.append(self.hash_of(piece))
            owners.append(i)
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.owners = np.array(keys, np.uint64)[order], np.array(owners, np.int32)[order]
        assert len(np.unique(self.keys)) == len(self.keys), "two pieces share a hash"
        self.key_scores = np.array(self.scores)[self.owners]
        # by the top bits of a hash: 1 for a piece, 2 for the start of a longer one
        self.maybe = np.zeros(1 << 20, np.uint8)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] |= 1
        starts = np.array(list({self.hash_of(p[:i]) for p in self.ids for i in range(1, len(p))}), np.uint64)
        self.maybe[(starts >> np.uint64(44)).astype(np.int64)] |= 2
        assert not any(_BLANK in p.lstrip(_BLANK) for p in self.ids), "a piece has a blank after another character"

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15 & _MASK) ^ (h >> 29)
        return h


@lru_cache(maxsize=4)
def load(content: bytes) -> Pieces:
    """Parses a model file (a protocol buffer): field 1 are pieces, each with 1 text, 2 score, 3 type; field 3 is its normaliser.

    A model is an error if it asks for what isn't done here: user-defined pieces, a normaliser's table, the removal of
    blanks, no blank in front.
    """

    def fields(b: bytes):
        i = 0
        while i < len(b):
            tag, i = varint(b, i)
            kind = tag & 7
            if kind == 0:
                value, i = varint(b, i)
            elif kind == 2:
                n, i = varint(b, i)
                value, i = b[i : i + n], i + n
            elif kind == 5:
                value, i = struct.unpack_from("<f", b, i)[0], i + 4
            else:
                value, i = b[i : i + 8], i + 8
            yield tag >> 3, value

    def varint(b: bytes, i: int):
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 128:
                return value, i

    names, scores, kinds = [], [], []
    for number, value in fields(content):
        own = dict(fields(value)) if number in (1, 3) else {}
        if number == 3 and (own.get(2) or not own.get(3, 1) or own.get(4, 1)):
            raise ValueError("the model's normaliser changes texts; only identity with a blank in front is supported")
        if number == 1:
            names.append(own.get(1, b"").decode())
            scores.append(float(own.get(2, 0.0)))
            kinds.append(own.get(3, 1))
    if 4 in kinds:
        raise ValueError("user-defined pieces are not supported")
    ids = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == 1}
    byte_ids = [i for i, k in enumerate(kinds) if k == 6]
    normal = [scores[i] for i in ids.values()]
    # an unknown character scores 10 under the worst piece
    return Pieces(ids, scores, names, byte_ids, kinds.index(2), min(normal) - 10.0, max(map(len, ids)))


def _table(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0, lengths) of strings, as a table with a row per place."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((int(lengths.max(initial=0)), len(strings)), np.uint32)
    column = np.repeat(np.arange(len(strings)), lengths)
    out[np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[column], column] = flat
    return out, lengths


def best_paths(strings: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, how many each has, scores) of the best segmentations of strings of like length, all strings in step.

    An unknown character has the negative id -1 - code point.
    """
    points, lengths = _table(strings)
    n, longest = points.shape[0], min(pieces.longest, points.shape[0])
    best = np.full((n + 1, len(strings)), -np.inf)
    back, owner = np.zeros((n + 1, len(strings)), np.int32), np.zeros((n + 1, len(strings)), np.int32)
    best[0] = 0
    for start in range(n):
        live = np.flatnonzero(lengths > start)
        h = np.zeros(len(live), np.uint64)
        for size in range(1, min(longest, n - start) + 1):
            if size > 1:
                more = lengths[live] >= start + size
                live, h = live[more], h[more]
            if not len(live):
                break
            end = start + size
            h = ((h ^ points[end - 1][live]) * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
            kind = pieces.maybe[(h >> np.uint64(44)).astype(np.int64)]
            try_ = np.flatnonzero(kind & 1)
            at = np.minimum(np.searchsorted(pieces.keys, h[try_]), len(pieces.keys) - 1)
            hit = pieces.keys[at] == h[try_]
            to, at = live[try_[hit]], at[hit]
            score = best[start][to] + pieces.key_scores[at]
            better = score > best[end][to]  # longer last pieces come first
            to = to[better]
            best[end][to], back[end][to], owner[end][to] = score[better], size, pieces.owners[at[better]]
            if size == 1:
                none = np.ones(len(live), bool)
                none[try_[hit]] = False
                to = live[none]
                score = best[start][to] + pieces.unknown_score
                better = score > best[end][to]
                to = to[better]
                best[end][to], back[end][to], owner[end][to] = score[better], 1, -1 - points[start][to].astype(np.int64)
            longer = kind > 1
            live, h = live[longer], h[longer]
    which, at, ids, words = np.arange(len(strings)), lengths.copy(), [], []
    while len(which := which[at[which] > 0]):
        end = at[which]
        ids.append(owner[end, which])
        words.append(which)
        at[which] = end - back[end, which]
    scores = best[lengths, np.arange(len(strings))]
    if not ids:
        return np.zeros(0, np.int32), np.zeros(len(strings), np.int64), scores
    turn = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    words = np.concatenate(words)
    return np.concatenate(ids)[np.lexsort((-turn, words))], np.bincount(words, minlength=len(strings)), scores


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size] of all ``which``, one after another."""
    sizes = size[which]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[which] - (ends - sizes), sizes)]


class Encoder:
    """Segments words, remembering them; ``keep`` bounds how many."""

    def __init__(self, pieces: Pieces, keep: int = 100_000):
        self.pieces, self.keep = pieces, keep
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size, self.score = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def expanded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their UTF-8 bytes' pieces, or the unknown piece where the model has none."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, counts
        points, which = np.unique(-1 - ids[unknown], return_inverse=True)
        of = [[self.pieces.byte_ids[b] for b in chr(p).encode()] if len(self.pieces.byte_ids) == 256 else [self.pieces.unknown] for p in points.tolist()]
        times = np.ones(len(ids), np.int64)
        times[unknown] = np.array([len(x) for x in of])[which]
        first = np.cumsum(times) - times
        out = np.repeat(ids, times)
        table = np.array([x + [0] * (4 - len(x)) for x in of], np.int32)
        for k in range(4):
            there = times[unknown] > k
            out[first[unknown[there]] + k] = table[which[there], k]
        ends = np.cumsum(counts)
        return out, np.diff(np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], ends])])

    def learn(self, words) -> None:
        if len(self.index) > self.keep:
            self.forget()
        new = sorted({w for w in words if w not in self.index}, key=len)
        found, sizes, scores, lo = [self.flat], [self.size], [self.score], 0
        while lo < len(new):  # so many at a time that the tables stay in a core's cache, if words are short
            hi = min(len(new), lo + max(1, 200_000 // (len(new[lo]) + 8)))
            while hi > lo + 1 and len(new[hi - 1]) * (hi - lo) > 500_000:
                hi = lo + (hi - lo) // 2
            ids, counts, best = best_paths(new[lo:hi], self.pieces)
            ids, counts = self.expanded(ids, counts)
            scores.append(best)
            found.append(ids)
            sizes.append(counts)
            lo = hi
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.flat, self.size, self.score = np.concatenate(found), np.concatenate(sizes), np.concatenate(scores)
        self.start = np.cumsum(self.size) - self.size

    def scored(self, texts: list[str]) -> tuple[pa.ListArray, np.ndarray]:
        """The ids and the score of each text, which is marked and starts with a blank."""
        words = [_WORDS.findall(t) for t in texts]
        self.learn(chain.from_iterable(words))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64)
        edges = np.cumsum([0, *map(len, words)])
        ends = np.concatenate([[0], np.cumsum(self.size[which])])[edges]
        scores = np.diff(np.concatenate([[0.0], np.cumsum(self.score[which])])[edges])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gathered(self.flat, self.start, self.size, which))), scores

    def ids(self, texts: list[str]) -> pa.ListArray:
        return self.scored(texts)[0]


_WORDS = re.compile(f"{_BLANK}+[^{_BLANK}]*")


def marked(text: str) -> str:
    """The text with blanks as pieces have them and one in front; an empty text stays empty."""
    return _BLANK + text.replace(" ", _BLANK) if text else ""


def cut(text: str, chunk: int, reach: int) -> list[tuple[int, str, str, str]]:
    """(part, the code point before, the chunk, ``reach`` code points behind it) of a text, in order."""
    return [(i // chunk, text[max(0, i - 1) : i], text[i : i + chunk], text[i + chunk : i + chunk + reach]) for i in range(0, len(text), chunk)]


_JOINT, _LAST_JOINT = re.compile(f"(?<=[^{_BLANK}]){_BLANK}"), re.compile(f"{_BLANK}(?=[^{_BLANK}])")


def parted(before: str, body: str) -> tuple[str, str, str] | None:
    """A chunk up to its first joint, between its first and its last one, and from there on; None without a joint."""
    whole = before + body
    if before:
        first, last = _JOINT.search(whole), _LAST_JOINT.search(whole[::-1])  # reversed, as the last one is needed
        if first is None:
            return None
        first, last = first.start() - 1, len(whole) - last.start() - 2
    else:  # a text's start is a joint
        last = _LAST_JOINT.search(body[:0:-1])
        first, last = 0, len(body) - last.start() - 1 if last else 0
    return body[:first], body[first:last], body[last:]


def matches(text: str, start: int, pieces: Pieces) -> list[tuple[int, float, int]]:
    """(end, score, id) of the pieces at ``start``, and of an unknown character where it is no piece."""
    out = [] if text[start] in pieces.ids else [(start + 1, pieces.unknown_score, -1 - ord(text[start]))]
    for end in range(start + 1, min(len(text), start + pieces.longest) + 1):
        i = pieces.ids.get(text[start:end])
        if i is not None:
            out.append((end, pieces.scores[i], i))
    return out


def transfer(text: str, after: str, pieces: Pieces) -> np.ndarray:
    """The max-plus matrix of a chunk without a joint; states are the code points 0 .. longest - 1 behind its edges."""
    states, n, whole = pieces.longest, len(text), text + after
    best = np.full((n + states, states), -np.inf)
    own = np.arange(min(states, n + 1))
    best[own, own] = 0.0  # entered at i: row i, column i
    for start in range(n):
        row = best[start]
        if np.isneginf(row).all():
            continue
        for end, score, _ in matches(whole, start, pieces):
            np.maximum(best[end], row + score, out=best[end])
    return best[n:].T.copy()


def entered(head: str, pieces: Pieces) -> np.ndarray:
    """By state, the best score of a path from there to the joint at the end of ``head``."""
    best = np.full(max(len(head) + 1, pieces.longest), -np.inf)
    best[len(head)] = 0.0
    for start in range(len(head) - 1, -1, -1):
        best[start] = max((score + best[end] for end, score, _ in matches(head, start, pieces)), default=-np.inf)
    return best[: pieces.longest]


def left(tail: str, after: str, pieces: Pieces) -> np.ndarray:
    """By state, the best score of a path from the joint where ``tail`` starts to there, behind the chunk's end."""
    n, whole = len(tail), tail + after
    best = [-np.inf] * (n + pieces.longest)
    best[0] = 0.0
    for start in range(n):
        if best[start] > -np.inf:
            for end, score, _ in matches(whole, start, pieces):
                best[end] = max(best[end], best[start] + score)
    return np.array(best[n : n + pieces.longest])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def entry(head: str, scores: np.ndarray, pieces: Pieces) -> int:
    """The state in which a best path to the joint at the end of ``head`` enters it, given each state's best score.

    Of equal paths it is the one with the longest last pieces, as in a text that isn't cut.
    """
    n = len(head)
    best, back = [*scores[: n + 1].tolist(), *[-np.inf] * (n + 1 - len(scores))], [None] * (n + 1)
    for start in range(n):
        if best[start] > -np.inf:
            for end, score, _ in matches(head, start, pieces):
                if best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
    while back[n] is not None:
        n = back[n]
    return n


def states_between(matrices: list[np.ndarray], heads: list[str | None], enter: int, leave: int, pieces: Pieces) -> list[int]:
    """The states at all edges of a row of chunks that is entered and left in the given ones.

    ``heads``: what each chunk (or the first of a block) has before its first joint; None without a joint.
    """
    forward = [np.full(len(matrices[0]), -np.inf)]
    forward[0][enter] = 0.0
    for m in matrices[:-1]:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    states = [leave]
    for f, m, head in list(zip(forward, matrices, heads, strict=True))[:0:-1]:
        states.append(int(np.argmax(f + m[:, states[-1]])) if head is None else entry(head, f, pieces))
    return [enter, *states[::-1]]


def backtraced(text: str, after: str, enter: int, leave: int, pieces: Pieces) -> list[int]:
    """Piece ids of a chunk's best path between two states; a piece that crosses the chunk's end is its own."""
    n, whole = len(text), text + after
    best, back = [-np.inf] * (n + pieces.longest + 1), [None] * (n + pieces.longest + 1)
    best[enter] = 0.0
    for start in range(enter, n):
        if best[start] == -np.inf:
            continue
        for end, score, i in matches(whole, start, pieces):
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, i)
    path, at = [], n + leave
    while at > enter:
        at, i = back[at]
        path.append(i)
    return path[::-1]


_BLOCK = 64
_CHUNKS = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])
_OWN = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("matrix", pa.binary()), ("joined", pa.bool_()), ("head", pa.string()), ("ids", pa.list_(pa.int32())), ("tail", pa.string()), ("after", pa.string())])


def _giant_ids(giants: DataFrame, content, chunk: int) -> DataFrame:
    """(key, ids) of long texts: (key, text).  Chunks are spread over all tasks, those of equal texts once; a text's
    matrices meet in blocks."""

    def spread(batches):
        reach = load(content.value).longest - 1
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = cut(marked(text), chunk, reach)
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist([dict(zip(_CHUNKS.names, (key, *r), strict=True)) for r in rows[lo : lo + 256]], _CHUNKS)

    def matrices(batches):
        encoder = Encoder(load(content.value))
        for batch in batches:
            bodies, after = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            parts = [parted(*x) for x in zip(batch.column(2).to_pylist(), bodies, strict=True)]
            ids, scores = encoder.scored([p[1] if p else "" for p in parts])
            found = []
            for body, behind, part, score in zip(bodies, after, parts, scores, strict=True):
                if part is None:
                    found.append(transfer(body, behind, encoder.pieces))
                else:
                    found.append(entered(part[0], encoder.pieces)[:, None] + score + left(part[2], behind, encoder.pieces)[None, :])
            columns = [pa.array([m.tobytes() for m in found], pa.binary()), pa.array([p is not None for p in parts])]
            ends = [pa.array([p[0] if p else b for p, b in zip(parts, bodies, strict=True)]), ids, pa.array([p[2] if p else "" for p in parts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *ends, batch.column(4)], schema=_OWN)

    def square(b: bytes) -> np.ndarray:
        m = np.frombuffer(b)
        return m.reshape(round(len(m) ** 0.5), -1)

    def block_product(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        out = square(table["matrix"][0].as_py())
        for m in table["matrix"][1:]:
            out = product(out, square(m.as_py()))
        return pa.table([*[table[c][:1] for c in ("key", "block", "joined", "head")], pa.array([out.tobytes()], pa.binary())], ["key", "block", "joined", "head", "matrix"])

    def states_of(table: pa.Table, enter: int, leave: int) -> list[pa.Array]:
        heads = [h if j else None for j, h in zip(table["joined"].to_pylist(), table["head"].to_pylist(), strict=True)]
        states = states_between([square(m.as_py()) for m in table["matrix"]], heads, enter, leave, load(content.value))
        return [pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())]

    def block_states(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return pa.table([table["key"], table["block"], *states_of(table, 0, 0)], ["key", "block", "enter", "leave"])

    def part_states(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table([table["key"], table["part"], *states_of(table, table["enter"][0].as_py(), table["leave"][0].as_py())], ["key", "part", "enter", "leave"])

    def trace(batches):
        encoder = Encoder(load(content.value))
        ids_of = lambda *way: encoder.expanded(p := np.array(backtraced(*way, encoder.pieces), np.int32), np.array([len(p)]))[0]
        for batch in batches:
            place, found = [], []
            for part, joined, head, tail, after, enter, leave in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                place += [3 * part, 3 * part + 2]
                found += [ids_of(head, "", enter, 0), ids_of(tail, after, 0, leave)] if joined else [ids_of(head, after, enter, leave), []]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), 2)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(place, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["key", "place", "ids"])

    chunks = giants.mapInArrow(trimmed(spread), "key long, part int, before string, body string, after string").dropDuplicates(["key", "part"])
    fields = "key long, part int, matrix binary, joined boolean, head string, ids array<int>, tail string, after string"
    with shuffles_removed(giants.sparkSession):
        own = written(chunks.mapInArrow(trimmed(matrices), fields), "piece-matrices").withColumn("block", F.floor(F.col("part") / _BLOCK).cast("int"))
    small = own.select("key", "block", "part", "joined", F.when(F.col("joined"), F.col("head")).alias("head"), "matrix")
    blocks = small.groupBy("key", "block").applyInArrow(block_product, "key long, block int, joined boolean, head string, matrix binary")
    edges = blocks.groupBy("key").applyInArrow(block_states, "key long, block int, enter int, leave int")
    states = small.join(edges, ["key", "block"]).groupBy("key", "block").applyInArrow(part_states, "key long, part int, enter int, leave int")
    # a chunk's own ids are the same on all paths, so they don't travel to its states: its ends do
    ends = own.select("key", "part", "joined", "head", "tail", "after").join(states, ["key", "part"])
    traced = ends.mapInArrow(trimmed(trace), "key long, place long, ids array<int>")
    between = own.where("joined").select("key", (3 * F.col("part").cast("long") + 1).alias("place"), "ids")
    in_order = F.array_sort(F.collect_list(F.struct("place", "ids")))  # a document is a row, before and after
    return traced.unionByName(between).groupBy("key").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``pieces``: array<int>, the ids of each text's best segmentation.

    Null and empty texts have no pieces.  Other columns pass unchanged, but one named ``pieces`` is replaced.  Texts of over
    ``chunk`` code points are cut and encoded by all tasks; equal long texts are encoded once.
    """
    kept = [c for c in docs.columns if c != "pieces"]
    docs = docs.select(*[f"`{c}`" for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", pieces array<int>"
    return _encoded(docs, model, chunk, lambda content: lambda batch: batch, schema)


def _encoded(docs: DataFrame, model: str, chunk: int, finish, schema: str) -> DataFrame:
    """The encoded batches of ``docs`` after ``finish(content of the model file)``, before they leave the Python worker."""
    spark = docs.sparkSession
    bounded_batches(spark, 500, 2)
    content = spark.sparkContext.broadcast(_read(model))
    kept, text = docs.columns, docs.columns.index("text")

    def short(batches):
        encoder, last = Encoder(load(content.value)), finish(content.value)
        for batch in batches:
            pieces = encoder.ids([marked(t or "") for t in batch.column(text).to_pylist()])
            yield last(pa.RecordBatch.from_arrays([*batch.columns, pieces], [*kept, "pieces"]))

    def done(batches):
        last = finish(content.value)
        yield from map(last, batches)

    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    encoded = docs.where(~long).mapInArrow(trimmed(short), schema)
    giants = docs.where(long)
    if giants.isEmpty():
        return encoded
    keyed = giants.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64("text").alias("key"))
    ids = _giant_ids(keyed.select("key", F.col("row.text").alias("text")), content, chunk)
    joined = keyed.join(ids, "key").select("row.*", F.col("ids").alias("pieces"))
    return encoded.unionByName(joined.mapInArrow(trimmed(done), schema))


def _read(model: str) -> bytes:
    with open(model, "rb") as f:  # on the driver; a few hundred KB
        return f.read()


class Decoder:
    """The bytes that each id stands for; control pieces have none."""

    def __init__(self, pieces: Pieces):
        of = [b""] * len(pieces.names)
        for p, i in pieces.ids.items():
            of[i] = p.replace(_BLANK, " ").encode()
        for b, i in enumerate(pieces.byte_ids):
            of[i] = bytes([b])
        of[pieces.unknown] = " \u2047 ".encode()
        self.size = np.array([len(b) for b in of], np.int64)
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(of), np.uint8)

    def texts(self, ids: pa.ListArray) -> list[bytes | None]:
        """The bytes of each list, without the blank that encoding put in front; null for null."""
        own = pa.compute.list_flatten(ids).to_numpy(zero_copy_only=False)
        counts = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        data = gathered(self.flat, self.start, self.size, own).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[own])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = (data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [t[t[:1] == b" " :] if there else None for t, there in zip(texts, ids.is_valid().to_pylist(), strict=True)]


def decode(rows: DataFrame, model: str = MODEL, column: str = "pieces") -> DataFrame:
    """``rows`` with ``decoded``: the text of the ids in ``column``, without the blank that encoding put in front.

    Null ids give null; ids outside the vocabulary are an error; bytes that are no UTF-8 become U+FFFD.  A column named
    ``decoded`` is replaced.
    """
    spark = rows.sparkSession
    bounded_batches(spark, 500, 2)
    content = spark.sparkContext.broadcast(_read(model))
    kept = [c for c in rows.columns if c != "decoded"]
    rows = rows.select(*[f"`{c}`" for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"
    at = kept.index(column)

    def join(batches):
        decoder = Decoder(load(content.value))
        for batch in batches:
            found = [None if t is None else t.decode("utf-8", "replace") for t in decoder.texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*kept, "decoded"])

    return rows.mapInArrow(join, schema)


_DIGEST = ["doc_id", "n_chars", "n_pieces", "pieces_sha256", "round_trip"]


def piece_digest(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_pieces, pieces_sha256 (ids as little-endian 32-bit integers), round_trip of each row."""

    def finish(content: bytes):
        decoder = Decoder(load(content))

        def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, text = batch.column(2), pa.compute.fill_null(batch.column(1), "")
            counts = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)
            flat, ends = pa.compute.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<i4"), np.concatenate([[0], np.cumsum(counts)]).tolist()
            sha = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            same = [t == d.encode() for t, d in zip(decoder.texts(ids), text.to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.compute.utf8_length(text).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sha), pa.array(same)], _DIGEST)

        return digest

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _encoded(rows, model, chunk, finish, "doc_id long, n_chars long, n_pieces long, pieces_sha256 string, round_trip boolean")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_digest(documents(spark, sf_dir))
