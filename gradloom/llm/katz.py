"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

Tokens are words (A-Z lower-cased) and one end per document.  All n-grams of orders 1, 2 and 3 are counted, none is left
out.  A shuffle brings each place (word before last, last word, next word, document) to the group of its last word: all
counts, contexts and backoff weights that the place's probability needs meet there, so a group gives each document its
sum and no table of n-grams is written.  Places travel packed, as ranks of words instead of hashes; the places of
documents that are only scored count 0.  One job counts the counts, a second one, which packs the places again, scores.

The ``KNOWN`` most frequent words are broadcast with their counts; those of rarer words are joined and sent to the groups
that ask.  A last word with too many places for one group is dealt over several by the word before it; what follows it is
then counted beforehand and all of it sent to each of them.  Neither changes a result.

An n-gram that was not seen has the backoff weight of its context times the probability of the shorter n-gram,
recursively.  A context's weight is (1 - what its n-grams hold) / (1 - what these hold one order lower), so every
context's probabilities, over all known words and one class of unknown ones, add up to 1.  A context's count is the sum
of its n-grams' counts, as each of its places is followed by one token.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, documents, dropped, shuffles_removed, trimmed, written
from .text import mix, slices, text_buffer, word_bounds, word_hashes

#: Words that are broadcast at most.
KNOWN = 1 << 20
#: Places of a group, which a task holds as arrays, and groups at least.
GROUP, GROUPS = 1 << 20, 48
#: Tasks that score groups at most; each sends a document's sum once.
TASKS = 48
#: Documents' sums that a task holds.
SUMS = 1 << 20
#: Counts up to this are discounted.
LOW = 5
_END_HASH = np.uint64(0x5EED_0E4D_0000_0001)
_START_HASH = np.uint64(0x5EED_57A2_0000_0003)
_NONE, _START, _FIRST = 0, 1, 2  # codes: nothing (before a start), a start, the most frequent word


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all tokens in order, ends included."""
    n = len(offsets) - 1
    starts, ends, doc = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    at = np.cumsum(np.bincount(doc, minlength=n))
    return np.insert(hashes, at, _END_HASH), np.insert(doc, at, np.arange(n))


def is_training(n: int = 10, out: int = 0) -> Column:
    """Whether crc32 of the id as text leaves another remainder than ``out``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n)) != out


def _before(x: np.ndarray, doc: np.ndarray, start) -> np.ndarray:
    """What stands before each token of its document; ``start`` before the first one."""
    out = np.concatenate([x[:1], x[:-1]])
    out[np.concatenate([[True], doc[1:] != doc[:-1]])] = start
    return out


@dataclass
class Vocabulary:
    """Frequent words, most frequent first: ``hashes``, training counts ``n``.

    ``pieces``: over how many pieces the first ones are dealt as last words; all others, and those of an empty place, are one.
    """

    hashes: np.ndarray
    n: np.ndarray
    pieces: np.ndarray
    pieces_of_start: int
    n_groups: int

    def __post_init__(self):
        self.order = np.argsort(self.hashes).astype(np.int32)
        self.hashes = self.hashes[self.order]  # ascending
        rank = np.flatnonzero(self.order < len(self.pieces))
        dealt = {int(_START_HASH): self.pieces_of_start} | {int(self.hashes[i]): int(self.pieces[self.order[i]]) for i in rank}
        self.dealt_hashes = np.array(sorted(h for h, k in dealt.items() if k > 1), np.uint64)
        self.by_code = np.concatenate([[1, self.pieces_of_start], self.pieces, [1]])

    @property
    def end(self) -> int:
        """The first code of words that aren't broadcast."""
        return _FIRST + len(self.hashes)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The codes of words; -1 for those that aren't broadcast."""
        values, back = np.unique(hashes, return_inverse=True)
        out = np.where(values == _START_HASH, _START, -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == values, self.order[at] + _FIRST, out)
        return out[back]

    def dealt(self, codes: np.ndarray) -> np.ndarray:
        """Over how many pieces words are dealt."""
        last = len(self.by_code) - 1
        return self.by_code[np.where(codes < 0, last, np.minimum(codes, last))]

    def group(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The group of a piece of a last word, by its hash."""
        return (mix(last + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n_groups)).astype(np.int64)

    def places(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, code of the word before, of the one before that, group) of each token."""
        w = self.codes(hashes)
        v = _before(w, doc, _START)
        u = _before(v, doc, _NONE)
        last = _before(hashes, doc, _START_HASH)
        return w, v, u, self.group(last, mix(_before(last, doc, np.uint64(_NONE))) % self.dealt(v).astype(np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, compressed byte by byte of their values."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    head = np.array([len(body), *[len(a) for a in arrays]], "<i8").tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unpack(packed: bytes, *types: str) -> list[np.ndarray]:
    head, out, at = np.frombuffer(packed, "<i8", len(types) + 1), [], 0
    body = np.frombuffer(pa.decompress(packed[8 * len(head) :], int(head[0]), codec="zstd"), np.uint8)
    for n, kind in zip(head[1:], types):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


#: What a group gets from a slice: codes u, v, w of places, whether another document begins, names of rare words, documents' keys, whether these are training.
_TYPES = ("<u4", "<u4", "<u4", "?", "<u8", "<u8", "?")
_EMPTY = pack(*[np.zeros(0, kind) for kind in _TYPES])


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` yields of a slice's (tokens, document, key, whether it is training)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            own, learn = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in slices(offsets):
                hashes, doc = tokens_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield from make(hashes, doc, own[lo:hi], learn[lo:hi])

    return docs.select("text", "key", F.expr("NOT held_out").alias("learn")).mapInArrow(trimmed(run), schema)


def _batches(columns: dict[str, np.ndarray]):
    columns = {c: x.view(np.int64) if x.dtype == np.uint64 else x for c, x in columns.items()}
    for at in range(0, len(next(iter(columns.values()))), 1 << 16):
        yield pa.RecordBatch.from_pydict({c: pa.array(x[at : at + (1 << 16)]) for c, x in columns.items()})


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n, m): all words and the end; n counts those of training rows, m those of all."""

    def make(hashes, doc, _, learn):
        w, back, m = np.unique(hashes, return_inverse=True, return_counts=True)
        yield from _batches({"w": w, "n": np.bincount(back, learn[doc], len(w)).astype(np.int64), "m": m})

    return _mapped(docs, make, "w long, n long, m long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def least_known(words: DataFrame) -> int:
    """From how many occurrences on words are broadcast, so that there are at most ``KNOWN``."""
    top = 1 << 12
    of = {r.m: r.n for r in words.groupBy(F.least("m", F.lit(top)).alias("m")).agg(F.count("*").alias("n")).collect()}  # a row per count
    least, n = top + 1, 0
    while least > 1 and n + of.get(least - 1, 0) <= KNOWN:
        least, n = least - 1, n + of.get(least - 1, 0)
    if least > top:  # over KNOWN words of so many occurrences
        least = max(least, (words.agg(F.sum("m").alias("m")).first()["m"] or 0) // KNOWN + 1)
    return least


def follower_counts(docs: DataFrame, shared) -> DataFrame:
    """(v, w, n): the bigrams of last words that are dealt over several pieces; n counts those of training rows."""

    def make(hashes, doc, _, learn):
        v = _before(hashes, doc, _START_HASH)
        at = np.flatnonzero(np.isin(v, shared.value.dealt_hashes))
        if not len(at):
            return
        v, w, n = v[at], hashes[at], learn[doc[at]]
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
        yield from _batches({"v": v[new], "w": w[new], "n": np.add.reduceat(n, new)})

    return _mapped(docs, make, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def packed_places(docs: DataFrame, shared) -> DataFrame:
    """A row (g, blob) per slice and group: its places, the hashes of their words that aren't broadcast, and its documents."""

    def make(hashes, doc, own, learn):
        vocabulary = shared.value
        *codes, group = vocabulary.places(hashes, doc)
        order = np.argsort(group.astype(np.uint16) if vocabulary.n_groups < 1 << 16 else group, kind="stable")  # documents stay in order
        edges = np.searchsorted(group[order], np.arange(vocabulary.n_groups + 1))
        codes, doc = [x[order] for x in codes], doc[order]
        for g in np.flatnonzero(np.diff(edges)):  # groups without a place have no row
            part = slice(edges[g], edges[g + 1])
            w, v, u = (x[part] for x in codes)
            missing = [np.flatnonzero(x < 0) for x in (w, v, u)]
            names, back = np.unique(np.concatenate([hashes[order[part][at] - i] for i, at in enumerate(missing)]), return_inverse=True)
            for x, at, own_names in zip((w, v, u), missing, np.split(vocabulary.end + back, np.cumsum([len(at) for at in missing])[:2])):
                x[at] = own_names
            new = np.diff(doc[part], prepend=-1) != 0
            mine = doc[part][new]
            new[0] = False
            blob = pack(*(x.astype("<u4") for x in (u, v, w)), new, names, own[mine].view(np.uint64), learn[mine].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array([int(g)]), pa.array([blob], pa.binary())], ["g", "blob"])

    return _mapped(docs, make, "g long, blob binary")


def dealt_followers(followers: DataFrame, shared) -> DataFrame:
    """(g, v, w, n, n1): ``followers`` for each piece of v."""
    bounded_batches(followers.sparkSession, rows=1 << 14)

    def run(batches):
        for batch in batches:
            vocabulary = shared.value
            v, w, n, n1 = (c.fill_null(0).to_numpy() for c in batch.columns)
            pieces = vocabulary.dealt(vocabulary.codes(v.view(np.uint64)))
            at = np.repeat(np.arange(len(v)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield from _batches({"g": vocabulary.group(v[at].view(np.uint64), piece), "v": v[at], "w": w[at], "n": n[at], "n1": n1[at]})

    return followers.select("v", "w", "n", "n1").mapInArrow(run, "g long, v long, w long, n long, n1 long")


def good_turing(of: dict[int, int]) -> np.ndarray:
    """Factors for counts 0..LOW from the counts of counts ``of``: Katz's, where these lie in (0, 1]; else r / (r + 1)."""
    out = np.ones(LOW + 1)
    n = [0, *[of.get(r, 0) for r in range(1, LOW + 2)]]
    tail = (LOW + 1) * n[LOW + 1] / n[1] if n[1] else 1.0
    for r in range(1, LOW + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d <= 1 else r / (r + 1)
    return out


def counts_of_counts(counts: DataFrame) -> np.ndarray:
    """How many rows have n = 1..LOW + 1."""
    row = counts.agg(*[F.sum((F.col("n") == r).cast("long")).alias(f"n{r}") for r in range(1, LOW + 2)]).first()
    return np.array([row[f"n{r}"] or 0 for r in range(1, LOW + 2)])


def factors(of: np.ndarray) -> np.ndarray:
    return good_turing({r + 1: int(x) for r, x in enumerate(of)})


def discounted(factors: np.ndarray) -> Column:
    """The discounted ``n``."""
    n = F.col("n")
    return F.when(n <= LOW, n * F.element_at(F.array(*[F.lit(float(x)) for x in factors]), (F.least(n, F.lit(LOW)) + 1).cast("int"))).otherwise(n.cast("double"))


def _held(n: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.where(n <= LOW, n * factors[np.minimum(n, LOW)], n.astype(float))


def backed_off(context: np.ndarray, n: np.ndarray, lower: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """log10 of the probabilities of n-grams, all that their contexts (0, 1, ...) have; ``lower``: those one order lower."""
    size = int(context.max(initial=-1)) + 1
    held, seen = _held(n, factors), n > 0
    total, mass = np.bincount(context, n, size), np.bincount(context, held, size)
    below = np.bincount(context[seen], 10.0 ** lower[seen], size)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.minimum(1.0, (total - 0.5) / mass)
        weight = np.where(total > 0, np.log10((1 - scale * mass / total) / np.maximum(1 - below, 1e-12)), 0.0)
        return np.where(seen, np.log10(held * scale[context] / total[context]), weight[context] + lower)


class Group:
    """A group's distinct trigrams and bigrams with their training counts, its documents' keys, and the places of both."""

    def __init__(self, blobs, vocabulary: Vocabulary):
        parts = [unpack(b, *_TYPES) for b in blobs or [_EMPTY]]
        ends = np.cumsum([0, *[len(p[5]) for p in parts]])
        self.key = np.concatenate([p[5] for p in parts])
        self.rare = np.unique(np.concatenate([p[4] for p in parts]))
        self.end = vocabulary.end
        learn = np.concatenate([p[6] for p in parts])
        for p in parts:
            names = np.searchsorted(self.rare, p[4]).astype("<u4") + np.uint32(self.end)
            for x in p[:3]:
                at = np.flatnonzero(x >= self.end)
                x[at] = names[x[at] - np.uint32(self.end)]
        u, v, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.doc = np.concatenate([np.cumsum(p[3], dtype=np.int32) + np.int32(ends[i]) for i, p in enumerate(parts)])
        del parts
        wide = np.uint64(21 if self.end + len(self.rare) <= 1 << 21 else 32)
        if wide == 21:
            keys = v.astype(np.uint64) << wide | u
        else:  # three words don't fit in 64 bits
            keys = np.unique(v.astype(np.uint64) << wide | u, return_inverse=True)[1].astype(np.uint64)
        keys <<= wide
        keys |= w
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.ones(len(order), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        del keys
        self.triple = np.empty(len(order), np.int32)
        self.triple[order] = np.cumsum(new, dtype=np.int32) - 1
        first = order[new]
        del order, new
        u, v, w = (x[first].astype(np.int64) for x in (u, v, w))
        self.triple_n = np.bincount(self.triple[learn[self.doc]], minlength=len(first))
        pairs, self.triple_pair = np.unique(v << 32 | w, return_inverse=True)
        self.pair_v, self.pair_w = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_n = np.bincount(self.triple_pair, self.triple_n, len(pairs)).astype(np.int64)
        self.dealt = vocabulary.dealt(self.pair_v) > 1
        self.triple_context = np.cumsum(np.diff(v << 32 | u, prepend=-1) != 0) - 1
        self.triple_n[u == _NONE] = 0  # a first token has no context of order 3

    def counts_of_counts(self) -> list[np.ndarray]:
        """Of bigrams and trigrams, but for bigrams that are counted elsewhere."""
        return [np.bincount(np.minimum(n, LOW + 2), minlength=LOW + 3)[1 : LOW + 2] for n in (self.pair_n[~self.dealt], self.triple_n)]

    def asked(self) -> np.ndarray:
        """Hashes of the next words that aren't broadcast."""
        return self.rare[np.unique(self.pair_w[self.pair_w >= self.end]) - self.end]

    def scores(self, vocabulary: Vocabulary, sent: tuple[np.ndarray, ...], d2: np.ndarray, d3: np.ndarray, log1) -> dict[str, np.ndarray]:
        """Per document: how many tokens, how many of them ``known``, sums of log10(count + 0.1) and of log10 probabilities.

        ``sent``: rows (v, w, n, n1) as hashes and counts, v 0 where only w's n1 is meant; ``log1`` gives log10 of order 1.
        """
        v, w, n, n1 = sent
        names = np.unique(np.concatenate([self.rare, w[vocabulary.codes(w) < 0]]))
        rare_n = np.zeros(len(names), np.int64)
        w_code = vocabulary.codes(w)
        at = np.flatnonzero(w_code < 0)
        own = np.searchsorted(names, w[at])
        rare_n[own] = n1[at]
        w_code[at] = self.end + own

        def renamed(codes):
            return np.where(codes < self.end, codes, self.end + np.searchsorted(names, self.rare)[np.maximum(codes - self.end, 0)]) if len(self.rare) else codes

        counts = np.concatenate([[0, 0], vocabulary.n, rare_n])
        # bigrams counted here, and those of dealt words, which come more than once where two pieces meet
        whole = np.flatnonzero(v)
        keys, pick = np.unique(vocabulary.codes(v[whole]) << 32 | w_code[whole], return_index=True)
        ours = self.pair_v << 32 | renamed(self.pair_w)
        pair_v = np.concatenate([self.pair_v[~self.dealt], keys >> 32])
        pair_w = np.concatenate([ours[~self.dealt], keys]) & 0xFFFFFFFF
        pair_n = np.concatenate([self.pair_n[~self.dealt], n[whole][pick]])
        place = np.empty(len(ours), np.int64)
        place[~self.dealt] = np.arange(int((~self.dealt).sum()))
        place[self.dealt] = int((~self.dealt).sum()) + np.searchsorted(keys, ours[self.dealt])
        _, context = np.unique(pair_v, return_inverse=True)
        log2 = backed_off(context, pair_n, log1(counts[pair_w]), d2)[place]
        log3 = backed_off(self.triple_context, self.triple_n, log2[self.triple_pair], d3)
        # a first token has nothing at order 3: its context has no count, so it keeps its lower probability
        size, own = len(self.key), counts[renamed(self.pair_w)][self.triple_pair]
        known, base = ((own > 0).astype(np.int64))[self.triple], np.log10(own + 0.1)[self.triple]
        return {
            "key": self.key, "all": np.bincount(self.doc, minlength=size), "known": np.bincount(self.doc, known, size).astype(np.int64),
            "base": np.bincount(self.doc, base, size).astype(float), "log": np.bincount(self.doc, log3[self.triple], size).astype(float),
        }


def _table(columns: dict[str, np.ndarray]) -> pa.Table:
    return pa.Table.from_pydict({c: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for c, x in columns.items()})


def _runs(batches):
    """(task, rows) of each group, from batches that are sorted by task and g."""
    held, last = [], None
    for batch in batches:
        g = batch.column("g").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi == lo:
                continue
            if held and g[lo] != last:
                yield held[0].column("task")[0].as_py(), pa.Table.from_batches(held)
                held = []
            last = g[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column("task")[0].as_py(), pa.Table.from_batches(held)


def added_up(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The sums of parts by key."""
    key, back = np.unique(np.concatenate([p["key"] for p in parts]), return_inverse=True)
    sums = {c: np.bincount(back, np.concatenate([p[c] for p in parts]), len(key)).astype(parts[0][c].dtype) for c in parts[0] if c != "key"}
    return {"key": key} | sums


def group_sums(rows: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` returns of each group's rows, added up by key over the groups of a task, ``SUMS`` keys or so at once."""

    def run(batches):
        parts, last = [], None
        for task, table in _runs(batches):
            if parts and (task != last or sum(len(p["key"]) for p in parts) > SUMS):
                parts = [added_up(parts)]
                if task != last or len(parts[0]["key"]) > SUMS // 2:
                    yield from _table(parts.pop()).to_batches(1 << 16)
            last = task
            parts.append(make(table))
        if parts:
            yield from _table(added_up(parts)).to_batches(1 << 16)

    rows = rows.withColumn("task", F.pmod("g", F.lit(TASKS)))
    return rows.repartition(TASKS, "task").sortWithinPartitions("task", "g").mapInArrow(trimmed(run), schema)


def n_gram_counts(docs: DataFrame, shared) -> DataFrame:
    """(g, r, two, three, w) of groups: how many bigrams (but those of dealt words) and trigrams have count r; or a word asked for."""

    def make(table):
        group = Group(table.column("blob").to_pylist(), shared.value)
        (two, three), asked = group.counts_of_counts(), group.asked()
        r = np.concatenate([np.arange(1, LOW + 2), np.zeros(len(asked), np.int64)])
        none = np.zeros(len(asked), np.int64)
        yield _table({"g": np.full(len(r), table.column("g")[0].as_py()), "r": r, "two": np.concatenate([two, none]), "three": np.concatenate([three, none]), "w": np.concatenate([np.zeros(LOW + 1, np.uint64), asked])})

    def run(table: pa.Table) -> pa.Table:
        return list(trimmed(make)(table))[0]

    return packed_places(docs, shared).groupBy("g").applyInArrow(run, "g long, r long, two long, three long, w long")


def vocabulary_of(words: DataFrame, least: int, n_places: int, n_rows: int) -> Vocabulary:
    found = words.where(F.col("m") >= least).orderBy(F.desc("m"), "w").toArrow()  # KNOWN rows at most
    w, n, m = (found.column(c).to_numpy() for c in ("w", "n", "m"))
    n_groups = max(GROUPS, -(-n_places // GROUP))
    most = max(1, min(GROUP, n_places // (2 * GROUPS)))
    return Vocabulary(w.view(np.uint64), n, -(-m[m > most] // most), max(1, -(-n_rows // most)), n_groups)


def katz_scores(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    ``training``: which rows to learn from; by default those whose crc32(doc_id) isn't divisible by 10.  Scores are log10.
    Null and empty texts are a lone end.  Without training rows every token is unknown, at probability 1 of that class
    (base_score: log10 of 0.1 / 0.1 = 0).  Repeated rows each get a row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    training = is_training() if training is None else training
    docs = docs.select(F.col("doc_id").cast("long"), "text", (~training).alias("held_out")).withColumn("key", F.xxhash64("doc_id", "text"))

    with shuffles_removed(spark):
        words = written(word_counts(docs), "katz-words")
        d1 = factors(counts_of_counts(words))
        about = words.where("n > 0").agg(F.sum("n").alias("all"), F.count("*").alias("distinct"), F.sum(discounted(d1)).alias("held")).first()
        n_tokens, n_distinct, held = about["all"] or 0, about["distinct"], about["held"] or 0.0
        scale = min(1.0, (n_tokens - 0.5) / held) if held else 1.0  # leaves half a token to unknown words at least
        unknown = 1 - scale * held / n_tokens if n_tokens else 1.0

        def log1(n: np.ndarray) -> np.ndarray:
            return np.log10(np.where(n > 0, _held(n, d1) * (scale / max(1, n_tokens)), unknown))

        least = least_known(words)
        rare = words.where(F.col("m") < least).select("w", F.col("n").alias("n1"))
        n_places = words.agg(F.sum("m").alias("m")).first()["m"] or 0
        n_rows = words.where(F.col("w") == int(_END_HASH.view(np.int64))).agg(F.sum("m").alias("m")).first()["m"] or 0
        shared = spark.sparkContext.broadcast(vocabulary_of(words, least, n_places, n_rows))
        any_rare = least > 1 and not rare.isEmpty()

        followers = follower_counts(docs, shared)
        followers = followers.join(rare, "w", "left") if any_rare else followers.withColumn("n1", F.lit(None).cast("long"))
        followers = written(followers, "katz-followers")
        counts = written(n_gram_counts(docs, shared), "katz-counts")
        of = {r.r: r for r in counts.where("r > 0").groupBy("r").agg(F.sum("two").alias("two"), F.sum("three").alias("three")).collect()}  # a row per r
        two, three = (np.array([of[r][c] if r in of else 0 for r in range(1, LOW + 2)]) for c in ("two", "three"))
        d2, d3 = factors(two + counts_of_counts(followers)), factors(three)

        rows = packed_places(docs, shared).unionByName(dealt_followers(followers, shared), allowMissingColumns=True)
        if any_rare:
            rows = rows.unionByName(counts.where("r = 0").select("g", "w").join(rare, "w").select("g", "w", "n1"), allowMissingColumns=True)

        def score(table):
            blobs = table.column("blob").combine_chunks()
            sent = table.filter(blobs.is_null())
            sent = tuple(sent.column(c).combine_chunks().fill_null(0).to_numpy() for c in ("v", "w", "n", "n1"))
            sent = (sent[0].view(np.uint64), sent[1].view(np.uint64), *sent[2:])
            return Group(blobs.drop_null().to_pylist(), shared.value).scores(shared.value, sent, d2, d3, log1)

        sums = group_sums(rows, score, "key long, all long, known long, base double, log double")
        found = written(sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("all", "known", "base", "log")]), "katz-order3")
        dropped(words, followers, counts)

    rows = docs.select("doc_id", "held_out", "key")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))  # rows alike in id and text add up under one key
    found = found.join(copies, "key")
    of_one = lambda c: F.col(c) / F.col("copies")
    per_token = math.log10(n_tokens + 0.1 * (n_distinct + 1))
    return rows.join(found, "key").select(
        "doc_id", "held_out", of_one("all").cast("long").alias("n_tokens"), of_one("known").cast("long").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (of_one("base") - of_one("all") * per_token).alias("base_score"), of_one("log").alias("score"),
    )


def op8_katz_scores(spark, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
