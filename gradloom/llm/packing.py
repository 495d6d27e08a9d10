"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised where they lie; what is longer than a sequence is cut so that only its first piece is short.  Short
pieces are dealt by hash into chunks of a few thousand, which best fit packs, largest first; then bins that aren't full
exchange documents, one for one, two for one, or one for none, whenever the sum of squared fills grows, until bins run
empty or nothing grows it.  Bins that are still not full meet those of other chunks and search on, round by round, until
one chunk holds them all or a round gains nothing.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, documents, trimmed, written

CAPACITY = 1024
#: Short pieces that a task packs at once, in the first round; bins that aren't full, in later ones.
CHUNK = 4096
#: Words that a tokeniser keeps with their ids.
_KEPT = 1_000_000
# Characters up to U+024F, without rare blanks and controls: there the letters and numbers of the split are these ranges.
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t\\n\\r "
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_L, _N, _O, _B, _END = range(5)
_KIND = np.array([_END] + [_L if re.match(f"[{_LETTER}]", chr(c)) else _N if re.match(f"[{_NUMBER}]", chr(c)) else _B if re.match(f"[{_BLANK}]", chr(c)) else _O for c in range(1, 0x250)], np.uint8)
_LONG = 4096  # longer words are told apart by themselves
_RANDOM = np.random.default_rng(11)
_CODE, _PLACE = (_RANDOM.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (0x250, _LONG))


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level split begin, in texts of plain characters that each end in a zero.

    Words tile the texts: runs of letters, numbers or other marks, each with the space before it; what is left of a run of
    blanks; and the endings 's 't 're 've 'm 'll 'd after no space.
    """
    kind = _KIND[codes]
    first = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    end, own = np.append(first[1:], len(codes)), kind[first]
    begins = np.zeros(len(codes) + 1, bool)
    begins[first] = True
    inner = np.flatnonzero((own[:-1] == _B) & (own[1:] != _END))  # blanks before a word: the last is apart, a space joins the word
    begins[end[inner] - 1] = True
    joins = inner[codes[end[inner] - 1] == 0x20]
    begins[end[joins]] = False
    quote = np.flatnonzero((own[:-1] == _O) & (own[1:] == _L) & (end[:-1] - first[:-1] == 1) & (codes[first[:-1]] == 0x27))
    quote = quote[begins[first[quote]]]
    at, size = first[quote], end[quote + 1] - first[quote + 1]
    one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (size > 1) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
    taken = np.where(short, 1, np.where(long, 2, 0))
    begins[at[taken > 0] + 1] = False
    begins[(at + taken + 1)[(taken > 0) & (size > taken)]] = True
    return np.flatnonzero(begins[:-1])


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Token ids of texts, as little-endian 32-bit numbers, by a tokeniser file's JSON.

    A byte-level model merges within the words of a fixed split alone, so the library is asked once a word; words that are
    alike are found by 64-bit hashes of a batch.  Texts with characters that the split of this class doesn't know, or with
    special tokens, go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        about = json.loads(spec)
        pre = about.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not about.get("normalizer")
        self.library, self.kept = Tokenizer.from_str(spec), {}
        special = [t["content"] for t in about.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and bool(_PLAIN.fullmatch(t)) and not (self.special and self.special.search(t)) for t in texts]
        quick = iter(self._by_word([t for t, p in zip(texts, plain, strict=True) if p]))
        whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(quick if p else whole) for p in plain]

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        text = "\0".join(texts) + "\0"
        codes = np.frombuffer(text.encode("utf-16-le"), "<u2")
        starts = word_starts(codes)
        ends = np.append(starts[1:], len(codes))
        words = codes[starts] != 0
        place = np.arange(len(codes)) - np.repeat(starts, ends - starts)
        hashes = np.add.reduceat(_CODE[codes] * _PLACE[place % _LONG], starts)[words]
        starts, ends = starts[words], ends[words]
        for i in np.flatnonzero(ends - starts > _LONG):
            hashes[i] = hash(text[starts[i] : ends[i]]) & 0xFFFFFFFFFFFFFFFF
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)  # words that are alike
        found = self._of([text[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
        size = np.array([len(x) for x in found], np.int64) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = size[which]
        upto = np.cumsum(n)
        ids = flat[np.arange(int(n.sum())) + np.repeat(at[which] - (upto - n), n)]
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        edges = np.append(0, upto)[np.searchsorted(starts, edges)]
        return [ids[a:b].tobytes() for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def _of(self, words: list[str]) -> list[bytes]:
        if len(self.kept) > _KEPT:
            self.kept.clear()
        kept = self.kept
        new = [w for w in words if w not in kept]
        kept.update(zip(new, self._whole(new), strict=True))
        return [kept[w] for w in words]


@lru_cache(maxsize=1)
def _ids(spec: str) -> Ids:
    """One for all tasks of a Python worker, which then know most words."""
    return Ids(spec)


def _groups(texts: list[str], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``limit`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def token_pieces(docs: DataFrame, end: int = 2, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row of ``docs`` (doc_id, text), with ``ids`` if asked for.

    A document's ids are those of its whole text and then ``end``, so null and empty texts are one piece of one id.
    Documents of more than ``capacity`` ids are cut; the first piece has what is left over, all others ``capacity`` ids.
    Repeated rows have pieces each; an empty table gives an empty result; other columns are ignored.
    ``tokenizer``: a file of the tokenizers library, read by the driver and sent to the tasks (a few MB).
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer or tokenizer_file(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi in _groups(texts):
                rows = []
                for doc, own in zip(doc_ids[lo:hi], ids(texts[lo:hi]), strict=True):
                    own += last
                    n = len(own) // 4
                    first = (n - 1) % capacity + 1
                    edges = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        part = own[4 * a : 4 * b]
                        rows.append((doc, piece, a, b - a, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(cut), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (indices into ``sizes``): each size, largest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left > size:
            insort(room, (left - size, b))
    return bins


class _Search:
    """Local search over bins that aren't full; arrays of items, and of pairs of items of one bin, are scanned at once."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        self._index()

    def _index(self) -> None:
        """What a bin may give: nothing, one item, or two; with (bin, first, second) and the size of it all."""
        open_ = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity]
        one = [(b, i, -1) for b in open_ for i in self.bins[b]]
        two = [(b, i, j) for b in open_ for k, i in enumerate(self.bins[b]) for j in self.bins[b][k + 1 :]]
        none = [(b, -1, -1) for b in open_]
        self.offers = np.array(none + one + two, np.int64).reshape(-1, 3)
        weight = np.append(self.sizes, 0)
        self.given = weight[self.offers[:, 1]] + weight[self.offers[:, 2]]
        self.count = (self.offers[:, 1:] >= 0).sum(axis=1)
        self.live = np.ones(len(self.offers), bool)

    def _refresh(self, *changed: int) -> None:
        """Offers of changed bins are written anew; all are, once a quarter is stale."""
        gone = np.isin(self.offers[:, 0], changed)
        self.live &= ~gone
        fresh = []
        for b in changed:
            if 0 < self.fill[b] < self.capacity:
                own = self.bins[b]
                fresh += [(b, -1, -1), *((b, i, -1) for i in own), *((b, i, j) for k, i in enumerate(own) for j in own[k + 1 :])]
        more = np.array(fresh, np.int64).reshape(-1, 3)
        weight = np.append(self.sizes, 0)
        self.offers = np.concatenate([self.offers[self.live], more])
        self.given = np.concatenate([self.given[self.live], weight[more[:, 1]] + weight[more[:, 2]]])
        self.count = np.concatenate([self.count[self.live], (more[:, 1:] >= 0).sum(axis=1)])
        self.live = np.ones(len(self.offers), bool)

    def step(self, donor: int) -> bool:
        """The exchange that moves most from ``donor`` to another bin and makes the sum of squared fills grow; whether there is one.

        The donor gives one item for none, one or two, or two items for one.
        """
        own = sorted(self.bins[donor], key=lambda i: -self.sizes[i])
        gives = [((i,), int(self.sizes[i]), 2) for i in own] + [((i, j), int(self.sizes[i] + self.sizes[j]), 1) for k, i in enumerate(own) for j in own[k + 1 :]]
        bin_, best = self.offers[:, 0], (0, None, None)
        if not len(bin_):
            return False
        fill = self.fill[bin_]
        other = bin_ != donor
        for items, size, most in gives:
            if size <= best[0]:
                continue
            net = size - self.given
            ok = other & (net > best[0]) & (fill + net <= self.capacity) & (fill + net > self.fill[donor]) & (self.count <= most)
            if len(items) == 2:
                ok &= self.count == 1  # moving two for none is moving one twice
            if ok.any():
                at = int(np.argmax(np.where(ok, net * (self.capacity + 1) + fill, -1)))  # among equals the fullest
                best = (int(net[at]), items, at)
        if best[1] is None:
            return False
        net, items, at = best
        to, *back = self.offers[at].tolist()
        back = [i for i in back if i >= 0]
        self.bins[donor] = [i for i in self.bins[donor] if i not in items] + back
        self.bins[to] = [i for i in self.bins[to] if i not in back] + list(items)
        self.fill[donor] -= net
        self.fill[to] += net
        self._refresh(donor, to)
        return True

    def run(self) -> list[list[int]]:
        """Empties the emptiest bins, one after the other, while fewer bins could hold everything and exchanges are found."""
        least = -(-int(self.fill.sum()) // self.capacity)
        stuck: set[int] = set()
        while int((self.fill > 0).sum()) > least:
            open_ = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity and b not in stuck]
            if not open_:
                break
            donor = min(open_, key=lambda b: (self.fill[b], b))
            while self.fill[donor] and self.step(donor):
                pass
            if self.fill[donor]:
                stuck.add(donor)  # it may still receive
        return [b for b in self.bins if b]


def improved(sizes: np.ndarray, bins: list[list[int]], capacity: int = CAPACITY) -> list[list[int]]:
    """``bins`` after the local search; full ones stay as they are."""
    fill = [int(sizes[b].sum()) for b in bins]
    full = [b for b, f in zip(bins, fill, strict=True) if f >= capacity]
    return full + _Search(sizes, [b for b, f in zip(bins, fill, strict=True) if f < capacity], capacity).run()


def packed(pieces: DataFrame, unit: str = "unit", capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """(unit, length, bin, offset) of ``pieces`` (unit, a unique long; length, 1 to ``capacity``), in bins of at most ``capacity``.

    A bin's number is the least unit in it; offsets go from 0 without gaps.  The result depends on units and lengths alone.
    Pieces are dealt by a hash of their unit, so chunks are of about ``chunk`` pieces whatever the table holds.
    """

    def placed(units: np.ndarray, sizes: np.ndarray, bins: list[list[int]]) -> pd.DataFrame:
        order = [sorted(b, key=lambda i: units[i]) for b in bins]
        at = np.array([i for b in order for i in b], np.int64)
        counts = np.array([len(b) for b in order], np.int64)
        length = sizes[at]
        ends = np.cumsum(length)
        starts = np.cumsum(counts) - counts
        begin = np.repeat((ends - length)[starts], counts) if len(at) else ends
        total = np.add.reduceat(length, starts) if len(at) else length
        return pd.DataFrame({"unit": units[at], "length": length, "bin": np.repeat(units[at][starts], counts) if len(at) else units[at], "offset": ends - length - begin, "fill": np.repeat(total, counts)})

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        units, sizes = pdf["unit"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        return placed(units, sizes, improved(sizes, best_fit(sizes, capacity), capacity))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        units, sizes = pdf["unit"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        bins = list(pdf.groupby("bin").indices.values())
        return placed(units, sizes, improved(sizes, [list(map(int, b)) for b in bins], capacity))

    schema = "unit long, length long, bin long, offset long, fill long"
    rows = pieces.select(F.col(unit).alias("unit"), F.col("length").cast("long").alias("length"))
    short = rows.where(F.col("length") < capacity)
    n = short.count()
    dealt = lambda df, by, k, turn: df.withColumn("chunk", F.pmod(F.xxhash64(F.lit(turn), by), F.lit(k))).repartition(k, "chunk").groupBy("chunk")
    done = [rows.where(F.col("length") >= capacity).select("unit", "length", F.col("unit").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    state = written(dealt(short, "unit", max(1, -(-n // chunk)), 0).applyInPandas(first, schema), "packed-0")
    turn, before = 0, None
    while True:
        done.append(state.where(F.col("fill") >= capacity).select("unit", "length", "bin", "offset"))
        left = state.where(F.col("fill") < capacity)
        size = left.where("offset = 0").agg(F.count("*").alias("bins"), F.sum("fill").alias("fill")).first()
        # no round helps when these bins are as few as can be, were all in one chunk already, or hardly became fewer
        if size["bins"] <= -(-(size["fill"] or 0) // capacity) or before == 1 or (turn and size["bins"] > 0.99 * were):
            break
        turn, before, were = turn + 1, max(1, -(-size["bins"] // chunk)), size["bins"]
        state = written(dealt(left, "bin", before, turn).applyInPandas(again, schema), f"packed-{turn}")
    done.append(left.select("unit", "length", "bin", "offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, end: int = 2, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``token_pieces`` with ``sequence_id`` (long) and ``offset``: where each is in its sequence of at most ``capacity`` ids.

    Nulls, empty and very long texts, repeated rows and empty tables are as there; pieces of equal length are told apart
    by their place in the written table, so ties don't matter.
    """
    pieces = written(token_pieces(docs, end, capacity, tokenizer).withColumn("unit", F.monotonically_increasing_id()), "pieces")
    places = packed(pieces, "unit", capacity).select("unit", F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(places, "unit").drop("unit")


def sequences(docs: DataFrame, packing: DataFrame, **options) -> DataFrame:
    """(sequence_id, ids): the sequences that ``packing`` (of ``pack_documents``, with the same options) makes of ``docs``, whose ids don't repeat."""
    ids = token_pieces(docs, with_ids=True, **options).select("doc_id", "piece", "ids")
    rows = packing.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids; every document ends in id 2."""
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
