"""Removal of repeated passages by sorting suffixes: deep-shallow sorting over the places where repeats can start.

A string of ``length`` bytes is named by the least hash of its ``gram``-byte substrings, so equal strings have equal
names wherever they stand.  Consecutive strings with one name form a run, of 16 or so.  Only runs whose name several
documents have can hold a repeat; which names these are is known from a filter of bounded size.

Such runs travel to the name's bucket with the text they cover; equal runs of a batch travel once, for the smallest
document, and are settled for the others at once.  Names that very many documents have would make hot buckets, since the
ends of a popular passage differ in every document; their strings travel one by one, under their own hash.  A bucket
sorts all suffixes that start in its runs: multikey quicksort by 8-byte characters to a shallow depth, then blind tries
for the groups with a longer common prefix.  Equal strings end up side by side, and all but those of the smallest
document are marked.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeated_hashes
from .shared import bounded_batches, buckets_for, documents, text_bytes, trimmed
from .text import mix, slices, text_buffer

LENGTH, GRAM, SHALLOW, SMALL = 50, 20, 13, 64
#: Documents from which on a name counts as hot.
HOT = 1024
_PART = 4 << 20  # bytes of run texts that are sorted at once


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte the 8 bytes from there, first byte highest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    two = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    four = two[:-2].astype(np.uint32) << 16 | two[2:]
    return (four[:-4].astype(np.uint64) << np.uint64(32) | four[4:])[: len(data)]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        h, have = np.minimum(h[:-have], h[have:]), have * 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first, count, name, document): runs of strings of ``length`` bytes with one name; count is of their starts."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, np.zeros(0, np.uint64), empty
    words = eights(data)
    n = len(data) - gram + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, gram - 8, 8), gram - 8]:
        h ^= h >> np.uint64(29)
        h = (h + words[at : n + at]) * np.uint64(0x94D049BB133111EB)
    h = mix(h)
    names = mix(_least(h, length - gram + 1))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(names)]
    fits = np.arange(len(names)) + length <= offsets[1:][doc]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & fits)
    ends = np.append(np.flatnonzero(new), len(names))
    last_fit = np.minimum(ends[np.searchsorted(ends, first, "right")], offsets[1:][doc[first]] - length + 1)
    return first, last_fit - first, names[first], doc[first]


def multikey_quicksort(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes at ``at`` by their first ``SHALLOW`` bytes: two characters, of 8 and of 5 bytes.

    Every open group is split in three around its pivot, the median of three of its characters; all groups of a round are
    split at once.  What equals the pivot goes on with the next character, or is done.  Groups of at most ``SMALL``, and
    those that are still open after twice the rounds of even splits, are settled together by comparison of both characters.
    """
    n = len(at)
    second_of = lambda own: words[at[own] + 8] >> np.uint64(24)
    order, rank, char = np.arange(n), np.arange(n), words[at]
    lo, size, second = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n), np.zeros(min(n, 1), bool)
    small = []
    for _ in range(2 * (n // SMALL).bit_length()):
        few = size <= SMALL
        small.append((lo[few], size[few]))
        lo, size, second = lo[~few], size[~few], second[~few]
        if not len(lo):
            break
        group, places = np.repeat(np.arange(len(lo)), size), _places(lo, size)
        own, key = order[places], char[places]
        x, y, z = char[lo], char[lo + size // 2], char[lo + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[group]
        left, parts = lo, []
        for side in (key < pivot, key == pivot, key > pivot):
            m = np.flatnonzero(side)
            count = np.bincount(group[m], minlength=len(lo))
            to = np.arange(len(m)) + (left - np.cumsum(count) + count)[group[m]]
            order[to], char[to] = own[m], key[m]
            parts.append((left, count))
            left = left + count
        (below, n_below), (same, n_same), (above, n_above) = parts
        rank[_places(same[second], n_same[second])] = np.repeat(same[second], n_same[second])
        same, n_same = same[~second], n_same[~second]
        on = _places(same, n_same)
        char[on] = second_of(order[on])
        lo, size = np.concatenate([below, same, above]), np.concatenate([n_below, n_same, n_above])
        second = np.concatenate([second, np.ones(len(same), bool), second])
    lo, size = (np.concatenate(x) for x in zip(*small, (lo, size), strict=True))
    by = np.argsort(lo, kind="stable")
    by = by[size[by] > 1]
    places, group = _places(lo[by], size[by]), np.repeat(lo[by], size[by])
    one, two = words[at[order[places]]], second_of(order[places])
    by = np.lexsort((two, one, group))
    order[places], one, two = order[places][by], one[by], two[by]
    rank[places] = places[_firsts(group, one, two)]
    return order, rank


def deep_shallow(words: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at ``at`` by their first ``length`` bytes; ``words`` are the text's ``eights``.

    Returns (order, group): positions into ``at`` in order, and for each place in it a number that equal strings share.
    """
    order, rank = multikey_quicksort(words, at)
    open_ = np.flatnonzero(_several(rank))
    while len(open_):  # one more node of its blind trie for every group that isn't settled
        own, groups = at[order[open_]], rank[open_]
        head = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        pivot = np.repeat(own[head], np.diff(np.append(head, len(groups))))
        branch, undecided = np.zeros(len(own), np.int64), np.arange(len(own))
        for depth in range(SHALLOW, length, 8):
            x, p = words[own[undecided] + depth], words[pivot[undecided] + depth]
            if depth + 8 > length:  # bytes behind the end don't count
                cut = np.uint64(8 * (depth + 8 - length))
                x, p = x >> cut << cut, p >> cut << cut
            differ = x ^ p
            pick = differ != 0
            if pick.any():
                d, x, hit = differ[pick], x[pick], undecided[pick]
                zeros = np.zeros(len(d), np.int64)
                for bits in (32, 16, 8):  # leading zero bytes
                    low = d < (np.uint64(1) << np.uint64(64 - bits))
                    zeros[low] += bits // 8
                    d = np.where(low, d << np.uint64(bits), d)
                byte = (x >> (np.uint64(56) - np.uint64(8) * zeros.astype(np.uint64)) & np.uint64(255)).astype(np.int64)
                # in order: what branches off below the pivot (shallowest first), the pivot's equals, what does above
                branch[hit] = np.where(x > p[pick], 1, -1) * (length + 1 - depth - zeros) * 256 + byte
                undecided = undecided[~pick]
                if not len(undecided):
                    break
        by = _by_two(groups, (branch + (1 << 19)).astype(np.uint64), 20)
        order[open_], branch, groups = order[open_][by], branch[by], groups[by]
        rank[open_] = groups + _within(groups, branch)
        several = _several(rank[open_]) & (branch != 0)
        open_ = open_[several]
    return order, rank


def _by_two(group: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """The order by (group, key), keys having ``bits`` bits: as one number where that fits into 64."""
    if len(group) and int(group.max()) >> (64 - bits):
        return np.lexsort((key, group))
    return np.argsort(group.astype(np.uint64) << np.uint64(bits) | key)


def _places(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by the keys the index of the first equal one."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(np.append(first, len(new))))


def _within(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For rows sorted by (group, key): places from the group's first row to the first with the same key."""
    return _firsts(group, key) - _firsts(group)


def _several(rank: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rank), bool)
    equal = rank[1:] == rank[:-1]
    out[1:] |= equal
    out[:-1] |= equal
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal ones; touching intervals become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], end[np.append(new[1:] - 1, len(end) - 1)] if len(start) else end


#: Runs of a batch for a bucket: documents are numbered within it; text lies one run after another.
_RUNS = ("ids:<i8", "rows:<i8", "key:<u4", "doc:<u4", "n:<i4", "many:<i4", "at:<i4", "text:u1")
#: Spans for a bucket of documents.
_SPANS = ("row:<i8", "start:<i4", "end:<i4")
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("packed", pa.binary())])


def _packed(kinds: tuple[str, ...], arrays: list[np.ndarray]) -> bytes:
    parts = [np.ascontiguousarray(x).astype(k.split(":")[1]) for k, x in zip(kinds, arrays, strict=True)]
    return zlib.compress(np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(x.tobytes() for x in parts), 1)


def _unpacked(kinds: tuple[str, ...], packed: bytes) -> list[np.ndarray]:
    data, out = zlib.decompress(packed), []
    at = 8 * len(kinds)
    for n, k in zip(np.frombuffer(data, "<i8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, k.split(":")[1], n, at))
        at += out[-1].nbytes
    return out


def _together(kinds: tuple[str, ...], blobs: list[bytes]) -> list[list[np.ndarray]]:
    return [list(x) for x in zip(*(_unpacked(kinds, b) for b in blobs), strict=True)] or [[] for _ in kinds]


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _spans_packed(row: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int) -> list[tuple[int, str, bytes]]:
    """Spans by the bucket of their row."""
    where = np.mod(row, n_buckets)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(n_buckets + 1))
    return [(int(i), "spans", _packed(_SPANS, [x[order[edges[i] : edges[i + 1]]] for x in (row, start, end)])) for i in np.flatnonzero(np.diff(edges))]


def _candidates(docs: DataFrame, filter_, n_buckets: int, length: int, gram: int) -> DataFrame:
    """(bucket, kind, packed): runs by bucket, and spans that are settled already by bucket of documents."""

    def collect(batches):
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            by_id = np.argsort(ids, kind="stable")
            place_of = np.empty(len(ids), np.int64)
            place_of[by_id] = np.arange(len(ids))
            data, offsets = text_buffer(batch.column(2))
            seen: dict[bytes, int] = {}  # text of a run -> its number
            number, where, owner, key, count = [], [], [], [], []
            for lo, hi in slices(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                first, size, name, doc = runs(own, at, length, gram)
                level = filter_.value.level(name)
                raw, plain, hot = own.tobytes(), np.flatnonzero(level == 1), np.flatnonzero(level > 1)
                # a hot name's strings go one by one, under a key of their own
                single = np.repeat(hot, size[hot])
                inside = np.arange(len(single)) - np.repeat(np.cumsum(size[hot]) - size[hot], size[hot])
                begin, strings = np.concatenate([first[plain], first[single] + inside]), np.concatenate([size[plain], np.ones(len(single), np.int64)])
                which = np.concatenate([doc[plain], doc[single]])
                here = [seen.setdefault(raw[a:b], len(seen)) for a, b in zip(begin.tolist(), (begin + strings + length - 1).tolist(), strict=True)]
                number.append(np.array(here, np.int64))
                where.append(begin - at[which])
                owner.append(which + lo)
                count.append(strings)
                key.append(np.concatenate([name[plain] & np.uint64(0xFFFFFFFF), np.full(len(single), 1 << 32, np.uint64)]))
            number, where, owner, count = (_cat(x, np.int64) for x in (number, where, owner, count))
            key, texts, out = _cat(key, np.uint64), list(seen), []
            if not len(number):
                continue
            order = np.lexsort((place_of[owner], number))  # per text, the smallest document first
            number, where, owner, count, key = number[order], where[order], owner[order], count[order], key[order]
            least = np.repeat(ids[owner[head := np.flatnonzero(np.diff(number, prepend=-1))]], times := np.diff(np.append(head, len(number))))
            lost = ids[owner] > least
            out += _spans_packed(rows[owner[lost]], where[lost], (where + count + length - 1)[lost], n_buckets)
            # the others stay: places of one row are a run's places
            number, where, owner, count, key = (x[~lost] for x in (number, where, owner, count, key))
            head = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            many = np.diff(np.append(head, len(number)))
            which, owner, count, key = number[head], owner[head], count[head], key[head]
            for i in np.flatnonzero(key >> np.uint64(32)).tolist():
                key[i] = zlib.crc32(texts[which[i]])
            bucket = (mix(key) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for i in np.flatnonzero(np.diff(edges)):
                pick = order[edges[i] : edges[i + 1]]
                docs_, doc = np.unique(owner[pick], return_inverse=True)
                places = where[np.repeat(head[pick] - (np.cumsum(many[pick]) - many[pick]), many[pick]) + np.arange(many[pick].sum())]
                text = np.frombuffer(b"".join([texts[j] for j in which[pick].tolist()]), np.uint8)
                out.append((int(i), "runs", _packed(_RUNS, [ids[docs_], rows[docs_], key[pick], doc, count[pick], many[pick], places, text])))
            yield _rows(out)

    return docs.mapInArrow(trimmed(collect), "bucket int, kind string, packed binary")


def _sorted_spans(table: pa.Table, length: int, n_buckets: int) -> pa.Table:
    """Packed spans of the strings in a bucket that a smaller document has, and those that were settled before."""
    kinds, blobs = table["kind"].to_pylist(), table["packed"].to_pylist()
    number = table["bucket"].to_pylist()
    out = [(b, k, x) for b, k, x in zip(number, kinds, blobs, strict=True) if k == "spans"]
    ids, rows, key, doc, n, many, at, text = _together(_RUNS, [x for k, x in zip(kinds, blobs, strict=True) if k == "runs"])
    base = np.cumsum([0, *map(len, ids)])
    doc = _cat([d + b for d, b in zip(doc, base[:-1], strict=True)], np.int64).astype(np.int64)
    ids, rows, key, n, many, at, text = (_cat(x, kind) for x, kind in zip((ids, rows, key, n, many, at, text), ("<i8", "<i8", "<u4", "<i8", "<i8", "<i4", "u1"), strict=True))
    size, order = n + length - 1, np.lexsort((ids[doc], key))
    offset, begin = np.cumsum(size) - size, np.cumsum(many) - many
    total, sorted_key, raw, lo = np.cumsum(size[order]), key[order], text.tobytes(), 0
    del text
    while lo < len(order):  # a part ends where a key ends
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PART, "right")))
        hi = int(np.searchsorted(sorted_key, sorted_key[hi - 1], "right"))
        own, lo = order[lo:hi], hi
        seen: dict[bytes, int] = {}  # equal runs are sorted once, for the smallest document
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(offset[own].tolist(), (offset[own] + size[own]).tolist(), strict=True)], np.int64)
        first = np.full(len(seen), len(own))
        np.minimum.at(first, which, np.arange(len(own)))
        counts, least = n[own[first]], ids[doc[own[first]]]
        data, start = np.frombuffer(b"".join(seen), np.uint8), np.cumsum(counts + length - 1) - (counts + length - 1)
        run = np.repeat(np.arange(len(seen)), counts)
        inside = np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
        by, group = deep_shallow(eights(np.concatenate([data, np.zeros(length + 8, np.uint8)])), start[run] + inside, length)
        of, head = least[run[by]], np.flatnonzero(np.diff(group, prepend=-1))
        lost = np.zeros(len(by), bool)
        lost[by] = of > np.repeat(np.minimum.reduceat(of, head), np.diff(np.append(head, len(by))))
        # consecutive lost strings of a run are one span, wherever the run is; all of it where a smaller document has it
        other = run[1:] != run[:-1]
        edge = np.flatnonzero(lost & np.concatenate([[True], ~lost[:-1] | other]))
        stop = np.flatnonzero(lost & np.concatenate([~lost[1:] | other, [True]]))
        spans = np.bincount(run[edge], minlength=len(seen))
        before = np.cumsum(spans) - spans
        whole = ids[doc[own]] > least[which]
        times = np.where(whole, 1, spans[which]) * many[own]
        i = np.repeat(np.arange(len(own)), times)  # the run of each span that comes out
        k = np.arange(len(i)) - (np.cumsum(times) - times)[i]
        per = np.where(whole, 1, spans[which])[i]
        j = before[which[i]] + k % np.maximum(per, 1)
        place, full = at[begin[own[i]] + k // np.maximum(per, 1)], whole[i]
        a = np.where(full, 0, inside[edge[np.where(full, 0, j)]] if len(edge) else 0)
        b = np.where(full, size[own[i]], inside[stop[np.where(full, 0, j)]] + length if len(edge) else 0)
        if len(i):
            out += _spans_packed(rows[doc[own[i]]], place + a, place + b, n_buckets)
    return pa.table(_rows(out).columns if out else [pa.array([], f.type) for f in _PACKED], schema=_PACKED)


def repeated_spans(docs: DataFrame, n_buckets: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(bucket, kind, packed): spans by bucket of documents, bytes of ``docs`` (doc_id, row, text) in strings of
    ``length`` bytes that documents with smaller ids have.  Spans may overlap.  ``row`` names a row.
    """
    spark = docs.sparkSession

    def names(batch):
        data, offsets = text_buffer(batch.column(0))
        for lo, hi in slices(offsets):
            _, _, name, doc = runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, gram)
            yield name, doc

    found = spark.sparkContext.broadcast(repeated_hashes(docs.select("text"), names, text_bytes(docs) / 16, (2, HOT)))
    bounded_batches(spark)
    sent = _candidates(docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text"), found, n_buckets, length, gram)
    return sent.groupBy("bucket").applyInArrow(lambda table: _sorted_spans(table, length, n_buckets), "bucket int, kind string, packed binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) with ``kept`` (binary: the bytes left), n_bytes, n_removed, n_spans.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id; strings are
    judged on the input.  Null texts count as empty; shorter texts stay whole; rows with a null id lose nothing; rows
    of one id don't affect each other; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    n_buckets = buckets_for(text_bytes(docs), 16e6)
    spans = repeated_spans(docs, n_buckets, length)
    dealt = docs.select(F.pmod("row", F.lit(n_buckets)).cast("int").alias("bucket"), "doc_id", "row", "text")

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        data, offsets = text_buffer(texts["text"])
        row, start, end = (_cat(x, np.int64) for x in _together(_SPANS, found["packed"].to_pylist()))
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        own = texts["row"].to_numpy()
        lo, hi = np.searchsorted(row, own), np.searchsorted(row, own, "right")
        kept, gone, spans = [], [], []
        for i in range(len(own)):
            text = data[offsets[i] : offsets[i + 1]]
            a, e = merged(start[lo[i] : hi[i]], end[lo[i] : hi[i]])
            if len(a):
                edges = np.zeros(len(text) + 1, np.int8)
                edges[a], edges[e] = 1, -1
                text = text[np.cumsum(edges[:-1]) == 0]
            gone.append(int((e - a).sum()))
            spans.append(len(a))
            kept.append(text.tobytes())
        return pa.table([texts["doc_id"], pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
