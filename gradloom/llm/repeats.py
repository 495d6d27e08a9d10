"""Which 64-bit hashes occur in several documents of a corpus: a filter of bounded size, from one packed shuffle.

Tasks reduce a batch of documents to distinct hashes with the number of documents that have each, and ship them packed
by hash range, four bytes a hash.  A range's reducer adds the counts and sets the bits of those that reach a threshold in
its own segment of a Bloom filter; segments laid side by side are the filter.  A hash that is in every document costs a
reducer one entry a batch.  False positives only let more candidates through; every caller verifies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches, buckets_for, trimmed

#: Bytes that the filter of one threshold may take, however large the corpus.
MOST_BYTES = 32 << 20
_PROBES = 5


def _slots(low: np.ndarray, bits: int) -> list[np.ndarray]:
    h = low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = h >> np.uint64(34), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(_PROBES)]


class RepeatFilter:
    """``level(h)``: how many of the thresholds (ascending) each hash reaches; too high only by a false positive."""

    def __init__(self, segments: list[list[bytes]]):
        self.bits = [[np.frombuffer(b, np.uint8) for b in level] for level in segments]
        self.n = len(segments[0])
        sizes = [np.array([len(b) * 8 for b in level], np.int64) for level in self.bits]
        self.size, self.start = sizes, [np.cumsum(s) - s for s in sizes]
        self.flat = [np.concatenate(level) for level in self.bits]
        del self.bits

    def level(self, hashes: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(hashes), np.int8), np.arange(len(hashes))
        for flat, size, start in zip(self.flat, self.size, self.start, strict=True):
            bucket, low = bucket_of(hashes[todo], self.n), (hashes[todo] & np.uint64(0xFFFFFFFF))
            for i in range(_PROBES):
                h = low * np.uint64(0x9E3779B97F4A7C15)
                at = (((h >> np.uint64(34)) + np.uint64(i) * ((h & np.uint64(0xFFFFFFFF)) | np.uint64(1))) % size[bucket].astype(np.uint64)).astype(np.int64) + start[bucket]
                hit = (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                todo, bucket, low = todo[hit], bucket[hit], low[hit]
            out[todo] += 1
        return out


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def repeated_hashes(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], n_hashes: float, thresholds: tuple[int, ...] = (2, 16)) -> RepeatFilter:
    """``hashes`` turns a batch of ``docs`` into (hashes, document number) parts, each document whole in one part.

    ``n_hashes``: about how many there are, which sets the number of hash ranges.
    """
    bounded_batches(docs.sparkSession)
    n_buckets = buckets_for(n_hashes * 4, each=6e6)  # sorting takes a reducer ten times as much
    most = MOST_BYTES // n_buckets

    def pack(batches):
        for batch in batches:
            for h, doc in hashes(batch):
                order = np.argsort(h, kind="stable")  # documents stay in order within a hash
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                values, counts = np.unique(h[new], return_counts=True)
                low, edges = (values & np.uint64(0xFFFFFFFF)).astype("<u4"), np.searchsorted(bucket_of(values, n_buckets), np.arange(n_buckets + 1))
                multi, n_multi = [], []
                once, own = counts == 1, np.flatnonzero(np.diff(edges))  # ranges without a hash have no row
                for i in own:
                    part = slice(edges[i], edges[i + 1])
                    multi.append(np.concatenate([low[part][~once[part]], counts[part][~once[part]].astype("<u4")]).tobytes())
                    n_multi.append(low[part][once[part]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n_multi, pa.binary()), pa.array(multi, pa.binary())], ["bucket", "once", "more"])

    def reduce(key, pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["once"]])
        more = [np.frombuffer(b, "<u4").reshape(2, -1) for b in pdf["more"]]
        low, counts = np.concatenate([once, *[m[0] for m in more]]), np.concatenate([np.ones(len(once), np.int64), *[m[1] for m in more]])
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first) if len(low) else counts
        out = []
        for t in thresholds:
            own = low[first][total >= t]
            size = int(min(most, max(8, len(own) * 2)))  # 16 bits a hash, while they fit
            bits = np.zeros(size * 8, bool)
            for at in _slots(own, size * 8):
                bits[at] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pd.DataFrame({"bucket": [key[0]], "segments": [out]})

    packed = docs.mapInArrow(trimmed(pack), "bucket int, once binary, more binary")
    rows = {r.bucket: r.segments for r in packed.groupBy("bucket").applyInPandas(reduce, "bucket int, segments array<binary>").collect()}
    empty = [b"\0" * 8 for _ in thresholds]
    return RepeatFilter([[bytes(rows.get(b, empty)[i]) for b in range(n_buckets)] for i in range(len(thresholds))])
