"""Registered queries on the smallest tables: against their SQL, or against a plain version of the contract."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from oracle import connect, differences
from tokenizers import Tokenizer

from gradloom.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


def test_op13(spark):
    library = Tokenizer.from_file(packing.tokenizer_file())
    want, total = set(), 0
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want |= {(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))}
    rows = queries.QUERIES["op13_best_fit_packing"](spark, SF).collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for x, n in own if x < o) for own in bins.values() for o, _ in own) and max(sum(n for _, n in own) for own in bins.values()) <= 1024
    assert len(bins) <= 1.01 * -(-total // 1024) + 1
