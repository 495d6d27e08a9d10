"""Repeat removal against a dictionary of all 50-byte strings, and the sort against sorted()."""

import hashlib
import random

import numpy as np
import pytest

from gradloom.llm import suffix_dedup as S


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["é", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 40)), rng.choice(passages) if rng.random() < 0.6 else "", text(rng.randint(0, 20)), "x" * rng.choice([0, 0, 0, 49, 50, 130])]
        rows.append((rng.randint(0, 10_000) * 2 + (i % 2), "".join(parts)))
    rows += [(20_001 + i, rows[5][1]) for i in range(5)] + [(30_000, None), (30_001, ""), (30_002, "a" * 49), (30_003, passages[0])]
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "HOT", 1024 if seed == 1 else 8)  # the second run splits popular names
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "'x' AS row", "1 AS bucket").repartition(5)
    got = S.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "q" * 60), (1, "q" * 60), (2, "q" * 55), (None, "q" * 60)]
    got = sorted(((r.doc_id or 0, r.n_removed, r.n_spans) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 55, 1)]
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("alphabet", [2, 5, 255])
def test_deep_shallow_sorts(alphabet):
    rng = np.random.default_rng(alphabet)
    data = rng.integers(1, alphabet + 1, 4000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    at = np.arange(len(data) - 50)
    order, group = S.deep_shallow(S.eights(np.concatenate([data, np.zeros(58, np.uint8)])), at)
    strings = [data[i : i + 50].tobytes() for i in at]
    assert [strings[i] for i in order] == sorted(strings)
    ordered = [strings[i] for i in order]
    assert all((ordered[i] == ordered[i + 1]) == (group[i] == group[i + 1]) for i in range(len(at) - 1))


@pytest.mark.parametrize("kind", ["few", "many", "rising", "falling", "pipe", "one", "long heads"])
@pytest.mark.parametrize("n", [0, 1, 2, 64, 65, 3000])
def test_multikey_quicksort(kind, n):
    """Order and equal ones by 13 bytes, also for inputs on which pivots split badly."""
    rng = np.random.default_rng(n)
    i = np.arange(n)
    keys = {"few": rng.integers(0, 3, n), "many": rng.integers(0, 1 << 40, n), "rising": i, "falling": n - i, "pipe": np.minimum(i, n - i), "one": i * 0, "long heads": rng.integers(0, 500, n)}[kind]
    head = 9 if kind == "long heads" else 3
    strings = [b"x" * head + int(k).to_bytes(5, "big") + b"y" * (45 - head) for k in keys]
    data = np.frombuffer(b"".join(strings) + bytes(58), np.uint8)
    order, rank = S.multikey_quicksort(S.eights(data), np.arange(n) * 50)
    assert sorted(order.tolist()) == list(range(n))
    ordered = [strings[k][: S.SHALLOW] for k in order]
    assert ordered == sorted(s[: S.SHALLOW] for s in strings)
    assert rank.tolist() == [ordered.index(s) for s in ordered]
