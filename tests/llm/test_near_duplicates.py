"""Components of near duplicates against all pairs; components of links against union-find."""

import random

import pytest

from gradloom.llm import near_duplicates as N
from gradloom.llm.components import components


def shingles(text, k=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, d = [], 0
    line = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.2:
                own = own[: rng.randint(1, len(own))]
            rows.append((d, " ".join(own).upper() if rng.random() < 0.1 else "\n".join(own)))
            d += 1
    for n in range(30):  # a popular line with a little of their own
        rows.append((d, line + " " + " ".join(rng.choice(words) for _ in range(n % 12))))
        d += 1
    return [*rows, (d, None), (d + 1, " \t"), (d + 2, "one two"), (d + 3, "ONE  two"), (d + 4, "one two three"), (d + 5, "z " * 4000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS h", "2 AS set_id").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    text = "a b c d e f g"
    got = N.jaccard_components(spark.createDataFrame([(7, text), (7, text), (3, text), (9, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(3, 3, 3), (7, 3, 3), (7, 3, 3), (9, 0, 9)]
    assert N.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 101), (7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 100: 50, 101: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
