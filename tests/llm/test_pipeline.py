"""Each stage of the pipeline on what the one before kept, against plain versions."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from gradloom.llm import sentencepiece


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "ro") for b in ("n", "sta", "rim", "o", "lek", "tu")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, line(rng.randint(30, 90)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]  # exact copies
    rows += [(300 + i, rows[20 + i][1] + " one two", "en", "s2") for i in range(10)]  # near copies
    rows += [(400, "too short", "en", "s1"), (401, None, "en", "s1"), (402, "", None, None), (403, (line(10) + "\n") * 30, "en", "s3")]
    rows += [(500 + i, f"{line(40)} password=abcdef0123456789ab {line(5)}", "en", None) for i in range(5)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]


def test_repeated_ids_across_groups(spark, tmp_path):
    """A row goes because of its own group, not because another row has its id."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(3, a), (7, a), (7, b), (9, c), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in got) == sorted([(3, a, False), (7, b, False), (9, c, False), (9, "", True), (9, "", False)])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("doc_id", "doc_id")
    out, sf_dir = {}, with_labels(spark, top)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out[name] = [r.asDict() for r in docs.collect()]
    return out


def with_labels(spark, path):
    """A folder whose labels table is empty, as what the quality stage reads."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])


def test_quality(stages):
    rows = {r["doc_id"]: r for r in stages["quality"]}
    assert not {400, 401, 402, 403} & set(rows)
    assert {i for i in range(120)} <= set(rows)  # clean documents stay
    assert set(stages["quality"][0]) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_near_duplicates(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages["quality"]}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == sorted(d for d in sets if find(d) == d)


def test_secrets(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"]}
    for r in stages["secrets"]:
        assert r["text"] == re.sub(r"password=\w+", "<secret:assign>", before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert len(stages["secrets"]) == len(before)


def test_mixing(stages):
    docs = {r["doc_id"]: r for r in stages["secrets"]}
    sizes = Counter()
    for r in docs.values():
        sizes[r["source"]] += len(r["text"].split())
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target, open_, left = {}, dict(zip(order, [3, 1, 2] * 3, strict=False)), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del open_[s]
    taken, copies = Counter(), Counter(r["doc_id"] for r in stages["mixing"])
    for r in stages["mixing"]:
        assert r == docs[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
    largest = max(len(r["text"].split()) for r in docs.values())
    assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= largest for s in sizes)


def test_pieces(stages):
    with open(sentencepiece.MODEL, "rb") as f:
        encoder = sentencepiece.Encoder(sentencepiece.load(f.read()))
    texts = {r["doc_id"]: r["text"] for r in stages["mixing"]}
    assert Counter(r["doc_id"] for r in stages["pieces"]) == Counter(r["doc_id"] for r in stages["mixing"])
    for r in stages["pieces"]:
        assert r["round_trip"] and r["n_chars"] == len(texts[r["doc_id"]])
        assert r["n_pieces"] == len(encoder.ids([sentencepiece.marked(texts[r["doc_id"]])])[0])


def test_null_and_repeated_ids(spark, tmp_path):
    """Documents without an id, and different texts of one id, go all the way; repeated rows become one.

    What the rules reject goes, though kept rows have the same id or none, too.
    """
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(60))
    rows = [(i if i > 3 else None, text(), "en", "s", 1) for i in range(40)] + [(50, text(), "en", "s", 1), (50, text(), "en", "s", 1)]
    rows.append(rows[20])
    docs, sf_dir = spark.createDataFrame(rows + [(None, "too short", "en", "s", 1), (50, "junk " * 50, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"), with_labels(spark, tmp_path)
    for name, stage in pipeline.STAGES[:4]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "secrets":
            assert sorted(r.text for r in docs.collect()) == sorted({r[1] for r in rows})
    counts = Counter(r.text for r in docs.collect())
    assert set(counts) == {r[1] for r in rows} and set(counts.values()) <= {1, 2}  # 1.5 copies each on average


def test_empty(spark, tmp_path):
    docs, sf_dir = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), with_labels(spark, tmp_path)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
