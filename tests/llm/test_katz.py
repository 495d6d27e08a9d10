"""Katz scores against a plain version, and that every context's probabilities add up to 1."""

import contextlib
import math
import os
import threading
import zlib
from collections import Counter

import numpy as np
import pytest

from gradloom.llm import katz

WORDS = "a b c d e f g the of to".split()


def documents(n=300):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS, p=[0.05] * 7 + [0.3, 0.2, 0.15], size=rng.integers(0, 12))) + (f" rare{i % 37}" if i % 3 == 0 else "")) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "THE of\tunseenword\n"), (n + 3, "the " * 3000)]


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*low.encode().split(), b"<end>"]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    return {r.doc_id: r for r in katz.katz_scores(df.withColumn("extra", df.doc_id)).collect()}


def test_base(scored):
    docs = documents()
    train = Counter(t for i, text in docs if zlib.crc32(str(i).encode()) % 10 != 0 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    for i, text in docs:
        own, r = tokens(text), scored[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), abs=1e-6)


def plain_model(docs):
    """Recursive Katz over dictionaries: p(word, history)."""
    train = [tokens(text) for i, text in docs if zlib.crc32(str(i).encode()) % 10 != 0]
    grams = {m: Counter() for m in (1, 2, 3)}
    for own in train:
        line = [b"<start>", *own]
        grams[1].update(own)
        grams[2].update(zip(line, line[1:]))
        grams[3].update(zip(line, line[1:], line[2:]))

    def factors(counts):
        of = Counter(counts.values())
        tail = 6 * of[6] / of[1] if of[1] else 1
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * of[r + 1] / of[r] / r - tail) / (1 - tail) if of[r] and tail < 1 else 0
            out[r] = d if 0 < d <= 1 else r / (r + 1)
        return out

    d = {m: factors(c) for m, c in grams.items()}
    held = lambda m, n: n * d[m].get(n, 1)
    total = sum(grams[1].values())
    mass = sum(held(1, n) for n in grams[1].values())
    scale1 = min(1, (total - 0.5) / mass)
    history = grams[1].copy()
    history[b"<start>"] = len(train)

    def p(word, context):
        if not context:
            n = grams[1][word]
            return scale1 * held(1, n) / total if n else 1 - scale1 * mass / total
        m = len(context) + 1
        followers = {g[-1]: n for g, n in grams[m].items() if g[:-1] == context}
        if not followers:
            return p(word, context[1:])
        c = history[context[0]] if m == 2 else grams[2][context]
        scale = min(1, (c - 0.5) / sum(held(m, n) for n in followers.values()))
        prob = {w: scale * held(m, n) / c for w, n in followers.items()}
        if word in prob:
            return prob[word]
        return (1 - sum(prob.values())) / (1 - sum(p(w, context[1:]) for w in prob)) * p(word, context[1:])

    return p, set(grams[1])


def test_scores_and_normalisation(scored):
    docs = documents(120)
    docs = [x for x in docs if x[0] != 123]
    p, words = plain_model(docs)
    for context in ((), (b"the",), (b"<start>",), (b"the", b"of"), (b"<start>", b"the"), (b"of", b"zzz")):
        assert sum(p(w, context) for w in words) + p(b"never seen", context) == pytest.approx(1, abs=1e-9)


def test_scores_match_plain(spark):
    docs = documents(60)[:62]
    p, _ = plain_model(docs)
    got = {r.doc_id: r.score for r in katz.katz_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        line = [b"<start>", *tokens(text)]
        want = sum(math.log10(p(line[k], tuple(line[max(0, k - 2) : k]))) for k in range(1, len(line)))
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_empty(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rare_words_are_in_the_model(spark):
    """N-grams of more words than any fixed number of frequent ones, and copies of rows."""
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 40).repeat(2)[:60])) for i in range(120)]
    docs += [(i + 200, docs[i][1]) for i in range(60)] + [docs[5]]
    p, _ = plain_model(docs)
    got = katz.katz_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got[::7]:
        line = [b"<start>", *tokens(texts[r.doc_id])]
        assert r.score == pytest.approx(sum(math.log10(p(line[k], tuple(line[max(0, k - 2) : k]))) for k in range(1, len(line))), abs=1e-6), r.doc_id


def test_tables_are_dropped_when_read(spark, tmp_path, monkeypatch):
    """The table of order 3 alone is left, which the result reads."""
    monkeypatch.setattr("gradloom.llm.shared.shared_dir", lambda _: str(tmp_path))
    got = katz.katz_scores(spark.createDataFrame(documents(40), "doc_id long, text string"))
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["gradloom-katz-order3"]
    assert got.count() == 44


@pytest.mark.parametrize("known", (0, 3, 40))
def test_words_that_are_not_broadcast(spark, monkeypatch, known):
    """The same scores when hardly a word is broadcast, and when there are many small groups; a repeated row counts twice."""
    monkeypatch.setattr(katz, "KNOWN", known)
    monkeypatch.setattr(katz, "GROUP", 40)
    docs = [*documents(60)[:62], documents(60)[7], documents(60)[7]]
    p, _ = plain_model(docs)
    train = Counter(t for i, text in docs if zlib.crc32(str(i).encode()) % 10 != 0 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    got = katz.katz_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    texts = dict(docs)
    for r in got:
        own = tokens(texts[r.doc_id])
        line = [b"<start>", *own]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), abs=1e-6)
        assert r.score == pytest.approx(sum(math.log10(p(line[k], tuple(line[max(0, k - 2) : k]))) for k in range(1, len(line))), abs=1e-6), r.doc_id


def test_disk(spark, tmp_path, monkeypatch):
    """Shuffles and tables of all steps take less than 24 bytes a token together at any time (several hashes a trigram took more)."""
    monkeypatch.setattr("gradloom.llm.shared.shared_dir", lambda _: str(tmp_path))
    rng = np.random.default_rng(3)
    words = np.array([f"w{x}" for x in range(20_000)])
    docs = [(i, " ".join(words[(20_000 ** rng.random(400)).astype(int) - 1])) for i in range(1000)]
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache()
    df.count()

    def used():
        total = 0
        for folder in (*local, str(tmp_path)):
            for base, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(FileNotFoundError):
                        total += os.path.getsize(os.path.join(base, name))
        return total

    floor, most, ended = used(), [0], threading.Event()

    def watch():
        while not ended.wait(0.05):
            most[0] = max(most[0], used())

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert katz.katz_scores(df).count() == 1000
    finally:
        ended.set()
        thread.join()
        df.unpersist()
    assert most[0] - floor < 24 * 401_000


def test_documents_leave_a_task_once(spark, monkeypatch):
    """However many groups there are, a document has a row for each task at most."""
    made = []
    was = katz.group_sums

    def watched(*args):
        made.append(was(*args).cache())
        return made[0]

    monkeypatch.setattr(katz, "group_sums", watched)
    monkeypatch.setattr(katz, "GROUP", 10)
    monkeypatch.setattr(katz, "TASKS", 2)
    assert katz.katz_scores(spark.createDataFrame(documents(60)[:60], "doc_id long, text string")).count() == 60
    assert made[0].count() <= 2 * 60
    made[0].unpersist()


def test_codes_that_fill_more_than_64_bits():
    class Wide(katz.Vocabulary):
        end = 1 << 21  # as if so many words were broadcast

    rng = np.random.default_rng(5)
    hashes, doc = rng.integers(1, 30, 400).astype(np.uint64), np.repeat(np.arange(8), 50)
    found = []
    for kind in (katz.Vocabulary, Wide):
        own = kind(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 1)
        w, v, u, _ = own.places(hashes, doc)
        names = np.unique(hashes)
        before = np.concatenate([[0, 0], hashes])
        for x, at in ((w, before[2:]), (v, before[1:-1]), (u, before[:-2])):
            x[x < 0] = own.end + np.searchsorted(names, at[x < 0])
        group = katz.Group([katz.pack(*(x.astype("<u4") for x in (u, v, w)), np.diff(doc, prepend=0) > 0, names, np.arange(8).astype("<u8"), np.ones(8, bool))], own)
        found.append((sorted(group.triple_n), sorted(group.pair_n), [x.tolist() for x in group.counts_of_counts()]))
    assert found[0] == found[1]
    assert sum(found[0][1]) == 400
