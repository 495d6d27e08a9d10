"""Filter audit, Merkle manifest and packing against plain versions, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.llm import filter_audit, merkle, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("part string", "idx long", "digest string", "failed int", "step int", "unit long", "length long", "n long", "top long", "key long")


def documents(n=90):
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(words[(i * 7 + j * j) % (5 + i % 36)] for j in range(i * 5 % 260))
        text = text.upper() if i % 9 == 0 else text + " #5 %" if i % 4 == 0 else text
        rows.append((i, text if i % 13 else "the same text again", ["en", None, "fr"][i % 3], [None, "", "hot", "hot", "hot", "ü", "z"][i % 7], len(text)))
    odd = [(900, None, None, None, None), (901, "", "en", "hot", 0), (902, " \n\t\x0b ", "xx", None, 3), (903, "A" * 200_000, "en", "alone", 1), (904, "wörd Émile " * 9000, "de", "hot", 1), (None, "the same text again", None, "hot", 5), (905, "日本語 <|endoftext|> x", None, "z", None), (906, "a'll 'S  \r\n\n x's ½", None, "z", None)]
    return rows + odd + odd[:3]  # repeated rows


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("1").cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING]) if clash else df


# filter audit


def plain_audit(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = defaultdict(list)
    for d, t, _, source, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        parts[source or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(rows)
            for step, x in enumerate(order, 1):
                gone = [r for r in alive if r[0][x]]
                rest = [r for r in alive if not r[0][x]]
                redundant = sum(r[0][x] for r in rows) - len(gone)
                unique = sum(r[0][x] and sum(r[0].values()) == 1 for r in rows)
                out[part, order, step] = [len(rest), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone)]
                total[x] += len(gone)
                alive = rest
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_filter_audit(spark, clash):
    docs = documents()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 3)] + [(6, None, 1), (9, 1, None), (None, 1, 1), (12, 0, 0)]
    marked = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").withColumn("part", F.lit("x"))
    got = filter_audit.replayed(filter_audit.document_flags(frame(spark, docs, clash), marked)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == plain_audit(docs, labels)
    assert len(got) == 600 * len({d[3] or "" for d in docs})


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert filter_audit.replayed(filter_audit.document_flags(frame(spark, []), labels)).collect() == []


# manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels of digests, the last with one."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_path(tree, i):
    for level in tree[:-1]:
        lo = i // 16 * 16
        yield level[lo:i], level[i + 1 : lo + 16]
        i //= 16


def plain_manifest(docs, tampered, change):
    def leaf(d, text, lang, source, n):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])

    groups = defaultdict(list)
    for d, t, lang, source, n in docs:
        given = leaf(d, change(t) if t is not None else None, lang, source, n) if tampered(d) else leaf(d, t, lang, source, n)
        groups[source].append((d is not None, d or 0, leaf(d, t, lang, source, n), given, d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(groups[s])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (*_, own, given, d) in enumerate(sorted(groups[s])):
            path = [*plain_path(trees[s], i), *plain_path(top, k)]
            acc = given
            for left, right in path:
                acc = sha(*left, acc, *right)
            out.append((d, own, trees[s][-1][0], top[-1][0], sha(*[x for left, right in path for x in left + right]), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def changed(spark, rows, clash=False):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.merkle_manifest(frame(spark, rows, clash), tampered, merkle.lower_ascii(F.col("text")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def by_crc(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 0


@pytest.mark.parametrize("clash", [False, True])
def test_manifest(spark, clash):
    rows = documents()
    got = changed(spark, rows, clash)
    assert got == plain_manifest(rows, by_crc, lower)
    assert {r[-1] for r in got} == {True, False}  # capitals that were lowered don't verify


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 1), (300, 20), (33, 33)])
def test_manifest_of_sizes(spark, n, sources):
    rows = [(i, f"T{i}", "en", f"s{i % sources:02d}", i) for i in range(n)]
    assert changed(spark, rows) == plain_manifest(rows, by_crc, lower)


def test_no_row_of_a_leaf_carries_siblings(spark):
    """The rows that become one per leaf repeat nothing of their run but the subroot."""
    got = merkle.merkle_manifest(frame(spark, documents(40)))
    line = next(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(" in x)
    repeated = re.findall(r"\[([^\[\]]*)\], false, \[", line)[-1]
    assert re.findall(r"(\w+)#", repeated) == ["subroot"]


def test_manifest_of_nothing_and_of_copies(spark):
    assert changed(spark, []) == []
    rows = [(7, "same Text", "en", "hot", 1)] * 400 + [(i, "Text", None, None, None) for i in range(5)]
    assert changed(spark, rows) == plain_manifest(rows, by_crc, lower)


# packing


def plain_ids(text):
    from tokenizers import Tokenizer

    plain_ids.library = getattr(plain_ids, "library", None) or Tokenizer.from_file(packing.tokenizer_file())
    return plain_ids.library.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_librarys():
    rng = np.random.default_rng(5)
    letters = list("abcdefgXYZ '\"`´.,;:-_#$%&*|<>()[]{}0123456789\n\t\r éüÉßªº²½ÿɏɐʼ日́€" + "\x0b\x0c\x1c\x85  ") + ["'s", "'ll", "'S", "  ", "\n\n", " the", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    ids = packing.Ids(open(packing.tokenizer_file(), encoding="utf-8").read())
    for t, own in zip(texts, ids(texts), strict=True):
        assert np.frombuffer(own, "<u4").tolist() == plain_ids(t)[:-1], t


@pytest.mark.parametrize("clash", [False, True])
def test_packing(spark, clash):
    docs = documents()
    got = packing.pack_documents(frame(spark, docs, clash), capacity=64).collect()
    want = Counter()
    for d, t, *_ in docs:
        ids = plain_ids(t)
        first = (len(ids) - 1) % 64 + 1
        edges = [0, *range(first, len(ids) + 1, 64)]
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 64) + 2


def test_sequences(spark):
    docs = [(d, t, *rest) for d, t, *rest in documents() if d is not None and d < 900]
    df = frame(spark, docs)
    rows = packing.pack_documents(df, capacity=64)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(df, rows, capacity=64).collect()}
    texts = {d: plain_ids(t) for d, t, *_ in docs}
    for r in rows.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == texts[r.doc_id][r.start : r.start + r.length]
    assert sum(map(len, seqs.values())) == sum(map(len, texts.values()))


def test_packing_of_nothing(spark):
    assert packing.pack_documents(frame(spark, [])).collect() == []


def squares(sizes, bins):
    return sum(int(sizes[b].sum()) ** 2 for b in bins)


@pytest.mark.parametrize("low, high", [(1, 100), (20, 60), (30, 45), (45, 55), (1, 12), (50, 51)])
def test_local_search(low, high):
    rng = np.random.default_rng(low)
    for n in (0, 1, 2, 50, 400):
        sizes = rng.integers(low, high, n)
        for before in (packing.best_fit(sizes, 100), [[i] for i in range(n)]):
            after = packing.improved(sizes, before, 100)
            assert sorted(i for b in after for i in b) == list(range(n))
            assert all(sizes[b].sum() <= 100 for b in after)
            assert squares(sizes, after) >= squares(sizes, before) and len(after) <= len(before)
            assert len(after) >= -(-int(sizes.sum()) // 100)


def test_each_exchange_of_the_search():
    one = packing.improved(np.array([60, 30, 50, 40]), [[0, 1], [2, 3]], 100)  # nothing to gain: two bins are needed
    assert len(one) == 2
    for sizes, bins in (
        ([50, 40, 5], [[0, 1], [2]]),  # move 5
        ([60, 35, 40], [[0, 1], [2]]),  # 40 for 35, then 35 stays alone: still two bins
        ([40, 30, 20, 40], [[0, 1, 2], [3]]),
    ):
        sizes = np.array(sizes)
        after = packing.improved(sizes, bins, 100)
        assert len(after) == max(1, -(-int(sizes.sum()) // 100))
    hard = np.array([34] * 3 + [33] * 3 + [32] * 2)  # 264 in three bins of 100: only mixed triples fit
    assert len(packing.improved(hard, [[0, 3], [1, 4], [2, 5], [6, 7]], 100)) == 3


def test_rounds_join_the_chunks(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(300, 420, 3000).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "unit long, length long")
    few, many = (len({r.bin for r in packing.packed(df, capacity=1024, chunk=c).collect()}) for c in (4096, 100))
    assert many <= 1.02 * few + 1
