"""The compressed trie gives what plain prefixes give, for any number of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from gradloom.operators import compressed_trie as C
from gradloom.operators import tries as T


def trajectories(spark, seed, n=60, hot=False):
    rng, rows = random.Random(seed), []
    for i in range(n):
        q = "hot" if hot or i % 3 == 0 else rng.choice([f"q{rng.randrange(6)}", ""])
        tokens = [rng.choice("ab" if rng.random() < 0.7 else "cdé") for _ in range(rng.choice([1, 2, 5, 9, 14]))]
        if i % 6 == 0:
            tokens = ["long"] * (20 + i) + tokens  # deep chains
        rows.append((q, i, tokens, rng.random() < 0.4, 0.5 + i / 100))
    return T.deduplicated(spark.createDataFrame(rows, "question_id string, rollout_index long, tokens array<string>, success boolean, weight double"))


def same(a, b):
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(b.columns)).collect()), key=str)
    assert key(a) == key(b)


@pytest.mark.parametrize("ranges, seed, hot", [(1, 1, False), (4, 3, True), (40, 4, True)])
def test_equals_plain_prefixes(spark, ranges, seed, hot):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = trajectories(spark, seed, hot=hot).cache()
    nodes, edges = T.node_stats(rows).cache(), T.edge_stats(rows).cache()
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        m, k_min, n_min = (2, 1, 1) if seed % 2 else (3, 2, 2)
        trie = C.compressed_trie(rows, m, k_min, n_min)
        same(C.node_stats(trie), nodes)
        same(C.edge_stats(trie), edges)
        reliable, frontier = T.reliable_prefixes(nodes, edges, m), T.failure_frontier(nodes, edges, k_min, n_min)
        same(C.reliable_prefixes(trie, m), reliable)
        same(C.reliable_prefixes(trie, m, most=4), T.reliable_prefixes(nodes, edges, m, most=4))
        same(C.teacher_distribution(trie, m), T.teacher_distribution(edges, reliable))
        same(C.failure_frontier(trie, k_min, n_min, weight="visits"), T.failure_frontier(nodes, edges, k_min, n_min, weight="visits"))
        same(C.failure_frontier(trie, k_min, n_min, most=5), T.failure_frontier(nodes, edges, k_min, n_min, most=5))
        for after in (True, False):
            same(C.token_valid_mask(trie, after), T.token_valid_mask(T.steps(rows), reliable, frontier, after).select("question_id", "rollout_index", "depth", "token", "valid"))
        counts = C.question_summary(trie, m, k_min, n_min)
        assert sum(r.positives for r in counts.collect()) == reliable.count() and sum(r.negatives for r in counts.collect()) == frontier.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_follow_sequences(spark):
    rows = spark.range(200).select(F.lit("q").alias("question_id"), F.col("id").alias("rollout_index"), F.concat(F.array_repeat(F.lit("same"), 3000), F.array(F.col("id").cast("string")), F.array_repeat(F.lit("end"), 500)).alias("tokens"), (F.col("id") % 2 == 0).alias("success"), F.lit(1.0).alias("weight"))
    trie = C.compressed_trie(rows)
    assert trie.chains.where("hi > lo").count() >= 190  # all but the rims
    assert trie.chains.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] == 3001 + 200 * 501


def test_odd_tables(spark):
    kinds = "question_id string, rollout_index long, tokens array<string>, success boolean, weight double"
    empty = C.compressed_trie(spark.createDataFrame([], kinds))
    assert empty.chains.collect() == [] == empty.fates.collect() and C.node_stats(empty).collect() == []
    odd = spark.createDataFrame([(None, 1, ["a", None], None, 1.0), (None, 2, ["a"], True, 2.0), ("x", 3, [], True, 1.0)], kinds)
    trie = C.compressed_trie(odd)
    assert {(r.question_id, r.depth, r.visits, r.successes) for r in C.node_stats(trie).collect()} == {(None, 0, 2, 1), (None, 1, 2, 1), (None, 2, 1, 0), ("x", 0, 1, 1)}
    assert {(r.rollout_index, tuple(r.valid)) for r in C.valid_masks(trie).collect()} == {(1, (True, False)), (2, (True,)), (3, ())}


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def long_texts(spark, n=300, length=400):
    """Sequences with tokens of their own, as most of a large table's have."""
    own = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.md5(F.concat_ws(" ", F.col("id").cast("string"), i.cast("string"))), 1, 6))
    return spark.range(n).select(F.lit("q").alias("question_id"), F.col("id").alias("rollout_index"), own.alias("tokens"), F.lit(True).alias("success"), F.lit(1.0).alias("weight"))


@pytest.mark.parametrize("stats", [C.edge_stats, C.node_stats], ids=["edges", "nodes"])
def test_prefixes_are_written_out_where_chains_are(spark, stats):
    """The written chains have all it takes, so sequences aren't shuffled again."""
    found = stats(C.compressed_trie(long_texts(spark)))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() in (300 * 400, 300 * 400 + 1)


def test_folder_holds_tokens_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "scratch", lambda spark, name: str(tmp_path / name))
    C.compressed_trie(long_texts(spark))
    assert folder_bytes(tmp_path) < 8 * 300 * 400  # 6 characters of 4 bits and an end each, where hashes alone were 8 bytes


def test_tokens_that_look_like_signs(spark):
    kinds = "question_id string, rollout_index long, tokens array<string>, success boolean, weight double"
    odd = [["a", "b"], ["a\x1fb"], ["a", None], ["a", "\x1e2"], ["a", ""], ["a"], [""], ["", ""], [None], [None, "a\x1f"], ["\x1e", "0"], ["\x1e0"], ["\x1f", "\x1e1"], ["\x1e\x1f\x1e2"]]
    given = spark.createDataFrame([("q", i, tokens, i % 2 == 0, 1.0 + i) for i, tokens in enumerate(odd + odd)], kinds)
    rows = T.deduplicated(given)
    assert sorted((r.rollout_index, r.tokens) for r in rows.collect()) == list(enumerate(odd))
    trie = C.compressed_trie(rows)
    same(C.node_stats(trie), T.node_stats(rows))
    same(C.edge_stats(trie), T.edge_stats(rows))


def test_deduplication_shuffles_digests(spark, monkeypatch):
    """Texts stay where they are, unless repeats are many; the result is the same either way, and with rollouts of one index."""
    given = long_texts(spark, 20, 5)
    given = given.unionByName(given.where("rollout_index % 3 = 0").withColumn("rollout_index", F.col("rollout_index") + 100)).withColumn("question_id", F.when(F.col("rollout_index") % 2 == 0, "even"))
    want = sorted((r.rollout_index, tuple(r.tokens)) for r in T._first_of(given, F.col("tokens"), F.col("key")).collect())
    few = T.deduplicated(given)
    assert "Aggregate" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.rollout_index, tuple(r.tokens)) for r in few.collect()) == want
    monkeypatch.setattr(T, "_REPEATS", 1)
    assert sorted((r.rollout_index, tuple(r.tokens)) for r in T.deduplicated(given).collect()) == want
    monkeypatch.undo()
    assert sorted((r.rollout_index, tuple(r.tokens)) for r in T.deduplicated(given.unionByName(given)).collect()) == want
