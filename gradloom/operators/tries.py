"""Prefix tries of sampled token sequences: statistics, reliable prefixes, failure frontiers, advantages, masks.

A prefix is keyed by question, depth and two running sums of its tokens' hashes (40 bits of md5 each), which a window
adds up: keys stay short however deep the trie is, and a sequence of any length is rows by position, never nested arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import scratch

END, ESCAPE = "\x1f", "\x1e"
NULL = ESCAPE + "2"
_REPEATS = 1 << 20  # rows of a broadcast, at most


def reward_weight(reward: Column, beta: float = 0.1, low: float = -5.0, high: float = 5.0) -> Column:
    """exp(clip(clip(reward) / beta, -50, 125)): T2."""
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    return F.exp(clip(clip(reward.cast("double"), low, high) / beta, -50.0, 125.0))


def with_end(tokens: Column, end: Column) -> Column:
    """Tokens that end in ``end``, which is appended where it is missing: P16."""
    return F.when(F.coalesce(F.try_element_at(tokens, F.lit(-1)) == end, F.lit(False)), tokens).otherwise(F.concat(tokens, F.array(end)))


def packed(tokens: Column) -> Column:
    """Tokens (array<string>) as a string, an END after each; a null and what looks like these signs are escaped.

    Strings are equal, or one the beginning of the other at an END, as the arrays are, in less than half of their bytes.
    """
    joined = F.array_join(tokens, END, NULL)
    ends = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(END), F.lit("")))
    plain = (ends == F.size(tokens) - 1) & ~F.contains(joined, F.lit(ESCAPE))
    sign = lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))
    escaped = F.array_join(F.transform(tokens, lambda t: sign(sign(t, ESCAPE, ESCAPE + "0"), END, ESCAPE + "1")), END, NULL)
    return F.concat(F.when(plain, joined).otherwise(escaped), F.when(F.size(tokens) > 0, END).otherwise(""))


def unpacked(text: Column) -> Column:
    """The tokens of ``packed``."""
    parts = F.split(text, END, -1)
    tokens = F.slice(parts, F.lit(1), F.size(parts) - 1)
    sign = lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))
    plain = lambda t: F.when(t != NULL, sign(sign(t, ESCAPE + "1", END), ESCAPE + "0", ESCAPE))
    return F.when(F.contains(text, F.lit(ESCAPE)), F.transform(tokens, plain)).otherwise(tokens)


def deduplicated(trajectories: DataFrame) -> DataFrame:
    """The first trajectory of each token sequence of a question; the order of rollouts decides which: T1.

    Sequences (of strings) are told apart by sha256, and only digests are shuffled: they and the repeats found are
    written to the shared folder, repeats are broadcast, up to ``_REPEATS``.  With more repeats, with rollouts of one index, or with tokens
    of another type, whole sequences are grouped.
    """
    rows = trajectories.where(F.size("tokens") > 0)
    if trajectories.schema["tokens"].dataType.elementType != T.StringType():
        return _first_of(rows, F.col("tokens"), F.col("key")).select(*trajectories.columns)
    digest, id_of = F.unhex(F.sha2(packed(F.col("tokens")), 256)), ["question_id", "rollout_index", "digest"]
    spark, path = trajectories.sparkSession, scratch(trajectories.sparkSession, "repeats")
    keys = rows.select("question_id", "rollout_index", digest.alias("digest"))
    keys.write.parquet(f"{path}/keys")  # texts are read once for both uses
    keys = spark.read.schema(keys.schema).parquet(f"{path}/keys")
    groups = keys.groupBy("question_id", "digest").agg(F.min("rollout_index").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(F.col("question_id").alias("q"), F.col("digest").alias("d"), "first")
    found = keys.join(groups, F.col("question_id").eqNullSafe(F.col("q")) & (F.col("digest") == F.col("d")))
    found = found.select(*id_of, F.col("rollout_index").eqNullSafe(F.col("first")).alias("stays"))
    found.write.parquet(f"{path}/found")
    found = spark.read.schema(found.schema).parquet(f"{path}/found")
    repeats, stay, groups = found.agg(F.count_if(~F.col("stays")), F.count_if("stays"), F.countDistinct(F.struct("question_id", "digest"))).first()
    if repeats > _REPEATS or stay != groups:
        return _first_of(rows, packed(F.col("tokens")), unpacked(F.col("key"))).select(*trajectories.columns)
    if not repeats:
        return rows
    dropped = F.broadcast(found.where(~F.col("stays")).select(*[F.col(c).alias(f"__{c}") for c in id_of]))
    same = F.col("question_id").eqNullSafe(F.col("__question_id")) & F.col("rollout_index").eqNullSafe(F.col("__rollout_index")) & (digest == F.col("__digest"))
    return rows.join(dropped, same, "left_anti")


def _first_of(rows: DataFrame, key: Column, tokens: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("question_id", "tokens")]
    first = F.min_by(F.struct(*rest), "rollout_index").alias("first")  # partial sums: thousands of copies are a row a task
    return rows.groupBy("question_id", key.alias("key")).agg(first).select("question_id", tokens.alias("tokens"), "first.*")


def _key(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a.cast("string"), b.cast("string"))


def steps(trajectories: DataFrame) -> DataFrame:
    """One row per token: question_id, rollout_index, depth, prefix (before the token), token, child (after it), and the rest.

    A rollout's index is unique within its question.
    """
    rest = [c for c in trajectories.columns if c not in ("question_id", "rollout_index", "tokens")]
    rows = trajectories.select("question_id", "rollout_index", *rest, F.posexplode("tokens").alias("depth", "token"))
    rows = rows.withColumn("m", F.md5(F.concat_ws(":", F.col("depth").cast("string"), "token")))
    number = lambda at: F.conv(F.substring("m", at, 10), 16, 10).cast("bigint")
    rows = rows.select("*", number(1).alias("h1"), number(11).alias("h2"))
    up = Window.partitionBy("question_id", "rollout_index").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s1", F.sum("h1").over(up)).withColumn("s2", F.sum("h2").over(up))
    keys = [_key(F.col("s1") - F.col("h1"), F.col("s2") - F.col("h2")).alias("prefix"), "token", _key(F.col("s1"), F.col("s2")).alias("child")]
    return rows.select("question_id", "rollout_index", *rest, "depth", *keys)


def node_stats(trajectories: DataFrame) -> DataFrame:
    """(question_id, depth, prefix, weight, visits, successes) of every prefix, the empty and the whole one included: T4."""
    roots = trajectories.select("question_id", "weight", "success", F.lit(0).alias("depth"), _key(F.lit(0), F.lit(0)).alias("prefix"))
    nodes = roots.unionByName(steps(trajectories).select("question_id", "weight", "success", (F.col("depth") + 1).alias("depth"), F.col("child").alias("prefix")))
    return nodes.groupBy("question_id", "depth", "prefix").agg(F.sum("weight").alias("weight"), F.count("*").alias("visits"), F.sum(F.col("success").cast("long")).alias("successes"))


def edge_stats(trajectories: DataFrame) -> DataFrame:
    """(question_id, depth, prefix, token, child, weight, visits): T5."""
    return steps(trajectories).groupBy("question_id", "depth", "prefix", "token", "child").agg(F.sum("weight").alias("weight"), F.count("*").alias("visits"))


def within(prefixes: DataFrame, most: int | None) -> DataFrame:
    """The prefixes that one more token keeps within ``most`` tokens, the question's ``query_tokens`` (if there) counted: T7, T8."""
    if most is None:
        return prefixes
    query = F.col("query_tokens") if "query_tokens" in prefixes.columns else F.lit(0)
    return prefixes.where(query + F.col("depth") + 1 <= most)


def reliable_prefixes(nodes: DataFrame, edges: DataFrame, m: int, most: int | None = None) -> DataFrame:
    """Prefixes with at least ``m`` successes that go on, ``within`` a length: T6, T7."""
    return within(nodes, most).where(F.col("successes") >= m).join(edges.select("question_id", "depth", "prefix").distinct(), ["question_id", "depth", "prefix"], "left_semi")


def teacher_distribution(edges: DataFrame, reliable: DataFrame) -> DataFrame:
    """Per reliable prefix the share of each next token, renormalised over those that go on: T7."""
    rows = edges.join(reliable.select("question_id", "depth", "prefix"), ["question_id", "depth", "prefix"], "left_semi")
    total = F.sum("weight").over(Window.partitionBy("question_id", "depth", "prefix"))
    return rows.select("question_id", "depth", "prefix", "token", (F.col("weight") / total).alias("prob"))


def failure_frontier(nodes: DataFrame, edges: DataFrame, k_min: int, n_min: int, negatives: bool = True, weight: str = "uniform", most: int | None = None) -> DataFrame:
    """Edges from a prefix with ``k_min`` successes to one with none in ``n_min`` visits; none without ``negatives``; ``within`` a length: T8, T10."""
    parent = within(nodes, most).where(F.col("successes") >= k_min).select("question_id", "depth", "prefix", F.col("visits").alias("parent_visits"), F.col("successes").alias("parent_successes"))
    child = nodes.where((F.col("successes") == 0) & (F.col("visits") >= n_min)).select("question_id", (F.col("depth") - 1).alias("depth"), F.col("prefix").alias("child"), F.col("visits").alias("child_visits"))
    found = edges.select("question_id", "depth", "prefix", "token", "child", F.col("visits").alias("edge_visits")).join(parent, ["question_id", "depth", "prefix"]).join(child, ["question_id", "depth", "child"])
    own = F.lit(1.0) if weight == "uniform" else F.col("child_visits").cast("double")
    return found.withColumn("negative_weight", own).where(F.lit(negatives))


def sample_weights(examples: DataFrame) -> DataFrame:
    """1 / max(count, 1) of the examples of a kind and question: T9."""
    n = F.count("*").over(Window.partitionBy("question_id", "example_kind"))
    return examples.withColumn("sample_weight", 1.0 / F.greatest(n, F.lit(1)))


def group_advantage(rollouts: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(reward - mean) / sqrt(max(population variance, eps)) within a question of two or more: T11.

    Statistics are aggregated and joined back, so a hot question is no hot window.
    """
    stats = rollouts.groupBy("question_id").agg(F.avg("reward").alias("mean"), F.var_pop("reward").alias("variance"), F.count("*").alias("n")).where("n > 1")
    rows = rollouts.join(stats, "question_id")
    return rows.withColumn("advantage", (F.col("reward") - F.col("mean")) / F.sqrt(F.greatest("variance", F.lit(eps)))).drop("mean", "variance")


def token_valid_mask(tokens: DataFrame, reliable: DataFrame, frontier: DataFrame, after_frontier: bool = True) -> DataFrame:
    """``tokens`` (of ``steps``) with ``valid``: not at a reliable prefix, not a frontier edge, nor after one: T12, J3."""
    at = ["question_id", "depth", "prefix"]
    rows = tokens.join(reliable.select(*at, F.lit(True).alias("reliable")), at, "left").join(frontier.select(*at, "token", F.lit(True).alias("frontier")), [*at, "token"], "left")
    flagged = rows.withColumn("reliable", F.coalesce("reliable", F.lit(False))).withColumn("frontier", F.coalesce("frontier", F.lit(False)))
    before = F.coalesce(F.max("frontier").over(Window.partitionBy("question_id", "rollout_index").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return flagged.withColumn("valid", ~F.col("reliable") & ~F.col("frontier") & (~before if after_frontier else F.lit(True)))


def response_examples(tokens: DataFrame, most: int | None = None) -> DataFrame:
    """One row per response of ``tokens`` (with ``valid`` and ``n_logprobs``, how many log probabilities it came with): T13.

    Responses are cut to ``most`` tokens; has_old is whether there is a log probability for each token that is left.
    """
    rows = tokens if most is None else tokens.where(F.col("depth") < most)
    in_order = F.array_sort(F.collect_list(F.struct("depth", F.col("valid").cast("int").alias("v"))))  # a response is a row
    rows = rows.groupBy("question_id", "rollout_index").agg(F.transform(in_order, lambda x: x["v"]).alias("valid_mask"), F.coalesce(F.max("n_logprobs"), F.lit(0)).alias("n"))
    return rows.select("question_id", "rollout_index", "valid_mask", (F.col("n") >= F.size("valid_mask")).alias("has_old"))


def align_logprobs(logprobs: Column, n: Column, slack: int = 2) -> Column:
    """Log probabilities of ``n`` tokens: cut or padded with 0.0 by up to ``slack``, else null: P15."""
    gap = n - F.size(logprobs)
    return F.when(F.abs(gap) > slack, None).when(gap > 0, F.concat(logprobs, F.array_repeat(F.lit(0.0), gap.cast("int")))).otherwise(F.slice(logprobs, F.lit(1), n.cast("int")))


def padded(values: Column, length: Column, pad: Column) -> Column:
    """T23."""
    return F.concat(values, F.array_repeat(pad, F.greatest(F.lit(0), length - F.size(values)).cast("int")))
