"""Filter interaction audit: what every order of a set of filters keeps, removes and loses, by direct relational replay.

Each document's failure flags are crossed with the orders of the filters (120 rows for five, a broadcast of fixed size);
its first failure in an order is an expression over the flags, the steps are exploded, and conditional sums with map-side
combining leave one row per part, order and step before anything is shuffled: a part with a third of all documents costs
a reducer one row a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, written

#: The filters, in the order of their letters.
LETTERS = "ABCDE"
_BLANK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions of A to D for a whole text that isn't null, by letter.

    Words are maximal runs of anything but space and 0x09-0x0D, and case counts.
    """
    words = F.filter(F.split(text, _BLANK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) per row of ``docs`` (doc_id, source, text): ``failed`` has bit i where filter i fails.

    ``part`` is the source; a null one is the empty string.  Null texts are empty ones.  E fails where a smaller doc_id has
    the same text; a null doc_id is never a repeat and makes none, rows of one id don't repeat each other.  Labels
    (doc_id, quality, toxic): an id is good or toxic if any of its rows says so; ids without labels are neither.  Other
    columns are ignored.

    Texts are told apart by sha256.  The smallest id of a text is found with partial aggregation and met again by (doc_id,
    digest), so that thousands of copies of a text, each with its own id, are as many keys.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, (_, fails) in enumerate(sorted(text_failures(F.col("text")).items()))]
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    own = written(own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed")), "audit-flags")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("key IS NOT NULL")
    rows = own.join(first, ["doc_id", "digest"], "left")
    known = F.col("doc_id").isNotNull()
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).join(marks, "key", "left")  # null ids are many keys; whom they meet doesn't count
    repeat = F.when(known & F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    marked = lambda c: (known & F.coalesce(c, F.lit(False))).alias(c)
    return rows.select("part", F.col("failed").bitwiseOR(repeat).alias("failed"), marked("good"), marked("toxic"))


def filter_orders(spark, letters: str = LETTERS) -> DataFrame:
    """(filter_order, bits) of every permutation; ``bits`` has the bit of the filter at each step."""
    rows = [("".join(p), [1 << letters.index(x) for x in p]) for p in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replayed(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part of ``flags`` (part, failed, good, toxic), filter order and step; see ``op11_filter_audit``.

    An empty table gives an empty result.
    """
    steps = range(1, len(letters) + 1)
    rows = flags.join(F.broadcast(filter_orders(flags.sparkSession, letters)))  # a fixed number of orders
    at = lambda k: F.element_at("bits", F.lit(k) if isinstance(k, int) else k)
    first = F.lit(len(letters) + 1)
    for k in reversed(steps):
        first = F.when(F.col("failed").bitwiseAND(at(k)) != 0, k).otherwise(first)
    rows = rows.withColumn("first", first).withColumn("step", F.explode(F.array(*[F.lit(k) for k in steps])))
    bit, step = at(F.col("step")), F.col("step")
    here = F.col("first") == step
    how_many = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)
    sums = rows.groupBy("part", "filter_order", "step").agg(
        how_many(F.col("first") > step, "kept"), how_many(here, "removed"), how_many((F.col("first") < step) & (F.col("failed").bitwiseAND(bit) != 0), "redundant"),
        how_many(F.col("failed") == bit, "unique_fails"), how_many(here & F.col("good"), "good_lost"), how_many(here & F.col("toxic"), "toxic_lost"),
    )
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", own)))  # as many rows as there are orders


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` is what the step's filter removes, summed over all orders, wherever it stands.
    """
    return replayed(document_flags(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = r"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
flags AS (SELECT d.part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM texts d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(p.x, q.x, r.x, s.x, u.x) AS o FROM letters p, letters q, letters r, letters s, letters u WHERE p.x NOT IN (q.x, r.x, s.x, u.x) AND q.x NOT IN (r.x, s.x, u.x) AND r.x NOT IN (s.x, u.x) AND s.x <> u.x),
combos AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM flags GROUP BY ALL),
replay AS (SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS x, fails, good, toxic, n, CASE WHEN k = 1 THEN false ELSE length(translate(substr(o, 1, k - 1), fails, '')) < k - 1 END AS gone FROM combos, orders, (SELECT unnest(range(1, 6)) AS k)),
sums AS (SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT contains(fails, x)), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND contains(fails, x)), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND contains(fails, x)), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (NOT gone AND contains(fails, x) AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND contains(fails, x) AND toxic), 0) AS BIGINT) AS toxic_lost FROM replay GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums"""
