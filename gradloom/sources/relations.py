"""Relations of the evaluation and training data model, derived from the driver's tables.

Each has a DataFrame form and, for the oracles, a SQL common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LABELS = 1 << 21  # rows of a broadcast, at most
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sampled response: order lines as responses to the question that the order is."""
    correct, stop = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), nth.alias("rollout_index"), correct.alias("correct"), F.when(stop, "stop").otherwise("length").alias("finish_reason"),
        F.round("l_discount", 2).alias("format_reward"), F.when(correct, 1.0).otherwise(0.0).alias("answer_reward"), F.when(stop, 0.0).otherwise(-0.05).alias("length_reward"),
        F.when(F.col("l_quantity") <= 2, "").otherwise(F.concat(F.lit("response "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))).alias("response_text"),
        ((~correct) & (F.round("l_tax", 2) >= 0.07)).alias("rescued"), F.col("l_quantity").cast("bigint").alias("n_tokens"),
    )
    return rows.withColumn("reward", F.round(F.col("format_reward") + F.col("answer_reward") + F.col("length_reward"), 6))


ROLLOUTS = f"""rollouts AS (
  SELECT *, round(format_reward + answer_reward + length_reward, 6) AS reward FROM (
    SELECT l_orderkey AS question_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS INTEGER) AS rollout_index,
           l_returnflag = 'R' AS correct, CASE WHEN l_linestatus = 'F' THEN 'stop' ELSE 'length' END AS finish_reason,
           round(l_discount, 2) AS format_reward, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answer_reward,
           CASE WHEN l_linestatus = 'F' THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS length_reward,
           CASE WHEN l_quantity <= 2 THEN '' ELSE concat('response ', l_partkey, ' of ', l_suppkey) END AS response_text,
           l_returnflag <> 'R' AND round(l_tax, 2) >= 0.07 AS rescued, CAST(l_quantity AS BIGINT) AS n_tokens
    FROM lineitem))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated evaluation of a checkpoint on a dataset, with its accuracy and a few more metrics."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset_key"), F.concat(F.lit("exp"), (F.col("user_id") % 4).cast("string"), F.lit("/checkpoint-"), (F.col("user_id") % 25).cast("string")).alias("checkpoint"),
        "ts", "event_id", F.round(F.col("value") - F.floor("value"), 6).alias("accuracy"), F.round("value", 6).alias("eval_seconds"), (F.col("event_id") % 3 == 0).alias("randomized"),
    )
    return rows.withColumn("run_index", F.row_number().over(Window.partitionBy("dataset_key", "checkpoint").orderBy("ts", "event_id")))


RUNS = """runs AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY dataset_key, checkpoint ORDER BY ts, event_id) AS INTEGER) AS run_index FROM (
    SELECT event_type AS dataset_key, concat('exp', user_id % 4, '/checkpoint-', user_id % 25) AS checkpoint, ts, event_id,
           round(value - floor(value), 6) AS accuracy, round(value, 6) AS eval_seconds, event_id % 3 = 0 AS randomized FROM events))"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences sampled per question: all words of documents, with labels as success."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    few = labels.count() <= _LABELS  # two numbers a row; texts needn't be shuffled to meet them
    rows = docs.join(F.broadcast(labels) if few else labels, "doc_id", "left")
    tokens = F.split(F.lower("text"), " ", -1)
    success = F.coalesce("quality", F.lit(0)) == 1
    reward = F.when(success, 1.0).otherwise(F.round((F.col("doc_id") % 7) / 10.0 - 0.3, 6))
    return rows.select(F.col("source").alias("question_id"), F.col("doc_id").alias("rollout_index"), tokens.alias("tokens"), success.alias("success"), reward.alias("reward"))


TRAJECTORIES = """trajectories AS (
  SELECT source AS question_id, d.doc_id AS rollout_index, string_split(lower(text), ' ') AS tokens, coalesce(quality, 0) = 1 AS success,
         CASE WHEN coalesce(quality, 0) = 1 THEN 1.0::DOUBLE ELSE round((d.doc_id % 7) / 10.0::DOUBLE - 0.3, 6) END AS reward
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers and completions in many forms, written from parts so that every extraction rule has rows."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    k = (key % 12).cast("int")
    text = F.element_at(F.array(
        F.concat(F.lit("Some steps.\nTherefore, the final answer is: $\\boxed{"), size, F.lit("}$. I hope it is correct.")),
        F.concat(F.lit("We get\n**Answer:** "), size), F.concat(F.lit("Work\nFinal Answer: \\frac{"), size, F.lit("}{3}")),
        F.concat(F.lit("So 1+1\n#### "), size), F.concat(F.lit("Thus \\boxed{"), size, F.lit("/7}")), F.concat(F.lit("The value\n\\boxed{\\text{("), F.lit("B"), F.lit(")}}")),
        F.concat(F.lit("1. Answer: \\$"), size, F.lit(",000")), F.concat(F.lit("Answer: x \\in \\{"), size, F.lit(", 2, 10\\}")), F.concat(F.lit("Final Answer: ("), size, F.lit(", 4]")),
        F.concat(F.lit("Therefore:\n\\boxed{x = "), size, F.lit(" \\text{cm}}")), F.lit("   "), F.concat(F.lit("No marker "), size),
    ), k + 1)
    gold = F.when(k == 5, "(B)").when(k == 4, F.concat(F.lit("\\frac{"), size, F.lit("}{7}"))).when(k == 2, F.concat(size, F.lit("/3"))).when(k == 6, F.concat(size, F.lit("000"))).when(k == 7, F.concat(F.lit("10, 2, "), size)).when(k == 8, F.concat(F.lit("("), size, F.lit(",4]"))).otherwise(F.when(key % 5 == 0, "17").otherwise(size))
    return p.select(key.alias("row_id"), "p_type", text.alias("completion"), gold.alias("gold"), F.when(key % 9 == 0, "length").when(key % 4 == 0, F.lit(None)).otherwise("stop").alias("finish_reason"), F.col("p_retailprice").alias("score"))


ANSWERS = r"""answers AS (
  SELECT p_partkey AS row_id, p_type,
    CASE p_partkey % 12
      WHEN 0 THEN concat('Some steps.', chr(10), 'Therefore, the final answer is: $\boxed{', p_size, '}$. I hope it is correct.')
      WHEN 1 THEN concat('We get', chr(10), '**Answer:** ', p_size) WHEN 2 THEN concat('Work', chr(10), 'Final Answer: \frac{', p_size, '}{3}')
      WHEN 3 THEN concat('So 1+1', chr(10), '#### ', p_size) WHEN 4 THEN concat('Thus \boxed{', p_size, '/7}') WHEN 5 THEN concat('The value', chr(10), '\boxed{\text{(', 'B', ')}}')
      WHEN 6 THEN concat('1. Answer: \$', p_size, ',000') WHEN 7 THEN concat('Answer: x \in \{', p_size, ', 2, 10\}') WHEN 8 THEN concat('Final Answer: (', p_size, ', 4]')
      WHEN 9 THEN concat('Therefore:', chr(10), '\boxed{x = ', p_size, ' \text{cm}}') WHEN 10 THEN '   ' ELSE concat('No marker ', p_size) END AS completion,
    CASE p_partkey % 12 WHEN 5 THEN '(B)' WHEN 4 THEN concat('\frac{', p_size, '}{7}') WHEN 2 THEN concat(p_size, '/3') WHEN 6 THEN concat(p_size, '000')
      WHEN 7 THEN concat('10, 2, ', p_size) WHEN 8 THEN concat('(', p_size, ',4]') ELSE CASE WHEN p_partkey % 5 = 0 THEN '17' ELSE CAST(p_size AS VARCHAR) END END AS gold,
    CASE WHEN p_partkey % 9 = 0 THEN 'length' WHEN p_partkey % 4 = 0 THEN NULL ELSE 'stop' END AS finish_reason, p_retailprice AS score
  FROM part)"""
