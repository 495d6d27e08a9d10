"""A corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir), with ``docs`` in the columns of documents, and returns a DataFrame that is
written as Parquet in the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradloom.llm.mixing import document_sizes, pivotal_mix, word_count
from gradloom.llm.near_duplicates import jaccard_components, row_key
from gradloom.llm.quality import quality_rules
from gradloom.llm.quality import row_key as quality_key
from gradloom.llm.secrets import redact
from gradloom.llm.sentencepiece import piece_digest
from gradloom.llm.shared import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep: each row by its own verdict, also where ids are null or repeat."""
    rules = quality_rules(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"), rows_too=True)
    kept = rules.where("kept").select("row").distinct()
    return docs.select(*COLUMNS, quality_key()).join(kept, "row", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; repeated rows become one.

    Null and empty texts are each a group of their own; a null id comes after all others.
    """
    groups = jaccard_components(docs, rows_too=True)
    own = F.struct("component", F.when(F.col("component").isNull(), F.col("row")).alias("alone"))
    first = groups.groupBy(own.alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    docs = docs.select(*COLUMNS, row_key()).dropDuplicates(["row"])
    return docs.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted anew."""
    masked = redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it."""
    sizes = document_sizes(docs)
    # rows that share id, source and size take their copies in turn
    key, turn = F.xxhash64("doc_id", "source", "size"), lambda *by: F.row_number().over(Window.partitionBy("key").orderBy(*by))
    copies = pivotal_mix(sizes).withColumn("key", key).withColumn("turn", turn("copies")).where("copies > 0").select("key", "turn", "copies")
    rows = docs.withColumn("size", word_count("text")).withColumn("key", key).withColumn("turn", turn("text"))
    return rows.join(copies, ["key", "turn"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and copy: how many pieces it has, their digest, and whether they decode to the text."""
    return piece_digest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("pieces", pieces)]

#: The perplexity bands, the hash-driven mix and the segmentation can't be said in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
