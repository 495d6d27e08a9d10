"""Helpers the operators share: the shared folder, written tables, Arrow settings, fractions from hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import _fs

#: A run of word characters, as every contract of this package defines words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; it must be set, but for local sessions and tests.

    A local session without it takes a temporary folder of the driver, the same for the whole session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=1)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-gradloom-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as a Parquet table in the shared folder and reads it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/gradloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` has made and that nothing reads any more, so that they don't add up on disk."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("gradloom-"):
                fs, path = _fs(table.sparkSession, folder)
                fs.delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when it has ended; Spark else keeps them until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread_join(rows: DataFrame, table: DataFrame, on: str, *salt: str, share: int = 1024) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row per ``on`` (long or string); null where it has none.

    What ``table`` has for keys with over one in ``share`` of all rows (fewer than ``share``) is broadcast; such rows are
    dealt by a hash of ``salt``, so that no key takes more than its part of a task.
    """
    values = [c for c in table.columns if c != on]
    total = rows.count()
    heavy = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("m")).where(F.col("m") * share > total).select(on)
    few = table.join(F.broadcast(heavy), on, "left_semi").select(on, F.struct(*values).alias("hot"))
    rows = rows.join(F.broadcast(few), on, "left")
    rows = rows.withColumn("by", F.when(F.col("hot").isNull() & F.col(on).isNotNull(), F.col(on)).otherwise(F.xxhash64(*salt).cast(table.schema[on].dataType)))
    rows = rows.join(table.select(F.col(on).alias("cold_on"), F.struct(*values).alias("cold")), F.col("by") == F.col("cold_on"), "left")
    # a row without a key, or with a heavy one, meets nothing by chance
    found = F.when(F.col("hot").isNotNull(), F.col("hot")).when(F.col(on) == F.col("cold_on"), F.col("cold"))
    return rows.withColumn("found", found).select("*", *[F.col(f"found.{v}").alias(v) for v in values]).drop("hot", "by", "cold_on", "cold", "found")


def bounded_batches(spark: SparkSession, rows: int = 4000, mb: int = 8) -> None:
    """Bounds the Arrow batches that Python workers hold, by rows and by bytes (long texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unit(*cols) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes bucket counts."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def buckets_for(n_bytes: float, each: float = 24e6, least: int = 12) -> int:
    """How many hash buckets hold ``n_bytes`` of packed data when one may take ``each`` bytes."""
    return max(least, int(n_bytes // each) + 1)


def trimmed(task):
    """A function over Arrow batches that gives memory back when its task ends; Python workers live on between tasks."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run
