"""Finding, reading and writing files: dataset layouts, line-wise JSON, step files, summaries, tables.

All access is through Spark and its file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a pattern matches, is there."""
    fs, target = _fs(spark, path)
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; only local sessions may leave that unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or tempfile.mkdtemp(prefix="spark-gradloom-")
    return f"{top.rstrip('/')}/gradloom-{name}-{uuid.uuid4().hex}"


#: Where a split's files may be, the first that is there wins: S1, S3, S4.
LAYOUTS = ("{split}/*.parquet", "data/{split}-*.parquet", "{split}-*.parquet", "data/*.parquet", "*.parquet")


def load_dataset(spark: SparkSession, root: str, split: str = "train", config: str | None = None) -> DataFrame:
    """A dataset folder in any of its usual layouts; a folder of the configuration's name is looked into first.

    A folder of Arrow files comes before any other layout; where it has no splits, it is the whole table: S1, S3, S15.
    """
    from .arrow_folder import is_arrow_folder, load_arrow_folder

    roots = [f"{root}/{config}", root] if config else [root]
    for top in roots:
        if is_arrow_folder(spark, top):
            return load_arrow_folder(spark, top, split)
        for layout in LAYOUTS:
            if exists(spark, pattern := f"{top}/{layout.format(split=split)}"):
                return spark.read.option("mergeSchema", "true").parquet(pattern)
        if exists(spark, f"{top}/*.json*"):
            return spark.read.json(f"{top}/*.json*")
    raise FileNotFoundError(f"no files of {split} under {root}")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = True) -> DataFrame:
    """Line-wise JSON: blank lines, a byte order mark and lines that don't parse are passed over: S6, S7.

    A path that isn't there is an empty table, or an error.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], kind)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    with_errors = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select(F.from_json("value", with_errors, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return parsed.where("_corrupt IS NULL").drop("_corrupt")


def discover(spark: SparkSession, root: str, pattern: str = "checkpoint_summary.json") -> DataFrame:
    """(path, name) of files of a name, however deep: S8."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


#: Names of files with weights, as a file pattern.  Fixed values.
WEIGHT_FILES = "{pytorch_model.bin,model.safetensors,pytorch_model.bin.index.json,model.safetensors.index.json,pytorch_model-*.bin,model-*.safetensors}"


def listed_weights(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """(path) of the files with weights under ``root``, for ``artifacts.checkpoints``: S10.

    Spark lists large trees on its executors and the pattern is applied there; contents aren't read.  ``depth``: how many
    folders below ``root`` a file may lie.  A root that isn't there, or has none, is an empty table.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], "path string")
    found = discover(spark, root, WEIGHT_FILES).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    top = F.lit(_fs(spark, root)[1].toUri().getPath().rstrip("/"))
    below = F.size(F.split(F.regexp_replace("path", "^[a-z0-9]+://[^/]*", ""), "/")) - F.size(F.split(top, "/")) - 1
    return found if depth is None else found.where(below <= depth)


def step_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, step) of evaluation summaries, by their step: S9, F13."""
    for top in (root, f"{root}/metrics"):
        if exists(spark, f"{top}/eval_step_*_summary.json"):
            found = discover(spark, top, "eval_step_*_summary.json")
            step = F.regexp_extract("name", r"^eval_step_(\d+)_summary\.json$", 1)
            return found.where(step != "").select("path", step.cast("bigint").alias("step")).orderBy("step")
    return spark.createDataFrame([], "path string, step long")


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """K1."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made only if a complete one isn't there: K6."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON file that replaces the one before in one step: K2, R5."""
    from .publishing import replace_file

    replace_file(df.sparkSession, path, json.dumps(df.first().asDict(recursive=True), indent=2, ensure_ascii=False, default=str))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """K3."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the named columns in order, then all others by name: K4."""
    df.select(*columns, *sorted(c for c in df.columns if c not in columns)).write.mode("overwrite").option("header", "true").csv(path)


def write_log(df: DataFrame, path: str, line: str = "line") -> None:
    """K5."""
    df.select(line).write.mode("overwrite").text(path)
