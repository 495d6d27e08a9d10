"""Publishing files that are read while they are replaced: a reader finds the old or the new ones, never a gap.

A single file is written beside its place and renamed over it.  Several files go into a folder of their own, a version,
and one pointer file, replaced in that way, says which version holds; names within a version are exact.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .storage import _fs

POINTER = "CURRENT.json"


def read_file(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file so that readers see all of it or what was there before: K2, R5.

    Local files are renamed by the operating system, others by the file context's overwriting rename, which is one step
    where the store has such a step.  Checksum files of older writers would no longer fit, so they go first.
    """
    fs, target = _fs(spark, path)
    local = fs.getScheme() == "file"
    if local:
        old = target.getParent().suffix(f"/.{target.getName()}.crc")
        fs = fs.getRawFileSystem() if hasattr(fs, "getRawFileSystem") else fs
        fs.delete(old, False)
    partial = target.getParent().suffix(f"/.{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(partial, True)
    out.write(bytearray(text.encode()))
    out.close()
    if local:
        done = fs.rename(partial, target)
        if not done:
            raise OSError(f"{path}: could not be renamed into place")
        return
    options = spark._jvm.org.apache.hadoop.fs.Options
    over = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    over[0] = getattr(options, "Rename").OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(partial, target, over)


def csv_lines(rows: DataFrame, columns: list[str]) -> str:
    """The rows of a small table (one a checkpoint) as CSV with exactly these columns, in order; others are left out: K9."""
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows.select(*columns).toLocalIterator()])
    return out.getvalue()


def publish(spark: SparkSession, root: str, files: dict[str, str | DataFrame], keep: int = 3) -> str:
    """Publishes ``files`` (name: a text, or a DataFrame that becomes a folder of line-wise JSON) under ``root``, all at once: K7-K9.

    Returns the version's folder.  The newest ``keep`` versions stay, so that readers of an older one can finish.
    """
    fs, top = _fs(spark, root)
    fs.mkdirs(top)
    pointer = f"{root}/{POINTER}"
    past = json.loads(read_file(spark, pointer))["versions"] if fs.exists(top.suffix(f"/{POINTER}")) else []
    version = f"v{len(past) and int(past[-1].split('-')[0][1:]) + 1:06d}-{uuid.uuid4().hex[:8]}"
    for name, what in files.items():
        if isinstance(what, DataFrame):
            what.write.option("ignoreNullFields", "false").json(f"{root}/{version}/{name}")
        else:
            replace_file(spark, f"{root}/{version}/{name}", what)
    replace_file(spark, pointer, json.dumps({"current": version, "files": sorted(files), "versions": [*past, version][-keep:]}))
    for old in past[: -(keep - 1)] if keep > 1 else past:
        fs.delete(top.suffix(f"/{old}"), True)
    return f"{root}/{version}"


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Paths by name of the version that holds; empty before the first."""
    fs, top = _fs(spark, root)
    if not fs.exists(top.suffix(f"/{POINTER}")):
        return {}
    now = json.loads(read_file(spark, f"{root}/{POINTER}"))
    return {name: f"{root}/{now['current']}/{name}" for name in now["files"]}
