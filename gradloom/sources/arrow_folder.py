"""Dataset folders of Arrow IPC files, with their state, their splits and, failing those, the whole table.

Files are read by Spark's own file systems, one partition or more of whole files, and decoded in Arrow functions, so any
store that Spark reads will do; only the columns asked for leave the decoder.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .publishing import read_file
from .storage import _fs, exists

STATE, SPLITS = "state.json", "dataset_dict.json"
_HEAD = 8 << 20  # a file's schema is in its first bytes


def _opened(data) -> pa.ipc.RecordBatchReader | pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(data) if bytes(data[:6]) == b"ARROW1" else pa.ipc.open_stream(data)


def _schema(spark: SparkSession, path: str) -> pa.Schema:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        head = bytes(stream.readNBytes(_HEAD))
    finally:
        stream.close()
    return pa.ipc.open_stream(head[8:] if head[:6] == b"ARROW1" else head).schema  # a file holds a stream after its mark


def is_arrow_folder(spark: SparkSession, root: str) -> bool:
    return exists(spark, f"{root}/{STATE}") or exists(spark, f"{root}/{SPLITS}")


def arrow_files(spark: SparkSession, root: str, split: str | None = "train") -> list[str]:
    """Files of a split, in order: S1, S3, S15.

    A folder of splits has the split's folder, or it is an error; a folder of one table is that table, whatever the split.
    """
    if exists(spark, f"{root}/{SPLITS}"):
        splits = json.loads(read_file(spark, f"{root}/{SPLITS}"))["splits"]
        if split not in splits:
            raise FileNotFoundError(f"no split {split} under {root}: {', '.join(splits)}")
        root = f"{root}/{split}"
    state = json.loads(read_file(spark, f"{root}/{STATE}"))
    if state.get("_indices_files"):
        raise ValueError(f"{root}: rows are chosen by an index file; write the table out first")
    return [f"{root}/{f['filename']}" for f in state["_data_files"]]


def read_arrow(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """The rows of Arrow IPC files (stream or file format), all or the named columns; a file is decoded in one task.

    All files have the first one's schema; a table of no files is an error.  Files of over 2 GB can't be read.
    """
    if not paths:
        raise FileNotFoundError("no Arrow files")
    schema = from_arrow_schema(_schema(spark, paths[0]))
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    kinds = to_arrow_schema(schema)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader = _opened(batch.column(0)[i].as_buffer())
                parts = reader if isinstance(reader, pa.RecordBatchStreamReader) else (reader.get_batch(k) for k in range(reader.num_record_batches))
                for part in parts:
                    for lo in range(0, part.num_rows, 10_000):
                        some = part.slice(lo, 10_000).select(kinds.names)
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(some.columns, kinds, strict=True)], schema=kinds)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(decode, schema)


def load_arrow_folder(spark: SparkSession, root: str, split: str | None = "train", columns: list[str] | None = None) -> DataFrame:
    return read_arrow(spark, arrow_files(spark, root, split), columns)
