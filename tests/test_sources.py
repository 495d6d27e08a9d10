"""Arrow folders, listings of trees, publishing while readers read, accounting in one pass."""

import json
import os
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradloom.operators import artifacts as R
from gradloom.operators import preparation as P
from gradloom.sources import publishing as U
from gradloom.sources import storage as S
from gradloom.sources.arrow_folder import load_arrow_folder, read_arrow

ROWS = pa.table({"id": pa.array(range(25), pa.int64()), "text": [None if i % 5 == 0 else f"é{i}" for i in range(25)], "tags": [[str(i)] * (i % 3) for i in range(25)], "more": pa.array([b"x" * 1000] * 25)})


def arrow_folder(path, table, files=3, kind="stream"):
    os.makedirs(path)
    for i in range(files):
        part = table.slice(i * len(table) // files, (i + 1) * len(table) // files - i * len(table) // files)
        with (pa.ipc.new_stream if kind == "stream" else pa.ipc.new_file)(f"{path}/data-{i}.arrow", table.schema) as w:
            w.write_table(part, max_chunksize=4)
    with open(f"{path}/state.json", "w") as f:
        json.dump({"_data_files": [{"filename": f"data-{i}.arrow"} for i in range(files)], "_split": None}, f)


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_arrow_folder(spark, tmp_path, kind):
    arrow_folder(f"{tmp_path}/d", ROWS, kind=kind)
    df = S.load_dataset(spark, f"{tmp_path}/d", "train")  # no splits: the whole table
    assert df.schema.simpleString() == "struct<id:bigint,text:string,tags:array<string>,more:binary>"
    assert sorted((r.id, r.text, r.tags) for r in df.collect()) == list(zip(*[ROWS[c].to_pylist() for c in ("id", "text", "tags")], strict=True))
    few = load_arrow_folder(spark, f"{tmp_path}/d", columns=["text", "id"])
    assert few.columns == ["text", "id"] and few.where("text IS NULL").count() == 5


def test_arrow_splits_and_precedence(spark, tmp_path):
    arrow_folder(f"{tmp_path}/d/cfg/train", ROWS.slice(0, 10), 1)
    arrow_folder(f"{tmp_path}/d/cfg/test", ROWS.slice(10), 2)
    (tmp_path / "d/cfg/dataset_dict.json").write_text(json.dumps({"splits": ["train", "test"]}))
    spark.range(3).write.parquet(f"{tmp_path}/d/cfg/data/train-0.parquet")  # Arrow comes first
    assert [S.load_dataset(spark, f"{tmp_path}/d", s, "cfg").count() for s in ("train", "test")] == [10, 15]
    with pytest.raises(FileNotFoundError):
        S.load_dataset(spark, f"{tmp_path}/d", "validation", "cfg")
    arrow_folder(f"{tmp_path}/empty", ROWS.slice(0, 0), 1)
    assert S.load_dataset(spark, f"{tmp_path}/empty").collect() == []
    with pytest.raises(FileNotFoundError):
        read_arrow(spark, [])
    (tmp_path / "empty/state.json").write_text(json.dumps({"_data_files": [], "_indices_files": [{"filename": "i.arrow"}]}))
    with pytest.raises(ValueError):
        S.load_dataset(spark, f"{tmp_path}/empty")


def test_listing(spark, tmp_path):
    for p in ("a/checkpoint-5/model.safetensors", "a/checkpoints/iter_7_actor/model-00001-of-00002.safetensors", "a/checkpoints/anchor_ema/pytorch_model.bin", "b/checkpoint-1/config.json", "b/x/y/z/w/model.safetensors"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("w")
    found = R.checkpoints(S.listed_weights(spark, str(tmp_path)))
    top = str(tmp_path)
    assert {(r.experiment, r.name, r.type, r.step) for r in found.collect()} == {(f"{top}/a", "checkpoint-5", "trainer_checkpoint", 5), (f"{top}/a", "iter_7_actor", "iter_actor", 7), (f"{top}/a", "anchor_ema", "anchor_ema", None), (f"{top}/b/x/y/z", "w", "weight_dir", None)}
    assert S.listed_weights(spark, top, depth=3).count() == 3 and S.listed_weights(spark, f"{top}/none").collect() == []


def test_readers_never_see_a_gap(spark, tmp_path):
    path, root = f"{tmp_path}/s.json", f"{tmp_path}/pub"
    U.replace_file(spark, path, json.dumps({"n": 0}))
    U.publish(spark, root, {"summary.json": "0", "report.csv": "0"})
    failed, reads, stop = [], [0], threading.Event()

    def read():
        while not stop.is_set():
            try:
                json.loads(open(path).read())["n"]
                names = json.loads(open(f"{root}/{U.POINTER}").read())
                a, b = (open(f"{root}/{names['current']}/{n}").read() for n in ("summary.json", "report.csv"))
                assert a == b  # both of one version
                reads[0] += 1
            except Exception as e:  # noqa: BLE001
                failed.append(repr(e))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 40):
        U.replace_file(spark, path, json.dumps({"n": i, "pad": "x" * 5000}))
        if i % 4 == 0:
            U.publish(spark, root, {"summary.json": str(i), "report.csv": str(i)}, keep=50)
    stop.set()
    reader.join()
    assert not failed and reads[0] > 10
    assert U.read_file(spark, U.published(spark, root)["summary.json"]) == "36"
    S.write_summary(spark.range(1), path)  # over a file that is there
    assert json.loads(spark.read.text(path, wholetext=True).first()[0]) == {"id": 0}


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/p"
    assert U.published(spark, root) == {}
    for i in range(5):
        U.publish(spark, root, {"t": spark.range(i), "eval_step_1234567_summary.json": str(i)}, keep=2)
    assert len([d for d in os.listdir(root) if d.startswith("v")]) == 2
    assert spark.read.json(U.published(spark, root)["t"]).count() == 4
    rows = spark.createDataFrame([(1, None, "a,b")], "z int, y string, x string")
    assert U.csv_lines(rows, ["x", "y"]) == 'x,y\n"a,b",\n'


def test_accounting_is_one_job(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, "a").when(F.col("id") % 11 == 0, "b").when(F.col("id") % 500 == 1, "odd").alias("drop_reason"), (F.col("id") % 50).alias("n"))
    spark.sparkContext.setJobGroup("accounting", "")
    kept, counts = P.prepared(df, f"{tmp_path}/kept", ("a", "b"), "n", 40)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("accounting")
    rows = df.collect()
    assert counts == {"input": 1000, "kept": kept.count(), "a": 143, "b": sum(r.drop_reason == "b" for r in rows), "other": sum(r.drop_reason == "odd" for r in rows), "too_long": sum(r.drop_reason is None and r.n > 40 for r in rows), "max_seen": 49, "max_kept": 40}
    assert kept.columns == ["id", "n"] and kept.count() == sum(r.drop_reason is None and r.n <= 40 for r in rows) and len(jobs) <= 2
    assert P.prepared(df.limit(0), f"{tmp_path}/none", ("a",))[1] == {"input": 0, "kept": 0, "other": 0, "a": 0}
