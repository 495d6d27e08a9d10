"""Positions equal a plain ranking, whatever the number of partitions and the columns kept."""

import pytest
from pyspark.sql import functions as F

from gradloom.operators import artifacts as R
from gradloom.operators import sampling as S
from gradloom.operators.positions import placed


@pytest.fixture
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def wide(spark, n=30_000):
    rows = spark.range(n).withColumn("score", F.pmod(F.xxhash64("id"), F.lit(997)).cast("double"))
    return rows.select("id", F.when(F.col("id") % 101 != 0, F.col("score")).alias("score"), F.concat(F.lit("text "), "id").alias("text"), F.md5(F.col("id").cast("string")).alias("more"))


@pytest.mark.parametrize("n", [1, 8, 200])
def test_ranked_with_all_columns(spark, parts, n):
    parts(n)
    rows = wide(spark)
    want = {r.id: i for i, r in enumerate(sorted(rows.select("id", "score").collect(), key=lambda r: (-(r.score if r.score is not None else float("-inf")), r.id)))}
    for _ in range(2):
        ranked = S.ranked(rows, "score", "id")
        assert {r.id: r.position for r in ranked.select("id", "position", "text").collect()} == want
        assert {r.id: r.position for r in ranked.select("id", "position").collect()} == want
        assert ranked.columns == ["id", "score", "text", "more", "position"]


def test_sampled_places(spark, parts):
    parts(8)
    pool = wide(spark, 10_000).withColumnRenamed("id", "row_id")
    rows = S.sampled(pool, 25_000, 3, 1).collect()
    assert sorted(r.place for r in rows) == list(range(25_000))
    for p in range(2):  # whole passes
        assert len({r.row_id for r in rows if p * 10_000 <= r.place < (p + 1) * 10_000}) == 10_000


def test_within_groups(spark, parts):
    parts(8)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i * 37 % 1000) for i in range(5000)]
    frame = spark.createDataFrame(rows, "id long, g string, v long")
    want, seen = {}, {}
    for i, g, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = seen[g] = seen.get(g, -1) + 1
    assert {r.id: r.at for r in placed(frame, F.col("v"), F.col("id"), within=("g",), name="at").collect()} == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, position string")
    assert placed(empty, F.col("id")).collect() == [] and placed(empty, F.col("id")).columns == ["id", "position"]
    same = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3, "id long, position string")
    assert sorted(r.position for r in placed(same, F.col("id")).collect()) == list(range(53))


def test_step_names(spark):
    rows = spark.createDataFrame([(12,), (999_999,), (1_234_567,)], "step long")
    assert [r[0] for r in rows.select(R.step_name(F.col("step"))).collect()] == ["eval_step_000012", "eval_step_999999", "eval_step_1234567"]
