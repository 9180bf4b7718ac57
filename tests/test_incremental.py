import pytest
from pyspark.sql import functions as F

from thermocline.operators import incremental
from thermocline.operators.incremental import IncrementalTarget, TargetState, after_key, pending

SOURCE = "g long, k string, version long, lsn long, _at string"


def test_sealed_frontier(spark, rows):
    source = spark.createDataFrame([(1, "a", 1, 10, "x"), (1, "b", 2, 11, "x"), (1, "c", 3, None, "x"), (2, "a", 1, None, "x"), (2, "b", 1, 5, "x"), (None, "n", 1, 1, "x")], SOURCE)
    state = TargetState(sealed=spark.createDataFrame([(1, 10), (1, 4), (3, 99), (2, None)], "g long, position long"))
    got = pending(source, state, ["k"], "version", group="g", position=F.col("lsn"))
    assert got.columns == source.columns
    assert rows(got.select("g", "k")) == rows(spark.createDataFrame([(1, "b"), (2, "a"), (2, "b"), (None, "n")], "g long, k string"))


def test_rows_and_nulls(spark, rows):
    source = spark.createDataFrame([(1, "a", 1, 0, ""), (1, "a", 2, 0, ""), (1, None, 1, 0, ""), (1, "b", None, 0, "")], SOURCE)
    held = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("zz", 9)], "k string, version long")
    assert rows(pending(source, TargetState(rows=held), ["k"], "version").select("k", "version")) == rows(spark.createDataFrame([("a", 2), ("b", None)], "k string, version long"))


def test_empty(spark):
    source = spark.createDataFrame([], SOURCE)
    assert pending(source, TargetState(), ["k"], "version").count() == 0
    assert pending(source, TargetState(rows=source, sealed=spark.createDataFrame([], "g long, position long")), ["k"], "version", group="g", position=F.col("lsn")).count() == 0


def test_unbounded_frontier_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(incremental, "small_side", lambda df: df)
    source = spark.createDataFrame([(i % 3, str(i), 1, i, "") for i in range(30)], SOURCE)
    state = TargetState(sealed=spark.createDataFrame([(0, 15), (1, -1)], "g long, position long"))
    got = pending(source, state, ["k"], "version", group="g", position=F.col("lsn"))
    assert got.count() == sum(not (i % 3 == 0 and i <= 15) for i in range(30))


def test_runs_take_each_record_once(spark, tmp_path):
    schema = "k string, version long, v string"
    target = IncrementalTarget(spark, f"file://{tmp_path}/target", ["k"], "version")
    day1 = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 1, "y")], schema)
    assert target.run(day1) == 2 and target.current() == 1
    assert target.run(day1) == 0 and target.current() == 1
    day2 = day1.unionByName(spark.createDataFrame([("a", 2, "z"), ("c", 1, None)], schema))

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        target.run(day2, fails)
    assert target.current() == 1
    assert target.run(day2) == 2
    assert sorted(map(tuple, target.rows().collect()), key=str) == sorted([("a", 1, "x"), ("a", 2, "z"), ("b", 1, "y"), ("c", 1, None)], key=str)


def test_a_rival_run_cannot_publish_the_same_version(spark, tmp_path):
    target = IncrementalTarget(spark, f"file://{tmp_path}/target", ["k"], "version")
    rows_ = spark.createDataFrame([("a", 1)], "k string, version long")

    def with_rival(df):
        IncrementalTarget(spark, f"file://{tmp_path}/target", ["k"], "version").run(rows_)
        return df

    with pytest.raises(RuntimeError, match="published by another run"):
        target.run(rows_, with_rival)
    assert target.rows().count() == 1


def test_after_key(spark):
    df = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (0, "z"), (1, "B"), (None, "a")], "t long, v string")
    got = df.where(after_key([F.col("t"), F.col("v")], [F.lit(1), F.lit("b")])).collect()
    assert sorted(map(tuple, got)) == [(1, "c"), (2, "a")]


def test_a_target_adopts_what_earlier_runs_did(spark, tmp_path):
    schema = "g long, k string, position long, version long"
    target = IncrementalTarget(spark, f"file://{tmp_path}/target", ["g", "k", "position"], "version")
    source = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 20, 1), (1, "b", None, 1), (2, "a", 10, 1), (2, "a", 10, 1)], schema)
    assert target.adopt(source.where("g = 1 AND coalesce(position, 0) <= 10")) == 2 and target.current() == 1
    assert target.adopt(source) == 0
    assert target.run(source) == 2 and target.current() == 2
    assert sorted(map(tuple, target.added().collect())) == [(1, "a", 20, 1), (2, "a", 10, 1)]
    assert target.run(source) == 0 and target.current() == 2


def test_of_repeats_the_same_row_is_kept(spark, tmp_path):
    schema = "k string, version long, v string, m int"
    rows_ = [("a", 1, "y", 1), ("a", 1, "x", 2), ("a", 1, None, 3), ("b", None, "z", 1)]
    for i, order in enumerate((rows_, rows_[::-1])):
        target = IncrementalTarget(spark, f"file://{tmp_path}/t{i}", ["k"], "version")
        target.run(spark.createDataFrame(order, schema))
        assert sorted(map(tuple, target.rows().collect())) == [("a", 1, None, 3), ("b", None, "z", 1)]
