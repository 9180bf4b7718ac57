import os

from pyspark.sql import functions as F

from thermocline.operators.support import bounded, estimated_bytes, partitions_for, release_scratch, small_side, spread, written


def test_bounded_counts_rows_and_text(spark):
    df = spark.createDataFrame([(i, "x" * 10, [1]) for i in range(50)], "a long, b string, c array<long>")
    assert bounded(df) and not bounded(df, rows=49) and not bounded(df, text_bytes=100)
    assert bounded(df.limit(0)) and bounded(df.select("a", F.col("a").alias("A2")))
    assert "broadcast" in small_side(df)._jdf.queryExecution().analyzed().toString().lower()


def test_sizes(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    joined = files.join(files.withColumnRenamed("id", "j"), F.col("id") == F.col("j")).crossJoin(files.withColumnRenamed("id", "k").limit(1))
    assert estimated_bytes(joined) < 10 * estimated_bytes(files)
    assert estimated_bytes(spark.createDataFrame([(1,)] * 7, "a long")) == 700 or partitions_for(spark.createDataFrame([(1,)], "a long"), 1 << 20) >= 4


def test_spread_and_scratch(spark):
    small = spark.range(0, 10, 1, 1)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50
    df = written(small, "test")
    assert df.count() == 10
    path = df.inputFiles()[0].replace("file://", "")
    assert os.path.exists(path) and release_scratch(spark) > 0 and not os.path.exists(path)
