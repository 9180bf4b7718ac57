from datetime import UTC, date, datetime, timedelta, timezone

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from thermocline.functions.column_types import canonical_value, column_type, type_of
from thermocline.functions.keys import TierKeyType, band_floor, decode_key, encode_key, key_text, key_text_by_names, micros
from thermocline.functions.paths import canonical_path
from thermocline.functions.positions import format_position, parse_position, parse_position_rank, position_rank


@given(st.lists(st.text(alphabet="a\\\x1fé", max_size=6), min_size=2, max_size=3))
def test_key_text_round_trip(parts):
    assert decode_key(encode_key(parts), len(parts)) == parts


def test_key_text_columns(spark):
    df = spark.createDataFrame([(1, "a\\b"), (2, "x\x1fy"), (3, None)], "t long, v string")
    got = [r[0] for r in df.select(key_text([F.col("t"), F.col("v")])).collect()]
    assert got == [encode_key([1, "a\\b"]), encode_key([2, "x\x1fy"]), None]
    assert [r[0] for r in df.select(key_text([F.col("v")])).collect()] == ["a\\b", "x\x1fy", None]
    with pytest.raises(ValueError):
        encode_key([1, None])


def test_key_text_by_names(spark):
    df = spark.createDataFrame([(["t", "v"], 1, "a\\"), (["v"], 1, "a\\"), (["v", "t"], 1, "b"), ([], 1, "b"), (None, 1, "b"), (["zz"], 1, "b"), (["t", "v"], 1, None)], "n array<string>, t long, v string")
    got = [r[0] for r in df.select(key_text_by_names(F.col("n"), {"t": F.col("t"), "v": F.col("v")})).collect()]
    assert got == ["1\x1fa\\\\", "a\\", "b\x1f1", None, None, None, None]


def test_tier_key_canonical():
    ts = TierKeyType("timestamptz")
    assert ts.canonical("1970-01-01 00:00:01.5") == 1_500_000
    assert ts.canonical("1970-01-01T02:00:00+02:00") == 0
    assert ts.canonical("1969-12-31 23:59:59.999999") == -1
    assert ts.canonical("1970-01-01 00:00:00.1234569") == 123456  # digits beyond microseconds are cut
    assert ts.canonical("1970-01-01 00:00:60") == 60_000_000
    assert ts.canonical(datetime(1970, 1, 1, 1, tzinfo=timezone(timedelta(hours=1)))) == 0
    assert TierKeyType("date").canonical("1970-01-03") == 2
    assert TierKeyType("date").canonical(date(1969, 12, 31)) == -1
    assert TierKeyType("bigint").canonical(-7) == -7
    with pytest.raises(ValueError):
        TierKeyType("text")
    assert ts.canonical(datetime(2024, 1, 1, tzinfo=UTC)) == ts.canonical("2024-01-01")


def test_lags_and_tokens():
    ts, day, big = TierKeyType("timestamp"), TierKeyType("date"), TierKeyType("bigint")
    assert [ts.lag(x) for x in ("7d", "12h", "30m", "10s")] == [604800000000, 43200000000, 1800000000, 10000000]
    assert day.lag("2d") == 2 and big.lag("25") == 25
    for kind, text in ((day, "12h"), (big, "1d")):
        with pytest.raises(ValueError):
            kind.lag(text)
    assert big.token(-5) == "m5" and day.token(0) == "19700101" and ts.token(0) == "19700101T000000"


def test_native_literals_reach_the_scan(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_micros(F.col("id") * 1_000_000).alias("ts")).withColumn("n", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    for name, kind in (("ts", "timestamp"), ("n", "timestamp_ntz")):
        key = TierKeyType("timestamptz" if kind == "timestamp" else "timestamp")
        found = back.where(F.col(name) >= key.native(50_000_000, kind))
        assert found.count() == 50
        plan = found._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual" in plan.split("PushedFilters", 1)[1][:200]
        assert back.where(key.encode(F.col(name), kind) == 7_000_000).count() == 1
        assert back.where(F.col(name) >= key.native(2**63 - 1, kind)).count() == 0


def test_band_floor_and_micros(spark):
    df = spark.createDataFrame([(-5,), (-10,), (0,), (9,)], "k long")
    assert [r[0] for r in df.select(band_floor(F.col("k"), 10)).collect()] == [-10, -10, 0, 0]
    assert spark.range(1).select(micros(F.expr("TIMESTAMP_NTZ'1969-12-31 23:59:59.000001'"), "timestamp_ntz")).first()[0] == -999_999


def test_positions(spark):
    texts = ["16", "1/200D879A", "FFFFFFFF/FFFFFFFF", "18446744073709551615", "0/0", "x", "", None, "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_position_rank(F.col("t"))).collect()]
    rank = lambda v: v - 2**63
    assert got == [rank(16), rank((1 << 32) + 0x200D879A), rank(2**64 - 1), rank(2**64 - 1), rank(0), None, None, None, None]
    assert spark.createDataFrame([(5,), (-1,)], "v long").select(position_rank(F.col("v")).alias("r")).orderBy("r").collect()[1][0] == 2**63 - 1
    assert parse_position("1/A") == (1 << 32) + 10 and format_position((1 << 32) + 10) == "1/A"
    with pytest.raises(ValueError):
        parse_position(str(2**64))


def test_paths(spark):
    one = "s3://b/w/t/data/band=p1/x-1.parquet"
    texts = [one, "s3a://b/w/t/data/band=p1/x-1.parquet", "s3://b/w/t/./data/band%3Dp1//x-1.parquet", "s3n://b/w/t/q/../data/band=p1/x-1.parquet", "S3://b/w/t/data/band=p1/x-1.parquet"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "/a//b/./c", "s3://b/100%/y"]], "p string")
    got = [r[0] for r in df.select(canonical_path(F.col("p"))).collect()]
    assert got == [one] * 5 + [None, "/a/b/c", "s3://b/100%/y"]


def test_column_types(spark):
    assert type_of(1700, 655366) == "DECIMAL" and type_of(1700, -1) == "DOUBLE" and type_of(26, -1) == "LONG" and type_of(9999, -1) == "TEXT"
    df = spark.createDataFrame([(None, 1700, -1), (None, 1700, 655366), ("TEXT", 20, -1), (None, 3802, -1)], "g string, o int, m int")
    assert [r[0] for r in df.select(column_type(F.col("g"), F.col("o"), F.col("m"))).collect()] == ["DOUBLE", "DECIMAL", "TEXT", "TEXT"]
    cases = [("12", "LONG", -1, "12"), ("1.5", "LONG", -1, None), ("1.005", "DECIMAL", ((5 << 16) | 2) + 4, "1.01"), ("-0.5", "DECIMAL", ((5 << 16) | 2) + 4, "-0.50"), ("1234.5", "DECIMAL", ((5 << 16) | 2) + 4, None), ("t", "BOOLEAN", -1, "true"),
             ("2025-01-02", "DATE", -1, "2025-01-02"), ("x", "DATE", -1, None), ("\\xAB", "BINARY", -1, "\\xab"), ("zz", "UUID", -1, None), ("free", "TEXT", -1, "free"), (None, "LONG", -1, None), ("7", "DECIMAL", (3 << 16) + 4, "7")]
    df = spark.createDataFrame([c[:3] for c in cases], "v string, k string, m int")
    assert [r[0] for r in df.select(canonical_value(F.col("v"), F.col("k"), F.col("m"))).collect()] == [c[3] for c in cases]
