"""JSON lines as rows of a table, with strict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thermocline.functions.keys import TierKeyType


class BadRow(ValueError):
    """A line that isn't a row of the table."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, tier_column: str | None = None, key: TierKeyType | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of a JSON-lines file; unknown fields, unreadable lines, nested values and tier keys outside ``[low, high)`` are errors.

    The checks are one distributed pass that finds the first offender by text, not a driver loop.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    names = F.array(*[F.lit(n) for n in schema.names])
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    raw = F.from_json("value", "map<string,string>")
    problem = F.when(keys.isNull(), "no JSON object").when(F.size(F.array_except(keys, names)) > 0, F.concat(F.lit("unknown column "), F.array_join(F.array_except(keys, names), ", ")))
    for f in schema.fields:
        given = F.try_element_at(raw, F.lit(f.name))
        problem = problem.when(given.isNotNull() & parsed[f.name].isNull(), F.lit(f"column {f.name} can't be read as {f.dataType.simpleString()}"))
    rows = lines.select("value", "at", "file", parsed.alias("r"), problem.alias("problem"))
    if tier_column is not None and key is not None:
        at = key.encode(F.col(f"r.{tier_column}"), schema[tier_column].dataType.simpleString())
        out = F.lit(False)
        if low is not None:
            out = out | (at < low)
        if high is not None:
            out = out | (at >= high)
        rows = rows.withColumn("problem", F.coalesce("problem", F.when(at.isNull(), "no tier key").when(out, "tier key outside the window")))
    first = rows.where(F.col("problem").isNotNull()).select("problem", "at", "file", F.left("value", F.lit(200)).alias("v")).orderBy("at").limit(1).collect()
    if first:
        raise BadRow(f"line {_line(spark, path, first[0]['file'], first[0]['at'])}: {first[0]['problem']}: {first[0]['v']}")
    return rows.select("r.*")


def _line(spark: SparkSession, path: str, file: str, at: int) -> int:
    """Line number in its file of the row that a scan of ``path`` numbered ``at``: the lines of the same file in earlier splits, and those before it in its own."""
    number = F.monotonically_increasing_id()
    before = spark.read.text(path).select(number.alias("n"), F.col("_metadata.file_path").alias("f")).where((F.col("f") == file) & (F.col("n") <= at))
    return before.count()


def read_free_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with any keys; values must be scalars."""
    df = spark.read.json(path, mode="FAILFAST")
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)]
    if nested:
        raise BadRow(f"columns hold nested values: {nested}")
    return df
