"""A registered table with its stores: heap, lake and overlay."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from thermocline.catalog import Catalog
from thermocline.functions.keys import TierKeyType, key_text
from thermocline.plans.modes import TableMode
from thermocline.sources.lake import Lake, LakePartition
from thermocline.sources.store import Store

#: The overlay is broadcast up to so many keys; the catalog keeps a bound of their number.
OVERLAY_BROADCAST_KEYS = 100_000
#: Segments of the overlay that a read merges; a write that makes more merges them into one.
OVERLAY_SEGMENTS = 8


@dataclass
class CutLine:
    t: int
    s: int
    r: int | None


class TieredTable:
    """Everything known about one table at one moment; made afresh by the engine for every call."""

    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, row):
        self.spark, self.catalog, self.row = spark, catalog, row
        self.id, self.name = row["table_id"], row["name"]
        self.schema = T.StructType.fromJson(json.loads(row["schema_json"]))
        self.keys: list[str] = json.loads(row["key_columns"])
        self.tier, self.key = row["tier_column"], TierKeyType(row["tier_type"])
        self.mode = TableMode(row["mode"], bool(row["keep_heap"]), row["heap_retention_lag"] is not None)
        self.root = f"{root}/{self.name}"
        self.lake = Lake(spark, f"{self.root}/lake", self.schema, self.keys, self.tier, self.key, LakePartition(row["layout"], row["layout_width"]))
        self.store = Store(spark, self.root)

    @property
    def tier_dtype(self) -> str:
        return self.schema[self.tier].dataType.simpleString()

    def cut(self) -> CutLine:
        c = self.catalog.cutline(self.id)
        return CutLine(c["t"], c["s"], c["r"])

    def native(self, key: int) -> Column:
        """Literal in the tier column's own type: comparisons with it reach the file scan."""
        return self.key.native(key, self.tier_dtype)

    def canonical(self) -> Column:
        return self.key.encode(F.col(self.tier), self.tier_dtype)

    def hot(self, cut: int) -> Column:
        return F.lit(True) if cut <= -(2**63) else F.col(self.tier) >= self.native(cut)

    def cold(self, cut: int) -> Column:
        return F.lit(False) if cut <= -(2**63) else F.col(self.tier) < self.native(cut)

    def pk(self) -> Column:
        return key_text([F.col(c) for c in self.keys])

    def typed(self, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns and types; a missing column is null, an unknown one an error."""
        unknown = set(rows.columns) - set(self.schema.names)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    # heap -----------------------------------------------------------------

    def heap(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """All heap rows; ``low`` and ``high`` prune files by their recorded range."""
        files = [f for f in self.catalog.heap_files(self.id) if (low is None or f["hi"] is None or f["hi"] >= low) and (high is None or f["lo"] is None or f["lo"] < high)]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f["path"] for f in files])

    def grid(self) -> list[tuple[int, int, str]]:
        return [(p["lo"], p["hi"], p["partition_id"]) for p in self.catalog.partitions(self.id) if p["state"] in ("hot", "sealing", "tiering")]

    def write_heap(self, rows: DataFrame) -> list[tuple]:
        """Writes heap files, one folder per partition of the grid, and describes them; publishes nothing."""
        path = f"{self.root}/heap/{uuid.uuid4().hex}"
        key, grid = self.canonical(), self.grid()
        place = F.lit("rest")
        if grid:
            starts = F.array(*[F.lit(g[0]).cast("long") for g in grid])
            at = F.size(F.filter(starts, lambda s: s <= key))
            ends, names = F.array(*[F.lit(g[1]).cast("long") for g in grid]), F.array(*[F.lit(g[2]) for g in grid])
            place = F.when((at > 0) & (key < F.try_element_at(ends, at)), F.try_element_at(names, at)).otherwise(F.lit("rest"))
        self.typed(rows).withColumn("_part", place).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
        out = []
        for f in self.lake.describe(path):
            part = f.path.split("/_part=")[1].split("/")[0]
            out.append((f.path, part, f.low, f.high, f.records))
        return out

    # overlay --------------------------------------------------------------

    def overlay_schema(self) -> T.StructType:
        image = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields])
        return T.StructType([T.StructField("pk", T.StringType()), T.StructField("op", T.ShortType()), T.StructField("tier_key", T.LongType()), T.StructField("old_tier_key", T.LongType()), T.StructField("version", T.LongType()), T.StructField("image", image)])

    def overlay_segments(self) -> list[str]:
        return self.catalog.segments(self.id)

    def overlay(self, segments: list[str] | None = None) -> DataFrame:
        """One row per key: the newest change and the tier key under which the lake still holds the row."""
        segments = self.overlay_segments() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], self.overlay_schema())
        rows = self.spark.read.schema(self.overlay_schema()).parquet(*segments)
        if len(segments) == 1:
            return rows
        return newest_wins(rows)

    def corrected_keys(self, segments: list[str]) -> DataFrame:
        """Key columns of every correction; a key in several segments comes several times."""
        rows = self.spark.read.schema(self.overlay_schema()).parquet(*segments) if segments else self.spark.createDataFrame([], self.overlay_schema())
        return rows.select(*[F.col(f"image.{k}").alias(k) for k in self.keys])

    def write_segment(self, changes: DataFrame) -> tuple[str, int]:
        """Writes a segment of corrections, one per key; returns its path and number of rows.  Publishes nothing."""
        path, seen = f"{self.root}/overlay/{uuid.uuid4().hex}", Observation()
        changes.select(*self.overlay_schema().names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return path, seen.get["n"]

    def merge_segments(self, most: int = OVERLAY_SEGMENTS) -> None:
        """Merges the overlay into one segment once it has more than ``most``; reads merge what is there until then."""
        old = self.overlay_segments()
        if len(old) > most:
            path, n = self.write_segment(newest_wins(self.spark.read.schema(self.overlay_schema()).parquet(*old)))
            self.catalog.replace_segments(self.id, old, [path], n)

    def overlay_keys(self) -> int:
        return self.catalog.overlay(self.id)["keys"]


def newest_wins(rows: DataFrame) -> DataFrame:
    """Newest change per key.  The first change tells where the lake holds the row, later moves keep that:
    ``old_tier_key`` is that key, or null if the newest tier key is the same."""
    where = F.coalesce("old_tier_key", "tier_key")
    per = rows.groupBy("pk").agg(F.max_by(F.struct("op", "tier_key", "version", "image"), "version").alias("n"), F.min_by(where, "version").alias("o"))
    return per.select("pk", "n.op", "n.tier_key", F.nullif(F.col("o"), F.col("n.tier_key")).alias("old_tier_key"), "n.version", "n.image")
