"""The cold store: Parquet files under immutable snapshots.

A snapshot lists its data files with their band, range of tier keys, size and sequence, and
the delete files that apply to older files of the same band.  Files are written first and
never changed; a snapshot becomes visible through the catalog alone, so files of failed
attempts are orphans without effect.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from thermocline.functions.keys import TierKeyType, band_floor
from thermocline.sources.store import Store

NO_BAND = "all"
#: Up to so many new files the driver reads their footers itself; more are described by a distributed scan.
FOOTERS = 64


@dataclass(frozen=True)
class LakePartition:
    """Layout by the tier key: none, truncate (with a width), hour, day, month or year."""

    kind: str = "none"
    width: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("none", "truncate", "hour", "day", "month", "year"):
            raise ValueError(f"unknown layout {self.kind!r}")
        if self.kind == "truncate" and not 0 < self.width < 2**31:
            raise ValueError("truncate needs a width from 1 to 2^31 - 1")

    def band(self, column: Column, key: TierKeyType, dtype: str) -> Column:
        """Name of the band of a row, from its native tier-key column."""
        if self.kind == "none":
            return F.lit(NO_BAND)
        if self.kind == "truncate":
            return band_floor(key.encode(column, dtype), self.width).cast("string")
        when = column if key.name != "bigint" else F.timestamp_micros(column)
        form = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[self.kind]
        return F.date_format(when, form)


@dataclass
class DataFile:
    path: str
    band: str
    low: int | None
    high: int | None
    records: int
    bytes: int
    sequence: int
    deletes: int = 0


@dataclass
class DeleteFile:
    path: str
    band: str
    records: int
    sequence: int


@dataclass
class Snapshot:
    number: int
    files: list[DataFile] = field(default_factory=list)
    deletes: list[DeleteFile] = field(default_factory=list)
    stamps: dict[str, str] = field(default_factory=dict)
    made_at: float = 0.0
    base: int = 0

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "base": self.base, "made_at": self.made_at, "stamps": self.stamps, "files": [vars(f) for f in self.files], "deletes": [vars(d) for d in self.deletes]})

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        x = json.loads(text)
        return cls(x["number"], [DataFile(**f) for f in x["files"]], [DeleteFile(**d) for d in x["deletes"]], x["stamps"], x["made_at"], x.get("base", 0))


class Lake:
    """One cold table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key_columns: list[str], tier_column: str, key: TierKeyType, layout: LakePartition, target_bytes: int = 128 << 20):
        self.spark, self.root, self.schema, self.layout = spark, Store.plain(root.rstrip("/")), schema, layout
        self.key_columns, self.tier_column, self.key, self.target_bytes = key_columns, tier_column, key, target_bytes
        self.store = Store(spark, self.root)

    # snapshots ------------------------------------------------------------

    def _snapshot_path(self, number: int) -> str:
        return f"{self.root}/snapshots/{number:012d}.json"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names(f"{self.root}/snapshots") if n.endswith(".json")]

    def snapshot(self, number: int | None) -> Snapshot:
        if not number:
            return Snapshot(0)
        return Snapshot.from_json(self.store.read_text(self._snapshot_path(number)))

    def commit(self, base: Snapshot, *, add: Iterable[DataFile] = (), drop: Iterable[str] = (), add_deletes: Iterable[DeleteFile] = (), drop_deletes: Iterable[str] = (), stamps: dict[str, str] | None = None) -> Snapshot:
        """A new snapshot on top of ``base``; two writers can't make the same one.  It counts once the catalog publishes it, which it does only while ``base`` is the published one."""
        gone, gone_deletes, add, add_deletes = set(drop), set(drop_deletes), list(add), list(add_deletes)
        number = max([base.number, *self.numbers()]) + 1
        while True:
            try:
                return self._commit(base, number, gone, gone_deletes, add, add_deletes, stamps)
            except Exception as e:
                # another writer took the number
                if not self.store.exists(self._snapshot_path(number)) or "exist" not in str(e).lower():
                    raise
                number += 1

    def _commit(self, base: Snapshot, number: int, gone: set[str], gone_deletes: set[str], add: list[DataFile], add_deletes: list[DeleteFile], stamps: dict[str, str] | None) -> Snapshot:
        files = [f for f in base.files if f.path not in gone]
        files += [DataFile(**{**vars(f), "sequence": number}) for f in add]
        deletes = [d for d in base.deletes if d.path not in gone_deletes]
        deletes += [DeleteFile(**{**vars(d), "sequence": number}) for d in add_deletes]
        made = Snapshot(number, files, deletes, dict(stamps or {}), time.time(), base.number)
        self.store.write_text(self._snapshot_path(number), made.to_json())
        return made

    def discard(self, made: Snapshot) -> None:
        """Removes a snapshot that wasn't published; its files are swept as orphans."""
        self.store.delete(self._snapshot_path(made.number))

    def stamped(self, after: int, **wanted: str) -> Snapshot | None:
        """The newest snapshot made on top of ``after`` that carries all the wanted stamps.  One on an older base is void: it lacks what was published since."""
        for n in sorted((n for n in self.numbers() if n > after), reverse=True):
            s = self.snapshot(n)
            if s.base == after and all(s.stamps.get(k) == v for k, v in wanted.items()):
                return s
        return None

    # reading --------------------------------------------------------------

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def scan(self, snapshot: Snapshot, low: int | None = None, high: int | None = None, bands: set[str] | None = None) -> DataFrame:
        """Rows of a snapshot; ``low`` and ``high`` (half-open, canonical) and ``bands`` prune files by the manifest."""
        files = [f for f in snapshot.files if (bands is None or f.band in bands) and (low is None or f.high is None or f.high >= low) and (high is None or f.low is None or f.low < high)]
        if not files:
            return self._empty()
        if not snapshot.deletes:
            return self.spark.read.schema(self.schema).parquet(*[f.path for f in files])
        # files grouped by the delete files that apply to them: those of the same band made later
        groups: dict[tuple[str, ...], list[str]] = {}
        for f in files:
            applied = tuple(d.path for d in snapshot.deletes if d.band == f.band and d.sequence > f.sequence)
            groups.setdefault(applied, []).append(f.path)
        out = None
        for applied, paths in groups.items():
            part = self.spark.read.schema(self.schema).parquet(*paths)
            if applied:
                keys = self.spark.read.schema(T.StructType([self.schema[c] for c in self.key_columns])).parquet(*applied).distinct()
                part = part.join(keys, self.key_columns, "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def may_match(self, snapshot: Snapshot, low: int | None, high: int | None) -> bool:
        """Whether any file can hold a key of the half-open range, by the manifest alone."""
        return any((low is None or f.high is None or f.high >= low) and (high is None or f.low is None or f.low < high) for f in snapshot.files)

    # writing --------------------------------------------------------------

    def _dtype(self) -> str:
        return self.schema[self.tier_column].dataType.simpleString()

    def with_band(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_band", self.layout.band(F.col(self.tier_column), self.key, self._dtype()))

    def write(self, rows: DataFrame, folder: str = "data") -> list[DataFile]:
        """Writes rows fanned out by band and lists the new files; commits nothing.

        The rebalance hint lets AQE split large bands and join small ones into files of about the
        advisory size.
        """
        path = f"{self.root}/{folder}/{uuid.uuid4().hex}"
        banded = self.with_band(rows.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]))
        banded.hint("rebalance", "_band").write.partitionBy("_band").parquet(path)
        return self.describe(path)

    def describe(self, path: str) -> list[DataFile]:
        """Files below ``path`` with band, range, records and size, from their footers; where these don't tell, or files are many, by a scan of the tier key alone."""
        sizes = {p: b for p, b, _ in self.store.files(path) if p.endswith(".parquet")}
        if not sizes:
            return []
        found = {p: self.store.footer(p, self.tier_column) for p in sizes} if len(sizes) <= FOOTERS else {}
        if not found or None in found.values():
            rows = self.spark.read.schema(self.schema).parquet(*sizes)
            key = self.key.encode(F.col(self.tier_column), self._dtype())
            per = rows.groupBy(F.col("_metadata.file_path").alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).collect()
            plain = {Store.plain(r["p"]): r for r in per}
            found = {p: tuple(r)[1:] for p in sizes if (r := plain.get(p) or next((x for q, x in plain.items() if unquote(q) == p), None)) is not None}
        out = []
        for p, (low, high, n) in found.items():
            if n:
                band = p.split("/_band=")[1].split("/")[0] if "/_band=" in p else NO_BAND
                out.append(DataFile(p, unquote(band), low, high, n, sizes[p], 0))
        return out

    def write_deletes(self, keys: DataFrame) -> list[DeleteFile]:
        """Delete files for ``keys`` (key columns and ``_band``)."""
        path = f"{self.root}/deletes/{uuid.uuid4().hex}"
        keys.select(*self.key_columns, "_band").distinct().hint("rebalance", "_band").write.partitionBy("_band").parquet(path)
        found = [p for p, _, _ in self.store.files(path) if p.endswith(".parquet")]
        if not found:
            return []
        per = self.spark.read.parquet(*found).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {Store.plain(r["p"]): r["n"] for r in per} | {Store.plain(unquote(r["p"])): r["n"] for r in per}
        return [DeleteFile(p, unquote(p.split("/_band=")[1].split("/")[0]), counts.get(p, 0), 0) for p in found]

    def replace_keys(self, base: Snapshot, keys: DataFrame, rows: DataFrame | None, stamps: dict[str, str], *, merge_on_read: bool = False) -> Snapshot:
        """Removes ``keys`` and adds ``rows``; ``keys`` has the key columns and ``_band``, the band the old image lies in, or the key columns alone if that isn't known.

        Copy on write by default: only files that hold a key are rewritten, and what stays of them
        goes into the same write as the new rows.  With ``merge_on_read`` the keys become delete files.
        """
        if merge_on_read:
            add = self.write(rows) if rows is not None else []
            deletes = self.write_deletes(keys) if base.files else []
            return self.commit(base, add=add, add_deletes=deletes, stamps=stamps)
        on = [*self.key_columns, "_band"] if "_band" in keys.columns else list(self.key_columns)
        files, touched = base.files, {f.band for f in base.files}
        if files and "_band" in on:
            touched = {r["_band"] for r in keys.select("_band").distinct().collect()}
            files = [f for f in files if f.band in touched]
        parts = [rows.select(*self.schema.names)] if rows is not None else []
        if files:
            hit = self.spark.read.schema(self.schema).parquet(*[f.path for f in files]).select(*self.key_columns, F.col("_metadata.file_path").alias("_p"))
            hits = {p for r in hit.join(keys.select(*self.key_columns), self.key_columns, "left_semi").select("_p").distinct().collect() for p in (Store.plain(r["_p"]), Store.plain(unquote(r["_p"])))}
            indebted = {d.band for d in base.deletes}
            files = [f for f in files if f.path in hits or "_band" in on and f.band in indebted]
            if files:
                old = self.scan(Snapshot(base.number, files, base.deletes))
                parts.append(self.with_band(old).join(keys.select(*on), on, "left_anti").select(*self.schema.names))
        kept = None
        for part in parts:
            kept = part if kept is None else kept.unionByName(part)
        add = self.write(kept) if kept is not None else []
        gone = {f.path for f in files}
        bands_left = {f.band for f in base.files if f.path not in gone}
        return self.commit(base, add=add, drop=gone, drop_deletes=[d.path for d in base.deletes if d.band in touched and d.band not in bands_left], stamps=stamps)

    def drop(self) -> None:
        self.store.delete(self.root)
