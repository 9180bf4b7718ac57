"""Routed writes: upserts, deletes, and INSERT, UPDATE and DELETE statements over both halves."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, functions as F

from thermocline.operators.seam import cold_rows, hot_rows, scan
from thermocline.operators.support import written_seen
from thermocline.plans.modes import Side
from thermocline.plans.predicate import Reach, classify, tier_predicate
from thermocline.sources.lake import Snapshot
from thermocline.sources.store import Store
from thermocline.table import CutLine, TieredTable


class WriteRejected(ValueError):
    """The statement was refused before anything was written."""


@dataclass
class WriteResult:
    """Affected rows of each half, and on request the rows themselves."""

    hot_rows: int = 0
    cold_rows: int = 0
    returning: DataFrame | None = None

    @property
    def rows(self) -> int:
        return self.hot_rows + self.cold_rows


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


class Writes:
    """Write methods of the engine.

    Every write captures one (T, S, overlay) state, writes new files and publishes them in one
    catalog transaction.  Heap files are immutable: a rewritten file is swapped for its successor.
    """

    # routing --------------------------------------------------------------

    def upsert(self, name: str, rows: DataFrame) -> WriteResult:
        """Routes each row by its tier key.  Hot rows replace heap rows of the same key; with keep_heap cold rows do too.
        Cold rows become corrections, or replace the lake's row in a direct table.  A key may stand once in a batch."""
        return self._put(self.table(name), rows, replace=True)

    def _put(self, t: TieredTable, rows: DataFrame, *, replace: bool, checks=None) -> WriteResult:
        cut = t.cut()
        rows, seen = self._taken(t, rows, cut, "upsert")
        self._unique(t, rows)
        if checks is not None:
            checks(t, cut.t, rows)
        hot, cold = rows.where(t.hot(cut.t)), rows.where(t.cold(cut.t))
        n_hot, n_cold = seen["hot"], seen["cold"]
        if t.mode.heap_complete and not t.mode.keep_heap:
            hot, cold, n_hot, n_cold = rows, rows.limit(0), n_hot + n_cold, 0
        heap_in = rows if t.mode.keep_heap else hot
        with self._publishing(t, cut) as p:
            if n_hot or t.mode.keep_heap and n_cold:
                floor = None if t.mode.heap_complete else cut.t
                if not replace and self._held(t, heap_in, floor):
                    raise WriteRejected("a key of the batch is in the heap already")
                p.rewrite_heap(heap_in.select(*t.keys) if replace else None, heap_in, floor)
            if n_cold:
                self._cold_upserts(t, p, cold)
        return WriteResult(n_hot, n_cold)

    def _unique(self, t: TieredTable, rows: DataFrame) -> None:
        if not rows.groupBy(*t.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise WriteRejected("a key repeats within the batch")

    @staticmethod
    def _held(t: TieredTable, rows: DataFrame, floor: int | None) -> bool:
        """Whether the heap holds a key of ``rows`` (at or above ``floor``); reads the key columns of the files in reach."""
        heap = t.heap(low=floor)
        heap = heap.where(t.hot(floor)) if floor is not None else heap
        return not heap.select(*t.keys).join(rows.select(*t.keys), t.keys, "left_semi").isEmpty()

    def _cold_upserts(self, t: TieredTable, p: Publishing, cold: DataFrame) -> None:
        plan = t.mode.insert(Side.COLD)
        if plan.overlay:
            p.add_overlay(cold, 0)
        elif plan.lake:
            p.replace_lake(cold.select(*t.keys), cold)

    def delete_keys(self, name: str, keys: DataFrame) -> WriteResult:
        """Deletes rows given by key columns and tier key: hot ones from the heap (never below the cut-line), cold ones by tombstones, or from the lake of a direct table."""
        t = self.table(name)
        missing = {*t.keys, t.tier} - set(keys.columns)
        if missing:
            raise WriteRejected(f"a delete needs {sorted(missing)}")
        at = t.cut()
        cut = at.t
        keys, seen = self._taken(t, keys.select(*dict.fromkeys([*t.keys, t.tier])), at, "delete")
        hot, cold = keys.where(t.hot(cut)), keys.where(t.cold(cut))
        n_hot, n_cold = 0, seen["cold"]
        with self._publishing(t, at) as p:
            if t.mode.heap_complete:
                n_hot = p.rewrite_heap(keys.select(*t.keys), None, None)
            elif seen["hot"]:
                n_hot = p.rewrite_heap(hot.select(*t.keys), None, cut)
            if n_cold:
                plan = t.mode.delete(Side.COLD)
                if plan.overlay:
                    # a key named under several tier keys is one tombstone
                    p.add_overlay(cold.dropDuplicates(t.keys), 1)
                elif plan.lake:
                    p.replace_lake(cold.select(*t.keys), None)
        if t.mode.heap_complete:
            n_cold = 0
        return WriteResult(n_hot, n_cold)

    def _taken(self, t: TieredTable, rows: DataFrame, cut: CutLine, label: str) -> tuple[DataFrame, dict]:
        """The batch, written once, with its numbers of hot and cold rows.  A null key or tier key or a row below the retention line refuses it before any write."""
        bad = F.col(t.tier).isNull()
        for k in t.keys:
            bad = bad | F.col(k).isNull()
        rows, seen = written_seen(t.typed(rows), label, F.max(F.when(bad, 1)).alias("null"), F.min(t.canonical()).alias("low"), F.count_if(t.hot(cut.t)).alias("hot"), F.count_if(t.cold(cut.t)).alias("cold"))
        if seen["null"]:
            raise WriteRejected("a row has no primary key or tier key")
        if cut.r is not None and seen["low"] is not None and seen["low"] < cut.r and t.mode.insert(Side.COLD).check_retention:
            raise WriteRejected(f"tier key {seen['low']} is below the retention line {cut.r}")
        return rows, seen

    # statements -----------------------------------------------------------

    def insert(self, name: str, rows: DataFrame, *, returning: bool = False) -> WriteResult:
        """INSERT: hot rows need a partition and a key that the heap doesn't hold; cold ones are routed, and a table whose routing is off refuses them."""
        t = self.table(name)
        rows = t.typed(rows)

        def checks(t: TieredTable, cut: int, rows: DataFrame) -> None:
            cold = rows.where(t.cold(cut)) if not t.mode.heap_complete or t.mode.keep_heap else rows.limit(0)
            if not t.row["spill"] and _any(cold):
                raise WriteRejected("routed writes are off for this table")
            if t.grid() and not t.mode.heap_complete:
                inside = F.lit(False)
                for lo, hi, _ in t.grid():
                    inside = inside | t.canonical().between(lo, hi - 1)
                if _any(rows.where(t.hot(cut)).where(~inside)):
                    raise WriteRejected("a hot row has no partition")
            if returning and _any(cold):
                raise WriteRejected("RETURNING isn't possible for an INSERT with cold rows")

        result = self._put(t, rows, replace=False, checks=checks)
        result.returning = rows if returning else None
        return result

    def update(self, name: str, changes: dict[str, str | Column], where: str | None = None, *, returning: bool = False) -> WriteResult:
        """UPDATE: ``changes`` maps columns to new values over the old row.

        Hot and cold matches are changed against one state; rows whose tier key crosses the cut-line
        move, and a moved correction remembers where the lake holds the row.  ``returning`` gives the
        new rows.
        """
        t = self.table(name)
        if set(changes) & set(t.keys):
            raise WriteRejected("the primary key can't be set")
        if unknown := set(changes) - set(t.schema.names):
            raise WriteRejected(f"unknown columns: {sorted(unknown)}")
        expr = {c: F.expr(v) if isinstance(v, str) else v for c, v in changes.items()}
        # _at: the tier key before the change, where the lake holds the row
        new_image = lambda df, *kept: df.select(*kept, *[(expr[f.name].cast(f.dataType) if f.name in expr else F.col(f.name)).alias(f.name) for f in t.schema.fields], t.canonical().alias("_at"))
        return self._change(t, where, new_image, returning)

    def delete(self, name: str, where: str | None = None, *, returning: bool = False) -> WriteResult:
        """DELETE: tombstones for cold matches, removal of hot ones; ``returning`` gives the old rows."""
        return self._change(self.table(name), where, None, returning)

    def _change(self, t: TieredTable, where: str | None, new_image, returning: bool) -> WriteResult:
        cut = t.cut()
        condition = where or "true"
        if t.mode.heap_complete:
            return self._change_complete(t, condition, new_image, cut, returning)
        reach = classify(tier_predicate(t.spark, where, t.tier, t.key, t.tier_dtype), cut.t) if where else Reach.MIXED
        if t.mode.direct and reach is not Reach.HOT and _any(scan(t, cut.t, cut.s).where(t.cold(cut.t)).where(condition)):
            raise WriteRejected("a direct table takes no statement that may touch cold rows")
        halves = []
        if reach is not Reach.COLD:
            halves.append(hot_rows(t, cut.t).where(condition).withColumn("_hot", F.lit(True)))
        if reach is not Reach.HOT and not t.mode.direct:
            halves.append(cold_rows(t, cut.t, cut.s).where(condition).withColumn("_hot", F.lit(False)))
        if not halves:
            return WriteResult(0, 0, t.spark.createDataFrame([], t.schema) if returning else None)
        both = halves[0] if len(halves) == 1 else halves[0].unionByName(halves[1])
        change = self._matched(t, both, new_image, cut.t)
        if change.rows and (new_image is not None or change.cold):
            change.check(t, cut.r)
        with self._publishing(t, cut) as p:
            if change.hot:
                # rows that stay or arrive above the cut-line go into the files that lose their old images
                p.rewrite_heap(change.old("_hot").select(*t.keys), change.new("_now_hot") if new_image is not None else None, cut.t)
            elif change.to_hot:
                p.rewrite_heap(None, change.new("_now_hot"), cut.t)
            if new_image is None:
                if change.cold:
                    p.add_overlay(change.old("NOT _hot"), 1)
            else:
                if change.cold > change.to_hot or change.to_cold:
                    # a row that the lake never held has no older place there
                    at = F.when(F.col("_hot"), F.lit(None).cast("long")).otherwise(F.col("_at"))
                    p.add_overlay(change.new("NOT _now_hot", at.alias("_at")), 0)
                if change.to_hot:
                    # the lake still holds the old image: a tombstone at the old tier key hides it
                    p.add_overlay(change.old("NOT _hot AND _now_hot"), 1)
        result = WriteResult(change.hot, change.cold)
        if returning:
            result.returning = change.old("true") if new_image is None else change.new("true")
        return result

    @staticmethod
    def _matched(t: TieredTable, rows: DataFrame, new_image, cut: int) -> Matched:
        """Old and new images of the matched rows, written once; the counts come from the same write."""
        old = F.struct(*[F.col(c) for c in t.schema.names])
        if new_image is None:
            pairs = rows.select("_hot", old.alias("o"), old.alias("n"), t.canonical().alias("_at"), F.col("_hot").alias("_now_hot"))
        else:
            image = new_image(rows.withColumn("_o", old), "_hot", "_o")
            pairs = image.select("_hot", F.col("_o").alias("o"), F.struct(*[F.col(c) for c in t.schema.names]).alias("n"), "_at", F.coalesce(t.hot(cut), F.lit(False)).alias("_now_hot"))
        key = t.key.encode(F.col(f"n.{t.tier}"), t.tier_dtype)
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_hot")).alias("hot"), F.count_if(F.col("_hot") & ~F.col("_now_hot")).alias("to_cold"), F.count_if(~F.col("_hot") & F.col("_now_hot")).alias("to_hot"), F.count_if(key.isNull()).alias("nulls"), F.min(key).alias("low")]
        done, seen = written_seen(pairs, "matched", *counts)
        return Matched(done, **seen)

    def _change_complete(self, t: TieredTable, condition: str, new_image, cut, returning: bool) -> WriteResult:
        """A heap that holds all rows is changed in place; with keep_heap the change of cold rows also goes to overlay or lake."""
        change = self._matched(t, t.heap().where(condition).withColumn("_hot", F.coalesce(t.hot(cut.t), F.lit(False))), new_image, cut.t)
        with self._publishing(t, cut) as p:
            if change.rows:
                p.rewrite_heap(change.old("true").select(*t.keys), change.new("true") if new_image is not None else None, None)
            if change.rows and t.mode.keep_heap and t.row["cold_mirror"]:
                if new_image is None:
                    self._mirror_cold(t, p, change.old("NOT _hot"), None)
                else:
                    self._mirror_cold(t, p, change.old("NOT _hot AND _now_hot"), change.new("NOT _now_hot", F.when(F.col("_hot"), F.lit(None).cast("long")).otherwise(F.col("_at")).alias("_at")))
        return WriteResult(change.rows, 0, (change.new("true") if new_image is not None else change.old("true")) if returning else None)

    def _mirror_cold(self, t: TieredTable, p: Publishing, gone: DataFrame, kept: DataFrame | None) -> None:
        if t.mode.direct:
            keys = gone.select(*t.keys) if kept is None else gone.select(*t.keys).unionByName(kept.select(*t.keys))
            if _any(keys):
                p.replace_lake(keys, kept.drop("_at") if kept is not None else None)
            return
        p.add_overlay(gone, 1)
        if kept is not None:
            p.add_overlay(kept, 0)

    # statements as text ---------------------------------------------------

    def execute(self, text: str) -> WriteResult:
        """Runs an INSERT, UPDATE or DELETE statement on a registered table, with ``RETURNING *`` at the end if rows are wanted.

        The text is read by Spark's parser.  Refused before any effect: other statements, aliases of
        the target, conditions or values with a subquery, and columns given twice.
        """
        body, returning = re.subn(r"(?is)\s+returning\s+\*\s*$", "", text.strip().rstrip(";").rstrip())
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
        kind = plan.getClass().getSimpleName()
        if kind not in ("UpdateTable", "DeleteFromTable", "InsertIntoStatement"):
            raise WriteRejected(f"{text.split(None, 1)[0].upper()} isn't a change of rows")
        target = plan.table()
        if target.getClass().getSimpleName() != "UnresolvedRelation":
            raise WriteRejected("the target can't have an alias")
        name = str(target.multipartIdentifier().last())
        if kind == "InsertIntoStatement":
            return self._execute_insert(name, plan, body, bool(returning))
        condition = plan.condition()
        if kind == "UpdateTable":
            where = self._plain_sql(condition.get()) if condition.isDefined() else None
            changes = {}
            assigned = plan.assignments()
            for a in (assigned.apply(i) for i in range(assigned.size())):
                column = str(a.key().nameParts().last())
                if column in changes:
                    raise WriteRejected(f"{column} is set twice")
                changes[column] = self._plain_sql(a.value())
            return self.update(name, changes, where, returning=bool(returning))
        where = self._plain_sql(condition)
        return self.delete(name, None if where == "true" else where, returning=bool(returning))

    def _execute_insert(self, name: str, plan, body: str, returning: bool) -> WriteResult:
        t = self.table(name)
        if plan.overwrite():
            raise WriteRejected("INSERT OVERWRITE isn't a routed write")
        columns = [str(plan.userSpecifiedCols().apply(i)) for i in range(plan.userSpecifiedCols().size())]
        views = self.register_views(*self.named_tables(body)) if self.named_tables(body) else None
        try:
            rows = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan.query()), self.spark)
            columns = columns or t.schema.names[: len(rows.columns)]
            if len(columns) != len(rows.columns) or len(set(columns)) != len(columns):
                raise WriteRejected(f"{len(rows.columns)} values for the columns {columns}")
            return self.insert(name, rows.toDF(*columns), returning=returning)
        finally:
            if views is not None:
                views.close()

    @staticmethod
    def _plain_sql(expression) -> str:
        """Text of an expression without subqueries."""
        nodes = [expression]
        while nodes:
            node = nodes.pop()
            if re.search("Subquery|ListQuery|Exists", node.getClass().getSimpleName()):
                raise WriteRejected("a subquery can't be routed")
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        return expression.sql()

    # flags ----------------------------------------------------------------

    def enable_routed_writes(self, name: str) -> None:
        t = self.table(name)
        if t.mode.heap_complete:
            raise WriteRejected("the heap of this table holds all rows; nothing is routed")
        self.catalog.set_flag(t.id, "spill", True)

    def disable_routed_writes(self, name: str) -> None:
        self.catalog.set_flag(self.table(name).id, "spill", False)

    def attach_cold_mirror(self, name: str) -> None:
        t = self.table(name)
        if not t.mode.keep_heap:
            raise WriteRejected("only a table that keeps its heap mirrors cold changes")
        self.catalog.set_flag(t.id, "cold_mirror", True)

    def detach_cold_mirror(self, name: str) -> None:
        self.catalog.set_flag(self.table(name).id, "cold_mirror", False)

    def _publishing(self, t: TieredTable, cut: CutLine | None = None) -> Publishing:
        return Publishing(self, t, cut or t.cut())


@dataclass
class Matched:
    """Matched rows of a statement, each with its old image ``o``, new image ``n``, old tier key ``_at`` and the sides it was and is on."""

    pairs: DataFrame
    rows: int
    hot: int
    to_cold: int
    to_hot: int
    nulls: int
    low: int | None

    @property
    def cold(self) -> int:
        return self.rows - self.hot

    def old(self, which: str) -> DataFrame:
        return self.pairs.where(which).select("o.*")

    def new(self, which: str, *more: Column) -> DataFrame:
        return self.pairs.where(which).select("n.*", *more)

    def check(self, t: TieredTable, r: int | None) -> None:
        """No null tier key and nothing below the retention line among the new images; refused before anything is published."""
        if self.nulls:
            raise WriteRejected("a row has no primary key or tier key")
        if r is not None and self.low is not None and self.low < r and t.mode.insert(Side.COLD).check_retention:
            raise WriteRejected(f"tier key {self.low} is below the retention line {r}")


class Publishing:
    """Collects the files of one write and publishes them in one catalog transaction at the end.

    The write was routed by ``cut``; if T has moved by then, or another writer has replaced a heap
    file, nothing is published.
    """

    def __init__(self, engine, t: TieredTable, cut: CutLine):
        self.engine, self.t, self.cut = engine, t, cut
        self.heap_add: list[tuple] = []
        self.heap_drop: list[str] = []
        self.changes: list[DataFrame] = []
        self.lake: tuple[DataFrame, DataFrame | None] | None = None
        self.extra: list = []

    def __enter__(self) -> Publishing:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.publish()

    def rewrite_heap(self, gone: DataFrame | None, add: DataFrame | None, floor: int | None) -> int:
        """Rewrites the heap files that hold any of the keys ``gone`` (at or above ``floor``) without them and with ``add``, in one write; returns the rows removed."""
        t, removed, parts = self.t, 0, []
        files = {f["path"]: f for f in t.catalog.heap_files(t.id) if f["path"] not in self.heap_drop and (floor is None or f["hi"] is None or f["hi"] >= floor)}
        if gone is not None and files:
            reached = t.hot(floor) if floor is not None else F.lit(True)
            gone = gone.distinct()
            rows = t.spark.read.schema(t.schema).parquet(*files).withColumn("_path", F.col("_metadata.file_path"))
            hits = {r["_path"]: r["n"] for r in rows.where(reached).join(gone, t.keys, "left_semi").groupBy("_path").agg(F.count(F.lit(1)).alias("n")).collect()}
            touched = [p for found in hits for p in {Store.plain(found), Store.plain(unquote(found))} if p in files]
            removed = sum(hits.values())
            if touched:
                whole = t.spark.read.schema(t.schema).parquet(*touched)
                flagged = gone.withColumn("_gone", F.lit(True))
                kept = whole.join(flagged, t.keys, "left").where(~(F.coalesce("_gone", F.lit(False)) & F.coalesce(reached, F.lit(False))))
                parts.append(kept.select(*t.schema.names))
                self.heap_drop += touched
        if add is not None:
            parts.append(t.typed(add))
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            self.heap_add += t.write_heap(rows)
        return removed

    def add_overlay(self, rows: DataFrame, op: int) -> None:
        """Corrections (0) or tombstones (1), one per key in the whole write.  A column ``_at`` gives the tier key before the change."""
        t = self.t
        image = F.struct(*[(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.schema.fields])
        old = F.nullif(F.col("_at"), t.canonical()) if "_at" in rows.columns else F.lit(None).cast("long")
        self.changes.append(rows.select(t.pk().alias("pk"), F.lit(op).cast("short").alias("op"), t.canonical().alias("tier_key"), old.alias("old_tier_key"), image.alias("image")))

    def replace_lake(self, keys: DataFrame, rows: DataFrame | None) -> None:
        self.lake = (keys, rows)

    def publish(self) -> None:
        t, catalog = self.t, self.engine.catalog
        segment = None
        if self.changes:
            changes = self.changes[0]
            for more in self.changes[1:]:
                changes = changes.unionByName(more)
            # all corrections of a write have one version; key and version name a correction
            segment = t.write_segment(changes.withColumn("version", F.lit(catalog.next_versions(t.id, 1)).cast("long")))

        def finish() -> None:
            catalog.expect(t.id, t=self.cut.t)
            catalog.swap_heap(t.id, self.heap_add, self.heap_drop)
            if segment is not None and segment[1]:
                catalog.append_overlay(t.id, *segment)
            for act in self.extra:
                act()

        if self.lake is not None:
            keys, rows = self.lake

            def make(base: Snapshot) -> Snapshot:
                bands = t.lake.with_band(t.lake.scan(base).join(keys.distinct(), t.keys, "left_semi")).select(*t.keys, "_band")
                return t.lake.replace_keys(base, bands, rows, {"op-kind": "direct"})

            with catalog.lake_lock(t.id, wait=60):
                self.engine.commit_lake(t, make, lambda made: finish())
            return
        with catalog.transaction():
            finish()
        t.merge_segments()
