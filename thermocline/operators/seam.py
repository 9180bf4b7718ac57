"""Reading a tiered table: hot rows, lake rows without corrected keys, and corrections."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from thermocline.operators.support import bounded
from thermocline.plans.modes import Cold
from thermocline.plans.predicate import Reach, bounds, classify, tier_predicate
from thermocline.table import OVERLAY_BROADCAST_KEYS, TieredTable


# What separates the parts of a token.
TOKEN_SEPARATOR = "\x1f"


class NeverCommitted(RuntimeError):
    """A strict read needs a lake snapshot and there is none."""


def merge_cold(lake: DataFrame, corrected: DataFrame, upserts: DataFrame, keys: list[str], columns: list[str], overlay_keys: int | None) -> DataFrame:
    """Lake rows whose key isn't ``corrected`` in any way, and the overlay's ``upserts``.

    Keys are compared in their own types.  ``overlay_keys``: bound of the number of corrected keys,
    or None if unknown; they are broadcast only within a bound, beyond it the join shuffles.
    """
    small = overlay_keys <= OVERLAY_BROADCAST_KEYS if overlay_keys is not None else bounded(corrected)
    base = lake.join(F.broadcast(corrected) if small else corrected, keys, "left_anti")
    return base.select(*columns).unionByName(upserts.select(*columns))


def cold_rows(t: TieredTable, cut: int, snapshot: int, *, overlay: bool = True, low: int | None = None, high: int | None = None) -> DataFrame:
    """The cold half below ``cut`` at a lake snapshot; ``low`` and ``high`` prune lake files by the manifest and filter nothing else."""
    names = t.schema.names
    lake = t.lake.scan(t.lake.snapshot(snapshot), low=low, high=cut if high is None else min(cut, high)).where(t.cold(cut))
    n = t.overlay_keys() if overlay else 0
    if not n:
        return lake
    segments = t.overlay_segments()
    upserts = t.overlay(segments).where(F.col("op") == 0).select("image.*").where(t.cold(cut))
    return merge_cold(lake, t.corrected_keys(segments), upserts, t.keys, names, n)


def hot_rows(t: TieredTable, cut: int, low: int | None = None, high: int | None = None) -> DataFrame:
    return t.heap(low=cut if low is None else max(cut, low), high=high).where(t.hot(cut))


def scan(t: TieredTable, cut: int, snapshot: int, *, where: str | None = None, reach: Reach | None = None) -> DataFrame:
    """The whole table at (cut, snapshot).  With ``where`` the half that can't match isn't read."""
    kind = t.mode.cold_read
    if t.mode.heap_complete:
        low, high = bounds(tier_predicate(t.spark, where, t.tier, t.key, t.tier_dtype))
        rows = t.heap(low, high)
        return rows.where(where) if where else rows
    predicate = tier_predicate(t.spark, where, t.tier, t.key, t.tier_dtype)
    reach, (low, high) = reach or (classify(predicate, cut) if where else Reach.MIXED), bounds(predicate)
    halves = []
    if reach is not Reach.COLD:
        halves.append(hot_rows(t, cut, low, high))
    if reach is not Reach.HOT:
        live = kind is Cold.LIVE
        # a live lake is read at what is published now, whatever was pinned
        halves.append(cold_rows(t, cut, t.cut().s if live else snapshot, overlay=not live, low=low, high=high))
    rows = halves[0] if len(halves) == 1 else halves[0].unionByName(halves[1])
    return rows.where(where) if where else rows


@dataclass
class ReadHandle:
    """A consistent read; keep it open until the last action on its DataFrame is done."""

    engine: object
    df: DataFrame
    pins: list[str] = field(default_factory=list)

    def dataframe(self) -> DataFrame:
        return self.df

    def close(self) -> None:
        for p in self.pins:
            self.engine.catalog.unpin(p)
        self.pins = []

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_) -> None:
        self.close()


class Reads:
    """Read methods of the engine."""

    def read(self, name: str, where: str | None = None, *, strict: bool = False, hybrid: bool = False, hybrid_lag: int | str = 0, mirror_wait_ms: int = 5000, pin_ttl: float = 900) -> ReadHandle:
        """One consistent view of a table under a read pin.

        ``strict``: fail if the lake was never committed.  ``hybrid`` (mirrored tables): rows older
        than the newest tier key less ``hybrid_lag`` come from the mirror in the lake, once it has
        caught up within ``mirror_wait_ms``, else the heap answers all.
        """
        t = self.table(name)
        if hybrid:
            return self._hybrid(t, where, hybrid_lag, mirror_wait_ms, pin_ttl)
        if t.mode.heap_complete:
            return ReadHandle(self, scan(t, 0, 0, where=where))
        pin, cut, snapshot = self.catalog.pin(t.id, pin_ttl)
        try:
            if strict and t.mode.cold_read is Cold.MERGED and not snapshot:
                raise NeverCommitted(f"{name} has no lake snapshot yet")
            return ReadHandle(self, scan(t, cut, snapshot, where=where), [pin])
        except BaseException:
            self.catalog.unpin(pin)
            raise

    def _hybrid(self, t: TieredTable, where: str | None, lag: int | str, wait_ms: int, ttl: float) -> ReadHandle:
        if t.mode.base != "mirrored":
            raise ValueError("hybrid reads are for mirrored tables")
        if not self.wait_for_mirror(t.name, wait_ms):
            return ReadHandle(self, scan(t, 0, 0, where=where))
        pin, _, snapshot = self.catalog.pin(t.id, ttl)
        try:
            top = self.high_water(t)
            if not snapshot or top is None:
                return ReadHandle(self, t.heap().where(where or "true"), [pin])
            cut = top - t.key.lag(lag)
            rows = hot_rows(t, cut).unionByName(cold_rows(t, cut, snapshot, overlay=False))
            return ReadHandle(self, rows.where(where) if where else rows, [pin])
        except BaseException:
            self.catalog.unpin(pin)
            raise

    def wait_for_mirror(self, name: str, wait_ms: int = 5000, poll_ms: int = 50) -> bool:
        """Waits until the mirror's frontier has reached the newest change; False when the time is up."""
        t = self.table(name)
        until = time.monotonic() + wait_ms / 1000
        target = self.newest_position(t)
        while True:
            f = self.catalog.frontier(t.id)
            if target is None or f is not None and f >= target:
                return True
            if time.monotonic() >= until:
                return False
            time.sleep(poll_ms / 1000)

    def newest_position(self, t: TieredTable) -> int | None:
        """Position of the newest change of a mirrored table, kept in the catalog; sources set it through :meth:`note_position`."""
        return self.catalog.newest(t.id)

    def note_position(self, name: str, position: int) -> None:
        self.catalog.set_newest(self.table(name).id, position)

    def register_views(self, *names: str, pin_ttl: float = 900) -> ReadHandle:
        """Temp views of the named tables (default: all), each at one pinned state, so that any SQL sees them."""
        views = ReadHandle(self, None)
        try:
            for row in self.catalog.tables():
                if not names or row["name"] in names:
                    h = self.read(row["name"], pin_ttl=pin_ttl)
                    views.pins += h.pins
                    h.df.createOrReplaceTempView(row["name"])
        except BaseException:
            views.close()
            raise
        return views

    def named_tables(self, text: str) -> list[str]:
        """Registered tables that a statement names, by Spark's own parser; names of CTEs and other views are none."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        found = {n.split(",")[-1].strip().lower() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan.treeString())}
        return [r["name"] for r in self.catalog.tables() if r["name"].lower() in found]

    def sql(self, text: str, pin_ttl: float = 900) -> ReadHandle:
        """Runs a query over registered tables: joins, CTEs, subqueries, aggregates and windows alike.  Only the tables that it names are pinned."""
        names = self.named_tables(text)
        views = self.register_views(*names, pin_ttl=pin_ttl) if names else ReadHandle(self, None)
        try:
            return ReadHandle(self, self.spark.sql(text), views.pins)
        except BaseException:
            views.close()
            raise

    def preview(self, text: str, rows: int = 1000, seconds: float = 30) -> list[dict]:
        """The first rows of a query, for display; it is cancelled after ``seconds``."""
        context, tag = self.spark.sparkContext, f"preview-{uuid.uuid4().hex}"
        late = threading.Timer(seconds, context.cancelJobsWithTag, [tag])
        with self.sql(text) as df:
            context.addJobTag(tag)
            late.start()
            try:
                return [r.asDict() for r in df.limit(rows).collect()]
            finally:
                late.cancel()
                context.removeJobTag(tag)

    # tokens ---------------------------------------------------------------

    def cold_token(self, name: str) -> str:
        """An opaque name of the cold half that a read would see now: a pinned snapshot, or the live lake of a direct table."""
        t, cut = self.table(name), self.table(name).cut()
        return TOKEN_SEPARATOR.join(["live", t.name] if t.mode.direct else ["lake", t.name, str(cut.s)])

    def read_token(self, token: str) -> DataFrame:
        """Rows of the lake that a token names."""
        kind, name, *rest = token.split(TOKEN_SEPARATOR)
        if (kind, len(rest)) not in (("live", 0), ("lake", 1)) or rest and not rest[0].isdigit():
            raise ValueError(f"no token: {token!r}")
        t = self.table(name)
        return t.lake.scan(t.lake.snapshot(t.cut().s if kind == "live" else int(rest[0])))
