"""Data movement: tiering, folding, retention, ingestion, initial copy, partition upkeep.

Every movement writes files first, journals its phases and publishes in one catalog
transaction; after a crash the next run finds the stamped snapshot and finishes or abandons.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from thermocline.catalog import BaseMoved
from thermocline.operators.incremental import after_key
from thermocline.operators.support import written
from thermocline.sources.jsonl import read_jsonl
from thermocline.sources.lake import Snapshot
from thermocline.table import TieredTable


#: Up to so many corrections a fold takes the oldest by a bounded top-k; beyond it takes whole versions, and splits those larger than its batch.
TOP_ROWS = 100_000


class MovementError(RuntimeError):
    """A movement was refused before any side effect."""


#: How often a commit is done again when another writer published first.
COMMIT_TRIES = 8


class Movement:
    """Movement methods of the engine."""

    def commit_lake(self, t: TieredTable, make: Callable[[Snapshot], Snapshot], publish: Callable[[Snapshot], None]) -> Snapshot:
        """Commits to the lake: ``make`` builds a snapshot on the published one, ``publish`` makes it and what belongs to it visible in one transaction.

        The transaction holds only while the base is still the published snapshot.  If another
        writer came first, ``make`` runs again on what that one published, so neither undoes the other.
        """
        for _ in range(COMMIT_TRIES):
            base = t.lake.snapshot(self.catalog.cutline(t.id)["s"])
            made = make(base)
            self.pause_point("made")
            try:
                with self.catalog.transaction():
                    self.catalog.expect(t.id, s=base.number)
                    if made.number != base.number:
                        self.catalog.advance(t.id, self.catalog.cutline(t.id)["t"], made.number)
                    publish(made)
                return made
            except BaseMoved:
                if made.number != base.number:
                    t.lake.discard(made)
        raise MovementError(f"{t.name}: other writers published first {COMMIT_TRIES} times")

    # partitions -----------------------------------------------------------

    def add_partition(self, name: str, lo, hi, partition_id: str | None = None) -> str:
        t = self.table(name)
        lo, hi = t.key.canonical(lo), t.key.canonical(hi)
        for p in self.catalog.partitions(t.id):
            if lo < p["hi"] and p["lo"] < hi and p["partition_id"] != partition_id:
                raise MovementError(f"[{lo}, {hi}) overlaps {p['partition_id']}")
        partition_id = partition_id or f"{t.name}_{t.key.token(lo)}"
        self.catalog.upsert_partition(t.id, partition_id, lo, hi)
        return partition_id

    def premake(self, name: str, width: int | str, headroom: int = 3) -> list[str]:
        """Keeps ``headroom`` partitions of ``width`` above the highest hot key, so that new rows always have one."""
        t = self.table(name)
        width = t.key.lag(width)
        parts = self.catalog.partitions(t.id)
        top = self.high_water(t)
        if top is None and not parts:
            return []
        end = max(p["hi"] for p in parts) if parts else top - top % width
        wanted = (top if top is not None else end) + headroom * width
        made = []
        while end <= wanted:
            made.append(self.add_partition(name, end, end + width)) if t.key.name == "bigint" else made.append(self._add_canonical(t, end, end + width))
            end += width
        return made

    def _add_canonical(self, t: TieredTable, lo: int, hi: int) -> str:
        partition_id = f"{t.name}_{t.key.token(lo)}"
        self.catalog.upsert_partition(t.id, partition_id, lo, hi)
        return partition_id

    def sync_partitions(self, name: str, declared: Mapping[str, str]) -> list[str]:
        """Registers as hot what the heap's owner declares and the catalog doesn't know; returns the new partitions.

        ``declared`` maps partition names to texts such as ``FOR VALUES FROM ('2024-01-01') TO
        ('2024-02-01')``.  Other forms (a default partition, an open end) have no range and are
        passed over; known names stay as they are, whatever their bounds say.
        """
        t, made = self.table(name), []
        known = {p["partition_id"] for p in self.catalog.partitions(t.id)}
        for partition_id, text in declared.items():
            ends = partition_bounds(text, t)
            if partition_id not in known and ends is not None:
                self.catalog.upsert_partition(t.id, partition_id, *ends)
                made.append(partition_id)
        return made

    def off_grid(self, name: str) -> DataFrame:
        """Heap rows at or above the cut-line that lie in no partition."""
        t = self.table(name)
        rows = t.heap(low=t.cut().t).where(t.hot(t.cut().t))
        for p in self.catalog.partitions(t.id):
            rows = rows.where(~t.canonical().between(p["lo"], p["hi"] - 1))
        return rows

    def high_water(self, t: TieredTable) -> int | None:
        """Highest tier key in the heap, from the ranges of its files."""
        return max((f["hi"] for f in self.catalog.heap_files(t.id) if f["hi"] is not None), default=None)

    # tiering --------------------------------------------------------------

    def tier(self, name: str, lag: int | str = 0, up_to: int | None = None) -> int | None:
        """Moves the contiguous run of partitions that end at or below the high-water mark less ``lag`` into the lake; returns the new cut-line.

        ``up_to`` overrides the high-water mark (canonical).  Cycle: resume, select, seal, flush,
        commit, advance (T, S), mark tiered.  Nothing to move gives None.
        """
        t = self.table(name)
        self.resume(name)
        top = up_to if up_to is not None else self.high_water(t)
        if top is None:
            return None
        limit = top - t.key.lag(lag)
        chosen = self._contiguous(t, limit)
        if not chosen:
            return None
        cut = t.cut()
        new_t = chosen[-1]["hi"]
        op = uuid.uuid4().hex
        self.catalog.log_op(op, t.id, "tiering", "flushing", details={"new-tier-key-hi": new_t})
        for p in chosen:
            for state in ("sealing", "tiering"):
                if p["state"] == "hot" or p["state"] == "sealing" and state == "tiering":
                    self.catalog.transition(t.id, p["partition_id"], state)
                    p = {**p, "state": state}
        rows = t.heap(low=cut.t, high=new_t).where(t.hot(cut.t) & t.cold(new_t))
        stamps = {"op-id": op, "op-kind": "tiering", "table-id": str(t.id), "new-tier-key-hi": str(new_t)}
        files = t.lake.write(rows)
        self.fail_point("before-commit")

        def publish(made: Snapshot) -> None:
            self.fail_point("after-commit")
            self.catalog.expect(t.id, t=cut.t)
            self._finish_tiering(t, op, new_t, made.number)

        self.commit_lake(t, lambda base: t.lake.commit(base, add=files, stamps=stamps) if files else base, publish)
        self.reclaim(name)
        return new_t

    def _contiguous(self, t: TieredTable, limit: int) -> list[dict]:
        """Partitions from the cut-line on as far as they end within the limit.

        The run stops at a hole and moves what lies before it; the next cycle begins at the hole
        and reports it as an error, since rows in it would be passed over.
        """
        cut = t.cut().t
        parts = [dict(p) for p in self.catalog.partitions(t.id) if p["state"] in ("hot", "sealing", "tiering")]
        chosen, expected = [], cut
        for p in parts:
            if p["hi"] > limit:
                break
            if p["lo"] > expected:
                if not chosen:
                    raise MovementError(f"no partition covers [{expected}, {p['lo']})")
                break
            chosen.append(p)
            expected = max(expected, p["hi"])
        return chosen

    def _finish_tiering(self, t: TieredTable, op: str, new_t: int, s: int) -> None:
        self.catalog.log_op(op, t.id, "tiering", "committed", s)
        with self.catalog.transaction():
            self.catalog.advance(t.id, max(new_t, self.catalog.cutline(t.id)["t"]), s)
            self.catalog.log_op(op, t.id, "tiering", "advanced", s)
            for p in self.catalog.partitions(t.id):
                if p["hi"] <= new_t and p["state"] == "tiering":
                    self.catalog.transition(t.id, p["partition_id"], "tiered")

    def resume(self, name: str) -> list[str]:
        """Finishes or abandons operations that a crash left open."""
        t = self.table(name)
        out = []
        for op in self.catalog.open_ops(t.id):
            details = json.loads(op["details"])
            # a snapshot on an older base is void: what it lacks would be undone
            made = t.lake.stamped(self.catalog.cutline(t.id)["s"], **{"op-id": op["op_id"]})
            if made is not None and op["kind"] == "tiering":
                self._finish_tiering(t, op["op_id"], int(details["new-tier-key-hi"]), made.number)
                out.append(f"{op['op_id']} finished")
            elif op["phase"] == "committed" and op["kind"] == "tiering" and op["s"] is not None and op["s"] <= self.catalog.cutline(t.id)["s"]:
                self._finish_tiering(t, op["op_id"], int(details["new-tier-key-hi"]), self.catalog.cutline(t.id)["s"])
                out.append(f"{op['op_id']} finished")
            else:
                self.catalog.log_op(op["op_id"], t.id, op["kind"], "abandoned")
                out.append(f"{op['op_id']} abandoned")
        return out

    def reclaim(self, name: str, lag: int | str = 0) -> list[str]:
        """Drops heap rows of tiered partitions that no live pin needs; tables that keep their heap keep them."""
        t = self.table(name)
        if t.mode.keep_heap or t.mode.heap_complete:
            return []
        horizon, top = self.catalog.horizon(t.id)[0], self.high_water(t)
        dropped, gone = [], []
        for p in self.catalog.partitions(t.id):
            if p["state"] == "tiered" and p["hi"] <= horizon and (top is None or p["hi"] <= top - t.key.lag(lag)):
                dropped.append(p["partition_id"])
        for f in self.catalog.heap_files(t.id):
            if f["partition_id"] in dropped and f["hi"] is not None and f["hi"] < horizon:
                gone.append(f["path"])
        with self.catalog.transaction():
            self.catalog.swap_heap(t.id, [], gone)
            for p in dropped:
                self.catalog.transition(t.id, p, "dropped")
        return dropped

    # folding --------------------------------------------------------------

    def fold(self, name: str, batch: int = 1000, *, merge_on_read: bool = False) -> int | None:
        """Folds the oldest ``batch`` corrections into the lake; returns the new snapshot, None if pinned or nothing to do.  A batch beyond ``TOP_ROWS`` takes its last version whole unless that alone is more than a batch.

        A correction replaces the row where the lake holds it (its old tier key) and lands at its
        new one.  Exactly the folded keys at their folded versions are cleared: the other rows of a
        write, which share its version, and corrections that arrive meanwhile stay.
        """
        t = self.table(name)
        if self.catalog.pinned(t.id) or not t.overlay_keys():
            return None
        op, left = uuid.uuid4().hex, []
        self.catalog.log_op(op, t.id, "compaction", "flushing")

        def make(base: Snapshot) -> Snapshot:
            segments = t.overlay_segments()
            rows = t.overlay(segments)
            chosen = written(_oldest(rows, batch, t.overlay_keys()), "fold")
            top = chosen.agg(F.max("version")).first()[0]
            left[:] = [segments, top, *self._without_folded(t, segments, chosen)]
            if top is None:
                return base
            return self._replace(t, base, chosen, {"op-id": op, "op-kind": "compaction", "folded-version": str(top)}, merge_on_read)

        def publish(made: Snapshot) -> None:
            self.fail_point("after-fold-commit")
            segments, top, kept, n = left
            self.catalog.publish_fold(t.id, made.number, top or 0, (kept, n), folded=segments)
            self.catalog.log_op(op, t.id, "compaction", "advanced", made.number, {"version": top})

        return self.commit_lake(t, make, publish).number

    def _without_folded(self, t: TieredTable, segments: list[str], folded: DataFrame) -> tuple[list[str], int]:
        """The overlay of ``segments`` less the folded keys, as one segment.  Rows of a key older than the folded one were merged into it."""
        left = t.overlay(segments).join(folded.select("pk", F.col("version").alias("_folded")), "pk", "left").where(F.col("_folded").isNull() | (F.col("version") > F.col("_folded")))
        path, n = t.write_segment(left)
        return ([path], n) if n else ([], 0)

    def _replace(self, t: TieredTable, base: Snapshot, changes: DataFrame, stamps: dict, merge_on_read: bool = False) -> Snapshot:
        """Lake without the changed keys in the bands that hold them, plus the upserts."""
        image = changes.select("image.*", "op", F.coalesce("old_tier_key", "tier_key").alias("_at"))
        at = self._from_canonical(t, F.col("_at"))
        # the band of the old image: the layout applied to the old tier key
        band = t.lake.layout.band(at, t.key, t.tier_dtype)
        keys = image.select(*t.keys, band.alias("_band"))
        rows = image.where("op = 0").select(*t.schema.names)
        return t.lake.replace_keys(base, keys, rows, stamps, merge_on_read=merge_on_read)

    @staticmethod
    def _from_canonical(t: TieredTable, key):
        if t.key.name == "bigint":
            return key
        if t.key.name == "date":
            return F.date_from_unix_date(key.cast("int"))
        return F.timestamp_micros(key).cast(t.tier_dtype) if t.tier_dtype == "timestamp" else F.timestamp_add("MICROSECOND", key, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))

    # retention ------------------------------------------------------------

    def expire(self, name: str, width: int | str = 1) -> int | None:
        """Drops lake files older than the retention lag behind the cut-line, whole bands at a time; returns the new line.

        The line is aligned to ``width`` and capped by the lowest tier key in the heap and by the
        lowest staged load.  A file that straddles the line stops the run before any effect.
        """
        t = self.table(name)
        lag = t.row["lake_retention_lag"]
        if lag is None or self.catalog.pinned(t.id):
            return None
        cut, width = t.cut(), t.key.lag(width)
        line = cut.t - lag
        # a tiered partition whose heap rows wait for reclaim holds the line back as well
        caps = [p["lo"] for p in self.catalog.partitions(t.id) if p["state"] != "dropped" and (p["state"] != "tiered" or p["partition_id"] in self._with_heap_rows(t))]
        caps += [json.loads(x["staged"])["lo"] for x in self.catalog.loads(t.id, "staged") if x["staged"]]
        line = min([line, *caps])
        line -= line % width
        if cut.r is not None and line <= cut.r:
            return None
        op, keep = uuid.uuid4().hex, []

        def make(base: Snapshot) -> Snapshot:
            gone = [f for f in base.files if f.high is None or f.high < line]
            if any(f.low is not None and f.low < line <= f.high for f in base.files if f.high is not None):
                raise MovementError(f"a lake file straddles {line}")
            segments = t.overlay_segments()
            keep[:] = [segments, *(t.write_segment(t.overlay(segments).where(F.col("tier_key") >= line)) if segments else (None, 0))]
            return t.lake.commit(base, drop=[f.path for f in gone], stamps={"op-id": op, "op-kind": "maintenance", "retention": str(line)}) if gone else base

        def publish(made: Snapshot) -> None:
            segments, path, n = keep
            self.catalog.publish_retention(t.id, line, made.number)
            if segments:
                self.catalog.replace_segments(t.id, segments, [path] if n else [], n)

        self.commit_lake(t, make, publish)
        return line

    def _with_heap_rows(self, t: TieredTable) -> set[str]:
        """Partitions that heap files are still listed under."""
        return {f["partition_id"] for f in self.catalog.heap_files(t.id)} if not t.mode.keep_heap else set()

    def expire_mirrored_heap(self, name: str, newest: int) -> int | None:
        """Heap retention of a mirrored table: partitions behind the lag leave the heap once the mirror has passed the position at which they were first seen so.

        T moves first; the rows go afterwards, and only when no pin needs them.
        """
        t = self.table(name)
        lag, top = t.row["heap_retention_lag"], self.high_water(t)
        if lag is None or top is None:
            return None
        f = self.catalog.frontier(t.id)
        ready = []
        for p in self.catalog.partitions(t.id):
            if p["state"] == "hot" and p["hi"] <= top - lag:
                if p["seen_position"] is None:
                    self.catalog.note_position(t.id, p["partition_id"], newest)
                elif f is not None and f >= int(p["seen_position"]):
                    ready.append(p)
        if not ready:
            return None
        line = max(p["hi"] for p in ready)
        with self.catalog.transaction():
            self.catalog.advance_cut(t.id, max(line, self.catalog.cutline(t.id)["t"]))
            for p in ready:
                for state in ("sealing", "tiering", "tiered"):
                    self.catalog.transition(t.id, p["partition_id"], state)
        self.reclaim(name)
        return line

    # ingestion ------------------------------------------------------------

    def ingest(self, name: str, rows: DataFrame, *, op_id: str | None = None) -> int:
        """Adds historical rows to the lake in one commit; returns the snapshot.

        All tier keys must lie below the cut-line and at or above the retention line.  If the lake
        may hold rows of the same range, rows of the same key in the same band are replaced;
        otherwise it is a plain append.  Without a null, keys must be unique in the batch.
        """
        t = self.table(name)
        cut = t.cut()
        rows = written(t.typed(rows), "ingest")
        low, high, null = rows.agg(F.min(t.canonical()), F.max(t.canonical()), F.max(F.when(F.col(t.tier).isNull(), 1))).first()
        if low is None and not null:
            return cut.s
        if null:
            raise MovementError("a row has no tier key")
        if high >= cut.t or cut.r is not None and low < cut.r:
            raise MovementError(f"tier keys {low}..{high} leave the window [{cut.r}, {cut.t})")
        stamps = {"op-id": op_id or uuid.uuid4().hex, "op-kind": "ingest"}
        appended = []

        def make(base: Snapshot) -> Snapshot:
            if t.lake.may_match(base, low, high + 1):
                return t.lake.replace_keys(base, t.lake.with_band(rows).select(*t.keys, "_band"), rows, stamps)
            if not appended:
                appended.extend(t.lake.write(rows))
            return t.lake.commit(base, add=appended, stamps=stamps)

        def publish(made: Snapshot) -> None:
            r = self.catalog.cutline(t.id)["r"]
            if r is not None and low < r:
                raise MovementError(f"the retention line moved to {r}")

        return self.commit_lake(t, make, publish).number

    def ingest_files(self, name: str, paths: Sequence[str]) -> int:
        """Adopts Parquet files; columns are matched by name."""
        return self.ingest(name, self.spark.read.parquet(*paths))

    def ingest_jsonl(self, name: str, path: str) -> int:
        """Adopts JSON lines; a line that doesn't fit the table ends the run before any effect and is named by its number."""
        return self.ingest(name, read_jsonl(self.spark, path, self.table(name).schema))

    # initial copy ---------------------------------------------------------

    def next_chunk(self, t: TieredTable, rows: DataFrame, last: Sequence | None, size: int) -> DataFrame:
        """The ``size`` rows with the lowest keys after ``last``: a bounded top-k, not a full sort."""
        if last is not None:
            rows = rows.where(after_key([F.col(k) for k in t.keys], [F.lit(v).cast(t.schema[k].dataType) for k, v in zip(t.keys, last)]))
        return rows.orderBy(*t.keys).limit(size)

    def initial_copy(self, name: str, consistent_point: int, *, chunk_rows: int | None = None, most_chunks: int | None = None) -> bool:
        """Copies the heap of a mirrored table into its lake; True when complete.

        By default one distributed write.  With ``chunk_rows`` it goes in key order, journals the
        last key after every chunk and continues there after a stop; chunks replace rows of the
        same key, so a chunk done twice changes nothing.
        """
        t = self.table(name)
        progress = self.catalog.copy_progress(t.id)
        if chunk_rows is None:
            files = t.lake.write(t.heap())
            self.commit_lake(t, lambda base: t.lake.commit(base, add=files, stamps={"op-kind": "mirror", "commit-lsn": str(consistent_point)}), lambda made: self.catalog.advance_frontier(t.id, consistent_point, made.number))
            return True
        last = json.loads(progress["last_key"]) if progress and progress["last_key"] else None
        done = 0
        while most_chunks is None or done < most_chunks:
            chunk = written(self.next_chunk(t, t.heap(), last, chunk_rows), "copy-chunk")
            n = chunk.count()
            if n:
                keys = t.lake.with_band(chunk).select(*t.keys, "_band")
                top = chunk.orderBy(*[F.desc(k) for k in t.keys]).select(*[F.col(k).cast("string") for k in t.keys]).first()
                last = list(top)
                self.commit_lake(t, lambda base: t.lake.replace_keys(base, keys, chunk, {"op-kind": "mirror"}), lambda made: self.catalog.note_copy(t.id, consistent_point, last))
                done += 1
            if n < chunk_rows:
                with self.catalog.transaction():
                    self.catalog.advance_frontier(t.id, consistent_point)
                    self.catalog.end_copy(t.id)
                return True
        return False

    # test hook ------------------------------------------------------------

    def fail_point(self, where: str) -> None:
        """Raises if a test asked for a crash here."""
        if self._fail_at == where:
            self._fail_at = None
            raise RuntimeError(f"crash asked for: {where}")

    def crash_at(self, where: str | None) -> None:
        self._fail_at = where

    def pause_point(self, where: str) -> None:
        """Runs once what a test asked to happen here, so that two writers can be made to meet."""
        act = self._at_pause.pop(where, None)
        if act is not None:
            act()

    def meanwhile(self, act: Callable[[], object], where: str = "made") -> None:
        self._at_pause[where] = act


def partition_bounds(text: str, t: TieredTable) -> tuple[int, int] | None:
    """Canonical half-open range of a declared bound; None if it has none."""
    found = re.fullmatch(r"\s*FOR\s+VALUES\s+FROM\s*\(\s*('(?:[^']|'')*'|[+-]?\d+)\s*\)\s*TO\s*\(\s*('(?:[^']|'')*'|[+-]?\d+)\s*\)\s*", text, re.I)
    if not found:
        return None
    plain = [g[1:-1].replace("''", "'") if g.startswith("'") else g for g in found.groups()]
    try:
        lo, hi = (t.key.canonical(int(x) if t.key.name == "bigint" else x) for x in plain)
    except (ValueError, TypeError):
        return None
    return (lo, hi) if lo < hi else None


def _oldest(rows: DataFrame, batch: int, keys: int) -> DataFrame:
    """The oldest ``batch`` corrections of at most ``keys``; a large batch ends with the version that reaches it, so that nothing is sorted.

    A version of more than ``batch`` corrections is split, so that exactly ``batch`` are taken; the number stays below two batches.
    """
    if batch >= keys:
        return rows
    if batch <= TOP_ROWS:
        return rows.orderBy("version", "pk").limit(batch)
    # one row per write, not per correction
    per = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
    last = per.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < batch).orderBy(F.desc("version")).first()
    if last is None:
        return rows
    if last["n"] <= batch:
        return rows.where(F.col("version") <= last["version"])
    part = _exactly(rows.where(F.col("version") == last["version"]), batch - last["_before"], last["n"])
    return rows.where(F.col("version") < last["version"]).unionByName(part)


def _exactly(rows: DataFrame, take: int, n: int) -> DataFrame:
    """``take`` of ``n`` corrections, fewer than ``n``: whole hash buckets of their keys, and of the bucket that goes beyond ``take`` a bounded top-k."""
    buckets = -(-2 * n // max(TOP_ROWS, 1))
    # n as a seed: what an earlier fold left of the version is spread evenly again
    at = F.pmod(F.xxhash64("pk", F.lit(n)), F.lit(buckets))
    sizes = dict(rows.groupBy(at.alias("at")).count().collect())
    edge, left = 0, take
    while sizes.get(edge, 0) <= left:
        left -= sizes.get(edge, 0)
        edge += 1
    whole = rows.where(at < edge)
    return whole.unionByName(rows.where(at == edge).orderBy("pk").limit(left)) if left else whole
