"""Labelled loads: each label takes effect exactly once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from thermocline.operators.writes import WriteRejected
from thermocline.plans.modes import Side
from thermocline.sources.lake import DataFile, Snapshot

SPOOL_ROWS = 1000


@dataclass
class LoadResult:
    label: str
    hot_rows: int
    delta_rows: int
    staged_rows: int
    replay: bool = False

    def to_dict(self) -> dict:
        return {"hot_rows": self.hot_rows, "delta_rows": self.delta_rows, "staged_rows": self.staged_rows}


class Loads:
    """Load methods of the engine."""

    def stream_load(self, name: str, label: str, rows: DataFrame, spool_rows: int = SPOOL_ROWS) -> LoadResult:
        """Routes a batch once per label; a repeated label returns the recorded result and changes nothing.

        The batch is refused as a whole if a key repeats, a key or tier key is null, a row lies
        below the retention line, or a cold row goes to a direct table.  More than ``spool_rows``
        cold rows are staged as lake files and adopted later; fewer become corrections.  Hot rows
        replace heap rows of the same key.
        """
        t = self.table(name)
        known = self.catalog.load(t.id, label)
        if known:
            r = json.loads(known["result"] or "{}")
            return LoadResult(label, r.get("hot_rows", 0), r.get("delta_rows", 0), r.get("staged_rows", 0), True)
        at = t.cut()
        cut = at.t
        rows, seen = self._taken(t, rows, at, "load")
        self._unique(t, rows)
        complete = t.mode.heap_complete and not t.mode.keep_heap
        hot = rows if complete else rows.where(t.hot(cut))
        cold = rows.limit(0) if complete else rows.where(t.cold(cut))
        n_hot, n_cold = (seen["hot"] + seen["cold"], 0) if complete else (seen["hot"], seen["cold"])
        plan = t.mode.insert(Side.COLD)
        if n_cold and plan.lake:
            raise WriteRejected("a direct table takes no cold rows from a load")
        staged = n_cold > spool_rows
        manifest = None
        if staged:
            files = t.lake.write(cold, "staging")
            manifest = {"files": [f.path for f in files], "lo": min(f.low for f in files), "hi": max(f.high for f in files), "entries": [vars(f) for f in files]}
        p = self._publishing(t, at)
        if n_hot or t.mode.keep_heap and n_cold:
            into_heap = rows if t.mode.keep_heap else hot
            p.rewrite_heap(into_heap.select(*t.keys), into_heap, None if t.mode.heap_complete else cut)
        if n_cold and not staged:
            p.add_overlay(cold, 0)
        result = LoadResult(label, n_hot, 0 if staged else n_cold, n_cold if staged else 0)
        outcome: list[bool] = []

        def record() -> None:
            if not self.catalog.begin_load(t.id, label, "staged" if staged else "committed", manifest, result.to_dict()):
                raise WriteRejected(f"label {label!r} was taken meanwhile")
            outcome.append(True)

        p.extra.append(record)
        p.publish()
        return result

    def adopt_loads(self, name: str) -> int | None:
        """Takes all staged loads into the lake in one commit; returns the snapshot, or None if there are none.

        The labels become committed in the transaction that publishes the snapshot, all or none.
        """
        t = self.table(name)
        staged = self.catalog.loads(t.id, "staged")
        if not staged:
            return None
        labels = [x["label"] for x in staged]
        op = "adopt-" + uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([t.id, labels])).hex
        loads = [[DataFile(**e) for e in json.loads(x["staged"])["entries"]] for x in staged]
        stamps = {"op-id": op, "op-kind": "load", "labels": json.dumps(labels)}

        def make(base: Snapshot) -> Snapshot:
            done = t.lake.stamped(base.number, **{"op-id": op})
            if done is not None:
                return done
            entries = [e for files in loads for e in files]
            low, high = min(e.low for e in entries), max(e.high for e in entries)
            if len(loads) == 1 and not t.lake.may_match(base, low, high + 1):
                return t.lake.commit(base, add=entries, stamps=stamps)
            rows = None
            for i, files in enumerate(loads):
                part = self.spark.read.schema(t.schema).parquet(*[f.path for f in files]).withColumn("_load", F.lit(i))
                rows = part if rows is None else rows.unionByName(part)
            # every place that any of the loads names is cleared; of a key loaded several times the newest load stays
            places = t.lake.with_band(rows).select(*t.keys, "_band")
            if len(loads) > 1:
                newest = rows.groupBy(*t.keys).agg(F.max("_load").alias("_load"))
                rows = rows.join(newest, [*t.keys, "_load"])
            return t.lake.replace_keys(base, places, rows.select(*t.schema.names), stamps)

        def publish(made: Snapshot) -> None:
            self.fail_point("after-adopt-commit")
            self.catalog.finish_loads(t.id, labels, "committed", made.number)

        return self.commit_lake(t, make, publish).number

    def fail_load(self, name: str, label: str) -> None:
        """Gives up a staged load; its files are swept after the grace period."""
        self.catalog.finish_loads(self.table(name).id, [label], "failed")

    def load_stream(self, name: str, stream: DataFrame, checkpoint: str, prefix: str = "batch"):
        """A streaming query that loads every micro-batch under the label ``prefix-<batch id>``; a batch run again is a replay."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.stream_load(name, f"{prefix}-{batch_id}", batch)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
