"""Mirroring a change stream into the lake with Structured Streaming."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from thermocline.functions.keys import key_text
from thermocline.functions.positions import position_rank
from thermocline.operators.support import written_seen
from thermocline.sources.lake import Snapshot
from thermocline.table import TieredTable


#: Number within a position that none exceeds: the position is done with.
_LAST = 2**63 - 1


class StreamError(RuntimeError):
    """The stream can't be applied; the query ends."""


class SchemaDiverged(StreamError):
    """A column was dropped, renamed, reordered or changed to another family of types."""


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "integer"
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return "number"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return "timestamp"
    return kind.typeName()


def classify_schema(old: T.StructType, new: T.StructType) -> list[T.StructField]:
    """Columns that ``new`` appends to ``old``; raises if it differs in any other way.  A change within a family of types is allowed."""
    for i, f in enumerate(old.fields):
        if i >= len(new.fields) or f.name not in new.names:
            raise SchemaDiverged(f"column {f.name} is gone")
        if new.fields[i].name != f.name:
            raise SchemaDiverged(f"column {f.name} has moved")
        if family(f.dataType) != family(new.fields[i].dataType):
            raise SchemaDiverged(f"column {f.name} changed from {f.dataType.simpleString()} to {new.fields[i].dataType.simpleString()}")
    return new.fields[len(old.fields) :]


def change_schema(table: T.StructType) -> T.StructType:
    """Schema of change rows of a table: position (commit order), seq (order within), kind, new and old image, unchanged columns."""
    image = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.fields])
    return T.StructType([T.StructField("position", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("new", image), T.StructField("old", image), T.StructField("unchanged", T.ArrayType(T.StringType()))])


def collapse(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Newest image per key: ``pk, op (0 upsert, 1 delete), position, row``.

    A column marked unchanged takes its value from the old image.  An update that changes the key
    deletes the old key.  Positions are unsigned.  Only one row per key is shuffled from each map
    task.
    """
    filled = F.struct(*[F.when(F.array_contains(F.coalesce("unchanged", F.array().cast("array<string>")), c), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in columns])
    is_delete = F.col("kind") == "delete"
    order = F.struct(position_rank(F.col("position")).alias("rank"), "seq")
    own = changes.select(F.when(is_delete, F.col("old")).otherwise(filled).alias("row"), F.when(is_delete, 1).otherwise(0).alias("op"), order.alias("o"), F.lit(1).alias("second"))
    moved_key = (F.col("kind") == "update") & F.col("old").isNotNull()
    for_old = changes.where(moved_key).select(F.col("old").alias("row"), F.lit(1).alias("op"), order.alias("o"), F.lit(0).alias("second"), filled.alias("new_row"))
    differs = F.lit(False)
    for k in keys:
        differs = differs | (F.col(f"row.{k}").isNotNull() & ~F.col(f"row.{k}").eqNullSafe(F.col(f"new_row.{k}")))
    both = own.unionByName(for_old.where(differs).drop("new_row"))
    keyed = both.withColumn("pk", key_text([F.col(f"row.{k}") for k in keys]))
    per = keyed.groupBy("pk").agg(F.max_by(F.struct("op", "row", "o"), F.struct("o", "second")).alias("m"))
    return per.select("pk", "m.op", position_rank(F.col("m.o.rank")).alias("position"), "m.row")


class Mirror:
    """Mirror methods of the engine."""

    def apply_changes(self, name: str, changes: DataFrame, *, up_to: int | None = None) -> int | None:
        """Merges a batch of changes into the lake and advances the frontier with the snapshot; returns the new frontier.

        What lies at or below the frontier, position and then number within it, was applied before
        and is skipped, so a batch may come again.  Where the feed has ``commit`` rows, only whole
        transactions are applied: changes above the last commit are kept with the table until their
        commit comes.  A feed without them is taken as it comes, and a position that goes on in the
        next batch goes on there.  ``up_to`` says that everything up to a position was delivered (a
        heartbeat) and advances the frontier even if nothing changed.  New columns at the end widen
        the table.  A truncate, a change without key or an unchanged value without old image ends
        the stream before anything of the batch is applied.
        """
        t = self.table(name)
        self._recover_frontier(t)
        image = changes.schema["new"].dataType
        if image.names != t.schema.names:
            self.evolve(name, image)
            t = self.table(name)
        frontier, props = self.catalog.frontier(t.id), self.catalog.props(t.id)
        rank, tail = position_rank(F.col("position")), props.get("mirror-tail")
        if tail:
            changes = changes.unionByName(self.spark.read.schema(changes.schema).parquet(tail)).dropDuplicates(["position", "seq"])
        if frontier is not None:
            at = F.lit(_rank(frontier))
            changes = changes.where((rank > at) | (rank == at) & (F.col("seq") > F.lit(props.get("mirror-seq", _LAST))))
        commits = F.col("kind") == "commit"
        marked = F.coalesce("unchanged", F.array().cast("array<string>"))
        lost = (F.size(marked) > 0) & F.col("old").isNull()
        facts = [F.count_if(~commits).alias("changed"), F.max(F.when(F.col("kind") == "truncate", 1)).alias("truncated"), F.max(F.when(lost, 1)).alias("unfilled"), F.max(F.struct(rank.alias("rank"), "seq")).alias("top")]
        fresh, seen = written_seen(changes, "changes", F.max(F.when(commits, rank)).alias("committed"), *facts)
        highest, committed = seen["top"] and seen["top"]["rank"], seen["committed"]
        whole = committed is not None or bool(tail)
        limit = max((x for x in (committed if whole else highest, None if up_to is None else _rank(up_to)) if x is not None), default=None)
        taken = fresh.where(rank <= F.lit(limit)) if limit is not None else fresh.limit(0)
        held = highest is not None and (limit is None or highest > limit)
        if held:
            seen = taken.agg(*facts).first()
        changed, truncated, unfilled, top = (seen[k] for k in ("changed", "truncated", "unfilled", "top"))
        if truncated:
            raise StreamError(f"{name} was truncated")
        if unfilled:
            raise StreamError("an unchanged value has no old image")
        found = {"mirror-seq": None if top is None else top["seq"], "mirror-tail": None}
        if held:
            found["mirror-tail"] = f"{t.root}/mirror-tail/{uuid.uuid4().hex}"
            (fresh if limit is None else fresh.where(rank > F.lit(limit))).write.parquet(found["mirror-tail"])
        position = frontier if limit is None else max(_position(limit), frontier or 0)
        if top is not None and _position(top["rank"]) != position or top is None:
            # nothing of the frontier's own position was applied now: what comes of it later was there before or is new as a whole
            found["mirror-seq"] = props.get("mirror-seq", _LAST) if position == frontier else _LAST
        if not changed:
            with self.catalog.transaction():
                if position is not None and position != frontier:
                    self.catalog.advance_frontier(t.id, position)
                self.catalog.set_props(t.id, found)
            return position
        newest, seen = written_seen(collapse(taken.where(~commits), t.keys, t.schema.names), "newest", F.count_if(F.col("pk").isNull()).alias("no_key"), F.count_if((F.col("op") == 0) & F.col(f"row.{t.tier}").isNull()).alias("no_tier"))
        if seen["no_key"]:
            raise StreamError("a change has no primary key")
        if seen["no_tier"]:
            raise StreamError("a row has no tier key")

        def publish(made: Snapshot) -> None:
            self.fail_point("after-mirror-commit")
            self.catalog.advance_frontier(t.id, position, made.number)
            self.catalog.set_props(t.id, found)

        self.commit_lake(t, lambda base: self._merge_into_lake(t, base, newest, position, found), publish)
        return position

    def _merge_into_lake(self, t: TieredTable, base: Snapshot, newest: DataFrame, top: int, found: dict) -> Snapshot:
        keys = newest.select("row.*").select(*t.keys)
        rows = newest.where("op = 0").select("row.*").select(*t.schema.names)
        return t.lake.replace_keys(base, keys, rows, {"op-kind": "mirror", "commit-lsn": str(top), "mirror": json.dumps(found)})

    def _recover_frontier(self, t: TieredTable) -> None:
        """After a crash between commit and publication: the mirror snapshot on top of the published one tells how far the stream got."""
        cut = self.catalog.cutline(t.id)
        made = t.lake.stamped(cut["s"], **{"op-kind": "mirror"})
        if made is not None and "commit-lsn" in made.stamps:
            f = self.catalog.frontier(t.id)
            at = int(made.stamps["commit-lsn"])
            if f is None or at >= f:
                with self.catalog.transaction():
                    self.catalog.expect(t.id, s=made.base)
                    self.catalog.advance_frontier(t.id, at, made.number)
                    self.catalog.set_props(t.id, json.loads(made.stamps.get("mirror", "{}")))

    def evolve(self, name: str, new: T.StructType) -> list[str]:
        """Appends new columns to the table's schema; other changes are refused."""
        t = self.table(name)
        added = classify_schema(t.schema, new)
        if added:
            wider = T.StructType([*t.schema.fields, *[T.StructField(f.name, f.dataType, True) for f in added]])
            self.catalog.set_schema(t.id, wider.json())
        return [f.name for f in added]

    def mirror_stream(self, name: str, stream: DataFrame, checkpoint: str, *, fold: bool = True, every: str | None = None):
        """A streaming query that mirrors change rows; at-least-once batches become exactly-once by the frontier.

        ``every``: interval between batches, such as ``2 seconds``; by default it takes what is
        there and ends.  How many rows a batch takes is the source's setting.
        """

        def each(batch: DataFrame, batch_id: int) -> None:
            self.apply_changes(name, batch)
            if fold and self.table(name).mode.heap_retention:
                self.fold(name)

        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _rank(position: int) -> int:
    """Signed number that sorts as the unsigned position does."""
    return (position & (2**64 - 1)) - 2**63


def _position(rank: int) -> int:
    return rank + 2**63
