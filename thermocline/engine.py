"""The engine: registration and all operations on tiered tables."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from thermocline.catalog import Catalog, CatalogError
from thermocline.functions.keys import INT64_MIN, TierKeyType
from thermocline.operators.maintenance import Maintenance
from thermocline.operators.movement import Movement
from thermocline.operators.seam import Reads
from thermocline.operators.writes import Writes
from thermocline.plans.modes import TableMode
from thermocline.sources.lake import LakePartition
from thermocline.streaming.loads import Loads
from thermocline.streaming.mirror import Mirror
from thermocline.table import CutLine, TieredTable


def overlay_settings(profile: Mapping[str, str], credential: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of a storage profile: environment below profile below credential.

    A blank value removes a key.  The environment name of a key is upper case with ``_`` for ``-`` and ``.``.
    """
    env = os.environ if environment is None else environment
    names = {*profile, *(credential or {})}
    out = {k: env[e] for k in names if (e := k.upper().replace("-", "_").replace(".", "_")) in env}
    for layer in (profile, credential or {}):
        for k, v in layer.items():
            if str(v).strip():
                out[k] = v
            else:
                out.pop(k, None)
    return out


class Engine(Reads, Writes, Movement, Loads, Mirror, Maintenance):
    """Tiered tables below ``root``, a folder that all executors share.

    The control state is one SQLite file on the driver (``catalog_path``, default beside the
    tables when they are local).
    """

    def __init__(self, spark: SparkSession, root: str, catalog_path: str | None = None, **catalog_options):
        self.spark, self.root = spark, root.rstrip("/")
        if catalog_path is None:
            os.makedirs(self.root, exist_ok=True)
            catalog_path = f"{self.root}/catalog.db"
        self.catalog = Catalog(catalog_path, **catalog_options)
        self._fail_at: str | None = None
        self._at_pause: dict = {}

    def table(self, name: str) -> TieredTable:
        row = self.catalog.lookup(name)
        if row is None:
            raise CatalogError(f"no table {name!r}")
        return TieredTable(self.spark, self.catalog, self.root, row)

    def register(
        self, name: str, schema: T.StructType | str, primary_key: list[str], tier_key: str, *, tier_type: str | None = None, mode: str = "tiered", keep_heap: bool = False,
        heap_retention: int | str | None = None, lake_retention: int | str | None = None, layout: LakePartition | str = "none", cut=None, partitions: list[tuple] | None = None, profile: str | None = None,
    ) -> TieredTable:
        """Registers a table.  ``partitions`` are half-open ranges of the tier key; the cut-line begins at ``cut``, else at the lowest partition, else (and for mirrored tables) below everything."""
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        for c in [*primary_key, tier_key]:
            if c not in schema.names:
                raise CatalogError(f"no column {c!r}")
        native = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "date": "date"}.get(schema[tier_key].dataType.simpleString())
        kind = TierKeyType(tier_type or native or "unsupported")
        layout = LakePartition(layout) if isinstance(layout, str) else layout
        lag = lambda x: None if x is None else kind.lag(x)
        TableMode(mode, keep_heap, heap_retention is not None)
        with self.catalog.transaction():
            i = self.catalog.register(
                name, schema.json(), primary_key, tier_key, kind.name, mode, keep_heap=keep_heap, heap_retention_lag=lag(heap_retention), lake_retention_lag=lag(lake_retention),
                layout=layout.kind, layout_width=layout.width, profile=profile,
            )
            floors = [kind.canonical(lo) for lo, _ in partitions or []]
            start = kind.canonical(cut) if cut is not None else INT64_MIN if mode == "mirrored" or not floors else min(floors)
            self.catalog.init_cutline(i, start)
        for lo, hi in partitions or []:
            self.add_partition(name, lo, hi)
        return self.table(name)

    def unregister(self, name: str, *, drop_lake: bool = False) -> None:
        t = self.table(name)
        self.catalog.unregister(t.id)
        if drop_lake:
            t.lake.drop()

    def storage_profile(self, name: str, config: dict, default: bool = False) -> None:
        self.catalog.create_profile(name, config, default)

    def load_heap(self, name: str, rows: DataFrame) -> int:
        """Adds rows to the heap as they are, for a first fill."""
        t = self.table(name)
        files = t.write_heap(rows)
        self.catalog.swap_heap(t.id, files, [])
        return sum(f[4] for f in files)

    def run_cycle(self, name: str, *, lag: int | str = 0, fold_batch: int = 1000) -> dict:
        """One upkeep cycle of a table: tier, fold, adopt loads, expire, maintain if asked for."""
        t = self.table(name)
        done: dict[str, object] = {"pins_swept": self.catalog.sweep_pins()}
        if t.mode.base != "mirrored":
            done["tiered"] = self.tier(name, lag)
        if not t.mode.direct:
            done["folded"] = self.fold(name, fold_batch)
        done["adopted"] = self.adopt_loads(name)
        done["expired"] = self.expire(name) if t.row["lake_retention_lag"] is not None else None
        if self.catalog.claim_maintenance(t.id):
            done["maintained"] = self.maintain(name)
        return done

    def options(self, name: str, credential: Mapping[str, str] | None = None) -> dict:
        """Effective storage settings of a table."""
        t = self.table(name)
        return overlay_settings(self.catalog.profile(t.row["profile"]), credential)

    def use_storage(self, name: str, credential: Mapping[str, str] | None = None) -> dict:
        """Hands a table's storage settings to the file systems that this session opens from now on: keys that begin with ``fs.`` as they are."""
        found = self.options(name, credential)
        conf = self.spark._jsc.hadoopConfiguration()
        for k, v in found.items():
            if k.startswith("fs."):
                conf.set(k, str(v))
        return found

    def seam_sql(self, name: str, pin: str | None = None) -> str:
        """SQL text of a table's state, the current one or that of a live ``pin``, over temp views of its parts, for use in ``spark.sql``."""
        t = self.table(name)
        cut = t.cut() if pin is None else CutLine(*self.catalog.pinned_at(pin, t.id), t.cut().r)
        if t.mode.heap_complete:
            t.heap().createOrReplaceTempView(f"{name}_heap")
            return f"SELECT * FROM {name}_heap"
        from thermocline.operators.seam import cold_rows, hot_rows

        hot_rows(t, cut.t).createOrReplaceTempView(f"{name}_hot")
        cold_rows(t, cut.t, cut.s, overlay=not t.mode.direct).createOrReplaceTempView(f"{name}_cold")
        return f"SELECT * FROM {name}_hot UNION ALL SELECT * FROM {name}_cold"

    def version(self) -> str:
        from thermocline import __version__

        return __version__

    def close(self) -> None:
        self.catalog.close()


__all__ = ["Engine", "overlay_settings"]
