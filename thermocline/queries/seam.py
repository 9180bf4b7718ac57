"""Queries over tiered tables.

The base state is ``events`` as a tiered table: cut-line at 2024-01-16, older rows in the lake,
and corrections for older rows: ``value + 1`` for ids divisible by 10 and a deletion for ids
that leave 1.  It is built once per session and folder of tables; queries that change a table
do so on a clone of their own, which shares the immutable files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thermocline.engine import Engine
from thermocline.functions.keys import band_floor, micros
from thermocline.operators.support import scratch_path, table
from thermocline.sources.lake import LakePartition, Snapshot
from thermocline.sources.store import Store

T_CUT, R_LINE = "2024-01-16", "2024-01-05"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
ORDERS_CUT = "1998-01-01"
_bases: dict[tuple[str, str], Engine] = {}
_clones = [0]


def corrected(rows: DataFrame, column: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Corrections of cold rows: new images and rows to delete."""
    changed = rows.where(F.col(column) % 10 == 0)
    return changed, rows.where(F.col(column) % 10 == 1)


def base(spark: SparkSession, sf_dir: str) -> Engine:
    """Engine with the tables ``events`` and ``orders`` in their base state."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _bases:
        return _bases[key]
    root = Store.plain(scratch_path(spark, "tiered"))
    local = root if "://" not in root else os.path.join(os.environ.get("TMPDIR", "/tmp"), os.path.basename(root))
    os.makedirs(local, exist_ok=True)
    e = Engine(spark, root, f"{local}/catalog.db")
    e.register("events", EVENTS, ["event_id"], "ts", layout=LakePartition("month"), partitions=[("2024-01-01", T_CUT), (T_CUT, "2024-02-01")])
    e.load_heap("events", table(spark, sf_dir, "events"))
    e.tier("events", up_to=e.table("events").key.canonical(T_CUT))
    cold = table(spark, sf_dir, "events").where(F.col("ts") < F.lit(T_CUT).cast("timestamp_ntz"))
    up, gone = corrected(cold)
    with e._publishing(e.table("events")) as p:
        p.add_overlay(up.withColumn("value", F.col("value") + 1), 0)
        p.add_overlay(gone, 1)
    e.register("orders", ORDERS, ["o_custkey", "o_orderkey"], "o_orderdate", layout=LakePartition("year"), partitions=[("1990-01-01", ORDERS_CUT), (ORDERS_CUT, "2005-01-01")])
    e.load_heap("orders", table(spark, sf_dir, "orders").select(*[c.split()[0] for c in ORDERS.split(", ")]))
    e.tier("orders", up_to=e.table("orders").key.canonical(ORDERS_CUT))
    cold = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(ORDERS_CUT).cast("timestamp_ntz"))
    up, gone = corrected(cold, "o_orderkey")
    with e._publishing(e.table("orders")) as p:
        p.add_overlay(up.withColumn("o_totalprice", F.col("o_totalprice") + 1), 0)
        p.add_overlay(gone, 1)
    _bases[key] = e
    return e


def clone(e: Engine, name: str, *, overlay: bool = True, **changes) -> str:
    """A table of its own with the state of ``name``; files are shared, as they never change.  ``changes`` go to the registration."""
    _clones[0] += 1
    made = f"{name}_{_clones[0]}"
    t, cat = e.table(name), e.catalog
    options = {"mode": "tiered", "layout": LakePartition(t.row["layout"], t.row["layout_width"])} | changes
    e.register(made, t.schema, t.keys, t.tier, tier_type=t.row["tier_type"], **options)
    n, cut = e.table(made), t.cut()
    with cat.transaction():
        for p in cat.partitions(t.id):
            cat.upsert_partition(n.id, p["partition_id"], p["lo"], p["hi"], p["state"])
        cat.swap_heap(n.id, [(f["path"], f["partition_id"], f["lo"], f["hi"], f["records"]) for f in cat.heap_files(t.id)], [])
        files = t.lake.snapshot(cut.s)
        s = n.lake.commit(Snapshot(0), add=files.files, stamps={"op-kind": "clone"}).number if files.files else 0
        cat.advance(n.id, cut.t, s)
        if overlay:
            cat.set_overlay(n.id, t.overlay_segments(), t.overlay_keys())
            cat.next_versions(n.id, cat.overlay(t.id)["version"])
    return made


def _view(spark: SparkSession, sf_dir: str, name: str = "events", where: str | None = None) -> DataFrame:
    return base(spark, sf_dir).read(name, where, pin_ttl=0).df


def _state(e: Engine, name: str) -> DataFrame:
    return e.read(name, pin_ttl=0).df


CUT_SQL = f"TIMESTAMP '{T_CUT}'"
SEAM = f"""seam AS (SELECT event_id, ts, user_id, event_type, CASE WHEN ts < {CUT_SQL} AND event_id % 10 = 0 THEN value + 1 ELSE value END AS value, props
  FROM events WHERE NOT (ts < {CUT_SQL} AND event_id % 10 = 1))"""
ORDER_SEAM = f"""oseam AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '{ORDERS_CUT}' AND o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE NOT (o_orderdate < TIMESTAMP '{ORDERS_CUT}' AND o_orderkey % 10 = 1))"""
WITH = f"WITH {SEAM} "
QUERIES: dict = {}
SQL: dict = {}


def exact_sum(column: str):
    """Sum of a double as a decimal: the same whatever the order of addition."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def query(sql: str | None):
    """Registers the function under its name with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# reads ------------------------------------------------------------------------


@query(WITH + "SELECT * FROM seam")
def seam_scan(spark, sf_dir):
    return _view(spark, sf_dir)


@query(WITH + "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM seam GROUP BY event_type")
def seam_agg(spark, sf_dir):
    return _view(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total"))


@query(f"SELECT * FROM events WHERE ts >= {CUT_SQL}")
def seam_hot_half(spark, sf_dir):
    from thermocline.operators.seam import hot_rows

    t = base(spark, sf_dir).table("events")
    return hot_rows(t, t.cut().t)


@query(WITH + f"SELECT * FROM seam WHERE ts < {CUT_SQL}")
def seam_cold_half(spark, sf_dir):
    from thermocline.operators.seam import cold_rows

    t = base(spark, sf_dir).table("events")
    return cold_rows(t, t.cut().t, t.cut().s)


@query(WITH + f"SELECT * FROM seam WHERE ts < {CUT_SQL} AND event_id % 10 = 0")
def seam_delta_only(spark, sf_dir):
    """A table whose lake was never written answers from its corrections."""
    e = base(spark, sf_dir)
    _clones[0] += 1
    name, t = f"events_d{_clones[0]}", e.table("events")
    e.register(name, t.schema, t.keys, t.tier, cut=T_CUT)
    e.catalog.append_overlay(e.table(name).id, t.overlay_segments()[0], t.overlay_keys())
    return _state(e, name)


@query(WITH + "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM seam JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def seam_join_customer(spark, sf_dir):
    return _view(spark, sf_dir).join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total"))


@query(f"WITH {SEAM}, {ORDER_SEAM} SELECT o_orderstatus, event_type, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS price FROM seam JOIN oseam ON event_id = o_orderkey GROUP BY o_orderstatus, event_type")
def cross_table_join(spark, sf_dir):
    a, b = _view(spark, sf_dir), _view(spark, sf_dir, "orders")
    return a.join(b, F.col("event_id") == F.col("o_orderkey")).groupBy("o_orderstatus", "event_type").agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("price"))


def _sql(spark, sf_dir, text):
    return base(spark, sf_dir).sql(text, pin_ttl=0).df


@query(WITH + "SELECT count(*) AS n FROM seam a WHERE EXISTS (SELECT 1 FROM seam b WHERE b.event_id = a.event_id + 1 AND b.event_type = a.event_type)")
def seam_exists(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT count(*) AS n FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE b.event_id = a.event_id + 1 AND b.event_type = a.event_type)")


@query(WITH + ", per AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM seam GROUP BY user_id) SELECT count(*) AS users, max(v) AS top FROM per WHERE v > (SELECT avg(v) FROM per)")
def seam_cte(spark, sf_dir):
    return _sql(spark, sf_dir, "WITH per AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM events GROUP BY user_id) SELECT count(*) AS users, max(v) AS top FROM per WHERE v > (SELECT avg(v) FROM per)")


@query(WITH + "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM seam")
def seam_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _view(spark, sf_dir).select("event_id", "user_id", F.row_number().over(w).cast("long").alias("rn"), F.sum(F.col("value").cast("decimal(18,4)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"))


@query(WITH + "SELECT event_type, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n FROM seam GROUP BY GROUPING SETS ((event_type), (date_trunc('month', ts)), ())")
def seam_grouping_sets(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT event_type, month, count(*) AS n FROM (SELECT event_type, cast(date_trunc('month', ts) AS timestamp_ntz) AS month FROM events) GROUP BY GROUPING SETS ((event_type), (month), ())")


@query(WITH + f"SELECT user_id FROM seam WHERE ts < {CUT_SQL} INTERSECT SELECT user_id FROM seam WHERE ts >= {CUT_SQL}")
def seam_intersect(spark, sf_dir):
    v = _view(spark, sf_dir)
    cut = F.lit(T_CUT).cast("timestamp_ntz")
    return v.where(F.col("ts") < cut).select("user_id").intersect(v.where(F.col("ts") >= cut).select("user_id"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def classify_hot(spark, sf_dir):
    """Proven hot: the lake isn't read."""
    return _view(spark, sf_dir, where="ts >= TIMESTAMP_NTZ '2024-01-20'").select("event_id", "ts")


@query(WITH + "SELECT event_id, ts, value FROM seam WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-10'")
def classify_cold(spark, sf_dir):
    """Proven cold: the heap isn't read."""
    return _view(spark, sf_dir, where="ts >= TIMESTAMP_NTZ '2024-01-02' AND ts < TIMESTAMP_NTZ '2024-01-10'").select("event_id", "ts", "value")


@query(WITH + "SELECT event_id, ts, value FROM seam WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def classify_mixed(spark, sf_dir):
    return _view(spark, sf_dir, where="ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'").select("event_id", "ts", "value")


@query(f"SELECT CASE WHEN ts >= {CUT_SQL} THEN 'hot' ELSE 'cold' END AS side, count(*) AS n FROM events GROUP BY 1")
def route_counts(spark, sf_dir):
    """Rows of each side as an insert of all of them counts them."""
    e = base(spark, sf_dir)
    done = e.insert(clone(e, "events"), table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + 20000000))
    return spark.createDataFrame([("hot", done.hot_rows), ("cold", done.cold_rows)], "side string, n long")


@query(f"WITH {ORDER_SEAM} SELECT * FROM oseam")
def composite_key_seam(spark, sf_dir):
    return _view(spark, sf_dir, "orders")


# writes -----------------------------------------------------------------------


@query(WITH + "SELECT event_id, ts, CASE WHEN user_id % 7 = 3 THEN value * 2 ELSE value END AS value FROM seam")
def update_mixed(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.update(name, {"value": "value * 2"}, "user_id % 7 = 3")
    return _state(e, name).select("event_id", "ts", "value")


@query(WITH + "SELECT event_id, value FROM seam WHERE NOT (user_id % 5 = 2 AND ts >= TIMESTAMP '2024-01-10')")
def delete_mixed(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.delete(name, "user_id % 5 = 2 AND ts >= TIMESTAMP_NTZ '2024-01-10'")
    return _state(e, name).select("event_id", "value")


@query(WITH + "SELECT event_id, value + 100 AS value FROM seam WHERE user_id % 11 = 4")
def returning_mixed(spark, sf_dir):
    e = base(spark, sf_dir)
    return e.update(clone(e, "events"), {"value": "value + 100"}, "user_id % 11 = 4", returning=True).returning.select("event_id", "value")


@query(WITH + f"SELECT event_id, CASE WHEN event_id % 100 = 2 AND ts < {CUT_SQL} THEN ts - INTERVAL 30 DAY ELSE ts END AS ts FROM seam")
def tier_move_within_cold(spark, sf_dir):
    """Corrections that move a row to another band; the fold finds the old image where the lake holds it."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.update(name, {"ts": "ts - INTERVAL 30 DAY"}, f"event_id % 100 = 2 AND ts < TIMESTAMP_NTZ '{T_CUT}'")
    e.fold(name, 1_000_000)
    return _state(e, name).select("event_id", "ts")


@query(WITH + f"SELECT event_id, CASE WHEN event_id % 100 = 2 AND ts < {CUT_SQL} THEN ts + INTERVAL 15 DAY ELSE ts END AS ts FROM seam")
def tier_move_to_hot(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.update(name, {"ts": "ts + INTERVAL 15 DAY"}, f"event_id % 100 = 2 AND ts < TIMESTAMP_NTZ '{T_CUT}'")
    return _state(e, name).select("event_id", "ts")


@query(WITH + f"SELECT event_id, CASE WHEN event_id % 100 = 3 AND ts >= {CUT_SQL} THEN ts - INTERVAL 15 DAY ELSE ts END AS ts FROM seam")
def tier_move_to_cold(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.update(name, {"ts": "ts - INTERVAL 15 DAY"}, f"event_id % 100 = 3 AND ts >= TIMESTAMP_NTZ '{T_CUT}'")
    return _state(e, name).select("event_id", "ts")


@query(f"""WITH {SEAM}, batch AS (SELECT event_id, ts, user_id, event_type, value + 7 AS value, props FROM events WHERE event_id % 50 = 0 AND ts < {CUT_SQL})
SELECT * FROM seam WHERE event_id NOT IN (SELECT event_id FROM batch) UNION ALL SELECT * FROM batch""")
def upsert_newest_wins(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    batch = table(spark, sf_dir, "events").where(f"event_id % 50 = 0 AND ts < TIMESTAMP_NTZ '{T_CUT}'")
    e.upsert(name, batch.withColumn("value", F.col("value") + 5))
    e.upsert(name, batch.withColumn("value", F.col("value") + 7))
    return _state(e, name)


@query(WITH + "SELECT event_id, ts, user_id, event_type, value, props FROM seam WHERE event_id % 20 <> 5")
def delete_by_key(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.delete_keys(name, table(spark, sf_dir, "events", "event_id", "ts").where("event_id % 20 = 5"))
    return _state(e, name)


@query(f"""WITH {SEAM}, batch AS (SELECT event_id + 10000000 AS event_id, ts, user_id, event_type, value, props FROM events WHERE event_id % 9 = 0)
SELECT * FROM seam UNION ALL SELECT * FROM batch""")
def insert_split(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.insert(name, table(spark, sf_dir, "events").where("event_id % 9 = 0").withColumn("event_id", F.col("event_id") + 10000000))
    return _state(e, name)


@query("SELECT event_id, ts, CASE WHEN event_id % 6 = 0 THEN value - 1 ELSE value END AS value FROM events WHERE event_id % 15 <> 7")
def keep_heap_mirror(spark, sf_dir):
    """Changes of a table that keeps its heap, read back from the cold half and the hot rows: both stores must agree."""
    e = base(spark, sf_dir)
    name = clone(e, "events", overlay=False, keep_heap=True)
    t = e.table(name)
    e.catalog.swap_heap(t.id, t.write_heap(t.lake.scan(t.lake.snapshot(t.cut().s))), [])
    e.update(name, {"value": "value - 1"}, "event_id % 6 = 0")
    e.delete(name, "event_id % 15 = 7")
    from thermocline.operators.seam import cold_rows, hot_rows

    cut = t.cut()
    return hot_rows(t, cut.t).unionByName(cold_rows(t, cut.t, cut.s)).select("event_id", "ts", "value")


@query(f"""WITH batch AS (SELECT event_id, ts, user_id, event_type, value + 3 AS value, props FROM events WHERE event_id % 40 = 8 AND ts < {CUT_SQL})
SELECT event_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM batch) AND NOT (event_id % 40 = 9 AND ts < {CUT_SQL}) UNION ALL SELECT event_id, value FROM batch""")
def direct_writes(spark, sf_dir):
    """A direct table changes its live lake at once, without an overlay."""
    e = base(spark, sf_dir)
    name = clone(e, "events", overlay=False, mode="direct")
    cold = table(spark, sf_dir, "events").where(f"ts < TIMESTAMP_NTZ '{T_CUT}'")
    e.upsert(name, cold.where("event_id % 40 = 8").withColumn("value", F.col("value") + 3))
    e.delete_keys(name, cold.where("event_id % 40 = 9").select("event_id", "ts"))
    return _state(e, name).select("event_id", "value")


# movement ---------------------------------------------------------------------


@query(WITH + "SELECT * FROM seam")
def fold_then_read(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.fold(name, 10_000_000)
    return _state(e, name)


@query(WITH + "SELECT * FROM seam")
def fold_merge_on_read(spark, sf_dir):
    """The fold as delete files, applied by an anti-join at read."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.fold(name, 10_000_000, merge_on_read=True)
    return _state(e, name)


@query(WITH + "SELECT * FROM seam")
def delete_debt_compaction(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.fold(name, 10_000_000, merge_on_read=True)
    e.compact_deletes(name)
    return _state(e, name)


@query("SELECT * FROM events")
def tiering_keeps_all(spark, sf_dir):
    """The cut-line moves over everything; no row is lost or doubled."""
    e = base(spark, sf_dir)
    name = clone(e, "events", overlay=False)
    e.tier(name, up_to=e.table(name).key.canonical("2024-02-01"))
    return _state(e, name)


@query(f"SELECT * FROM events WHERE ts >= TIMESTAMP '{R_LINE}'")
def retention_expire(spark, sf_dir):
    e = base(spark, sf_dir)
    _clones[0] += 1
    name = f"events_r{_clones[0]}"
    day = 86_400_000_000
    e.register(name, EVENTS, ["event_id"], "ts", layout=LakePartition("day"), partitions=[("2024-01-01", T_CUT), (T_CUT, "2024-02-01")], lake_retention="11d")
    e.load_heap(name, table(spark, sf_dir, "events"))
    e.tier(name, up_to=e.table(name).key.canonical(T_CUT))
    e.expire(name, width=day)
    return _state(e, name)


@query(f"""WITH {SEAM}, batch AS (SELECT event_id, ts, user_id, event_type, value * 10 AS value, props FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' AND event_id % 10 > 1)
SELECT * FROM seam WHERE event_id NOT IN (SELECT event_id FROM batch) UNION ALL SELECT * FROM batch""")
def ingest_overlap(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    batch = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-03' AND ts < TIMESTAMP_NTZ '2024-01-04' AND event_id % 10 > 1")
    e.ingest(name, batch.withColumn("value", F.col("value") * 10))
    return _state(e, name)


@query(WITH + "SELECT * FROM seam UNION ALL SELECT event_id + 50000000, ts - INTERVAL 365 DAY, user_id, event_type, value, props FROM events WHERE event_id % 3 = 0")
def ingest_append(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    batch = table(spark, sf_dir, "events").where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 50000000).withColumn("ts", F.expr("ts - INTERVAL 365 DAY"))
    e.ingest(name, batch.where(f"ts < TIMESTAMP_NTZ '{T_CUT}'"))
    return _state(e, name)


_LOAD = f"""WITH {SEAM}, batch AS (SELECT event_id, ts, user_id, event_type, value + 0.5 AS value, props FROM events WHERE event_id % 25 = 4)
SELECT * FROM seam WHERE event_id NOT IN (SELECT event_id FROM batch) UNION ALL SELECT * FROM batch"""


@query(_LOAD)
def stream_load_split(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.stream_load(name, "one", table(spark, sf_dir, "events").where("event_id % 25 = 4").withColumn("value", F.col("value") + 0.5), spool_rows=10_000_000)
    return _state(e, name)


@query(_LOAD)
def stream_load_replay(spark, sf_dir):
    """The same label again, with other rows, changes nothing."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    rows = table(spark, sf_dir, "events").where("event_id % 25 = 4")
    e.stream_load(name, "one", rows.withColumn("value", F.col("value") + 0.5), spool_rows=10_000_000)
    e.stream_load(name, "one", rows.withColumn("value", F.col("value") + 99))
    return _state(e, name)


@query(_LOAD)
def staged_load_adopted(spark, sf_dir):
    """Cold rows beyond the threshold are staged as lake files and adopted in one commit."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.stream_load(name, "one", table(spark, sf_dir, "events").where("event_id % 25 = 4").withColumn("value", F.col("value") + 0.5), spool_rows=10)
    e.adopt_loads(name)
    return _state(e, name)


_WHOLE = "SELECT event_id, ts, user_id, event_type, value + 0.5 AS value, props FROM events"


@query(_WHOLE)
def stream_load_whole(spark, sf_dir):
    """All rows of the table in one load, hot and cold."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.stream_load(name, "one", table(spark, sf_dir, "events").withColumn("value", F.col("value") + 0.5), spool_rows=1_000_000_000)
    return _state(e, name)


@query(f"""SELECT event_id, ts, user_id, event_type, CASE WHEN ts < {CUT_SQL} AND event_id % 10 = 0 THEN value + 1 ELSE value + 0.5 END AS value, props
FROM events WHERE NOT (ts < {CUT_SQL} AND event_id % 10 = 1)""")
def staged_load_whole(spark, sf_dir):
    """All rows in one load whose cold rows are staged as lake files and adopted; adoption leaves the overlay alone, so pending corrections still win."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.stream_load(name, "one", table(spark, sf_dir, "events").withColumn("value", F.col("value") + 0.5), spool_rows=10)
    e.adopt_loads(name)
    return _state(e, name)


@query(WITH + "SELECT * FROM seam UNION ALL SELECT event_id + 50000000, ts - INTERVAL 365 DAY, user_id, event_type, value, props FROM events")
def ingest_whole(spark, sf_dir):
    """All rows, a year earlier and under keys of their own, added to the lake."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.ingest(name, table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + 50000000).withColumn("ts", F.expr("ts - INTERVAL 365 DAY")))
    return _state(e, name)


@query(WITH + "SELECT * FROM seam UNION ALL SELECT event_id + 10000000, ts, user_id, event_type, value, props FROM events")
def insert_whole(spark, sf_dir):
    """All rows under keys of their own, routed to both tiers."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.insert(name, table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + 10000000))
    return _state(e, name)


# keys, bands, streams ------------------------------------------------------------


@query("SELECT CAST(floor(epoch_us(ts) / 86400000000.0) * 86400000000 AS BIGINT) AS band, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1")
def band_truncate(spark, sf_dir):
    key = micros(F.col("ts"), "timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(band_floor(key, 86_400_000_000).alias("band")).agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 6 <> 5")
def mirror_collapse(spark, sf_dir):
    """Inserts, repeated updates and deletes of orders as a change stream, collapsed to the newest image per key and merged into the lake; the first batch comes twice."""
    e = base(spark, sf_dir)
    _clones[0] += 1
    name = f"orders_m{_clones[0]}"
    e.register(name, ORDERS, ["o_orderkey"], "o_orderdate", mode="mirrored", layout=LakePartition("year"))
    rows = table(spark, sf_dir, "orders").select(*[c.split()[0] for c in ORDERS.split(", ")])
    image = lambda add=None: F.struct(*[(F.col(c) + add if c == "o_totalprice" and add else F.col(c)).alias(c) for c in rows.columns])
    none, unchanged = F.lit(None), F.array().cast("array<string>")
    kind = lambda k, pos, new, old: (F.lit(pos).cast("long").alias("position"), (F.col("o_orderkey") * 4 + pos).alias("seq"), F.lit(k).alias("kind"), new.alias("new"), old.alias("old"), unchanged.alias("unchanged"))
    empty = none.cast(rows.select(image().alias("x")).schema["x"].dataType)
    first = rows.select(*kind("insert", 1, image(), empty))
    second = rows.where("o_orderkey % 4 = 1").select(*kind("update", 2, image(3.0), empty)).unionByName(rows.where("o_orderkey % 4 = 1").select(*kind("update", 3, image(10.0), empty))).unionByName(rows.where("o_orderkey % 6 = 5").select(*kind("delete", 4, empty, image())))
    e.apply_changes(name, first)
    e.apply_changes(name, first)
    e.apply_changes(name, second)
    t = e.table(name)
    return t.lake.scan(t.lake.snapshot(t.cut().s)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def initial_copy(spark, sf_dir):
    """A chunked copy that stops after one chunk and is resumed behind the journaled key."""
    e = base(spark, sf_dir)
    _clones[0] += 1
    name = f"orders_c{_clones[0]}"
    e.register(name, ORDERS, ["o_orderkey"], "o_orderdate", mode="mirrored")
    rows = table(spark, sf_dir, "orders").select(*[c.split()[0] for c in ORDERS.split(", ")])
    e.load_heap(name, rows)
    n = rows.count()
    e.initial_copy(name, 77, chunk_rows=n // 2 + 1, most_chunks=1)
    e.initial_copy(name, 77, chunk_rows=n // 2 + 1)
    t = e.table(name)
    return t.lake.scan(t.lake.snapshot(t.cut().s)).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM events")
def hybrid_read(spark, sf_dir):
    """A mirrored table read from its lake up to a lag behind the newest row, from the heap beyond."""
    e = base(spark, sf_dir)
    _clones[0] += 1
    name = f"events_h{_clones[0]}"
    e.register(name, EVENTS, ["event_id"], "ts", mode="mirrored", layout=LakePartition("month"))
    e.load_heap(name, table(spark, sf_dir, "events"))
    e.initial_copy(name, 5)
    e.note_position(name, 5)
    return e.read(name, hybrid=True, hybrid_lag="3d", pin_ttl=0).df
