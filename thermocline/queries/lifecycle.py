"""Queries over the life of a tiered table: batches, crashes, writers that meet, retention, streams and reports.

Each builds its own table or clone, goes through the engine's operators and returns what they
left, so the SQL twin states the outcome over the plain tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from thermocline.engine import Engine
from thermocline.operators.movement import MovementError
from thermocline.operators.support import scratch_path, table
from thermocline.queries.seam import CUT_SQL, EVENTS, ORDERS, T_CUT, WITH, _clones, _state, base, clone, exact_sum
from thermocline.sources.lake import LakePartition
from thermocline.streaming.mirror import change_schema

QUERIES: dict = {}
SQL: dict = {}
NOON = "2024-01-15 12:00:00"
HUGE = 1_000_000_000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _fresh(e: Engine, spark, sf_dir: str, schema: str, key: str, tier: str, source: str, **options) -> str:
    """A table of its own with all rows of ``source`` in its heap."""
    _clones[0] += 1
    name = f"{source}_l{_clones[0]}"
    e.register(name, schema, [key], tier, **options)
    e.load_heap(name, _rows(spark, sf_dir, source, schema))
    return name


def _rows(spark, sf_dir: str, source: str, schema: str):
    return table(spark, sf_dir, source).select(*[c.split()[0] for c in schema.split(", ")])


def _lake(e: Engine, name: str):
    t = e.table(name)
    return t.lake.scan(t.lake.snapshot(t.cut().s))


def must(found: bool, what: str) -> None:
    if not found:
        raise RuntimeError(what)


# folds, casts, hot keys ---------------------------------------------------------


@query("SELECT step, n, total FROM range(5) r(step), (SELECT count(*) AS n, CAST(sum(CAST(CASE WHEN user_id % 7 = 3 AND ts < " + CUT_SQL + " THEN value * 2 ELSE value END AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events)")
def fold_in_batches(spark, sf_dir):
    """One statement's corrections folded in batches; the state after every batch is the same."""
    e = base(spark, sf_dir)
    name = clone(e, "events", overlay=False)
    e.update(name, {"value": "value * 2"}, f"user_id % 7 = 3 AND ts < TIMESTAMP_NTZ '{T_CUT}'")
    batch, out = -(-e.table(name).overlay_keys() // 4), None
    for step in range(5):
        seen = _state(e, name).agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total")).select(F.lit(step).cast("long").alias("step"), "n", "total")
        out = seen if out is None else out.unionByName(seen)
        must((e.fold(name, batch) is None) == (step == 4), "four batches empty the overlay")
    return out


def _noon(spark, sf_dir) -> tuple[Engine, str]:
    """Events with the cut-line at noon of a day."""
    e = base(spark, sf_dir)
    name = _fresh(e, spark, sf_dir, EVENTS, "event_id", "ts", "events", partitions=[("2024-01-01", NOON), (NOON, "2024-02-01")])
    e.tier(name, up_to=e.table(name).key.canonical(NOON))
    return e, name


@query("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15'")
def classify_cast(spark, sf_dir):
    """A cast that narrows proves nothing: rows of the day above the cut-line belong to the result."""
    e, name = _noon(spark, sf_dir)
    return e.read(name, "CAST(ts AS DATE) <= DATE '2024-01-15'", pin_ttl=0).df.select("event_id", "ts")


@query("SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN value + 1 ELSE value END AS value FROM events")
def update_cast(spark, sf_dir):
    e, name = _noon(spark, sf_dir)
    e.update(name, {"value": "value + 1"}, "CAST(ts AS DATE) = DATE '2024-01-15'")
    return _state(e, name).select("event_id", "value")


@query(WITH + f"SELECT event_id, CASE WHEN ts >= {CUT_SQL} THEN value + 2 ELSE value END AS value FROM seam")
def upsert_hot_twice(spark, sf_dir):
    """Upserts of all hot rows, twice: keys that are in the heap are replaced; an insert of them is refused."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    hot = table(spark, sf_dir, "events").where(f"ts >= TIMESTAMP_NTZ '{T_CUT}'")
    for add in (1, 2):
        e.upsert(name, hot.withColumn("value", F.col("value") + add))
    try:
        e.insert(name, hot)
    except ValueError:
        return _state(e, name).select("event_id", "value")
    raise RuntimeError("an insert of keys that exist was taken")


@query(WITH + """, changed AS (SELECT event_id, user_id, CASE WHEN user_id % 7 = 3 THEN value * 2 ELSE value END AS value FROM seam WHERE NOT coalesce(user_id % 5 = 2, false))
SELECT event_id, value FROM changed UNION ALL SELECT event_id + 30000000, value FROM changed WHERE user_id % 3 = 0""")
def statements_as_text(spark, sf_dir):
    """UPDATE, DELETE and INSERT ... SELECT as SQL text over both halves."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.execute(f"UPDATE {name} SET value = value * 2 WHERE user_id % 7 = 3")
    e.execute(f"DELETE FROM {name} WHERE user_id % 5 = 2")
    e.execute(f"INSERT INTO {name} SELECT event_id + 30000000, ts, user_id, event_type, value, props FROM {name} WHERE user_id % 3 = 0")
    return _state(e, name).select("event_id", "value")


# writers that meet -----------------------------------------------------------------

_YEAR_EARLIER = "SELECT event_id + 50000000 AS event_id, ts - INTERVAL 365 DAY AS ts, user_id, event_type, value, props FROM events"


def _year_earlier(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + 50000000).withColumn("ts", F.expr("ts - INTERVAL 365 DAY"))


@query(WITH + "SELECT * FROM seam UNION ALL " + _YEAR_EARLIER)
def ingest_during_fold(spark, sf_dir):
    """An ingest publishes while a fold is under way: the fold is done again on top of it."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.meanwhile(lambda: e.ingest(name, _year_earlier(spark, sf_dir)))
    e.fold(name, HUGE)
    must(not e.table(name).overlay_keys(), "all corrections are folded")
    return _state(e, name)


@query(WITH + "SELECT * FROM seam UNION ALL " + _YEAR_EARLIER)
def fold_during_ingest(spark, sf_dir):
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.meanwhile(lambda: e.fold(name, HUGE))
    e.ingest(name, _year_earlier(spark, sf_dir))
    must(not e.table(name).overlay_keys(), "all corrections are folded")
    return _state(e, name)


# loads -------------------------------------------------------------------------------


@query(f"SELECT event_id, CASE WHEN ts < {CUT_SQL} THEN CASE WHEN event_id % 2 = 0 THEN value + 2 ELSE value + 1 END ELSE value END AS value FROM events")
def adopt_two_loads(spark, sf_dir):
    """Two staged loads of the same rows, adopted in one commit after a crash; of a key in both the newer load stays."""
    e = base(spark, sf_dir)
    name = clone(e, "events", overlay=False)
    cold = table(spark, sf_dir, "events").where(f"ts < TIMESTAMP_NTZ '{T_CUT}'")
    e.stream_load(name, "one", cold.withColumn("value", F.col("value") + 1), spool_rows=1)
    e.stream_load(name, "two", cold.where("event_id % 2 = 0").withColumn("value", F.col("value") + 2), spool_rows=1)
    e.crash_at("after-adopt-commit")
    try:
        e.adopt_loads(name)
    except RuntimeError:
        must(len(e.catalog.loads(e.table(name).id, "staged")) == 2, "no label is committed alone")
    e.adopt_loads(name)
    must(len(e.catalog.loads(e.table(name).id, "committed")) == 2, "both labels are committed")
    return _state(e, name).select("event_id", "value")


@query(WITH + "SELECT * FROM seam UNION ALL " + _YEAR_EARLIER)
def ingest_json_lines(spark, sf_dir):
    """All rows, a year earlier, written as JSON lines and adopted from them."""
    e = base(spark, sf_dir)
    name, path = clone(e, "events"), scratch_path(spark, "json-lines")
    _year_earlier(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(path)
    e.ingest_jsonl(name, path)
    return _state(e, name)


# reads -------------------------------------------------------------------------------


@query(WITH + "SELECT * FROM seam")
def read_under_pin(spark, sf_dir):
    """A read that stays open while rows change, a fold is refused and the cut-line moves over everything."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    held = e.read(name)
    e.update(name, {"value": "0"}, "user_id % 3 = 1")
    must(e.fold(name, HUGE) is None, "a pinned table isn't folded")
    e.tier(name, up_to=e.table(name).key.canonical("2024-02-01"))
    return held.df


@query(WITH + "SELECT event_type, count(*) AS n FROM seam GROUP BY event_type")
def strict_read(spark, sf_dir):
    """A strict read of a table whose lake has a snapshot; one without is refused."""
    e = base(spark, sf_dir)
    _clones[0] += 1
    e.register(f"none_{_clones[0]}", EVENTS, ["event_id"], "ts")
    try:
        e.read(f"none_{_clones[0]}", strict=True)
    except RuntimeError:
        return e.read("events", strict=True, pin_ttl=0).df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    raise RuntimeError("a lake that was never committed was read strictly")


@query(f"SELECT event_id, ts, value FROM events WHERE ts < {CUT_SQL}")
def cold_by_token(spark, sf_dir):
    """The lake rows that a token names, after later folds."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    token = e.cold_token(name)
    e.fold(name, HUGE)
    return e.read_token(token).select("event_id", "ts", "value")


@query(WITH + "SELECT event_id, ts, value FROM seam")
def seam_sql_at_pin(spark, sf_dir):
    """The rewritten text of a table at a pin."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    pin, _, _ = e.catalog.pin(e.table(name).id, 900)
    text = e.seam_sql(name, pin)
    e.tier(name, up_to=e.table(name).key.canonical("2024-02-01"))
    return spark.sql(f"SELECT event_id, ts, value FROM ({text})")


# movement ------------------------------------------------------------------------------


@query("SELECT * FROM events")
def tier_crash_resume(spark, sf_dir):
    """Tiering that stops before and after its commit and is taken up again: nothing is lost or doubled."""
    e = base(spark, sf_dir)
    name = clone(e, "events", overlay=False)
    for where in ("before-commit", "after-commit"):
        e.crash_at(where)
        try:
            e.tier(name, up_to=e.table(name).key.canonical("2024-02-01"))
        except RuntimeError:
            continue
    e.tier(name, up_to=e.table(name).key.canonical("2024-02-01"))
    must(not e.catalog.open_ops(e.table(name).id), "no operation is left open")
    return _state(e, name)


@query(f"SELECT event_id, ts FROM events WHERE ts >= {CUT_SQL}")
def heap_after_reclaim(spark, sf_dir):
    """What is left in the heap once the tiered partitions are dropped."""
    e = base(spark, sf_dir)
    name = _fresh(e, spark, sf_dir, EVENTS, "event_id", "ts", "events", partitions=[("2024-01-01", T_CUT), (T_CUT, "2024-02-01")])
    e.tier(name, up_to=e.table(name).key.canonical(T_CUT))
    must([p["state"] for p in e.catalog.partitions(e.table(name).id)] == ["dropped", "hot"], "the tiered partition is dropped")
    return e.table(name).heap().select("event_id", "ts")


@query("SELECT * FROM events")
def holes_stop_tiering(spark, sf_dir):
    """Partitions with a hole: the run moves what lies before it and the next one is refused; reads stay whole."""
    e = base(spark, sf_dir)
    name = _fresh(e, spark, sf_dir, EVENTS, "event_id", "ts", "events", partitions=[("2024-01-01", "2024-01-08"), ("2024-01-09", "2024-02-01")])
    top = e.table(name).key.canonical("2024-02-01")
    e.tier(name, up_to=top)
    try:
        e.tier(name, up_to=top)
    except MovementError:
        return _state(e, name)
    raise RuntimeError("a hole was passed over")


@query(f"SELECT 'all' AS part, count(*) AS n FROM events UNION ALL SELECT 'heap', count(*) FROM events WHERE ts >= {CUT_SQL}")
def mirrored_heap_retention(spark, sf_dir):
    """The heap of a mirrored table lets go of old partitions once the mirror has passed them; reads stay whole."""
    e = base(spark, sf_dir)
    name = _fresh(e, spark, sf_dir, EVENTS, "event_id", "ts", "events", mode="mirrored", heap_retention="1d", partitions=[("2024-01-01", T_CUT), (T_CUT, "2024-06-01")])
    e.initial_copy(name, 5)
    e.expire_mirrored_heap(name, newest=9)
    must(e.table(name).heap().count() == e.read(name, pin_ttl=0).df.count(), "the mirror has to pass the position first")
    e.catalog.advance_frontier(e.table(name).id, 9)
    e.expire_mirrored_heap(name, newest=12)
    counted = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return counted(_state(e, name), "all").unionByName(counted(e.table(name).heap(), "heap"))


def _many_files(spark, sf_dir) -> tuple[Engine, str]:
    """Events tiered in five steps, so that one band has a file of each."""
    e = base(spark, sf_dir)
    days = ["2024-01-01", "2024-01-04", "2024-01-07", "2024-01-10", "2024-01-13", T_CUT, "2024-02-01"]
    name = _fresh(e, spark, sf_dir, EVENTS, "event_id", "ts", "events", layout=LakePartition("month"), partitions=list(zip(days, days[1:])))
    for day in days[1:-1]:
        e.tier(name, up_to=e.table(name).key.canonical(day))
    return e, name


@query("SELECT * FROM events")
def small_files_rewritten(spark, sf_dir):
    """Small files of one band packed into fewer; every row is kept once."""
    e, name = _many_files(spark, sf_dir)
    t = e.table(name)
    before = len(t.lake.snapshot(t.cut().s).files)
    must(e.rewrite_small_files(name) == 0, "too few small files for the default")
    e.policy(name, set_={"rewrite_min_input_files": 2})
    must(e.rewrite_small_files(name) >= 5 and len(t.lake.snapshot(t.cut().s).files) < before, "files were packed")
    return _state(e, name)


@query("SELECT * FROM events")
def snapshots_expired(spark, sf_dir):
    """Old snapshots and orphans go; what is current stays readable."""
    e, name = _many_files(spark, sf_dir)
    t = e.table(name)
    e.policy(name, set_={"snapshot_min_keep": 1, "snapshot_retention_hours": 0, "orphan_grace_hours": 0, "rewrite_min_input_files": 2})
    e.rewrite_small_files(name)
    t.lake.write(table(spark, sf_dir, "events"))
    must(len(e.expire_snapshots(name)) >= 4 and e.sweep_orphans(name), "snapshots and orphans were removed")
    return _state(e, name)


# streams -----------------------------------------------------------------------------------


def _changes(e: Engine, name: str, rows, position: int, kind: str, image=None, seq="o_orderkey"):
    """Change rows of ``rows``: all of one position."""
    schema = change_schema(e.table(name).schema)
    row = F.struct(*[(image[c] if image and c in image else F.col(c)).alias(c) for c in e.table(name).schema.names])
    none = F.lit(None)
    out = rows.select(F.lit(position).cast("long").alias("position"), F.col(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), (none if kind == "delete" else row).alias("new"), (row if kind == "delete" else none).alias("old"), F.array().alias("unchanged"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _commit_row(e: Engine, name: str, position: int):
    return e.spark.createDataFrame([(position, 2**62, "commit", None, None, [])], change_schema(e.table(name).schema))


def _mirrored(e: Engine) -> str:
    _clones[0] += 1
    name = f"orders_t{_clones[0]}"
    e.register(name, ORDERS, ["o_orderkey"], "o_orderdate", mode="mirrored", layout=LakePartition("year"))
    return name


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey % 5 <> 2")
def mirror_split_transaction(spark, sf_dir):
    """Transactions that are cut by batches: a part shows nothing until its commit comes, and nothing of the rest is lost."""
    e = base(spark, sf_dir)
    name, rows = _mirrored(e), _rows(spark, sf_dir, "orders", ORDERS)
    early, late = rows.where("o_orderdate < TIMESTAMP_NTZ '1995-01-01'"), rows.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' OR o_orderdate IS NULL")
    e.apply_changes(name, _commit_row(e, name, 1))
    e.apply_changes(name, _changes(e, name, early, 5, "insert").unionByName(_commit_row(e, name, 4)))
    must(_lake(e, name).isEmpty() and e.catalog.frontier(e.table(name).id) == 4, "half a transaction isn't shown")
    e.apply_changes(name, _changes(e, name, late, 5, "insert").unionByName(_commit_row(e, name, 5)))
    more = {"o_totalprice": F.col("o_totalprice") + 1}
    second = _changes(e, name, rows.where("o_custkey % 3 = 0"), 6, "update", more).unionByName(_commit_row(e, name, 6))
    third = _changes(e, name, rows.where("o_custkey % 5 = 2"), 7, "delete")
    e.apply_changes(name, second.unionByName(third))
    e.apply_changes(name, _commit_row(e, name, 7))
    return _lake(e, name).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, frontier FROM orders, (SELECT CAST('99' AS VARCHAR) AS frontier)")
def mirror_crash_resume(spark, sf_dir):
    """A batch whose commit was made and not published, delivered again, and a heartbeat after it."""
    e = base(spark, sf_dir)
    name = _mirrored(e)
    batch = _changes(e, name, _rows(spark, sf_dir, "orders", ORDERS), 5, "insert")
    e.crash_at("after-mirror-commit")
    try:
        e.apply_changes(name, batch)
    except RuntimeError:
        must(e.catalog.frontier(e.table(name).id) is None, "nothing is published")
    e.apply_changes(name, batch)
    e.apply_changes(name, batch.limit(0), up_to=99)
    frontier = e.status().where(F.col("name") == name).select(F.col("replicated_lsn").alias("frontier"))
    return _lake(e, name).select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(frontier))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 2 = 0 THEN 'late' END AS note FROM orders")
def mirror_widens(spark, sf_dir):
    """A stream that begins to carry one more column: rows from before read it as null."""
    e = base(spark, sf_dir)
    name, rows = _mirrored(e), _rows(spark, sf_dir, "orders", ORDERS)
    e.apply_changes(name, _changes(e, name, rows, 1, "insert"))
    later = _changes(e, name, rows.where("o_custkey % 2 = 0"), 2, "update")
    wide = later.withColumn("new", F.col("new").withField("note", F.lit("late"))).withColumn("old", F.lit(None).cast(later.withColumn("new", F.col("new").withField("note", F.lit("late"))).schema["new"].dataType))
    e.apply_changes(name, wide)
    return _lake(e, name).select("o_orderkey", "o_totalprice", "note")


# reports -----------------------------------------------------------------------------------


@query("SELECT CAST(epoch_us(max(ts)) AS BIGINT) AS high_water FROM events")
def heap_high_water(spark, sf_dir):
    """The highest tier key of the heap, from the ranges of its files."""
    e = base(spark, sf_dir)
    return spark.createDataFrame([(e.high_water(e.table("events")),)], "high_water long")


@query(f"SELECT CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS op, count(*) AS n FROM events WHERE ts < {CUT_SQL} AND event_id % 10 < 2 GROUP BY 1")
def overlay_backlog(spark, sf_dir):
    """Corrections and tombstones that wait for a fold."""
    return base(spark, sf_dir).table("events").overlay().groupBy(F.col("op").cast("int").alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'hot' AS side, count(*) FILTER (WHERE ts >= {CUT_SQL}) AS n FROM events UNION ALL SELECT 'cold', count(*) FILTER (WHERE ts < {CUT_SQL}) FROM events")
def affected_rows(spark, sf_dir):
    """What an insert of all rows under new keys reports for each side."""
    e = base(spark, sf_dir)
    r = e.insert(clone(e, "events"), table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + 10000000))
    return spark.createDataFrame([("hot", r.hot_rows), ("cold", r.cold_rows)], "side string, n long")


@query("SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') AS year, CAST(CAST(floor(epoch_us(ts) / 1800000000.0) * 1800000000 AS BIGINT) AS VARCHAR) AS band, count(*) AS n FROM events GROUP BY ALL")
def band_names(spark, sf_dir):
    """Names of the bands that every layout gives a row."""
    t = base(spark, sf_dir).table("events")
    layouts = {k: LakePartition(k) for k in ("hour", "day", "month", "year")} | {"band": LakePartition("truncate", 1_800_000_000)}
    bands = [layout.band(F.col("ts"), t.key, t.tier_dtype).alias(name) for name, layout in layouts.items()]
    return table(spark, sf_dir, "events").groupBy(*bands).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'events' AS name, 'tiered' AS mode, epoch_us({CUT_SQL}) AS tier_key_hi, (SELECT count(*) FROM events WHERE ts < {CUT_SQL} AND event_id % 10 < 2) AS overlay_rows, '{{"dropped": 1, "hot": 1}}' AS partitions, 1 AS live_pins, 1 AS staged_loads, 0 AS open_ops, 'ok' AS overlay_alert""")
def status_snapshot(spark, sf_dir):
    """Status of a clone with an open read and a staged load."""
    e = base(spark, sf_dir)
    name = clone(e, "events")
    e.read(name)
    e.stream_load(name, "one", table(spark, sf_dir, "events").where(f"ts < TIMESTAMP_NTZ '{T_CUT}'"), spool_rows=1)
    row = e.status().where(F.col("name") == name)
    return row.select(F.lit("events").alias("name"), "mode", "tier_key_hi", "overlay_rows", "partitions", F.col("live_pins").cast("int").alias("live_pins"), F.col("staged_loads").cast("int").alias("staged_loads"), F.col("open_ops").cast("int").alias("open_ops"), "overlay_alert")


@query(f"SELECT 0 AS delete_files, (SELECT count(*) FROM events WHERE ts < {CUT_SQL}) AS records, CAST(0.0 AS DOUBLE) AS delete_ratio")
def lake_stats(spark, sf_dir):
    s = base(spark, sf_dir).lake_stats("events")
    return spark.createDataFrame([(s["delete_files"], s["records"], s["delete_ratio"])], "delete_files int, records long, delete_ratio double")


@query("SELECT true AS ok, count(*) AS n, epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events")
def verify_checksum(spark, sf_dir):
    """Both sides of a mirrored table agree, checksum of the keys included."""
    e = base(spark, sf_dir)
    name = _fresh(e, spark, sf_dir, EVENTS, "event_id", "ts", "events", mode="mirrored")
    e.initial_copy(name, 5)
    found = e.verify(name)
    return spark.createDataFrame([(found["ok"], *found["lake"][:3])], "ok boolean, n long, low long, high long")


@query(f"""SELECT line, text FROM (VALUES (0, 'events: cut-line ' || epoch_us({CUT_SQL}) || ', pinned lake with overlay, snapshot 1, ' || (SELECT count(*) FROM events WHERE ts < {CUT_SQL} AND event_id % 10 < 2) || ' corrections'),
(1, 'UPDATE on events, cut-line ' || epoch_us({CUT_SQL}) || ': hot'), (2, '  hot half: heap files rewritten'), (3, 'DELETE on events, cut-line ' || epoch_us({CUT_SQL}) || ': cold'), (4, '  cold half: tombstones in the overlay')) t(line, text)""")
def explain_routes(spark, sf_dir):
    e = base(spark, sf_dir)
    lines = [x for s in ("SELECT * FROM events", "UPDATE events SET value = 1 WHERE ts >= '2024-01-20'", "DELETE FROM events WHERE ts < '2024-01-02'") for x in e.explain(s)]
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")
