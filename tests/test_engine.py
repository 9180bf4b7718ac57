import json

import pytest
from pyspark.sql import functions as F

from thermocline.catalog import CatalogError
from thermocline.engine import Engine, overlay_settings
from thermocline.operators.movement import MovementError
from thermocline.operators.seam import NeverCommitted
from thermocline.operators.writes import WriteRejected
from thermocline.sources.lake import LakePartition

SCHEMA = "id long, event_time long, val string"
TRIPS = [(1, 10, "a"), (2, 20, "b"), (3, 110, "c"), (4, 150, "d"), (5, 250, "e")]
GRID = [(0, 100), (100, 200), (200, 300)]


@pytest.fixture
def engine(spark, tmp_path):
    now = [1_000_000.0]
    e = Engine(spark, str(tmp_path / "e"), clock=lambda: now[0])
    e.now = now
    yield e
    e.close()


def frame(e, rows, schema=SCHEMA):
    return e.spark.createDataFrame(list(rows), schema)


def trips(e, name="trips", rows=TRIPS, tier=200, **k):
    e.register(name, SCHEMA, k.pop("keys", ["id"]), "event_time", partitions=k.pop("partitions", GRID), **k)
    e.load_heap(name, frame(e, rows))
    if tier is not None:
        e.tier(name, up_to=tier)
    return name


def state(e, name="trips", **k):
    with e.read(name, **k) as df:
        return sorted(tuple(r) for r in df.collect())


def test_golden_sequence(engine):
    e = engine
    trips(e)
    assert state(e) == TRIPS and e.table("trips").heap().count() == 1
    e.delete_keys("trips", frame(e, [(1, 10)], "id long, event_time long"))
    e.upsert("trips", frame(e, [(3, 110, "C!"), (6, 260, "f")]))
    want = [(2, 20, "b"), (3, 110, "C!"), (4, 150, "d"), (5, 250, "e"), (6, 260, "f")]
    assert state(e) == want
    assert e.fold("trips") and state(e) == want and e.table("trips").overlay_keys() == 0
    assert e.update("trips", {"val": "'B?'"}, "id = 2").rows == 1
    assert e.delete("trips", "id = 4").rows == 1
    want = [(2, 20, "B?"), (3, 110, "C!"), (5, 250, "e"), (6, 260, "f")]
    assert state(e) == want
    e.fold("trips")
    assert state(e) == want
    assert e.stream_load("trips", "hot", frame(e, [(7, 265, "g"), (8, 270, "h")])).hot_rows == 2
    mixed = e.stream_load("trips", "straddle", frame(e, [(9, 280, "i"), (10, 130, "j")]))
    assert (mixed.hot_rows, mixed.delta_rows) == (1, 1)
    assert e.stream_load("trips", "hot", frame(e, [(99, 265, "x")])).replay
    assert state(e) == sorted([*want, (7, 265, "g"), (8, 270, "h"), (9, 280, "i"), (10, 130, "j")])
    e.register("vehicles", "id long, vin string, last_seen long", ["id"], "last_seen", mode="mirrored")
    e.load_heap("vehicles", frame(e, [(2, "VIN-002", 5)], "id long, vin string, last_seen long"))
    with e.sql("SELECT t.id, val, vin FROM trips t JOIN vehicles v ON t.id = v.id") as df:
        assert [tuple(r) for r in df.collect()] == [(2, "B?", "VIN-002")]


def test_moves_across_the_cut(engine):
    e = engine
    trips(e)
    r = e.update("trips", {"event_time": "event_time + 200"}, "id = 2", returning=True)
    assert [tuple(x) for x in r.returning.collect()] == [(2, 220, "b")] and r.cold_rows == 1
    e.update("trips", {"event_time": "50"}, "id = 5")
    e.update("trips", {"event_time": "120"}, "id = 1")
    want = sorted([(1, 120, "a"), (2, 220, "b"), (3, 110, "c"), (4, 150, "d"), (5, 50, "e")])
    assert state(e) == want
    e.fold("trips")
    assert state(e) == want and e.verify("trips")["ok"]


def test_fold_of_a_move_between_bands(engine):
    e = engine
    trips(e, layout=LakePartition("truncate", 100))
    e.update("trips", {"event_time": "event_time + 100"}, "id = 1")
    e.update("trips", {"event_time": "event_time - 90"}, "id = 1")
    e.update("trips", {"event_time": "event_time + 100"}, "id = 2")
    e.update("trips", {"event_time": "event_time - 100"}, "id = 2")
    want = [(1, 20, "a"), *TRIPS[1:]]
    assert state(e) == want
    for merge_on_read in (False, True):
        e.fold("trips", merge_on_read=merge_on_read)
        assert state(e) == want
        e.update("trips", {"val": "val"}, "event_time < 200")
    e.fold("trips", merge_on_read=True)
    assert e.compact_deletes("trips") > 0 and state(e) == want


@pytest.mark.parametrize("where", ["before-commit", "after-commit"])
def test_tiering_survives_a_crash(engine, where):
    e = engine
    trips(e, tier=None)
    e.crash_at(where)
    with pytest.raises(RuntimeError):
        e.tier("trips", up_to=200)
    assert state(e) == TRIPS
    e.tier("trips", up_to=200)
    assert state(e) == TRIPS and e.table("trips").cut().t == 200
    assert not e.catalog.open_ops(e.table("trips").id)
    assert sum(f.records for f in e.table("trips").lake.snapshot(e.table("trips").cut().s).files) == 4


def test_tiering_selects_a_contiguous_run(engine):
    e = engine
    trips(e, tier=None, partitions=[(0, 100), (150, 200), (200, 300)], rows=[(1, 10, "a"), (5, 250, "e")])
    assert e.tier("trips", lag=200) is None
    assert e.tier("trips", up_to=300) == 100  # up to the hole
    with pytest.raises(MovementError):
        e.tier("trips", up_to=300)
    assert state(e) == [(1, 10, "a"), (5, 250, "e")]
    empty = trips(e, "empty", rows=[(1, 290, "z")], tier=None)
    assert e.tier(empty) == 200 and e.table(empty).cut().s == 0  # T moves, S stays


def test_pins_hold_folds_and_reclaims(engine):
    e = engine
    trips(e, tier=100)
    e.upsert("trips", frame(e, [(1, 10, "A")]))
    held = e.read("trips")
    assert e.fold("trips") is None
    e.tier("trips", up_to=200)
    assert sorted(tuple(r) for r in held.df.collect()) == [(1, 10, "A"), *TRIPS[1:]]
    held.close()
    assert e.fold("trips") and state(e) == [(1, 10, "A"), *TRIPS[1:]]


def test_fold_takes_the_oldest_and_keeps_the_rest(engine):
    e = engine
    trips(e)
    for i, v in ((1, "x"), (2, "y"), (3, "z")):
        e.upsert("trips", frame(e, [(i, 10 * i if i < 3 else 110, v)]))
    e.fold("trips", 2)
    assert e.table("trips").overlay_keys() == 1
    assert state(e) == [(1, 10, "x"), (2, 20, "y"), (3, 110, "z"), *TRIPS[3:]]


@pytest.mark.parametrize("merge_on_read", [False, True])
def test_fold_of_a_part_of_one_write(engine, merge_on_read):
    e = engine
    trips(e)
    e.update("trips", {"val": "upper(val)"}, "event_time < 200")
    want = [(i, t, v.upper() if t < 200 else v) for i, t, v in TRIPS]
    for left in (3, 2, 1, 0):
        assert e.fold("trips", 1, merge_on_read=merge_on_read)
        assert e.table("trips").overlay_keys() == left and state(e) == want
    e.delete("trips", "event_time < 150")
    assert e.fold("trips", 2, merge_on_read=merge_on_read)
    assert e.table("trips").overlay_keys() == 1 and state(e) == want[3:]


def test_rejections(engine):
    e = engine
    trips(e, lake_retention=150, layout=LakePartition("truncate", 50))
    e.expire("trips", width=50)
    assert e.table("trips").cut().r == 50
    cases = [
        lambda: e.upsert("trips", frame(e, [(9, 30, "z")])),
        lambda: e.upsert("trips", frame(e, [(None, 130, "z")])),
        lambda: e.insert("trips", frame(e, [(9, None, "z")])),
        lambda: e.insert("trips", frame(e, [(9, 999, "z")])),
        lambda: e.insert("trips", frame(e, [(9, 130, "z")]), returning=True),
        lambda: e.update("trips", {"id": "1"}),
        lambda: e.update("trips", {"nope": "1"}),
        lambda: e.delete_keys("trips", frame(e, [(1,)], "id long")),
        lambda: e.stream_load("trips", "a", frame(e, [(9, 130, "z"), (9, 131, "z")])),
        lambda: e.stream_load("trips", "b", frame(e, [(9, 130, "z"), (8, 1, "z")])),
    ]
    before = state(e)
    for case in cases:
        with pytest.raises(WriteRejected):
            case()
    with pytest.raises(ValueError):
        e.upsert("trips", frame(e, [(9, 130, "z", 1)], SCHEMA + ", extra int"))
    assert state(e) == before and e.catalog.load(e.table("trips").id, "a") is None
    e.disable_routed_writes("trips")
    with pytest.raises(WriteRejected):
        e.insert("trips", frame(e, [(9, 130, "z")]))
    e.enable_routed_writes("trips")
    assert e.insert("trips", frame(e, [(9, 130, "z"), (10, 290, "y")])).rows == 2


def test_retention(engine):
    e = engine
    trips(e, lake_retention=100, layout=LakePartition("truncate", 100))
    assert e.expire("trips", width=100) == 100
    assert state(e) == TRIPS[2:]
    assert e.expire("trips", width=100) is None
    straddles = trips(e, "one", lake_retention=100)
    with pytest.raises(MovementError):
        e.expire(straddles, width=100)
    assert state(e, straddles) == TRIPS


def test_ingest(engine):
    e = engine
    trips(e, layout=LakePartition("truncate", 100))
    before = e.table("trips").cut().s
    e.ingest("trips", frame(e, [(20, -50, "old")]))
    e.ingest("trips", frame(e, [(3, 111, "C2"), (21, 130, "n")]))
    want = sorted([(20, -50, "old"), (1, 10, "a"), (2, 20, "b"), (3, 111, "C2"), (4, 150, "d"), (21, 130, "n"), (5, 250, "e")])
    assert state(e) == want and e.table("trips").cut().s == before + 2
    for bad in ([(1, 200, "x")], [(1, None, "x")]):
        with pytest.raises(MovementError):
            e.ingest("trips", frame(e, bad))
    assert e.ingest("trips", frame(e, [])) == before + 2 and state(e) == want


def test_staged_loads(engine):
    e = engine
    trips(e)
    r = e.stream_load("trips", "big", frame(e, [(1, 10, "A"), (11, 30, "n"), (12, 260, "h")]), spool_rows=1)
    assert (r.hot_rows, r.staged_rows) == (1, 2)
    assert state(e) == sorted([*TRIPS, (12, 260, "h")])
    e.crash_at("after-adopt-commit")
    with pytest.raises(RuntimeError):
        e.adopt_loads("trips")
    e.adopt_loads("trips")
    assert state(e) == sorted([(1, 10, "A"), *TRIPS[1:], (11, 30, "n"), (12, 260, "h")])
    assert e.adopt_loads("trips") is None
    e.stream_load("trips", "bad", frame(e, [(1, 10, "B"), (2, 20, "B")]), spool_rows=1)
    e.fail_load("trips", "bad")
    assert e.sweep_failed_loads("trips") == 0
    e.now[0] += 25 * 3600
    assert e.sweep_failed_loads("trips") == 1 and state(e)[0] == (1, 10, "A")


def test_keep_heap_and_direct(engine):
    e = engine
    kept = trips(e, "kept", keep_heap=True)
    assert state(e, kept) == TRIPS and e.table(kept).heap().count() == 5
    e.update(kept, {"val": "'K'"}, "id IN (1, 5)")
    e.delete(kept, "id = 2")
    e.upsert(kept, frame(e, [(8, 50, "n")]))
    want = sorted([(1, 10, "K"), (3, 110, "c"), (4, 150, "d"), (5, 250, "K"), (8, 50, "n")])
    assert state(e, kept) == want
    assert e.verify(kept) == {"ok": True, "missing": 0, "differing": 0}
    e.detach_cold_mirror(kept)
    e.update(kept, {"val": "'Q'"}, "id = 1")
    assert e.verify(kept)["differing"] == 1
    e.attach_cold_mirror(kept)
    with pytest.raises(WriteRejected):
        e.enable_routed_writes(kept)
    direct = trips(e, "direct", mode="direct")
    e.upsert(direct, frame(e, [(1, 12, "A"), (6, 260, "f")]))
    e.delete_keys(direct, frame(e, [(2, 20)], "id long, event_time long"))
    assert state(e, direct) == sorted([(1, 12, "A"), (3, 110, "c"), (4, 150, "d"), (5, 250, "e"), (6, 260, "f")])
    with pytest.raises(WriteRejected):
        e.delete(direct, "val = 'c'")
    with pytest.raises(WriteRejected):
        e.stream_load(direct, "l", frame(e, [(1, 10, "x")]))
    assert e.delete(direct, "event_time >= 255").rows == 1


def test_reads_skip_the_other_half(engine):
    e = engine
    trips(e)
    with e.read("trips", "event_time >= 200") as df:
        assert df.count() == 1 and "lake" not in str(df.inputFiles())
    with e.read("trips", "event_time < 150") as df:
        assert df.count() == 3 and "/heap/" not in str(df.inputFiles())
    by_band = trips(e, "banded", layout=LakePartition("truncate", 100))
    with e.read(by_band, "event_time BETWEEN 100 AND 120") as df:
        assert df.count() == 1 and len(df.inputFiles()) == 1  # by the ranges in the manifest
    assert e.preview("SELECT count(*) AS n FROM trips") == [{"n": 5}]
    fresh = trips(e, "fresh", tier=None)
    with pytest.raises(NeverCommitted):
        e.read(fresh, strict=True)
    assert state(e, fresh) == TRIPS and not e.catalog.pinned(e.table(fresh).id)
    assert e.spark.sql(e.seam_sql("trips")).count() == 5


def test_composite_keys_and_types(engine):
    e = engine
    schema = "tenant long, device string, at timestamp, day date, v decimal(9,6)"
    e.register("r", schema, ["tenant", "device"], "at", layout=LakePartition("day"), partitions=[("2026-01-01", "2026-01-02"), ("2026-01-02", "2026-01-03"), ("2026-01-03", "2026-01-04")])
    rows = e.spark.sql("""SELECT * FROM VALUES (1L, 'a\\\\', TIMESTAMP'2026-01-01 10:00:00.123456Z', DATE'2026-01-01', 1.5BD), (1L, 'b', TIMESTAMP'2026-01-02 10:00:00Z', NULL, 2.5BD), (2L, 'a', TIMESTAMP'2026-01-03 10:00:00Z', NULL, NULL) AS t(tenant, device, at, day, v)""")
    e.load_heap("r", rows)
    e.tier("r", up_to=e.table("r").key.canonical("2026-01-03"))
    e.update("r", {"v": "v * 2"}, "device LIKE 'a%'")
    got = {(r["tenant"], r["device"]): r for r in e.read("r").df.collect()}
    assert str(got[1, "a\\"]["v"]) == "3.000000" and got[1, "a\\"]["at"].microsecond == 123456 and got[2, "a"]["v"] is None
    e.register("d", "id long, day date", ["id"], "day", partitions=[("2026-01-01", "2026-01-05"), ("2026-01-05", "2026-01-09")])
    e.load_heap("d", e.spark.sql("SELECT id, date_add(DATE'2026-01-01', cast(id AS int)) AS day FROM range(8)"))
    assert e.tier("d", lag="3d") is not None and e.read("d").df.count() == 8 and e.table("d").heap().count() == 4


def test_premake_and_off_grid(engine):
    e = engine
    trips(e, tier=None)
    assert e.premake("trips", 100, headroom=3) == ["trips_300", "trips_400", "trips_500"]
    assert e.premake("trips", 100, headroom=3) == []
    e.load_heap("trips", frame(e, [(9, 5000, "far")]))
    assert [r["id"] for r in e.off_grid("trips").collect()] == [9]
    with pytest.raises(MovementError):
        e.add_partition("trips", 550, 650)


def test_maintenance(engine):
    e = engine
    trips(e, layout=LakePartition("truncate", 100))
    for i in range(4):
        e.ingest("trips", frame(e, [(100 + i, -5 - i, "s")]))
    want = state(e)
    assert e.policy("trips")["rewrite_min_input_files"] == (8, "default")
    assert e.rewrite_small_files("trips") == 0
    e.policy("trips", set_={"rewrite_min_input_files": 4, "snapshot_min_keep": 2, "orphan_sweep": True})
    assert e.policy("trips")["rewrite_min_input_files"] == (4, "table")
    assert e.rewrite_small_files("trips") == 4 and state(e) == want
    e.table("trips").lake.write(frame(e, [(1, 1, "orphan")]))
    import time

    e.now[0] = time.time() + 100 * 3600
    done = e.maintain("trips")
    assert done["expired_snapshots"] and done["orphans"] and state(e) == want
    assert done["stats"]["records"] == 8 and len(e.table("trips").lake.numbers()) == 2
    assert e.policy("trips", reset=True)["orphan_sweep"] == (False, "default")
    with pytest.raises(ValueError):
        e.policy("trips", set_={"nope": 1})


def test_explain_and_status(engine):
    e = engine
    trips(e)
    assert "hot half" in e.explain("UPDATE trips SET val = 'x' WHERE event_time >= 250")[1]
    assert e.explain("DELETE FROM trips WHERE event_time < 200 RETURNING id")[1].strip().startswith("cold half: tombstones")
    assert len(e.explain("DELETE FROM trips")) == 3
    assert "overlay" in e.explain("INSERT INTO trips VALUES (1)")[2]
    assert e.explain("SELECT 1") == ["no registered table: the statement runs as it is"]
    row = e.status().first()
    assert row["tier_key_hi"] == 200 and json.loads(row["partitions"])["hot"] == 1 and row["overlay_alert"] == "ok"
    cycle = e.run_cycle("trips")
    assert cycle["tiered"] is None and "maintained" not in cycle
    e.catalog.request_maintenance(e.table("trips").id)
    assert "stats" in e.run_cycle("trips")["maintained"]


def test_registration(engine):
    e = engine
    with pytest.raises(CatalogError):
        e.register("x", SCHEMA, ["nope"], "event_time")
    with pytest.raises(ValueError):
        e.register("x", SCHEMA, ["id"], "val")
    with pytest.raises(ValueError):
        e.register("x", SCHEMA, ["id"], "event_time", mode="mirrored", keep_heap=True)
    with pytest.raises(ValueError):
        LakePartition("truncate", 2**31)
    trips(e)
    root = e.table("trips").lake.root
    e.unregister("trips", drop_lake=True)
    import os

    assert not os.path.exists(root)
    with pytest.raises(CatalogError):
        e.read("trips")


def test_storage_settings(engine):
    assert overlay_settings({"s3-key": "a", "region": "x", "blank": ""}, {"s3-key": "b"}, {"S3_KEY": "env", "BLANK": "env", "OTHER": "1"}) == {"s3-key": "b", "region": "x"}
    engine.storage_profile("main", {"endpoint": "here"})
    trips(engine, tier=None)
    assert engine.options("trips") == {"endpoint": "here"}


def test_empty_table(engine):
    e = engine
    e.register("none", SCHEMA, ["id"], "event_time")
    assert state(e, "none") == [] and e.tier("none") is None and e.fold("none") is None and e.premake("none", 10) == []
    assert e.update("none", {"val": "1"}).rows == 0 and e.delete("none").rows == 0
    assert e.read("none").df.agg(F.count("*")).first()[0] == 0
