"""Writers that meet, crashes, casts, transactions and limits: what must not lose or double a row."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from test_engine import SCHEMA, TRIPS, engine, frame, state, trips  # noqa: F401
from thermocline import catalog as catalog_module
from thermocline.catalog import BaseMoved, Catalog, CatalogError
from thermocline.operators import movement
from thermocline.operators.movement import MovementError
from thermocline.operators.writes import WriteRejected
from thermocline.sources.jsonl import BadRow
from thermocline.sources.lake import LakePartition
from thermocline.streaming.mirror import StreamError, change_schema

OLD = [(20, -50, "old"), (21, -40, "older")]


def test_ingest_during_fold_and_fold_during_ingest(engine):
    e = engine
    for first, other in (("fold", "ingest"), ("ingest", "fold")):
        name = trips(e, f"t_{first}")
        e.update(name, {"val": "upper(val)"}, "event_time < 200")
        run = {"fold": lambda: e.fold(name), "ingest": lambda: e.ingest(name, frame(e, OLD))}  # noqa: B023
        e.meanwhile(run[other])
        run[first]()
        assert state(e, name) == sorted([*OLD, *[(i, t, v.upper() if t < 200 else v) for i, t, v in TRIPS]])
        assert not e.table(name).overlay_keys()


def test_write_during_fold_stays(engine):
    e = engine
    trips(e)
    e.upsert("trips", frame(e, [(1, 10, "A")]))
    e.meanwhile(lambda: e.upsert("trips", frame(e, [(1, 10, "B"), (2, 20, "B")])))
    e.fold("trips")
    assert state(e)[:2] == [(1, 10, "B"), (2, 20, "B")] and e.table("trips").overlay_keys() == 2
    e.fold("trips")
    assert state(e)[:2] == [(1, 10, "B"), (2, 20, "B")] and not e.table("trips").overlay_keys()


def test_maintenance_and_tiering_meet(engine):
    e = engine
    trips(e, layout=LakePartition("truncate", 100))
    for i in range(3):
        e.ingest("trips", frame(e, [(100 + i, -5 - i, "s")]))
    e.policy("trips", set_={"rewrite_min_input_files": 2})
    want = state(e)
    e.meanwhile(lambda: e.tier("trips", up_to=300))
    assert e.rewrite_small_files("trips") >= 3 and state(e) == want
    assert e.table("trips").cut().t == 300


def test_a_write_routed_by_an_old_cut_line_is_refused(engine):
    e = engine
    trips(e)
    t = e.table("trips")
    p = e._publishing(t)
    p.rewrite_heap(None, frame(e, [(9, 210, "z")]), 200)
    e.tier("trips", up_to=300)
    with pytest.raises(BaseMoved):
        p.publish()
    assert state(e) == TRIPS


def test_commits_give_up_after_many_rivals(engine, monkeypatch):
    e = engine
    trips(e)
    monkeypatch.setattr(movement, "COMMIT_TRIES", 2)
    t = e.table("trips")

    def rival(base):
        made = t.lake.commit(base, stamps={"who": "rival"})
        e.catalog.advance(t.id, 200, made.number)
        return t.lake.commit(base)

    with pytest.raises(MovementError):
        e.commit_lake(t, rival, lambda made: None)
    assert state(e) == TRIPS


@pytest.mark.parametrize(("where", "ids"), [("CAST(event_time AS INT) <= 150", [1, 2, 3, 4]), ("CAST(event_time AS BIGINT) <= 150", [1, 2, 3, 4])])
def test_casts_of_the_tier_key(engine, where, ids):
    e = engine
    trips(e)
    with e.read("trips", where) as df:
        assert sorted(r["id"] for r in df.collect()) == ids


def test_a_day_that_the_cut_line_divides(engine):
    e = engine
    e.register("d", "id long, ts timestamp_ntz", ["id"], "ts", partitions=[("2024-01-01", "2024-01-15 12:00:00"), ("2024-01-15 12:00:00", "2024-02-01")])
    e.load_heap("d", e.spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-15 00:00:00' + make_dt_interval(0, CAST(id AS INT) * 7) AS ts FROM range(6)"))
    e.tier("d", up_to=e.table("d").key.canonical("2024-01-15 12:00:00"))
    for where, n in (("CAST(ts AS DATE) <= DATE '2024-01-15'", 4), ("CAST(ts AS DATE) = DATE '2024-01-15'", 4), ("ts <= CAST('2024-01-15 13:00' AS DATE)", 1), ("ts >= TIMESTAMP_NTZ '2024-01-15 12:00:00'", 4)):
        with e.read("d", where) as df:
            assert df.count() == n, where
    assert e.delete("d", "CAST(ts AS DATE) = DATE '2024-01-15'").rows == 4 and e.read("d").df.count() == 2


def test_hot_deletes_and_keys_that_exist(engine):
    e = engine
    trips(e)
    for v in ("x", "y"):
        assert e.upsert("trips", frame(e, [(5, 250, v)])).hot_rows == 1
    assert state(e)[-1] == (5, 250, "y") and len(state(e)) == 5
    for rows in ([(5, 251, "z")], [(8, 260, "a"), (8, 261, "b")]):
        with pytest.raises(WriteRejected):
            e.insert("trips", frame(e, rows))
    with pytest.raises(WriteRejected):
        e.upsert("trips", frame(e, [(1, 10, "a"), (1, 11, "b")]))
    assert e.delete("trips", "id >= 4").rows == 2 and state(e) == TRIPS[:3]


def test_many_segments_are_merged(engine):
    e = engine
    trips(e)
    for i in range(12):
        e.upsert("trips", frame(e, [(1 + i % 3, [10, 20, 110][i % 3], str(i))]))
    t = e.table("trips")
    assert len(t.overlay_segments()) <= 9
    assert [v for _, _, v in state(e)[:3]] == ["9", "10", "11"]
    e.fold("trips")
    assert [v for _, _, v in state(e)[:3]] == ["9", "10", "11"] and not t.overlay_keys()


def test_adoption_is_one_commit(engine):
    e = engine
    trips(e)
    e.stream_load("trips", "a", frame(e, [(1, 10, "A"), (30, 60, "A")]), spool_rows=1)
    e.stream_load("trips", "b", frame(e, [(1, 10, "B"), (31, 70, "B")]), spool_rows=1)
    before = e.table("trips").cut().s
    e.crash_at("after-adopt-commit")
    with pytest.raises(RuntimeError):
        e.adopt_loads("trips")
    assert len(e.catalog.loads(e.table("trips").id, "staged")) == 2 and e.table("trips").cut().s == before
    e.stream_load("trips", "c", frame(e, [(32, 80, "C"), (33, 81, "C")]), spool_rows=1)
    e.adopt_loads("trips")
    assert state(e) == sorted([(1, 10, "B"), *TRIPS[1:], (30, 60, "A"), (31, 70, "B"), (32, 80, "C"), (33, 81, "C")])
    made = e.table("trips").lake.snapshot(e.table("trips").cut().s)
    assert json.loads(made.stamps["labels"]) == ["a", "b", "c"] and made.base == before


def test_a_stamped_snapshot_on_an_old_base_is_void(engine):
    e = engine
    trips(e, tier=None)
    e.crash_at("after-commit")
    with pytest.raises(RuntimeError):
        e.tier("trips", up_to=100)
    e.ingest("trips", frame(e, [(40, -1, "in")]))
    assert e.resume("trips")[0].endswith("abandoned")
    e.tier("trips", up_to=200)
    assert state(e) == sorted([*TRIPS, (40, -1, "in")])


def fleet(e):
    e.register("fleet", "id long, vin string, last_seen long", ["id"], "last_seen", mode="mirrored")


def change(e, *rows):
    return e.spark.createDataFrame([(p, s, k, n, o, []) for p, s, k, n, o in rows], change_schema(e.table("fleet").schema))


def seen(e):
    t = e.table("fleet")
    return sorted(tuple(r)[:2] for r in t.lake.scan(t.lake.snapshot(t.cut().s)).collect())


def test_transactions_are_shown_whole(engine):
    e = engine
    fleet(e)
    one = change(e, (5, 1, "insert", (1, "a", 1), None), (5, 3, "commit", None, None), (6, 4, "insert", (2, "b", 1), None))
    two = change(e, (6, 5, "insert", (3, "c", 1), None), (6, 6, "commit", None, None), (7, 7, "delete", None, (1, None, None)))
    assert e.apply_changes("fleet", one) == 5 and seen(e) == [(1, "a")]
    assert e.apply_changes("fleet", one) == 5 and seen(e) == [(1, "a")]
    assert e.apply_changes("fleet", two) == 6 and seen(e) == [(1, "a"), (2, "b"), (3, "c")]
    assert e.apply_changes("fleet", two) == 6 and seen(e) == [(1, "a"), (2, "b"), (3, "c")]
    assert e.apply_changes("fleet", change(e, (7, 8, "commit", None, None))) == 7 and seen(e) == [(2, "b"), (3, "c")]


def test_a_truncate_in_the_tail_waits_for_its_commit(engine):
    e = engine
    fleet(e)
    e.apply_changes("fleet", change(e, (5, 1, "insert", (1, "a", 1), None), (5, 2, "commit", None, None), (6, 3, "truncate", None, None)))
    assert seen(e) == [(1, "a")]
    with pytest.raises(StreamError):
        e.apply_changes("fleet", change(e, (6, 4, "commit", None, None)))


def test_a_position_that_goes_on_and_positions_above_the_sign(engine):
    e = engine
    fleet(e)
    e.apply_changes("fleet", change(e, (5, 1, "insert", (1, "a", 1), None)))
    e.apply_changes("fleet", change(e, (5, 1, "insert", (1, "again", 1), None), (5, 2, "insert", (2, "b", 1), None)))
    assert seen(e) == [(1, "a"), (2, "b")]
    high = -(2**63) + 7  # 2^63 + 7 as an unsigned position
    assert e.apply_changes("fleet", change(e, (high, 3, "insert", (3, "c", 1), None), (6, 9, "insert", (3, "early", 1), None))) == 2**63 + 7
    assert seen(e)[-1] == (3, "c")
    e.apply_changes("fleet", change(e, (100, 4, "insert", (4, "late", 1), None)))
    assert len(seen(e)) == 3


def test_a_wider_stream_widens_the_table(engine):
    e = engine
    fleet(e)
    e.apply_changes("fleet", change(e, (5, 1, "insert", (1, "a", 1), None)))
    wide = change(e, (6, 2, "insert", (2, "b", 1), None)).withColumn("new", F.col("new").withField("color", F.lit("red")))
    e.apply_changes("fleet", wide.withColumn("old", F.lit(None).cast(wide.schema["new"].dataType)))
    t = e.table("fleet")
    assert sorted((r["id"], r["color"]) for r in t.lake.scan(t.lake.snapshot(t.cut().s)).collect()) == [(1, None), (2, "red")]


def test_locks_wait_and_lapse(engine):
    e = engine
    trips(e)
    i = e.table("trips").id
    with e.catalog.lake_lock(i):
        with pytest.raises(CatalogError), e.catalog.lake_lock(i, wait=0.1):
            pass
        e.now[0] += catalog_module.LOCK_LEASE + 1  # the holder died
        with e.catalog.lake_lock(i):
            pass


def test_an_older_catalog_is_brought_up(tmp_path):
    path = str(tmp_path / "c.db")
    Catalog(path).close()
    with sqlite3.connect(path) as db:
        db.execute("ALTER TABLE locks DROP COLUMN expires_at")
        db.execute("ALTER TABLE cutline DROP COLUMN newest")
        db.execute("UPDATE schema_meta SET version = 1")
    c = Catalog(path)
    with c.lake_lock(1):
        pass
    c.close()
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT version FROM schema_meta").fetchone()[0] == catalog_module.SCHEMA_VERSION


def test_lines_out_of_order_fail_the_verification(engine):
    e = engine
    trips(e)
    assert e.verify("trips")["ok"]
    e.catalog.publish_retention(e.table("trips").id, 10**6)
    assert not e.verify("trips")["ok"]


def test_tokens_pins_and_named_tables(engine):
    e = engine
    trips(e)
    trips(e, "other")
    token = e.cold_token("trips")
    e.ingest("trips", frame(e, OLD))
    assert e.read_token(token).count() == 4 and e.read_token(e.cold_token("trips")).count() == 6
    with pytest.raises(ValueError):
        e.read_token("lake")
    assert e.named_tables("WITH other AS (SELECT 1) SELECT * FROM trips WHERE id IN (SELECT id FROM TRIPS) AND 'x' <> 'other'")[0] == "trips"
    h = e.sql("SELECT count(*) AS n FROM trips")
    assert not e.catalog.pinned(e.table("other").id) and h.df.first()[0] == 7
    h.close()
    with pytest.raises(Exception):  # noqa: B017
        e.sql("SELECT nope FROM trips")
    assert not e.catalog.pinned(e.table("trips").id)
    pin, _, _ = e.catalog.pin(e.table("trips").id, 100)
    e.tier("trips", up_to=300)
    assert e.spark.sql(e.seam_sql("trips", pin)).count() == 7
    e.catalog.unpin(pin)
    with pytest.raises(CatalogError):
        e.seam_sql("trips", pin)


def test_declared_partitions(engine):
    e = engine
    trips(e, tier=None)
    assert e.sync_partitions("trips", {"trips_0": "FOR VALUES FROM (0) TO (1)", "p3": "FOR VALUES FROM ('300') TO ('400')", "rest": "DEFAULT", "open": "FOR VALUES FROM (MINVALUE) TO (0)", "odd": "FOR VALUES FROM (5) TO (5)"}) == ["p3"]
    assert [(p["lo"], p["hi"], p["state"]) for p in e.catalog.partitions(e.table("trips").id)][-1] == (300, 400, "hot")
    e.register("days", "id long, d date", ["id"], "d")
    assert e.sync_partitions("days", {"a": "for values from ('2024-01-01') to ('2024-01-08')", "b": "FOR VALUES FROM ('x') TO ('y')"}) == ["a"]


def test_json_lines_name_the_bad_line(engine, tmp_path):
    e = engine
    trips(e)
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": 50, "event_time": -3, "val": "j"}\n\n{"id": 51, "event_time": -2}\n')
    e.ingest_jsonl("trips", str(good))
    assert state(e)[-2:] == [(50, -3, "j"), (51, -2, None)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 52, "event_time": -3}\n\n{"id": "x", "event_time": -2}\n{"nope": 1}\n')
    with pytest.raises(BadRow, match="line 3: column id"):
        e.ingest_jsonl("trips", str(bad))


def test_replaced_heap_files_are_swept(engine):
    import time

    e = engine
    trips(e)
    e.policy("trips", set_={"orphan_grace_hours": 1})
    for v in ("x", "y"):
        e.update("trips", {"val": f"'{v}'"}, "id = 5 OR id = 1")
    e.fold("trips")
    want = state(e)
    e.now[0] = time.time() + 2 * 3600
    gone = e.sweep_orphans("trips")
    assert any("/heap/" in p for p in gone) and any("/overlay/" in p for p in gone) and state(e) == want


def test_large_batches_take_whole_versions(engine, monkeypatch):
    e = engine
    trips(e)
    for v in "pqr":
        e.upsert("trips", frame(e, [(1, 10, v)]) if v == "p" else frame(e, [(2, 20, v), (3, 110, v)]))
    monkeypatch.setattr(movement, "TOP_ROWS", 0)
    rows = e.table("trips").overlay()
    assert rows.count() == 3 and movement._oldest(rows, 2, 3).count() == 3 and movement._oldest(rows, 1, 3).count() == 1


def test_a_version_larger_than_a_large_batch_is_split(engine, monkeypatch):
    e = engine
    trips(e)
    e.upsert("trips", frame(e, [(1, 10, "A")]))
    e.upsert("trips", frame(e, [(i, i, "n") for i in range(10, 30)]))
    monkeypatch.setattr(movement, "TOP_ROWS", 3)
    want, left = state(e), []
    while e.fold("trips", 6):
        assert state(e) == want
        left.append([e.table("trips").overlay_keys(), e.table("trips").overlay().where("version = 1").count()])
    assert left == [[15, 0], [9, 0], [3, 0], [0, 0]]


def test_statements_as_text(engine):
    e = engine
    trips(e)
    r = e.execute("UPDATE trips SET val = concat(upper(val), '!'), event_time = event_time + 1 WHERE event_time BETWEEN 100 AND 260 OR id = 1 RETURNING *;")
    assert r.rows == 4 and sorted(tuple(x) for x in r.returning.collect()) == [(1, 11, "A!"), (3, 111, "C!"), (4, 151, "D!"), (5, 251, "E!")]
    assert e.execute("DELETE FROM trips WHERE val LIKE 'D%' AND event_time < 200").rows == 1
    assert e.execute("INSERT INTO trips (id, event_time) SELECT id + 10, event_time FROM trips WHERE id <> 1").rows == 3
    assert e.execute("INSERT INTO trips VALUES (9, 280, 'v')").hot_rows == 1
    assert state(e) == sorted([(1, 11, "A!"), (2, 20, "b"), (3, 111, "C!"), (5, 251, "E!"), (12, 20, None), (13, 111, None), (15, 251, None), (9, 280, "v")])
    assert not e.catalog.pinned(e.table("trips").id)
    before = state(e)
    for bad in ("SELECT 1", "UPDATE trips SET id = 1", "UPDATE trips SET val = 'a', val = 'b'", "UPDATE trips AS t SET val = 'x'", "DELETE FROM trips WHERE id IN (SELECT 1)", "INSERT OVERWRITE trips VALUES (1, 2, 'x')", "INSERT INTO trips (id, id) VALUES (1, 2)"):
        with pytest.raises(WriteRejected):
            e.execute(bad)
    with pytest.raises(Exception):  # noqa: B017
        e.execute("UPDATE trips SET val = nope")
    assert state(e) == before
    assert e.execute("DELETE FROM trips").rows == 8 and state(e) == []
