import struct

import pytest
from pyspark.sql import types as T

from thermocline.engine import Engine
from thermocline.functions.keys import TierKeyType
from thermocline.sources.jsonl import BadRow, read_free_jsonl, read_jsonl
from thermocline.sources.pgoutput import UNCHANGED, Decoder, ProtocolError, change_rows
from thermocline.streaming.mirror import SchemaDiverged, StreamError, change_schema, classify_schema, collapse

SCHEMA = "id long, vin string, last_seen long"


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.register("fleet", SCHEMA, ["id"], "last_seen", mode="mirrored")
    yield e
    e.close()


def changes(e, *rows):
    return e.spark.createDataFrame([(p, s, k, n, o, u or []) for p, s, k, n, o, u in rows], change_schema(e.table("fleet").schema))


def lake(e):
    t = e.table("fleet")
    return sorted(tuple(r) for r in t.lake.scan(t.lake.snapshot(t.cut().s)).collect())


def test_mirror_applies_each_change_once(engine):
    e = engine
    first = changes(e, (10, 1, "insert", (1, "V1", 100), None, None), (10, 2, "insert", (2, "V2", 200), None, None), (20, 3, "update", (1, "V1b", 150), None, None), (20, 4, "delete", None, (2, None, None), None))
    assert e.apply_changes("fleet", first) == 20 and lake(e) == [(1, "V1b", 150)]
    s = e.table("fleet").cut().s
    assert e.apply_changes("fleet", first) == 20 and e.table("fleet").cut().s == s
    second = changes(e, (30, 5, "update", (9, "V1b", 160), (1, "V1b", 150), None), (40, 6, "update", (9, None, 170), (9, "keep", 160), ["vin"]))
    e.apply_changes("fleet", second)
    assert lake(e) == [(9, "keep", 170)]
    assert e.apply_changes("fleet", first.limit(0), up_to=99) == 99 and e.catalog.frontier(e.table("fleet").id) == 99


def test_mirror_recovers_after_a_crash(engine):
    e = engine
    batch = changes(e, (10, 1, "insert", (1, "V1", 100), None, None))
    e.crash_at("after-mirror-commit")
    with pytest.raises(RuntimeError):
        e.apply_changes("fleet", batch)
    assert e.catalog.frontier(e.table("fleet").id) is None
    e.apply_changes("fleet", batch)
    assert lake(e) == [(1, "V1", 100)] and e.catalog.frontier(e.table("fleet").id) == 10


def test_what_ends_the_stream(engine):
    e = engine
    for row in ((10, 1, "truncate", None, None, None), (10, 1, "update", (1, None, 5), None, ["vin"]), (10, 1, "insert", (None, "x", 5), None, None), (10, 1, "insert", (1, "x", None), None, None)):
        with pytest.raises(StreamError):
            e.apply_changes("fleet", changes(e, row))
    assert lake(e) == []


def test_collapse_ties_and_moves(engine, rows):
    got = collapse(changes(engine, (1, 1, "insert", (1, "a", 1), None, None), (1, 2, "delete", None, (1, None, None), None), (2, 3, "insert", (1, "b", 2), None, None), (2, 4, "update", (2, "b", 2), (1, "b", 2), None)), ["id"], ["id", "vin", "last_seen"])
    assert rows(got.select("pk", "op")) == [("1", 1), ("2", 0)]


def test_schema_classes(engine):
    old = T._parse_datatype_string(SCHEMA)
    assert [f.name for f in classify_schema(old, T._parse_datatype_string("id int, vin string, last_seen long, color string"))] == ["color"]
    for bad in ("id long, last_seen long", "vin string, id long, last_seen long", "id long, code string, last_seen long", "id string, vin string, last_seen long"):
        with pytest.raises(SchemaDiverged):
            classify_schema(old, T._parse_datatype_string(bad))
    engine.apply_changes("fleet", changes(engine, (10, 1, "insert", (1, "V1", 100), None, None)))
    assert engine.evolve("fleet", T._parse_datatype_string(SCHEMA + ", color string")) == ["color"]
    assert lake(engine) == [(1, "V1", 100, None)]


def test_streams_to_completion(engine, tmp_path):
    e = engine
    schema = change_schema(e.table("fleet").schema)
    for i in range(3):
        e.spark.createDataFrame([(10 * i + 1, i, "insert", (i, f"V{i}", i), None, [])], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: e.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = e.mirror_stream("fleet", stream(), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert [r[0] for r in lake(e)] == [0, 1, 2] and e.catalog.frontier(e.table("fleet").id) == 21
    e.register("t", "id long, k long", ["id"], "k", partitions=[(0, 100)])
    e.spark.range(5).selectExpr("id", "id AS k").write.parquet(str(tmp_path / "rows"))
    q = e.load_stream("t", e.spark.readStream.schema("id long, k long").parquet(str(tmp_path / "rows")), str(tmp_path / "checkpoint2"))
    q.awaitTermination(120)
    assert e.read("t").df.count() == 5 and e.catalog.loads(e.table("t").id, "committed")[0]["label"] == "batch-0"


def test_resumable_copy_and_heap_retention(engine):
    e = engine
    e.load_heap("fleet", e.spark.range(25).selectExpr("id", "concat('V', id) AS vin", "id AS last_seen"))
    assert not e.initial_copy("fleet", 7, chunk_rows=10, most_chunks=1)
    assert len(lake(e)) == 10 and e.catalog.copy_progress(e.table("fleet").id)["last_key"] == '["9"]'
    assert e.initial_copy("fleet", 7, chunk_rows=10)
    assert len(lake(e)) == 25 and e.catalog.frontier(e.table("fleet").id) == 7 and e.verify("fleet")["ok"]
    e.register("aged", SCHEMA, ["id"], "last_seen", mode="mirrored", heap_retention=10, partitions=[(0, 10), (10, 20), (20, 30)])
    e.load_heap("aged", e.spark.range(25).selectExpr("id", "concat('V', id) AS vin", "id AS last_seen"))
    e.initial_copy("aged", 5)
    assert e.expire_mirrored_heap("aged", newest=9) is None  # the mirror has to pass 9 first
    assert e.expire_mirrored_heap("aged", newest=9) is None
    e.catalog.advance_frontier(e.table("aged").id, 9)
    assert e.expire_mirrored_heap("aged", newest=12) == 10
    assert e.read("aged").df.count() == 25 and e.table("aged").heap().count() == 15


def test_hybrid_read(engine):
    e = engine
    e.load_heap("fleet", e.spark.range(20).selectExpr("id", "'v' AS vin", "id AS last_seen"))
    e.initial_copy("fleet", 7)
    e.note_position("fleet", 7)
    with e.read("fleet", hybrid=True, hybrid_lag=5) as df:
        assert df.count() == 20 and "lake" in str(df.inputFiles()) and "/heap/" in str(df.inputFiles())
    e.note_position("fleet", 8)
    with e.read("fleet", hybrid=True, mirror_wait_ms=60) as df:
        assert df.count() == 20 and "lake" not in str(df.inputFiles())


def text(value):
    return b"t" + struct.pack(">I", len(value)) + value


def messages():
    relation = b"R" + struct.pack(">I", 7) + b"public\0fleet\0d" + struct.pack(">H", 3)
    for flag, name, oid in ((1, b"id", 20), (0, b"vin", 25), (0, b"last_seen", 20)):
        relation += bytes([flag]) + name + b"\0" + struct.pack(">Ii", oid, -1)
    row = lambda *v: struct.pack(">H", 3) + b"".join(v)
    yield b"B" + struct.pack(">QQI", 100, 0, 5)
    yield relation
    yield b"I" + struct.pack(">I", 7) + b"N" + row(text(b"1"), text(b"V1"), text(b"10"))
    yield b"U" + struct.pack(">I", 7) + b"O" + row(text(b"1"), text(b"V1"), text(b"10")) + b"N" + row(text(b"1"), b"u", text(b"11"))
    yield b"D" + struct.pack(">I", 7) + b"K" + row(text(b"2"), b"n", b"n")
    yield b"C" + bytes([0]) + struct.pack(">QQQ", 100, 120, 0)
    yield b"T" + struct.pack(">I", 1) + bytes([0]) + struct.pack(">I", 7)
    yield b"Y" + b"anything"


def test_decoder():
    d = Decoder()
    kinds = [d.decode(m) for m in messages()]
    assert [k.kind for k in kinds] == ["begin", "relation", "insert", "update", "delete", "commit", "truncate", "skipped"]
    assert kinds[2].new == {"id": "1", "vin": "V1", "last_seen": "10"} and kinds[3].new["vin"] is UNCHANGED and kinds[4].old == {"id": "2"}
    assert kinds[5].position == 120 and kinds[1].relation.columns[0] == ("id", True, 20, -1)
    for bad in (b"Z", b"I" + struct.pack(">I", 99) + b"N", b"B\0", b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", 1)):
        with pytest.raises(ProtocolError):
            d.decode(bad)
    got = list(change_rows(iter(messages()), "fleet"))
    assert [(g["position"], g["kind"], g["unchanged"]) for g in got] == [(120, "insert", []), (120, "update", ["vin"]), (120, "delete", [])]


def test_decoded_changes_reach_the_lake(engine):
    e = engine
    cast = lambda r: None if r is None else tuple(int(v) if k != "vin" and v is not None else v for k, v in ((c, r.get(c)) for c in ("id", "vin", "last_seen")))
    rows = [(g["position"], g["seq"], g["kind"], cast(g["new"]), cast(g["old"]), g["unchanged"]) for g in change_rows(iter(messages()), "fleet")]
    e.apply_changes("fleet", changes(e, *rows))
    assert lake(e) == [(1, "V1", 11)]


def test_jsonl(spark, tmp_path):
    schema = T._parse_datatype_string("id long, k long, v string")
    write = lambda *lines: (tmp_path / "x.jsonl").write_text("\n".join(lines)) and str(tmp_path / "x.jsonl")
    key = TierKeyType("bigint")
    got = read_jsonl(spark, write('{"id":1,"k":5,"v":"a"}', "", '{"k":6,"id":2}'), schema, tier_column="k", key=key, low=0, high=10)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, "a"), (2, 6, None)]
    for line, what in (('{"id":1,"zz":2}', "unknown column zz"), ("[1]", "no JSON object"), ("oops", "no JSON object"), ('{"id":"x","k":5}', "column id"), ('{"id":1,"k":99}', "window"), ('{"id":1}', "no tier key")):
        with pytest.raises(BadRow, match=what):
            read_jsonl(spark, write('{"id":1,"k":5}', line), schema, tier_column="k", key=key, low=0, high=10)
    assert read_free_jsonl(spark, write('{"a":1}', '{"b":"x"}')).count() == 2
    with pytest.raises(BadRow):
        read_free_jsonl(spark, write('{"a":[1]}'))
