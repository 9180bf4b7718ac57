import json

from thermocline.operators.schema_drift import latest_names, promote, rescue_ingest, schema_changes, target_schemas, typed_table

COLS = "table_id long, relation_lsn long, ordinal int, name string, is_key boolean, type_oid long, type_mod int, column_type string, lsn string"


def schema(t, lsn, *cols):
    return [(t, lsn, i + 1, c[0], i == 0, c[1], c[2] if len(c) > 2 else -1, c[3] if len(c) > 3 else None, "x") for i, c in enumerate(cols)]


HISTORY = [
    *schema(1, 10, ("id", 20), ("a", 25), ("b", 23), ("c", 1700, 655366)),
    *schema(1, 20, ("id", 20), ("a2", 25, -1, "TEXT"), ("b", 20), ("c", 1700, 655366)),
    *schema(1, 30, ("id", 20), ("a2", 25), ("c", 1700, 786438), ("d", 16)),
    *schema(2, 5, ("id", 20)),
    *schema(3, 1, ("id", 20), ("x", 25)),
    *schema(3, 2, ("id", 20), ("x ", 25)),
]


def test_changes(spark, rows):
    df = spark.createDataFrame(HISTORY[::-1] + HISTORY[:3] + [(None, 1, 1, "z", True, 20, -1, None, ""), (9, None, 1, "z", True, 20, -1, None, ""), (9, 1, 1, None, True, 20, -1, None, "")], COLS)
    assert rows(schema_changes(df)) == sorted(
        [(1, 20, "renamed", "a", "a2"), (1, 20, "retyped", "b", "b"), (1, 30, "removed", "b", ""), (1, 30, "retyped", "c", "c"), (1, 30, "added", "", "d"), (3, 2, "renamed", "x", "x ")], key=lambda r: tuple((True, str(x)) for x in r)
    )
    assert schema_changes(spark.createDataFrame([], COLS)).count() == 0


def test_rename_needs_the_same_place_and_type(spark, rows):
    df = spark.createDataFrame([*schema(1, 1, ("id", 20), ("a", 25), ("b", 25)), *schema(1, 2, ("id", 20), ("n", 16), ("b", 25))], COLS)
    assert rows(schema_changes(df)) == sorted([(1, 2, "removed", "a", ""), (1, 2, "added", "", "n")], key=lambda r: tuple((True, str(x)) for x in r))


def test_names_follow_renames(spark):
    df = spark.createDataFrame(HISTORY, COLS)
    got = {(r["table_id"], r["relation_lsn"], r["name"]): r["target_name"] for r in latest_names(df).collect()}
    assert got[1, 10, "a"] == "a2" and got[1, 20, "a2"] == "a2" and got[1, 10, "b"] is None and got[1, 20, "b"] is None and got[1, 10, "c"] == "c" and got[3, 1, "x"] == "x "
    assert {(r["table_id"], r["name"]) for r in target_schemas(df).collect()} == {(1, "id"), (1, "a2"), (1, "c"), (1, "d"), (2, "id"), (3, "id"), (3, "x ")}


BATCH = "file_id long, table_id long, relation_lsn long, row_no int, row_json string, fields string"


def ingest(spark, *texts, lsn=10):
    return rescue_ingest(spark.createDataFrame([(1, 1, lsn, i, t, "q") for i, t in enumerate(texts)], BATCH), spark.createDataFrame(HISTORY, COLS))


def test_ingest_enforces_and_rescues(spark):
    long_text = "y" * 100_000
    got = ingest(spark, '{"id":1,"a":"x","b":7,"c":"1.5"}', '{"id":"no","a":null,"c":"oops","zz":{"k":[1]}}', "not json", None, "{}", json.dumps({"id": 5, "a": long_text}))
    by = {r["row_no"]: (r["fields"], json.loads(r["_rescued"]) if r["_rescued"] else None) for r in got.collect()}
    assert by[0] == ({"id": "1", "a2": "x", "c": "1.50"}, {"b": "7"})
    assert by[1] == ({"a2": None}, {"id": "no", "c": "oops", "zz": '{"k":[1]}'})
    assert by[2] == ({}, {"_row": "not json"})
    assert by[3] == ({}, None) and by[4] == ({}, None)
    assert by[5] == ({"id": "5", "a2": long_text}, None)


def test_unknown_schema_and_repeats(spark):
    got = ingest(spark, '{"id":1}', lsn=999).collect()
    assert [(r["fields"], r["_rescued"]) for r in got] == [({}, '{"id":"1"}')]
    twice = spark.createDataFrame([(1, 1, 10, 0, '{"id":1}', "q")] * 3, BATCH)
    assert rescue_ingest(twice, spark.createDataFrame(HISTORY, COLS)).count() == 1
    assert rescue_ingest(twice.limit(0), spark.createDataFrame(HISTORY, COLS)).count() == 0
    assert rescue_ingest(twice, spark.createDataFrame([], COLS)).collect()[0]["_rescued"] == '{"id":"1"}'


def test_promotion_replays_rescued_values(spark):
    done = ingest(spark, '{"id":1,"b":"7"}', '{"id":2,"b":"seven"}', '{"id":3}')
    approved = spark.createDataFrame([(1, "b", "LONG", -1)], "table_id long, name string, column_type string, type_mod int")
    by = {r["row_no"]: (r["fields"], r["_rescued"]) for r in promote(done, approved).collect()}
    assert by == {0: ({"id": "1", "b": "7"}, None), 1: ({"id": "2"}, '{"b":"seven"}'), 2: ({"id": "3"}, None)}


def test_typed_table(spark):
    done = ingest(spark, '{"id":1,"a":"x","c":"2.345"}')
    table = typed_table(done, [("id", "LONG", -1), ("a2", "TEXT", -1), ("c", "DECIMAL", 655366), ("d", "BOOLEAN", -1)], 1)
    assert [t for _, t in table.dtypes] == ["bigint", "int", "bigint", "string", "decimal(10,2)", "boolean", "string"]
    assert str(table.first()["c"]) == "2.35"
