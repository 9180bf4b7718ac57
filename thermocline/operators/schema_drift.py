"""Schemas that drift: changes between announced schemas, and one consistent table by rescue-column ingestion.

Raw rows are read under the schema they were written with.  Fields of the enforced target
schema become typed values; unknown fields and values that can't be read as the target type
are kept as JSON in a rescue column.  Approved fields are promoted later by replaying the
rescued values into typed columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from thermocline.functions.column_types import SPARK_TYPE, canonical_value, column_type
from thermocline.operators.support import small_side, written

RESCUE = "_rescued"


def announced_schemas(relation_columns: DataFrame) -> DataFrame:
    """One row per column of each schema, whatever the order and number of announcements.

    Rows without table, position or name are ignored.  A missing column type follows from the
    type identifier and modifier.
    """
    kind = column_type(F.col("column_type"), F.col("type_oid"), F.col("type_mod"))
    rows = relation_columns.where(F.col("table_id").isNotNull() & F.col("relation_lsn").isNotNull() & F.col("name").isNotNull())
    rows = rows.select("table_id", "relation_lsn", "name", F.struct(F.col("ordinal"), F.col("type_oid"), F.col("type_mod"), kind.alias("column_type"), F.coalesce(F.col("is_key"), F.lit(False)).alias("is_key")).alias("c"))
    return rows.groupBy("table_id", "relation_lsn", "name").agg(F.max("c").alias("c")).select("table_id", "relation_lsn", "name", "c.*")


def _successions(schemas: DataFrame) -> DataFrame:
    """``table_id, relation_lsn, next_lsn``; next_lsn is null for the latest schema."""
    known = schemas.select("table_id", "relation_lsn").distinct()
    return known.withColumn("next_lsn", F.lead("relation_lsn").over(Window.partitionBy("table_id").orderBy("relation_lsn")))


def _steps(schemas: DataFrame) -> DataFrame:
    """Old and new columns of every succession side by side: by name, else by ordinal and type."""
    steps = _successions(schemas).where(F.col("next_lsn").isNotNull())
    fields = ["ordinal", "type_oid", "type_mod", "column_type"]
    old = schemas.join(steps, ["table_id", "relation_lsn"]).select("table_id", F.col("next_lsn").alias("lsn"), "name", F.struct(*fields).alias("old"))
    new = schemas.join(steps.select("table_id", F.col("next_lsn").alias("relation_lsn")), ["table_id", "relation_lsn"]).select("table_id", F.col("relation_lsn").alias("lsn"), "name", F.struct(*fields).alias("new"))
    return old.join(new, ["table_id", "lsn", "name"], "full_outer")


def schema_changes(relation_columns: DataFrame) -> DataFrame:
    """``table_id, relation_lsn, change_kind, old_name, new_name`` of every change from a schema to the next.

    ``retyped``: name in both, type identifier or modifier differs.  ``renamed``: a name that is
    gone and one that is new, at the same ordinal and of the same column type.  Other names that
    are gone are ``removed``, others that are new ``added``; the missing name is an empty text.
    Names compare exactly.  Tables with one schema have no changes.
    """
    both = _steps(announced_schemas(relation_columns))
    stays = F.col("old").isNotNull() & F.col("new").isNotNull()
    retyped = both.where(stays & (~F.col("old.type_oid").eqNullSafe(F.col("new.type_oid")) | ~F.col("old.type_mod").eqNullSafe(F.col("new.type_mod"))))
    retyped = retyped.select("table_id", "lsn", F.lit("retyped").alias("change_kind"), F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    moved = _moved(both)
    kind = F.when(F.col("old_name").isNull(), "added").when(F.col("new_name").isNull(), "removed").otherwise("renamed")
    rest = moved.select("table_id", "lsn", kind.alias("change_kind"), F.coalesce("old_name", F.lit("")).alias("old_name"), F.coalesce("new_name", F.lit("")).alias("new_name"))
    return retyped.unionByName(rest).withColumnRenamed("lsn", "relation_lsn")


def _moved(both: DataFrame) -> DataFrame:
    """Names that are gone or new, those of one ordinal and column type side by side.

    If an ordinal is announced for several names, the lowest gone name pairs with the lowest new one, and so on.
    """
    at = ["table_id", "lsn", "ordinal", "column_type"]
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("name"))
    side = lambda df, from_, name: df.select("table_id", "lsn", F.col(f"{from_}.ordinal").alias("ordinal"), F.col(f"{from_}.column_type").alias("column_type"), "name").withColumn("r", rank).withColumnRenamed("name", name)
    gone = side(both.where(F.col("new").isNull()), "old", "old_name")
    fresh = side(both.where(F.col("old").isNull()), "new", "new_name")
    return gone.join(fresh, [*at, "r"], "full_outer")


def latest_names(relation_columns: DataFrame) -> DataFrame:
    """Where each column of each schema ended up: ``table_id, relation_lsn, name, target_name``.

    ``target_name`` follows renames to the latest schema and is null for a column removed on the
    way.  The chains are followed by pointer doubling: as many joins as the logarithm of the
    longest history, none of them growing; each step is written, so the plan doesn't double.
    """
    schemas = written(announced_schemas(relation_columns), "schemas")
    steps = _successions(schemas)
    both = written(_steps(schemas), "schema-steps")
    kept = both.where(F.col("old").isNotNull() & F.col("new").isNotNull()).select("table_id", "lsn", F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    renamed = _moved(both).where(F.col("old_name").isNotNull() & F.col("new_name").isNotNull()).select("table_id", "lsn", "old_name", "new_name")
    moves = kept.unionByName(renamed).select("table_id", F.col("lsn").alias("next_lsn"), F.col("old_name").alias("name"), "new_name")
    hop = schemas.select("table_id", "relation_lsn", "name").join(steps, ["table_id", "relation_lsn"]).join(moves, ["table_id", "next_lsn", "name"], "left")
    # the latest schema points at itself; a removed column points at nothing
    hop = hop.select("table_id", "relation_lsn", "name", F.coalesce("next_lsn", "relation_lsn").alias("to_lsn"), F.when(F.col("next_lsn").isNull(), F.col("name")).otherwise(F.col("new_name")).alias("to_name"))
    most = steps.groupBy("table_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(0, (most - 1).bit_length())):
        hop = written(hop, "schema-hops")
        onward = hop.select("table_id", F.col("relation_lsn").alias("to_lsn"), F.col("name").alias("to_name"), F.col("to_lsn").alias("l2"), F.col("to_name").alias("n2"))
        hop = hop.join(onward, ["table_id", "to_lsn", "to_name"], "left").select("table_id", "relation_lsn", "name", F.coalesce("l2", "to_lsn").alias("to_lsn"), F.col("n2").alias("to_name"))
    return hop.select("table_id", "relation_lsn", "name", F.col("to_name").alias("target_name"))


def target_schemas(relation_columns: DataFrame) -> DataFrame:
    """Columns of the latest schema of each table: the schema that ingestion enforces."""
    schemas = announced_schemas(relation_columns)
    last = _successions(schemas).where(F.col("next_lsn").isNull()).select("table_id", "relation_lsn")
    return schemas.join(last, ["table_id", "relation_lsn"]).select("table_id", "ordinal", "name", "type_oid", "type_mod", "column_type", "is_key")


def rescue_ingest(row_batches: DataFrame, relation_columns: DataFrame) -> DataFrame:
    """``table_id, file_id, row_no, relation_lsn, fields, _rescued``: one row per raw row.

    ``fields`` (map) has the canonical text of every target column that the row has; ``_rescued``
    is a JSON object of the rest under the names they were written with: fields unknown to the
    schema, fields removed since and values that can't be read as the target type; null if there
    are none.  A null field stays a null value.  A row that isn't a JSON object is rescued whole
    under ``_row``; rows of a schema that was never announced are rescued field by field.
    Exact repeats of a raw row are one row.
    """
    key = ["table_id", "file_id", "row_no", "relation_lsn"]
    raw = row_batches.select(*key, "row_json").distinct()
    names = latest_names(relation_columns).join(target_schemas(relation_columns).select("table_id", F.col("name").alias("target_name"), "column_type", "type_mod"), ["table_id", "target_name"])
    # one map per schema, from the name written to the target: it grows with the schemas, not with the rows, and is broadcast when counted small
    per = names.groupBy(F.col("table_id").alias("_t"), F.col("relation_lsn").alias("_l")).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("target_name", "column_type", "type_mod")))).alias("_targets"))
    rows = raw.join(small_side(per), (F.col("table_id") == F.col("_t")) & (F.col("relation_lsn") == F.col("_l")), "left")
    readable = F.json_object_keys("row_json").isNotNull()
    cells = F.map_entries(F.when(readable, F.from_json("row_json", "map<string,string>")))
    none = F.lit(None).cast("struct<target_name:string,column_type:string,type_mod:int>")

    def read(cell):
        target = F.coalesce(F.try_element_at("_targets", cell["key"]), none)
        value = canonical_value(cell["value"], target["column_type"], target["type_mod"])
        typed = target["target_name"].isNotNull() & (cell["value"].isNull() | value.isNotNull())
        return F.struct(cell["key"].alias("key"), cell["value"].alias("value"), target["target_name"].alias("target"), value.alias("read"), typed.alias("typed"))

    rows = rows.select(*key, "row_json", readable.alias("_readable"), F.transform(F.coalesce(cells, F.array().cast("array<struct<key:string,value:string>>")), read).alias("_cells"))
    good = F.transform(F.filter("_cells", lambda c: c["typed"]), lambda c: F.struct(c["target"].alias("key"), c["read"].alias("value")))
    bad = F.transform(F.filter("_cells", lambda c: ~c["typed"]), lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))
    rescued = F.when(~F.col("_readable") & F.col("row_json").isNotNull(), F.to_json(F.create_map(F.lit("_row"), F.col("row_json")))).when(F.size(bad) > 0, F.to_json(F.map_from_entries(F.array_sort(bad)), {"ignoreNullFields": "false"}))
    return rows.select(*key, F.map_from_entries(F.array_sort(good)).alias("fields"), rescued.alias(RESCUE))


def promote(ingested: DataFrame, approved: DataFrame) -> DataFrame:
    """Replays rescued values of approved fields into typed values.

    ``approved`` has ``table_id, name, column_type, type_mod``.  A rescued value that can be read
    as the approved type moves into ``fields``; the rest stays rescued.  A field that is typed
    already is left as it is.
    """
    wanted = approved.groupBy("table_id").agg(F.collect_list(F.struct("name", "column_type", "type_mod")).alias("_wanted"))
    key = ["table_id", "file_id", "row_no", "relation_lsn"]
    rows = ingested.join(wanted, "table_id", "left")
    kept = F.from_json(RESCUE, "map<string,string>")
    cell = rows.where(F.col("_wanted").isNotNull() & F.col(RESCUE).isNotNull()).select(*key, F.explode(kept).alias("name", "value"), "_wanted")
    cell = cell.select(*key, "name", "value", F.try_element_at(F.filter("_wanted", lambda w: w["name"] == F.col("name")), F.lit(1)).alias("w"))
    read = canonical_value(F.col("value"), F.col("w.column_type"), F.col("w.type_mod"))
    ok = F.col("w").isNotNull() & (F.col("value").isNull() | read.isNotNull())
    pair = lambda v: F.struct(F.col("name").alias("key"), v.alias("value"))
    moved = cell.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(ok, pair(read)))).alias("_good"), F.collect_list(F.when(~ok, pair(F.col("value")))).alias("_bad"))
    null_safe = None
    for c in key:
        same = ingested[c].eqNullSafe(F.col(f"_k_{c}"))
        null_safe = same if null_safe is None else null_safe & same
    joined = ingested.join(moved.select(*[F.col(c).alias(f"_k_{c}") for c in key], "_good", "_bad"), null_safe, "left")
    fields = F.when(F.col("_good").isNull(), F.col("fields")).otherwise(F.map_concat(F.map_filter("_good", lambda k, v: ~F.map_contains_key("fields", k)), F.col("fields")))
    left = F.when(F.col("_good").isNull(), F.col(RESCUE)).when(F.size("_bad") > 0, F.to_json(F.map_from_entries("_bad"), {"ignoreNullFields": "false"}))
    return joined.select(*key, fields.alias("fields"), left.alias(RESCUE))


def typed_table(ingested: DataFrame, columns: Sequence[tuple[str, str, int]], table_id: int) -> DataFrame:
    """The consistent table of one registered table: file, row number, typed columns in order and the rescue column.

    ``columns`` lists ``(name, column_type, type_mod)``.
    """

    def typed(name: str, kind: str, mod: int):
        text = F.col("fields").getItem(name)
        if kind == "DECIMAL":
            packed = mod - 4
            return text.try_cast(T.DecimalType(packed >> 16 & 0xFFFF, packed & 0xFFFF))
        if kind == "BINARY":
            return F.unhex(F.substr(text, F.lit(3)))
        return text.try_cast(SPARK_TYPE[kind])

    return ingested.where(F.col("table_id") == table_id).select("file_id", "row_no", *[typed(*c).alias(c[0]) for c in columns], RESCUE)


__all__ = ["RESCUE", "announced_schemas", "latest_names", "promote", "rescue_ingest", "schema_changes", "target_schemas", "typed_table"]
