"""Queries of the data-preparation operators of the core: problems 1 to 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.functions.keys import key_text_by_names, micros
from thermocline.functions.positions import parse_position_rank, position_rank
from thermocline.operators import change_replay, consolidate, copy_diff, incremental, intervals, schema_drift
from thermocline.operators.support import scratch_path, small_side, table, written

COPY_FIELDS = ("id", "tenant", "vin", "event_time", "last_seen", "ts", "val", "status", "active", "lat", "lon", "celsius", "psi")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys after every delivered change has been applied: the feed has ended, so no hole and no transaction holds anything back."""
    return _replayed(spark, sf_dir, True).select("table_id", "pk", "arrival_seq")


def _replayed(spark: SparkSession, sf_dir: str, final: bool) -> DataFrame:
    """Live rows of all tables.  The feed declares no sizes of transactions, so none can be told to be incomplete."""
    feed = table(spark, sf_dir, "delta_feed", "arrival_seq", "table_id", "pk", "op", "tombstone", "version")
    deleted = F.coalesce(F.col("op") == 1, F.lit(False)) | F.coalesce(F.col("tombstone"), F.lit(False))
    state = change_replay.replay(feed, ["table_id", "pk"], "version", "arrival_seq", deleted, sequence="arrival_seq", final=final)
    return change_replay.live_rows(state)


P1_FOUND = """
SELECT table_id, pk, arrival_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY table_id, pk ORDER BY version DESC, arrival_seq DESC) AS r
  FROM delta_feed WHERE pk IS NOT NULL AND version IS NOT NULL)
WHERE r = 1 AND NOT (coalesce(op = 1, false) OR coalesce(tombstone, false))
"""


def p1_watermark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys of an open feed: only what lies below the first hole in the order of arrival."""
    return _replayed(spark, sf_dir, False).groupBy("table_id").agg(F.count(F.lit(1)).alias("live_keys"), F.max("version").alias("newest_version"))


def p1_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions of the mirrored tables as they are assembled from deliveries."""
    feed = table(spark, sf_dir, "delta_feed", "arrival_seq", "table_id", "pk", "version", "commit_lsn").where(F.col("pk").isNotNull() & F.col("version").isNotNull())
    found = change_replay.assemble(feed, ["table_id", "commit_lsn"], "commit_lsn", ["table_id", "pk", "version"], arrival="arrival_seq")
    return found.select("table_id", "commit_lsn", "changes", "first_arrival", "last_arrival")


P1_TRANSACTIONS = """
SELECT table_id, commit_lsn, count(*) AS changes, min(arrival_seq) AS first_arrival, max(arrival_seq) AS last_arrival FROM delta_feed
WHERE pk IS NOT NULL AND version IS NOT NULL AND commit_lsn IS NOT NULL GROUP BY table_id, commit_lsn
"""


P1_WATERMARK_STATE = """
WITH numbered AS (SELECT arrival_seq, row_number() OVER (ORDER BY arrival_seq) AS r, min(arrival_seq) OVER () AS lo FROM (SELECT DISTINCT arrival_seq FROM delta_feed)),
mark AS (SELECT max(arrival_seq) AS top FROM numbered WHERE arrival_seq - lo + 1 = r),
last AS (SELECT *, row_number() OVER (PARTITION BY table_id, pk ORDER BY version DESC, arrival_seq DESC) AS r
  FROM delta_feed, mark WHERE pk IS NOT NULL AND version IS NOT NULL AND arrival_seq <= top)
SELECT table_id, count(*) AS live_keys, max(version) AS newest_version FROM last
WHERE r = 1 AND NOT (coalesce(op = 1, false) OR coalesce(tombstone, false)) GROUP BY table_id
"""


def _copy_side(df: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows below the cut-line of their table, with key text."""
    kinds = dict(df.dtypes)
    at = F.lit(None).cast("long")
    for name in ("event_time", "last_seen", "id", "tenant"):
        at = F.when(F.col("tier_key_col") == name, F.col(name)).otherwise(at)
    at = F.when(F.col("tier_key_col") == "ts", micros(F.col("ts"), kinds["ts"])).otherwise(at)
    pk = key_text_by_names(F.col("primary_key_cols"), {c: F.col(c) for c in ("id", "tenant", "vin")})
    return df.select("table_id", *COPY_FIELDS).join(tables, "table_id").where(at < F.col("tier_key_hi")).withColumn("pk", pk)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows missing on one side and differing fields of heap and lake below the cut-line."""
    registry = table(spark, sf_dir, "registered_tables").where(F.col("keep_heap")).select("table_id", "primary_key_cols", "tier_key_col")
    tables = small_side(registry.join(table(spark, sf_dir, "cutline", "table_id", "tier_key_hi"), "table_id"))
    heap = _copy_side(table(spark, sf_dir, "heap_copy"), tables)
    lake = _copy_side(table(spark, sf_dir, "lake_copy"), tables)
    return copy_diff.copy_differences(heap, lake, COPY_FIELDS)


_KEY_PART = "replace(replace({0}, '\\', '\\\\'), chr(31), '\\' || chr(31))"
_TENANT, _VIN = _KEY_PART.format("CAST(tenant AS VARCHAR)"), _KEY_PART.format("vin")
_ID_PART = _KEY_PART.format("CAST(id AS VARCHAR)")
KEY_TEXT_SQL = f"""CASE WHEN len(primary_key_cols) = 1 THEN CASE primary_key_cols[1] WHEN 'id' THEN CAST(id AS VARCHAR) WHEN 'tenant' THEN CAST(tenant AS VARCHAR) ELSE vin END
  ELSE (CASE primary_key_cols[1] WHEN 'id' THEN {_ID_PART} WHEN 'tenant' THEN {_TENANT} ELSE {_VIN} END) || chr(31) || (CASE primary_key_cols[2] WHEN 'id' THEN {_ID_PART} WHEN 'tenant' THEN {_TENANT} ELSE {_VIN} END) END"""


def _p2_sql() -> str:
    side = f"""SELECT DISTINCT c.*, {KEY_TEXT_SQL} AS pk FROM {{0}} c JOIN registered_tables r USING (table_id) JOIN cutline k USING (table_id)
      WHERE keep_heap AND CASE tier_key_col WHEN 'event_time' THEN event_time WHEN 'last_seen' THEN last_seen WHEN 'ts' THEN epoch_us(ts) END < tier_key_hi"""
    differs = "\n".join(f"UNION SELECT h.table_id, h.pk, 'differs', '{c}' FROM h JOIN l USING (table_id, pk) WHERE h.{c} IS DISTINCT FROM l.{c}" for c in COPY_FIELDS)
    return f"""
WITH h AS ({side.format("heap_copy")}), l AS ({side.format("lake_copy")})
SELECT table_id, pk, 'heap_only' AS kind, '' AS field_name FROM h ANTI JOIN l USING (table_id, pk)
UNION SELECT table_id, pk, 'lake_only', '' FROM l ANTI JOIN h USING (table_id, pk)
{differs}"""


P2_FOUND = _p2_sql()


def mirror_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, position``: how far the mirror of each table got; the rank of an unsigned log position, null where nothing is recorded."""
    log = table(spark, sf_dir, "op_log", "table_id", "op_kind", "phase", "details")
    commit = parse_position_rank(F.get_json_object("details", "$['commit-lsn']"))
    journal = log.where((F.col("op_kind") == "mirror") & F.col("phase").isin("committed", "advanced")).select("table_id", commit.alias("position"))
    cut = table(spark, sf_dir, "cutline", "table_id", "replicated_lsn").select("table_id", position_rank(F.col("replicated_lsn")).alias("position"))
    copying = table(spark, sf_dir, "copy_progress", "table_id", "consistent_point").groupBy("table_id").agg(F.max(position_rank(F.col("consistent_point"))).alias("copied"), F.lit(True).alias("in_copy"))
    best = journal.unionByName(cut).groupBy("table_id").agg(F.max("position").alias("position"))
    joined = best.join(copying, "table_id", "full_outer")
    return joined.select("table_id", F.when(F.col("in_copy"), F.col("copied")).otherwise(F.col("position")).alias("position"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and heap rows that the next run of each mirrored table has to take.

    The target keeps the key, position and version of every source row it was made from.  Its first
    version is adopted from the records of the runs so far; the next run joins the source against
    it, takes what it doesn't hold and publishes that as the second version.
    """
    source = written(_p3_source(spark, sf_dir), "incremental-source")
    target = incremental.IncrementalTarget(spark, scratch_path(spark, "incremental-target"), ["table_id", "kind", "pk", "position"], "version")
    target.adopt(source.where("done"))
    if not target.run(source.drop("done")):
        return source.limit(0).select("table_id", "kind", "pk", "version")
    return target.added().select("table_id", "kind", "pk", "version").distinct()


def _p3_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, kind, pk, position, version, done``: changes and heap rows of the mirrored tables and whether an earlier run took them."""
    registry = table(spark, sf_dir, "registered_tables", "table_id", "mode", "primary_key_cols").where(F.col("mode") == "mirrored")
    feed = table(spark, sf_dir, "delta_feed", "table_id", "pk", "version", "commit_lsn").where(F.col("pk").isNotNull() & F.col("version").isNotNull())
    upto = mirror_frontiers(spark, sf_dir).where(F.col("position").isNotNull()).select(F.col("table_id").alias("_of"), F.col("position").alias("_upto"))
    rank = position_rank(F.col("commit_lsn"))
    changes = feed.join(small_side(registry.select("table_id").distinct()), "table_id", "left_semi").join(small_side(upto), F.col("table_id") == F.col("_of"), "left")
    # a change without position lies below every frontier
    taken = F.col("_upto").isNotNull() & F.coalesce(rank <= F.col("_upto"), F.lit(True))
    changes = changes.select("table_id", F.lit("change").alias("kind"), "pk", rank.alias("position"), "version", taken.alias("done"))

    progress = table(spark, sf_dir, "copy_progress", "table_id", "last_pk_text").join(registry.drop("mode"), "table_id")
    heap = table(spark, sf_dir, "heap_copy", "table_id", "id", "tenant", "vin").join(small_side(progress), "table_id")
    columns = {c: F.col(c) for c in ("id", "tenant", "vin")}
    copied = ~(F.col("last_pk_text").isNull() | F.coalesce(_after_last(columns), F.lit(False)))
    pk = key_text_by_names(F.col("primary_key_cols"), columns)
    copies = heap.select("table_id", F.lit("copy").alias("kind"), pk.alias("pk"), F.lit(None).cast("long").alias("position"), F.lit(0).cast("long").alias("version"), copied.alias("done"))
    return changes.unionByName(copies.where(F.col("pk").isNotNull()))


def _after_last(columns: dict):
    """Whether the row's key comes after ``last_pk_text``, column by column in the order of ``primary_key_cols``; numbers as numbers."""

    def compared(i: int):
        name, last = F.try_element_at("primary_key_cols", F.lit(i)), F.try_element_at("last_pk_text", F.lit(i))
        sign = F.lit(None).cast("int")
        for known, col in columns.items():
            value = last if known == "vin" else last.try_cast("long")
            sign = F.when(name == known, F.when(col > value, 1).when(col == value, 0).when(col < value, -1)).otherwise(sign)
        return sign

    first, second = compared(1), compared(2)
    return (first == 1) | ((first == 0) & (F.size("primary_key_cols") > 1) & (second == 1))


P3_FOUND = f"""
WITH journal AS (
  SELECT table_id, CASE WHEN contains(v, '/') THEN CAST('0x' || split_part(v, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(v, '/', 2) AS BIGINT) ELSE CAST(v AS BIGINT) END AS lsn
  FROM (SELECT table_id, json_extract_string(details, '$."commit-lsn"') AS v FROM op_log WHERE op_kind = 'mirror' AND phase IN ('committed', 'advanced') AND details IS NOT NULL)
  UNION ALL SELECT table_id, replicated_lsn FROM cutline),
frontier AS (
  SELECT table_id, max(lsn) AS f FROM journal WHERE table_id NOT IN (SELECT table_id FROM copy_progress) GROUP BY table_id
  UNION ALL SELECT table_id, max(consistent_point) FROM copy_progress GROUP BY table_id)
SELECT DISTINCT d.table_id, 'change' AS kind, d.pk, d.version
FROM delta_feed d JOIN registered_tables r USING (table_id) LEFT JOIN frontier USING (table_id)
WHERE mode = 'mirrored' AND pk IS NOT NULL AND version IS NOT NULL AND (f IS NULL OR commit_lsn > f)
UNION ALL
SELECT DISTINCT h.table_id, 'copy', {KEY_TEXT_SQL}, CAST(0 AS BIGINT)
FROM heap_copy h JOIN registered_tables r USING (table_id) JOIN copy_progress p USING (table_id)
WHERE mode = 'mirrored' AND (last_pk_text IS NULL OR CASE
  WHEN primary_key_cols = ['id'] THEN id > CAST(last_pk_text[1] AS BIGINT)
  WHEN primary_key_cols = ['vin'] THEN vin > last_pk_text[1]
  WHEN primary_key_cols = ['tenant', 'vin'] THEN tenant > TRY_CAST(last_pk_text[1] AS BIGINT) OR (tenant = TRY_CAST(last_pk_text[1] AS BIGINT) AND vin > last_pk_text[2])
  WHEN primary_key_cols = ['vin', 'tenant'] THEN vin > last_pk_text[1] OR (vin = last_pk_text[1] AND tenant > TRY_CAST(last_pk_text[2] AS BIGINT)) END)
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change from a schema to the next one of its table."""
    return schema_drift.schema_changes(table(spark, sf_dir, "relation_columns"))


P4_FOUND = """
WITH c AS (
  SELECT DISTINCT table_id, relation_lsn, ordinal, name, type_oid, type_mod, coalesce(column_type, CASE
    WHEN type_oid = 16 THEN 'BOOLEAN' WHEN type_oid = 17 THEN 'BINARY' WHEN type_oid IN (20, 21, 23, 26) THEN 'LONG' WHEN type_oid IN (700, 701) THEN 'DOUBLE'
    WHEN type_oid = 1082 THEN 'DATE' WHEN type_oid IN (1114, 1184) THEN 'TIMESTAMP' WHEN type_oid = 2950 THEN 'UUID'
    WHEN type_oid = 1700 THEN CASE WHEN type_mod >= 4 THEN 'DECIMAL' ELSE 'DOUBLE' END ELSE 'TEXT' END) AS kind FROM relation_columns),
s AS (SELECT table_id, relation_lsn AS old_lsn, lead(relation_lsn) OVER (PARTITION BY table_id ORDER BY relation_lsn) AS lsn FROM (SELECT DISTINCT table_id, relation_lsn FROM c)),
o AS (SELECT s.lsn, c.* FROM s JOIN c ON c.table_id = s.table_id AND c.relation_lsn = s.old_lsn WHERE s.lsn IS NOT NULL),
n AS (SELECT s.lsn, c.* FROM s JOIN c ON c.table_id = s.table_id AND c.relation_lsn = s.lsn),
gone AS (SELECT * FROM o ANTI JOIN n USING (table_id, lsn, name)), fresh AS (SELECT * FROM n ANTI JOIN o USING (table_id, lsn, name)),
m AS (SELECT table_id, lsn, gone.name AS old_name, fresh.name AS new_name FROM gone FULL JOIN fresh USING (table_id, lsn, ordinal, kind))
SELECT table_id, lsn AS relation_lsn, 'retyped' AS change_kind, name AS old_name, name AS new_name FROM o JOIN n USING (table_id, lsn, name)
  WHERE o.type_oid IS DISTINCT FROM n.type_oid OR o.type_mod IS DISTINCT FROM n.type_mod
UNION ALL SELECT table_id, lsn, CASE WHEN old_name IS NULL THEN 'added' WHEN new_name IS NULL THEN 'removed' ELSE 'renamed' END, coalesce(old_name, ''), coalesce(new_name, '') FROM m
"""


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent tables of all registered tables: typed fields of every raw row and what was rescued."""
    done = schema_drift.rescue_ingest(table(spark, sf_dir, "row_batches"), table(spark, sf_dir, "relation_columns"))
    return done.select("table_id", "file_id", "row_no", F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields"), F.col(schema_drift.RESCUE).alias("rescued"))


def p4_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent tables after every field that was removed on the way is approved again, under the type it had last: rescued values become typed ones."""
    columns = table(spark, sf_dir, "relation_columns")
    ingested = written(schema_drift.rescue_ingest(table(spark, sf_dir, "row_batches"), columns), "ingested")
    known = schema_drift.announced_schemas(columns).groupBy("table_id", "name").agg(F.max(F.struct("relation_lsn", "column_type", "type_mod")).alias("last")).select("table_id", "name", "last.column_type", "last.type_mod")
    removed = known.join(schema_drift.target_schemas(columns).select("table_id", "name"), ["table_id", "name"], "left_anti")
    done = schema_drift.promote(ingested, removed)
    return done.select("table_id", "file_id", "row_no", F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields"), F.col(schema_drift.RESCUE).alias("rescued"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files to be merged."""
    files = table(spark, sf_dir, "lake_files")
    found = consolidate.merge_candidates(files, table(spark, sf_dir, "maintenance_plans"), table(spark, sf_dir, "load_labels"))
    return found.select("table_id", "file_id")


_PATH = "regexp_replace(regexp_replace(regexp_replace(url_decode({0}), '^s3[an]?:/+', 's3:/'), '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
_CANDIDATES = f"""
WITH held AS (
  SELECT {_PATH.format("p")} AS path FROM (SELECT unnest(protected_files) AS p FROM maintenance_plans)
  UNION SELECT {_PATH.format("p")} FROM (SELECT unnest(CAST(json_extract_string(staged_files, '$.files[*]') AS VARCHAR[])) AS p FROM load_labels WHERE state = 'staged' AND staged_files IS NOT NULL AND json_valid(staged_files))),
f AS (SELECT table_id, partition_id, file_id, file_size_bytes, record_count, {_PATH.format("file_path")} AS path, delete_count,
    coalesce(TRY_CAST(settings['rewrite_target_bytes'] AS BIGINT), 134217728) AS target_bytes, coalesce(TRY_CAST(settings['rewrite_min_input_files'] AS BIGINT), 8) AS least,
    coalesce(settings['rewrite_enabled'], 'true') <> 'false' AS enabled
  FROM (SELECT * FROM lake_files QUALIFY row_number() OVER (PARTITION BY table_id, file_id ORDER BY created_at DESC, lake_snapshot_id DESC) = 1) LEFT JOIN maintenance_plans USING (table_id)),
c AS (SELECT *, count(*) OVER (PARTITION BY table_id, partition_id) AS n FROM f WHERE enabled AND file_size_bytes < target_bytes AND delete_count = 0 AND path NOT IN (SELECT path FROM held)),
cases AS (SELECT * FROM c WHERE n >= least)
"""
P5_FOUND = _CANDIDATES + "SELECT table_id, file_id FROM cases"


def p5_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger files that the candidates are rolled into."""
    return consolidate.consolidation_plan(table(spark, sf_dir, "lake_files"), table(spark, sf_dir, "maintenance_plans"), table(spark, sf_dir, "load_labels"))


P5_PLAN = _CANDIDATES + """
SELECT table_id, partition_id, output_no, count(*) AS input_files, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, CAST(sum(record_count) AS BIGINT) AS records FROM (
  SELECT *, CAST(floor((sum(file_size_bytes) OVER (PARTITION BY table_id, partition_id ORDER BY file_id) - file_size_bytes) / target_bytes) AS BIGINT) AS output_no FROM cases)
GROUP BY ALL HAVING count(*) > 1
"""


def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries, lying in many small sorted files, after the k-way merge into few."""
    feed = table(spark, sf_dir, "delta_feed", "arrival_seq", "table_id", "pk", "payload")
    folder, made = scratch_path(spark, "small-files"), scratch_path(spark, "merged-files")
    feed.repartition(96, "table_id", "pk").sortWithinPartitions("arrival_seq", "pk").write.parquet(folder)
    listing = consolidate.list_sorted(spark, folder, "arrival_seq")
    done = consolidate.SortedRunMerger(["arrival_seq", "pk"], made).run(consolidate.merge_orders(listing, bytes_per_order=32 << 20))
    if done.isEmpty():
        return feed
    consolidate.check_merge(listing, done)
    return spark.read.schema(feed.schema).parquet(made)


P5_MERGED = "SELECT arrival_seq, table_id, pk, payload FROM delta_feed"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of the partitions of each table and the gaps between them."""
    parts = table(spark, sf_dir, "table_partitions", "table_id", "tier_key_lo", "tier_key_hi", "state").where(~F.col("state").eqNullSafe("dropped"))
    found = intervals.periods_and_gaps(parts, ["table_id"], "tier_key_lo", "tier_key_hi")
    return found.select("table_id", "kind", F.col("lo").alias("tier_key_lo"), F.col("hi").alias("tier_key_hi"))


P6_FOUND = """
WITH v AS (SELECT table_id, tier_key_lo AS lo, tier_key_hi AS hi FROM table_partitions WHERE state IS DISTINCT FROM 'dropped' AND tier_key_lo < tier_key_hi),
r AS (SELECT *, max(hi) OVER (PARTITION BY table_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM r),
p AS (SELECT table_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY table_id, g)
SELECT table_id, 'period' AS kind, lo AS tier_key_lo, hi AS tier_key_hi FROM p
UNION ALL SELECT table_id, 'gap', hi, nxt FROM (SELECT *, lead(lo) OVER (PARTITION BY table_id ORDER BY lo) AS nxt FROM p) WHERE nxt IS NOT NULL
"""

QUERIES = {"p1_found": p1_found, "p1_watermark_state": p1_watermark_state, "p1_transactions": p1_transactions, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_rows": p4_rows, "p4_promoted": p4_promoted, "p5_found": p5_found, "p5_plan": p5_plan, "p5_merged": p5_merged, "p6_found": p6_found}
SQL = {"p1_found": P1_FOUND, "p1_watermark_state": P1_WATERMARK_STATE, "p1_transactions": P1_TRANSACTIONS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_plan": P5_PLAN, "p5_merged": P5_MERGED, "p6_found": P6_FOUND}

