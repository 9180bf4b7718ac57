"""Consolidating far too many small files.

:func:`merge_candidates` picks the files, :func:`assign_outputs` rolls them into outputs of a
target size and :class:`SortedRunMerger` merges sorted files by an external k-way merge per
key range, keeping repeated records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thermocline.functions.paths import canonical_path
from thermocline.operators.support import written

#: What holds without a plan or setting.
DEFAULT_TARGET_BYTES = 134217728
DEFAULT_MIN_INPUT_FILES = 8
DEFAULT_ENABLED = True

#: Files of one group per block when sizes are summed in key order.
BLOCK_FILES = 50_000


def settings_of(plans: DataFrame) -> DataFrame:
    """``table_id, target_bytes, min_files, enabled`` with defaults for what is left out or unreadable."""
    setting = lambda name: F.trim(F.try_element_at("settings", F.lit(name)))
    enabled = F.lower(setting("rewrite_enabled"))
    per = plans.where(F.col("table_id").isNotNull()).select(
        "table_id",
        F.coalesce(setting("rewrite_target_bytes").try_cast("long"), F.lit(DEFAULT_TARGET_BYTES)).alias("target_bytes"),
        F.coalesce(setting("rewrite_min_input_files").try_cast("long"), F.lit(DEFAULT_MIN_INPUT_FILES)).alias("min_files"),
        F.when(enabled.isin("true", "false"), enabled == "true").otherwise(F.lit(DEFAULT_ENABLED)).alias("enabled"),
    )
    return per.groupBy("table_id").agg(F.max("target_bytes").alias("target_bytes"), F.max("min_files").alias("min_files"), F.min("enabled").alias("enabled"))


def held_files(plans: DataFrame, labels: DataFrame) -> DataFrame:
    """``path``: canonical paths of protected files and of files staged by labels in state staged.

    Null or unreadable manifests name nothing.
    """
    protected = plans.select(F.explode("protected_files").alias("p"))
    readable = F.json_object_keys("staged_files").isNotNull()
    staged = labels.where((F.col("state") == "staged") & readable).select(F.explode(F.from_json("staged_files", "struct<files:array<string>>")["files"]).alias("p"))
    return protected.unionByName(staged).where(F.col("p").isNotNull()).select(canonical_path(F.col("p")).alias("path")).distinct()


def merge_candidates(files: DataFrame, plans: DataFrame, labels: DataFrame) -> DataFrame:
    """Files to be merged: ``table_id, partition_id, file_id, path, file_size_bytes, record_count, target_bytes``.

    A candidate has a known size below its table's target, no deletes and isn't held under any
    spelling of its path; a group (table and partition, null being a group) needs at least the
    table's minimum of candidates, and tables with rewriting off have none.  A file listed
    again counts once, with the listing made last.
    """
    listing = F.struct(F.col("created_at"), F.col("lake_snapshot_id"), F.col("file_path"), F.col("file_size_bytes"), F.col("record_count"), F.col("delete_count"), F.col("partition_id"))
    once = files.where(F.col("table_id").isNotNull() & F.col("file_id").isNotNull()).groupBy("table_id", "file_id").agg(F.max(listing).alias("l")).select("table_id", "file_id", "l.*")
    known = once.join(settings_of(plans), "table_id", "left").select(
        "table_id", "partition_id", "file_id", "file_size_bytes", "record_count", "delete_count", canonical_path(F.col("file_path")).alias("path"),
        F.coalesce("target_bytes", F.lit(DEFAULT_TARGET_BYTES)).alias("target_bytes"), F.coalesce("min_files", F.lit(DEFAULT_MIN_INPUT_FILES)).alias("min_files"), F.coalesce("enabled", F.lit(DEFAULT_ENABLED)).alias("enabled"),
    )
    free = known.where(F.col("enabled") & (F.col("file_size_bytes") < F.col("target_bytes")) & (F.col("delete_count") == 0)).join(held_files(plans, labels), "path", "left_anti")
    # the number of candidates by a plain count per group, so that a hot group isn't sorted in one task
    enough = free.groupBy("table_id", "partition_id").agg(F.count(F.lit(1)).alias("n"), F.max("min_files").alias("m")).where(F.col("n") >= F.col("m")).select(F.col("table_id").alias("_t"), F.col("partition_id").alias("_p"))
    return free.join(enough, (F.col("table_id") == F.col("_t")) & F.col("partition_id").eqNullSafe(F.col("_p")), "left_semi").select("table_id", "partition_id", "file_id", "path", "file_size_bytes", "record_count", "target_bytes")


def assign_outputs(candidates: DataFrame, block_files: int = BLOCK_FILES) -> DataFrame:
    """Candidates with ``output_no``: files in order of their id, rolled to a new output whenever the running sum of bytes crosses the target.

    Every file belongs to one output, so no record is lost or repeated.  The running sum is
    taken within blocks of file ids and over the sums of the blocks, so no task sorts a whole
    group.
    """
    keys = ["table_id", "partition_id"]
    c = candidates.withColumn("_block", F.floor(F.col("file_id") / F.lit(block_files)))
    sums = c.groupBy(*keys, "_block").agg(F.sum("file_size_bytes").alias("_bytes"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_block").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum("file_size_bytes").over(within), F.lit(0)))
    same = F.col("_b") == F.col("_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return c.join(sums, same).withColumn("output_no", F.floor((F.col("_base") + F.col("_in")) / F.col("target_bytes")).cast("long")).select(*candidates.columns, "output_no")


def consolidation_plan(files: DataFrame, plans: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per output file: ``table_id, partition_id, output_no, input_files, bytes, records``; outputs of one file are left as they are."""
    assigned = assign_outputs(merge_candidates(files, plans, labels))
    per = assigned.groupBy("table_id", "partition_id", "output_no").agg(F.count(F.lit(1)).alias("input_files"), F.sum("file_size_bytes").alias("bytes"), F.sum("record_count").alias("records"))
    return per.where(F.col("input_files") > 1)


def merge_orders(files: DataFrame, bytes_per_order: int = 1 << 30) -> DataFrame:
    """Work orders for :class:`SortedRunMerger` from sorted files: ``group_id, paths, low, high``.

    ``files``: group_id, path, low, high (range of the first sort column without its nulls, both ends
    inclusive, null if unknown), bytes and, where known, nulls (number of nulls in that column).  A
    group of more than ``bytes_per_order`` is cut at quantiles of the files' lows; every file goes to
    each range it meets, which reads its own part of it.  A file that may hold nulls also goes to
    the range with the open low end, to which they belong; without a count that is every file.
    """
    if "nulls" not in files.columns:
        files = files.withColumn("nulls", F.lit(None).cast("long"))
    sizes = files.groupBy("group_id").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / F.lit(bytes_per_order))).cast("int").alias("k"), F.percentile_approx("low", [i / 256 for i in range(1, 256)], 10_000).alias("grid"))
    step = F.greatest(F.lit(1), F.floor(F.lit(256) / F.col("k"))).cast("int")
    cuts = F.when(F.col("k") > 1, F.array_sort(F.array_distinct(F.filter("grid", lambda x, i: (i + 1) % step == 0)))).otherwise(F.array().cast("array<long>"))
    sized = sizes.select(F.col("group_id").alias("_g"), F.coalesce(cuts, F.array().cast("array<long>")).alias("cuts"))
    joined = files.join(sized, F.col("group_id").eqNullSafe(F.col("_g")))
    place = lambda x, empty: F.when(x.isNull(), empty).otherwise(F.size(F.filter("cuts", lambda c: c <= x)))
    met = F.sequence(place(F.col("low"), F.lit(0)), place(F.col("high"), F.size("cuts")))
    met = F.when(F.coalesce(F.col("nulls") == 0, F.lit(False)), met).otherwise(F.array_union(F.array(F.lit(0)), met))
    each = joined.withColumn("n", F.explode(met))
    end = lambda i: F.try_element_at("cuts", i)
    ranged = each.select("group_id", "path", F.when(F.col("n") > 0, end(F.greatest(F.col("n"), F.lit(1)))).alias("low"), end(F.col("n") + 1).alias("high"))
    return ranged.groupBy("group_id", "low", "high").agg(F.collect_list("path").alias("paths")).select("group_id", "paths", "low", "high")


@dataclass
class SortedRunMerger:
    """Merges Parquet files that are sorted by ``sort_columns`` into few files of about ``target_bytes``.

    A work order is a row ``group_id string, paths array<string>, low long, high long``: the runs
    of one group and the half-open range of the first sort column that this order takes from
    them (null: open; nulls of the column go with an open low end).  :func:`merge_orders` makes
    orders of bounded size, so a hot group is merged by many tasks.  Each order is one k-way
    merge over batches of ``batch_rows`` rows: memory depends on the number of runs, not on
    their length, and with more than ``fan_in`` runs they are first merged in passes.  Nulls
    sort first.  Repeated records are kept.  Outputs get a fresh name per attempt and only the
    returned ones count, so a lost and repeated task leaves an orphan at most.
    """

    sort_columns: Sequence[str]
    out_dir: str
    target_bytes: int = DEFAULT_TARGET_BYTES
    batch_rows: int = 8192
    fan_in: int = 64
    row_group_rows: int = 131_072

    RESULT = "group_id string, path string, records long, bytes long, lower string, upper string"

    def run(self, orders: DataFrame) -> DataFrame:
        """Merges every order and returns the new files with their key range, as a written table."""
        me = self
        ends = [F.col(c).cast("long").alias(c) if c in orders.columns else F.lit(None).cast("long").alias(c) for c in ("low", "high")]
        first = orders.select("group_id", "paths", *ends)
        first = first.repartition(max(1, first.count()))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    made = list(me.merge(row["group_id"], row["paths"] or [], row["low"], row["high"]))
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("group_id", pa.string()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("lower", pa.string()), ("upper", pa.string())]))

        return written(first.mapInArrow(work, self.RESULT), "merged-runs")

    def merge(self, group_id: str, paths: Sequence[str], low: int | None = None, high: int | None = None) -> Iterator[dict]:
        if not paths:
            return
        schema = pa.unify_schemas([pq.read_schema(where, filesystem=at) for at, where in map(_at, paths)])
        disk, folder = _at(self.out_dir)
        disk.create_dir(folder, recursive=True)
        scratch: list[str] = []
        runs: list = [(p, low, high) for p in paths]
        while len(runs) > self.fan_in:
            passed = []
            for i in range(0, len(runs), self.fan_in):
                # names that begin with _ are read by nobody, so a run that a lost task left is only space
                out = f"{self.out_dir}/_run-{uuid.uuid4().hex}.parquet"
                scratch.append(out)
                with pq.ParquetWriter(_at(out)[1], schema, filesystem=disk) as writer:
                    for table in self._tables(runs[i : i + self.fan_in], schema):
                        writer.write_table(table)
                passed.append((out, None, None))
            runs = passed
        try:
            yield from self._roll(group_id, runs, schema)
        finally:
            for path in scratch:
                disk.delete_file(_at(path)[1])

    def _tables(self, runs: Sequence[tuple], schema: pa.Schema) -> Iterator[pa.Table]:
        """Merged rows as sorted tables.  What lies at or below the lowest last key of all buffers can't be preceded by rows still unread."""
        readers = [self._batches(*run, schema) for run in runs]
        buffers: list[pa.Table | None] = [next(r, None) for r in readers]
        order = [(c, "ascending") for c in self.sort_columns]
        while any(b is not None for b in buffers):
            bound = min(self._key(b, b.num_rows - 1) for b in buffers if b is not None)
            ready = []
            for i, b in enumerate(buffers):
                if b is None:
                    continue
                n = self._count_up_to(b, bound)
                ready.append(b.slice(0, n))
                buffers[i] = b.slice(n) if n < b.num_rows else next(readers[i], None)
            part = pa.concat_tables(ready)
            yield part.take(pc.sort_indices(part, sort_keys=order, null_placement="at_start"))

    def _batches(self, path: str, low: int | None, high: int | None, schema: pa.Schema) -> Iterator[pa.Table]:
        first = self.sort_columns[0]
        disk, where = _at(path)
        file = pq.ParquetFile(where, filesystem=disk)
        for batch in file.iter_batches(self.batch_rows, row_groups=self._row_groups(file, low, high)):
            t = pa.Table.from_batches([batch])
            t = pa.table([t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema], schema=schema)
            if low is not None or high is not None:
                keys = t[first].cast(pa.int64())
                inside = pc.fill_null(pc.greater_equal(keys, low), False) if low is not None else pa.chunked_array([pa.array([True] * len(keys))])
                if high is not None:
                    inside = pc.and_(inside, pc.fill_null(pc.less(keys, high), True))
                t = t.filter(inside)
            if t.num_rows:
                yield t

    def _row_groups(self, file: pq.ParquetFile, low: int | None, high: int | None) -> list[int]:
        """Row groups that may hold rows of the range; a file sent along for its nulls costs its footer if it has none."""
        meta, kept = file.metadata, []
        at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == self.sort_columns[0]), None)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics if at is not None else None
            nulls = low is None and (s is None or not s.has_null_count or s.null_count > 0)
            if not nulls and s is not None and s.has_min_max and isinstance(s.min, int):
                if low is not None and s.max < low or high is not None and s.min >= high:
                    continue
            kept.append(g)
        return kept

    def _key(self, t: pa.Table, row: int) -> tuple:
        values = [t[c][row].as_py() for c in self.sort_columns]
        return tuple((v is not None, v if v is not None else 0) for v in values)

    def _count_up_to(self, t: pa.Table, bound: tuple) -> int:
        """Number of leading rows whose key is at most ``bound``."""
        low, high = 0, t.num_rows
        while low < high:
            middle = (low + high) // 2
            if self._key(t, middle) <= bound:
                low = middle + 1
            else:
                high = middle
        return low

    def _roll(self, group_id: str, runs: Sequence[tuple], schema: pa.Schema) -> Iterator[dict]:
        """Writes merged rows, beginning a new file whenever the current one has reached the target."""
        disk, folder = _at(self.out_dir)
        column, sink, pending, held = self.sort_columns[0], None, [], 0

        def flush() -> None:
            nonlocal pending, held
            if pending:
                writer.write_table(pa.concat_tables(pending))
            pending, held = [], 0

        for table in self._tables(runs, schema):
            if sink is None:
                name = f"part-{uuid.uuid4().hex}.parquet"
                path = f"{self.out_dir}/{name}"
                sink = disk.open_output_stream(f"{folder}/{name}")
                writer, records, lower = pq.ParquetWriter(sink, schema), 0, table[column][0].as_py()
            pending.append(table)
            held += table.num_rows
            records, upper = records + table.num_rows, table[column][-1].as_py()
            if held >= self.row_group_rows:
                flush()
                if sink.tell() >= self.target_bytes:
                    writer.close()
                    sink.close()
                    yield self._made(group_id, path, records, lower, upper)
                    sink = None
        if sink is not None:
            flush()
            writer.close()
            sink.close()
            yield self._made(group_id, path, records, lower, upper)

    @staticmethod
    def _made(group_id: str, path: str, records: int, lower: object, upper: object) -> dict:
        text = lambda v: None if v is None else str(v)
        disk, where = _at(path)
        return {"group_id": group_id, "path": path, "records": records, "bytes": disk.get_file_info(where).size, "lower": text(lower), "upper": text(upper)}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path within it; a path without scheme is on a folder that all executors mount."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def list_sorted(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """``group_id, path, low, high, bytes, nulls`` of the Parquet files below ``folder``, as :func:`merge_orders` takes them: one group, ranges of ``column`` from a scan of it alone."""
    rows = spark.read.parquet(folder)
    key = F.col(column).cast("long")
    per = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count_if(key.isNull()).alias("nulls"), F.count(F.lit(1)).alias("records"))
    return per.select(F.lit("all").alias("group_id"), "path", "low", "high", "bytes", "nulls", "records")


def check_merge(listing: DataFrame, made: DataFrame) -> None:
    """Raises unless the outputs hold as many records as the inputs: only then may they take their place."""
    before, after = (df.agg(F.sum("records")).first()[0] or 0 for df in (listing, made))
    if before != after:
        raise RuntimeError(f"{before} records went into the merge and {after} came out")
