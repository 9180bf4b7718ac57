import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from thermocline.operators import consolidate
from thermocline.operators.consolidate import SortedRunMerger, assign_outputs, consolidation_plan, merge_candidates, merge_orders

FILES = "file_id long, table_id long, partition_id string, file_path string, file_size_bytes long, record_count long, delete_count long, lake_snapshot_id long, created_at string, path string"
PLANS = "table_id long, settings map<string,string>, pinned_snapshot_floor long, protected_files array<string>"
LABELS = "table_id long, label string, state string, staged_files string"


def file(i, t=1, p="p", size=10, deletes=0, path=None):
    return (i, t, p, path or f"s3://b/t{t}/data/{i}.parquet", size, 1, deletes, 1, "2025", "q")


def run(spark, files, plans=(), labels=()):
    frames = [spark.createDataFrame(list(x), s) for x, s in ((files, FILES), (plans, PLANS), (labels, LABELS))]
    return sorted((r["table_id"], r["file_id"]) for r in merge_candidates(*frames).collect())


def test_defaults_and_minimum(spark):
    files = [file(i) for i in range(8)] + [file(20 + i, t=2) for i in range(7)]
    assert run(spark, files) == [(1, i) for i in range(8)]
    assert run(spark, []) == []


def test_what_is_no_candidate(spark):
    plans = [(1, {"rewrite_min_input_files": "1", "rewrite_target_bytes": "100"}, None, ["s3a://b/t1/./data//1.parquet", None]), (2, {"rewrite_enabled": "false", "rewrite_min_input_files": "1"}, None, None), (3, {"rewrite_min_input_files": "x"}, None, [])]
    labels = [(1, "a", "staged", '{"files":["s3://b/t1/data/%32.parquet"]}'), (1, "b", "failed", '{"files":["s3://b/t1/data/3.parquet"]}'), (1, "c", "staged", '{"files":["s3://b/t1/data/3.pa'), (1, "d", "staged", None)]
    files = [file(0), file(1), file(2), file(3), file(4, size=None), file(5, size=100), file(6, deletes=1), file(7, size=0), file(0), file(9, deletes=None), file(30, t=2), *[file(40 + i, t=3) for i in range(7)]]
    assert run(spark, files, plans, labels) == [(1, 0), (1, 3), (1, 7)]


def test_null_partition_is_a_group(spark):
    plans = [(1, {"rewrite_min_input_files": "2"}, None, None)]
    assert run(spark, [file(1, p=None), file(2, p=None), file(3, p="x")], plans) == [(1, 1), (1, 2)]


def test_outputs_lose_and_repeat_nothing(spark):
    rnd = random.Random(2)
    files = [file(i, p=rnd.choice(["a", None]), size=rnd.randint(0, 60)) for i in range(400)]
    plans = [(1, {"rewrite_target_bytes": "100"}, None, None)]
    frames = [spark.createDataFrame(x, s) for x, s in ((files, FILES), (plans, PLANS), ([], LABELS))]
    found = merge_candidates(*frames)
    assigned = assign_outputs(found, block_files=16).collect()
    assert sorted(r["file_id"] for r in assigned) == list(range(400))
    for p in ("a", None):
        total = 0
        for r in sorted((r for r in assigned if r["partition_id"] == p), key=lambda r: r["file_id"]):
            assert r["output_no"] == total // 100
            total += r["file_size_bytes"]
    plan = consolidation_plan(*frames).collect()
    assert sum(r["input_files"] for r in plan) <= 400 and all(r["input_files"] > 1 for r in plan)


def test_sorted_run_merge(spark, tmp_path):
    rnd = random.Random(4)
    paths, everything = [], []
    for i in range(9):
        rows = sorted(((rnd.choice([None, *range(30)]), rnd.choice(["a", "b", None])) for _ in range(rnd.choice([0, 400, 2000]))), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
        everything += rows
        pq.write_table(pa.table({"k": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.string())}), tmp_path / f"{i}.parquet")
        paths.append(str(tmp_path / f"{i}.parquet"))
    merger = SortedRunMerger(["k", "v"], str(tmp_path / "out"), target_bytes=1500, batch_rows=50, fan_in=3, row_group_rows=60)
    orders = spark.createDataFrame([("g", paths), ("none", []), ("null", None)], "group_id string, paths array<string>")
    made = merger.run(orders).collect()
    back = [r for m in sorted(made, key=lambda m: int(m["lower"] or -1)) for r in pq.read_table(m["path"]).to_pylist()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert [(r["k"], r["v"]) for r in back] == sorted(everything, key=key)
    assert len(made) > 1 and sum(m["records"] for m in made) == len(everything)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_run")]


def test_hot_group_is_merged_by_key_ranges(spark, tmp_path):
    rnd = random.Random(9)
    listing, everything = [], []
    for i in range(12):
        keys = sorted(rnd.randint(0, 1000) + 500 * (i % 3) for _ in range(200))
        if i == 0:
            keys = [None, None, *keys]
        everything += keys
        pq.write_table(pa.table({"k": pa.array(keys, pa.int64()), "v": pa.array([str(i)] * len(keys))}), tmp_path / f"{i}.parquet")
        known = [k for k in keys if k is not None]
        listing.append(("hot", str(tmp_path / f"{i}.parquet"), None if i == 0 else known[0], known[-1], 1000))
    orders = merge_orders(spark.createDataFrame(listing, "group_id string, path string, low long, high long, bytes long"), bytes_per_order=3000).collect()
    assert 2 < len(orders) <= 5
    made = SortedRunMerger(["k"], str(tmp_path / "out")).run(spark.createDataFrame(orders, "group_id string, paths array<string>, low long, high long")).collect()
    back = [r["k"] for m in sorted(made, key=lambda m: int(m["upper"])) for r in pq.read_table(m["path"]).to_pylist()]
    assert back == sorted(everything, key=lambda k: (k is not None, k or 0))


@pytest.mark.parametrize("counted", [False, True])
def test_nulls_of_files_with_a_known_range_are_kept(spark, tmp_path, counted):
    listing, everything = [], []
    for i in range(12):
        keys = [*[None] * (i % 3), *range(100 * i, 100 * i + 50)]
        everything += keys
        pq.write_table(pa.table({"k": pa.array(keys, pa.int64()), "v": pa.array([str(i)] * len(keys))}), tmp_path / f"{i}.parquet", row_group_size=20)
        listing.append(("hot", str(tmp_path / f"{i}.parquet"), 100 * i, 100 * i + 49, 1000, (i % 3 if i != 4 else None) if counted else None))
    files = spark.createDataFrame(listing, "group_id string, path string, low long, high long, bytes long, nulls long")
    orders = merge_orders(files if counted else files.drop("nulls"), bytes_per_order=3000)
    assert orders.count() > 2
    made = SortedRunMerger(["k"], str(tmp_path / "out"), batch_rows=7, fan_in=3).run(orders).collect()
    back = [r["k"] for m in sorted(made, key=lambda m: int(m["upper"])) for r in pq.read_table(m["path"]).to_pylist()]
    assert back == sorted(everything, key=lambda k: (k is not None, k or 0))
    at_open = orders.where("low is null").first()["paths"]
    assert counted == (str(tmp_path / "9.parquet") not in at_open)


def test_lists_merges_and_checks_by_uri(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(1000).selectExpr("id % 90 AS k", "cast(id AS string) AS v").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'n'")).repartition(7).sortWithinPartitions("k").write.parquet(folder)
    listing = consolidate.list_sorted(spark, folder, "k")
    assert listing.agg({"nulls": "sum"}).first()[0] == 1 and listing.count() == 7
    made = SortedRunMerger(["k"], out, fan_in=3, batch_rows=64).run(merge_orders(listing, bytes_per_order=2000))
    consolidate.check_merge(listing, made)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(map(tuple, spark.read.parquet(folder).collect()), key=str)
    with pytest.raises(RuntimeError):
        consolidate.check_merge(listing, made.limit(1))
