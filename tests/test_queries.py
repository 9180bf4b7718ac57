import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
CHECKED = [
    "p1_found", "p1_watermark_state", "p1_transactions", "p2_found", "p3_found", "p4_found", "p5_found", "p5_plan", "p5_merged", "p6_found", "seam_scan", "seam_agg", "cross_table_join", "seam_exists", "seam_window", "classify_cold",
    "update_mixed", "tier_move_within_cold", "tier_move_to_hot", "tier_move_to_cold", "keep_heap_mirror", "direct_writes", "fold_merge_on_read", "staged_load_adopted", "retention_expire", "mirror_collapse",
    "fold_in_batches", "update_cast", "upsert_hot_twice", "ingest_during_fold", "fold_during_ingest", "adopt_two_loads", "read_under_pin", "tier_crash_resume", "small_files_rewritten", "snapshots_expired", "mirror_split_transaction", "mirror_widens", "status_snapshot", "explain_routes",
]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (*range(1, 8), 9):
        assert f"p{n}_found" in entry.queries() or n >= 7


def test_the_rest_works_without_the_subpackage_for_text():
    code = "import sys; sys.modules['thermocline.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and not any(k.startswith(('p7', 'p8', 'p9')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_a_broken_subpackage_is_not_passed_over():
    code = "import sys; sys.modules['tiktoken'] = None; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    sys.exit(0 if e.name != 'thermocline.llm' else 1)\nsys.exit(1)"
    if (REPO / "thermocline" / "llm").exists():
        subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_imports_the_subpackage_for_text():
    for p in (REPO / "thermocline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "thermocline.llm" not in p.read_text(), p


@needs_tables
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["event_type", "n", "total"]


@needs_tables
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, str(REPO / "tools"))
    from compare import canonical

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@needs_tables
@pytest.mark.parametrize("name", ["stream_load_whole", "staged_load_whole", "ingest_whole", "insert_whole"])
def test_whole_loads_against_sql(spark, name):
    test_against_sql(spark, name)
