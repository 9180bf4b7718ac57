import random
from decimal import Decimal

from thermocline.operators.copy_diff import copy_differences

LEFT = "table_id long, pk string, n int, d decimal(5,2), x double, s string, kind string"
RIGHT = "table_id long, pk string, n long, d decimal(9,4), x double, s string, field_name string"
FIELDS = ["n", "d", "x", "s"]


def brute(left, right):
    def sides(rows_):
        out = {}
        for r in rows_:
            if r[0] is not None and r[1] is not None:
                out.setdefault((r[0], r[1]), set()).add(tuple("nan" if isinstance(v, float) and v != v else v for v in r[2:6]))
        return out

    a, b = sides(left), sides(right)
    out = [(*k, "heap_only", "") for k in a.keys() - b.keys()] + [(*k, "lake_only", "") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        for i, f in enumerate(FIELDS):
            if {r[i] for r in a[k]} != {r[i] for r in b[k]}:
                out.append((*k, "differs", f))
    return sorted(out)


def test_against_brute_force(spark, rows):
    rnd = random.Random(3)
    nan = float("nan")

    def row(k, extra):
        return (k[0], k[1], rnd.choice([1, 2, None]), rnd.choice([Decimal("1.10"), Decimal("1.20"), None]), rnd.choice([0.0, -0.0, nan, 1.5, None]), rnd.choice(["a", "A", "", None]), extra)

    keys = [(t, p) for t in (1, 2, None) for p in ("a", "b", "b\x1f", "é", None, "z" * 3000)]
    left = [row(rnd.choice(keys), "k") for _ in range(14)]
    right = [row(rnd.choice(keys), "f") for _ in range(14)]
    left += left[:5]
    right += [(*x[:6], "f") for x in left[:6]]
    got = copy_differences(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), FIELDS)
    assert sorted(tuple(r) for r in got.collect()) == brute(left, right)


def test_numbers_by_value_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5, Decimal("1.50"), None, None, "")], LEFT)
    right = spark.createDataFrame([(1, "a", 5, Decimal("1.5000"), None, None, "")], RIGHT)
    assert copy_differences(left, right, FIELDS).count() == 0


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "a", 5, None, None, None, "")], LEFT)
    none = spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in copy_differences(some, none, FIELDS).collect()] == [(1, "a", "heap_only", "")]
    assert copy_differences(none, none, FIELDS).count() == 0


def test_hot_key_of_exact_repeats(spark):
    from pyspark.sql import functions as F

    side = lambda n, v: spark.range(n).select(F.lit(1).cast("long").alias("table_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("pk"), F.when(F.col("id") % 3 == 0, v).otherwise(0).alias("n"))
    got = copy_differences(side(30_000, 1), side(30_000, 2), ["n"])
    assert [tuple(r) for r in got.collect()] == [(1, "hot", "differs", "n")]


def test_swapped_nulls_are_different_rows(spark):
    """Rows that a hash which passes over nulls takes for the same."""
    schema = "table_id long, pk string, a long, b long"
    left = spark.createDataFrame([(1, "k", 5, None), (1, "k", None, 5)], schema)
    right = spark.createDataFrame([(1, "k", 5, None)], schema)
    assert sorted(tuple(r) for r in copy_differences(left, right, ["a", "b"]).collect()) == [(1, "k", "differs", "a"), (1, "k", "differs", "b")]
    assert copy_differences(left, left.unionByName(left), ["a", "b"]).count() == 0
