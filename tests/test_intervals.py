import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from thermocline.operators.intervals import dyadic_blocks, drop_covered, merge_siblings, periods, periods_and_gaps, union_of

LO, HI = -(2**63), 2**63 - 1


def brute(items):
    out = {}
    for g, lo, hi in items:
        if lo is not None and hi is not None and lo < hi:
            out.setdefault(g, []).append((lo, hi))
    rows = []
    for g, spans in out.items():
        spans.sort()
        merged = [list(spans[0])]
        for lo, hi in spans[1:]:
            if lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        rows += [(g, lo, hi) for lo, hi in merged]
    return rows


bound = st.one_of(st.integers(-40, 40), st.sampled_from([LO, LO + 1, HI, HI - 1, 0, 2**62, -(2**62)]), st.integers(LO, HI))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), bound, bound), max_size=25))
def test_union_against_brute_force(items):
    items = [(g, min(a, b), max(a, b)) for g, a, b in items if a != b]
    arrays = [np.array([x[i] for x in items], np.int64) for i in range(3)]
    g, lo, hi = union_of(*arrays)
    assert sorted(zip(g.tolist(), lo.tolist(), hi.tolist())) == sorted(brute(items))


def test_blocks_are_canonical():
    g, s, l = dyadic_blocks(np.array([0]), np.array([3], np.uint64), np.array([13], np.uint64))
    assert sorted(zip(s.tolist(), l.tolist())) == [(3, 0), (4, 2), (8, 2), (12, 0)]
    g, s, l = drop_covered(np.array([0, 0, 0]), np.array([8, 8, 4], np.uint64), np.array([1, 3, 2], np.int8))
    assert sorted(zip(s.tolist(), l.tolist())) == [(4, 2), (8, 3)]
    g, s, l = merge_siblings(np.zeros(4, np.int64), np.array([0, 1, 2, 6], np.uint64), np.array([0, 0, 1, 1], np.int8))
    assert sorted(zip(s.tolist(), l.tolist())) == [(0, 2), (6, 1)]


SCHEMA = "t long, lo long, hi long, _cell long, kind string"


@pytest.mark.parametrize("cell", [100_000, 7])
def test_periods_and_gaps(spark, cell):
    rnd = np.random.RandomState(5)
    items = [(int(t), int(a), int(a + d)) for t, a, d in zip(rnd.choice([1, 1, 1, 2], 300), rnd.randint(-5000, 5000, 300), rnd.choice([-1, 0, 5, 20, 900], 300))]
    items += [(3, LO, HI), (3, 5, 6), (None, 1, 2), (None, 2, 3), (4, None, 3), (4, 3, None), (5, LO, 0), (5, 10, HI)] + items[:20]
    df = spark.createDataFrame([(*x, 1, "k") for x in items], SCHEMA)
    got = sorted(((r["t"], r["lo"], r["hi"]) for r in periods(df, ["t"], "lo", "hi", cell_intervals=cell).collect()), key=str)
    assert got == sorted(brute(items), key=str)
    both = periods_and_gaps(df, ["t"], "lo", "hi", cell_intervals=cell).collect()
    assert sorted((r["lo"], r["hi"]) for r in both if r["kind"] == "gap" and r["t"] == 5) == [(0, 10)]
    assert len([r for r in both if r["kind"] == "gap"]) == len(got) - len({r[0] for r in got})


def test_hot_group_of_long_intervals(spark):
    """Intervals that cross many cells are not copied into each."""
    items = [(1, i, i + 3000) for i in range(0, 4000, 2)] + [(1, 10_000 + i * 10, 10_000 + i * 10 + 4) for i in range(1000)]
    df = spark.createDataFrame([(*x, 0, "") for x in items], SCHEMA)
    got = sorted((r["t"], r["lo"], r["hi"]) for r in periods(df, ["t"], "lo", "hi", cell_intervals=100).collect())
    assert got == sorted(brute(items))


def test_empty_and_text_groups(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), ["t"], "lo", "hi").count() == 0
    df = spark.createDataFrame([("a", True, 1, 2), ("a", None, 2, 3), ("", True, 5, 6), ("a", True, 2, 9)], "g string, b boolean, lo long, hi long")
    got = sorted(map(str, (tuple(r) for r in periods(df, ["g", "b"], "lo", "hi").collect())))
    assert got == sorted(map(str, [("a", True, 1, 9), ("a", None, 2, 3), ("", True, 5, 6)]))
