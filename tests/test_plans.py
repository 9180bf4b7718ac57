import pytest

from thermocline.functions.keys import INT64_MIN, TierKeyType
from thermocline.plans.modes import Cold, Side, TableMode, WritePlan
from thermocline.plans.predicate import All, Any, Compare, Reach, Unknown, bounds, classify, tier_predicate


def test_mode_matrix():
    hot, cold = Side.HOT, Side.COLD
    assert TableMode("tiered").insert(hot) == WritePlan(heap=True)
    assert TableMode("tiered").insert(cold) == WritePlan(overlay=True, check_retention=True)
    assert TableMode("tiered", keep_heap=True).insert(cold) == WritePlan(heap=True, overlay=True, check_retention=True)
    assert TableMode("direct").insert(cold) == WritePlan(lake=True, check_retention=True)
    assert TableMode("direct", keep_heap=True).insert(cold) == WritePlan(heap=True, lake=True, check_retention=True)
    assert TableMode("mirrored").insert(cold) == WritePlan(heap=True)
    assert TableMode("mirrored", heap_retention=True).insert(cold) == WritePlan(overlay=True)
    assert TableMode("tiered").delete(hot).heap_floor and TableMode("tiered").delete(cold).check_retention
    assert not TableMode("mirrored").delete(hot).heap_floor
    assert TableMode("mirrored").heap_complete and TableMode("tiered", keep_heap=True).heap_complete and TableMode("tiered").routes_by_cut
    assert [TableMode(*m).cold_read for m in (("tiered",), ("direct",), ("mirrored",))] == [Cold.MERGED, Cold.LIVE, Cold.NONE]
    assert TableMode("tiered").update(cold, hot) == (TableMode("tiered").delete(cold), TableMode("tiered").insert(hot))
    for bad in (("other",), ("mirrored", True), ("tiered", False, True)):
        with pytest.raises(ValueError):
            TableMode(*bad)


@pytest.mark.parametrize(
    ("predicate", "reach"),
    [
        (Compare("=", 100), Reach.HOT), (Compare("=", 99), Reach.COLD), (Compare(">=", 100), Reach.HOT), (Compare(">=", 99), Reach.MIXED), (Compare(">", 99), Reach.HOT), (Compare(">", 98), Reach.MIXED),
        (Compare("<", 100), Reach.COLD), (Compare("<", 101), Reach.MIXED), (Compare("<=", 99), Reach.COLD), (Compare("<=", 100), Reach.MIXED), (Unknown(), Reach.MIXED), (All(()), Reach.MIXED), (Any(()), Reach.HOT),
        (All((Unknown(), Compare(">=", 100))), Reach.HOT), (All((Unknown(), Compare("<", 50))), Reach.COLD), (All((Compare(">=", 100), Compare("<", 50))), Reach.HOT),
        (Any((Compare("=", 1), Compare("=", 2))), Reach.COLD), (Any((Compare("=", 1), Compare("=", 200))), Reach.MIXED), (Any((Compare("=", 300), Compare("=", 200))), Reach.HOT), (Any((Unknown(), Compare("=", 1))), Reach.MIXED),
    ],
)
def test_classification(predicate, reach):
    assert classify(predicate, 100) is reach


def test_classification_below_everything():
    assert classify(Compare(">", INT64_MIN), INT64_MIN) is Reach.HOT
    assert classify(Compare("<=", INT64_MIN), INT64_MIN) is Reach.MIXED


@pytest.mark.parametrize(
    ("text", "reach"),
    [
        ("k >= 100", Reach.HOT), ("100 <= k AND v = 'x'", Reach.HOT), ("k IN (1, 2)", Reach.COLD), ("k IN (1, 200)", Reach.MIXED), ("k BETWEEN 10 AND 20", Reach.COLD), ("k = 5 OR k = 6", Reach.COLD), ("v = 'x'", Reach.MIXED),
        ("k + 1 >= 100", Reach.MIXED), ("CAST(k AS BIGINT) > 99", Reach.HOT), ("t.k < -5", Reach.COLD), ("NOT k >= 100", Reach.MIXED), (None, Reach.MIXED), ("k >= (SELECT 100)", Reach.MIXED),
    ],
)
def test_parsing(spark, text, reach):
    assert classify(tier_predicate(spark, text, "k", TierKeyType("bigint")), 100) is reach


def test_parsing_timestamps(spark):
    kind = TierKeyType("timestamp")
    cut = kind.canonical("2024-01-16")
    for text, reach in (("ts >= TIMESTAMP_NTZ '2024-01-20'", Reach.HOT), ("ts < '2024-01-16'", Reach.COLD), ("ts >= DATE '2024-01-16'", Reach.HOT), ("ts > '2024-01-01'", Reach.MIXED)):
        assert classify(tier_predicate(spark, text, "ts", kind), cut) is reach, text


def test_bounds():
    a, b = Compare(">=", 10), Compare("<", 20)
    assert bounds(All((a, b, Unknown()))) == (10, 20) and bounds(Any((Compare("=", 5), Compare("=", 9)))) == (5, 10)
    assert bounds(Any((a, b))) == (None, None) and bounds(Unknown()) == (None, None) and bounds(All(())) == (None, None)
    assert bounds(Compare(">", 3)) == (4, None) and bounds(Compare("<=", 3)) == (None, 4)
