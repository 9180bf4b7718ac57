import random

import pytest
from pyspark.sql import functions as F

from thermocline.llm import mixing
from thermocline.llm.mixing import budgets, mix_plan, mix_shares, mixture, token_counts

DOCS, TARGETS = "doc_id long, source string, tokens long, weight double", "source string, target_share double, max_repeats int"


def test_budgets():
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]
    totals = {"a": 1000, "b": 1000, "c": 100}
    assert budgets(totals, targets) == {"a": 1000, "b": 600, "c": 400}
    assert budgets(totals, targets, 1000) == {"a": 500, "b": 300, "c": 200}
    more = budgets(totals, targets, 3000)
    assert more == {"a": 1000, "b": 1600, "c": 400} or sum(more.values()) == 3000 and more["c"] == 400 and more["a"] == 1000
    assert budgets(totals, targets, 10_000) == {"a": 1000, "b": 2000, "c": 400}
    assert budgets({}, targets) == {"a": 0, "b": 0, "c": 0}
    assert budgets({"a": 10}, [("a", 1.0, 0), ("b", 0.0, 2)]) == {"a": 0, "b": 0}


def corpus(n=4000):
    rnd = random.Random(1)
    names = ["big"] * 6 + ["mid"] * 3 + ["small", None, "other"]
    return [(i, rnd.choice(names), rnd.choice([0, 1, 20, 100]), rnd.choice([None, 0.0, 0.2, 1.0])) for i in range(n)]


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.0, 1)], TARGETS)
    plan = mix_plan(spark.createDataFrame(corpus(), DOCS), targets)
    rows = plan.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    for s in caps:
        copies = {r["copies"] for r in rows if r["source"] == s}
        assert max(copies) - min(copies) <= 1  # whole epochs, then a fraction
    shares = {r["source"]: r for r in mix_shares(plan, targets).collect()}
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[s]["actual_share"] - want) < 0.005
    assert shares["absent"]["tokens"] == 0 and shares["absent"]["actual_share"] == 0
    assert mixture(spark.createDataFrame(corpus(), DOCS), plan).count() == sum(r["copies"] for r in rows)


def test_deterministic_and_by_weight(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("tokens"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("weight"))
    both = spark.createDataFrame([("s", 1.0, 1)], TARGETS)
    first = {r["doc_id"] for r in mix_plan(df, both, total_tokens=8000).collect()}
    again = {r["doc_id"] for r in mix_plan(df.repartition(7), both, total_tokens=8000).collect()}
    assert first == again and abs(len(first) - 800) <= 1
    assert sum(d % 2 == 0 for d in first) > 0.85 * len(first)
    assert first != {r["doc_id"] for r in mix_plan(df, both, total_tokens=8000, seed=1).collect()}


@pytest.mark.parametrize(("edge", "blocks"), [(10_000, 1000), (5, 3), (0, 2)])
def test_against_brute_force(spark, monkeypatch, edge, blocks):
    """However the end of a budget is searched for, the documents are those of a full sort."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    rows = corpus(1500)
    df = spark.createDataFrame(rows, DOCS)
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)]
    got = {(r["source"], r["doc_id"]): r["copies"] for r in mix_plan(df, spark.createDataFrame(targets, TARGETS)).collect()}
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", (-F.log(uniform) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.01)).alias("k")).collect()}
    totals = {s: sum(t for _, x, t, _ in rows if x == s) for s, _, _ in targets}
    want = {}
    for s, quota in budgets(totals, targets).items():
        before, (epochs, rest) = 0, divmod(quota, totals[s])
        for d, t in sorted(((d, t) for d, x, t, _ in rows if x == s), key=lambda r: (keys[r[0]], r[0])):
            extra = int(rest > 0 and t > 0 and before + t / 2 <= rest)
            before += t
            if epochs + extra:
                want[s, d] = epochs + extra
    assert got == want


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("s", 1.0, 1)], TARGETS)
    assert mix_plan(docs, targets).count() == 0
    assert mix_plan(docs, targets.limit(0)).count() == 0
    assert mix_shares(mix_plan(docs, targets), targets).first()["actual_share"] == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "Hello world"), (2, None, None), (3, "a", ""), (4, "a", "é" * 5000), (5, "a", "<|endoftext|>"), (6, "a", "x" * 200_000)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in token_counts(df).collect()}
    assert got[1]["tokens"] == 2 and got[2]["tokens"] == got[3]["tokens"] == 0 and got[4]["tokens"] > 1000 and got[5]["tokens"] > 1 and got[6]["tokens"] > 100
    assert got[1]["weight"] == pytest.approx(10 / 11) and got[2]["weight"] == 0.01
