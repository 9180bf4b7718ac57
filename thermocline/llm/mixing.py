"""Mixing sources to target shares of tokens.

Efraimidis-Spirakis sampling: every document gets an exponential key scaled by its quality
weight; documents are taken in the order of their keys within a source until the prefix sum
of tokens fills the source's budget.  Complete epochs of a source come before the fraction.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thermocline.operators.support import small_side, spread, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEED = 20_250_301
#: Ranges of keys per source in which the end of a budget is looked for at a time.
BLOCKS = 1000
#: A range of at most so many documents is sorted to find the last document of a budget.
EDGE_ROWS = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, weight``: tokens of the whole text and a quality weight, the share of letters in it (0.01 to 1).

    A null or empty text has no tokens.  ``tokenizer`` is a file of byte-level BPE ranks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            tokens = pa.array([len(encode(t)) if t else 0 for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, batch.column(2)], ["doc_id", "source", "tokens", "weight"])

    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(F.length("text"), F.lit(1))
    weight = F.greatest(F.coalesce(letters, F.lit(0.0)), F.lit(0.01))
    return spread(documents.select("doc_id", "source", weight.alias("weight"), "text")).mapInArrow(count, "doc_id long, source string, tokens long, weight double")


def budgets(totals: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, int]:
    """Tokens that each source contributes.

    ``targets``: source, share, most repeats.  Without ``total_tokens`` the mixture is the largest
    in which every source that has tokens meets its share.  With it, sources that can't fill
    their share give all they have at their cap, and the others share the rest by their targets.
    """
    cap = {s: totals.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    share = {s: float(x or 0) for s, x, _ in targets if x and x > 0 and cap[s] > 0}
    if not share:
        return {s: 0 for s, _, _ in targets}
    if total_tokens is None:
        norm = sum(share.values())
        total_tokens = int(min(cap[s] * norm / x for s, x in share.items()))
    out: dict[str, int] = {s: 0 for s, _, _ in targets}
    open_, left = dict(share), total_tokens
    while open_ and left > 0:
        norm = sum(open_.values())
        full = [s for s, x in open_.items() if left * x / norm > cap[s] + 0.5]
        if not full:
            out |= {s: min(cap[s], round(left * x / norm)) for s, x in open_.items()}
            break
        for s in full:
            out[s] = cap[s]
            del open_[s]
        left = total_tokens - sum(out[s] for s in out)
    return out


def mix_plan(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """Documents of the mixture with ``copies``: ``doc_id, source, tokens, weight, copies``.

    ``documents``: doc_id, source, tokens, weight.  ``targets``: source, target_share, max_repeats;
    a configuration of one row per source (a repeated source: the last by share).  Sources match
    exactly; documents of other sources or a null source don't take part.  A source gives complete
    epochs first and then the documents with the smallest keys until its budget is filled, to the
    nearest document, so no document comes more than ``max_repeats`` times.  Keys depend on the
    document id and ``seed`` only; ties go by id.  Documents without tokens never change a
    share and are taken in complete epochs only.  Null or non-positive weights count as 0.01.

    Only sums per source and key range reach the driver.  The end of each budget is searched for
    in ever narrower ranges of keys, ``BLOCKS`` at a time, until a range of at most ``EDGE_ROWS``
    documents is left to be sorted; no source is sorted, and no document is shuffled.
    """
    rules = {r["source"]: (r["source"], r["target_share"], r["max_repeats"]) for r in targets.where(F.col("source").isNotNull()).orderBy("target_share").collect()}
    spark = documents.sparkSession
    known = spark.createDataFrame([(s,) for s in rules], "source string")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.01))
    # written once: the counting of tokens isn't done again for each of the sums below
    docs = written(documents.join(small_side(known), "source", "left_semi").select("doc_id", "source", "tokens", "weight", (-F.log(uniform) / weight).alias("_key")), "token-counts")
    counted = F.col("tokens") > 0
    per = docs.groupBy("source").agg(F.sum("tokens").alias("t"), F.count_if(counted).alias("n"), F.min(F.when(counted, F.col("_key"))).alias("lo"), F.max(F.when(counted, F.col("_key"))).alias("hi")).collect()
    totals = {r["source"]: int(r["t"] or 0) for r in per}
    quota = budgets(totals, list(rules.values()), total_tokens)
    epochs = {s: q // totals[s] if totals.get(s) else 0 for s, q in quota.items()}
    ends = {r["source"]: _End(r["lo"], r["hi"], 0, r["n"], quota[r["source"]] % totals[r["source"]]) for r in per if totals[r["source"]] and quota.get(r["source"], 0) % totals[r["source"]]}
    _narrow(docs.where(counted), ends)
    plan = [(s, e, ends[s].low if s in ends else None, ends[s].high if s in ends else None, ends[s].base if s in ends else None, ends[s].rest if s in ends else 0) for s, e in epochs.items()]
    planned = docs.join(F.broadcast(spark.createDataFrame(plan, "source string, epochs long, _low double, _high double, _base long, _rest long")), "source")
    running = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = planned.where(counted & F.col("_key").between(F.col("_low"), F.col("_high"))).withColumn("_before", F.col("_base") + running)
    edge = edge.where(F.col("_before") + F.col("tokens") / 2 <= F.col("_rest")).select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.lit(1).alias("_last")).distinct()
    if sum(e.rows for e in ends.values()) <= EDGE_ROWS * max(1, len(ends)):
        edge = F.broadcast(edge)
    every = planned.join(edge, (F.col("source") == F.col("_s")) & (F.col("doc_id") == F.col("_d")) & counted & (F.col("_key") >= F.col("_low")), "left")
    extra = F.when(counted & (F.col("_key") < F.col("_low")), 1).otherwise(F.coalesce("_last", F.lit(0)))
    return every.withColumn("copies", F.col("epochs") + extra).where(F.col("copies") > 0).select("doc_id", "source", "tokens", "weight", "copies")


@dataclass
class _End:
    """Where a source's budget ends: a range of keys (both ends inclusive) with its number of documents, the tokens before it and the tokens to be filled."""

    low: float
    high: float
    base: int
    rows: int
    rest: int


def _narrow(docs: DataFrame, ends: dict[str, _End]) -> None:
    """Narrows every range that holds more than ``EDGE_ROWS`` documents to the block of it in which the budget ends.

    The lowest and the highest key of a range are never in one block, so every turn leaves fewer documents.
    """
    while True:
        wide = {s: e for s, e in ends.items() if e.rows > EDGE_ROWS and e.high > e.low}
        if not wide:
            return
        ranges = docs.sparkSession.createDataFrame([(s, e.low, e.high) for s, e in wide.items()], "source string, _low double, _high double")
        inside = docs.join(F.broadcast(ranges), "source").where(F.col("_key").between(F.col("_low"), F.col("_high")))
        # monotone in the key, so a block is a range of keys and its ends are those of its documents
        block = F.least(F.floor((F.col("_key") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BLOCKS), F.lit(BLOCKS - 1))
        blocks: dict[str, list] = {}
        for r in inside.groupBy("source", block.alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect():
            blocks.setdefault(r["source"], []).append(r)
        for s, e in wide.items():
            base = e.base
            for r in sorted(blocks[s], key=lambda r: r["b"]):
                if base + r["t"] > e.rest:
                    break
                base += r["t"]
            ends[s] = _End(r["lo"], r["hi"], base, r["n"], e.rest)


def mix_shares(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, tokens, documents, most_copies, actual_share`` of every target source."""
    per = plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    joined = targets.join(per, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))


def mixture(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents of the mixture, each as often as planned, with ``epoch`` counting its copies from 0 (a column of that name is replaced)."""
    chosen = documents.join(plan.select("doc_id", F.col("copies").alias("__copies")), "doc_id")
    return chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1))).drop("__copies")
