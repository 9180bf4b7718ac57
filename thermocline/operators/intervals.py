"""Continuous periods and gaps of half-open integer intervals.

Intervals are decomposed into canonical dyadic blocks (size 2^j, aligned to it); blocks
covered by an ancestor go, sibling pairs merge upward, and adjacent blocks coalesce.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from thermocline.operators.support import small_side, written

#: Intervals per cell of one group: the unit of work of a task.
CELL_INTERVALS = 100_000
TOP = np.uint64(1) << np.uint64(63)


def dyadic_blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical decomposition of [lo, hi) (unsigned): arrays of group, start and level."""
    lo, hi, group = lo.copy(), hi.copy(), group.copy()
    groups, starts, levels = [], [], []
    one = np.uint64(1)
    for j in range(64):
        if not len(lo):
            break
        bit = one << np.uint64(j)
        left = (lo < hi) & ((lo & bit) != 0)
        groups.append(group[left])
        starts.append(lo[left])
        levels.append(np.full(int(left.sum()), j, np.int8))
        lo = np.where(left, lo + bit, lo)
        done = left & (lo == 0)  # went past the top
        right = (lo < hi) & ~done & ((hi & bit) != 0)
        hi = np.where(right, hi - bit, hi)
        groups.append(group[right])
        starts.append(hi[right])
        levels.append(np.full(int(right.sum()), j, np.int8))
        open_ = (lo < hi) & ~done
        lo, hi, group = lo[open_], hi[open_], group[open_]
    if not groups:
        return group, lo, np.zeros(0, np.int8)
    return np.concatenate(groups), np.concatenate(starts), np.concatenate(levels)


def _last(level: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Last point of a block."""
    return start + ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))


def drop_covered(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without repeats and blocks that lie in a larger one.  Dyadic blocks nest or are disjoint, so
    in the order of start and falling size a block is covered when an earlier last point reaches its own."""
    order = np.lexsort((-level, start, group))
    group, start, level = group[order], start[order], level[order]
    if len(group) < 2:
        return group, start, level
    last = _last(level, start)
    rank = np.unique(last, return_inverse=True)[1].astype(np.int64)
    span = int(rank.max()) + 2
    dense = np.unique(group, return_inverse=True)[1].astype(np.int64)
    reach = np.maximum.accumulate(dense * span + rank)
    keep = np.ones(len(group), bool)
    keep[1:] = reach[:-1] < (dense * span + rank)[1:]
    return group[keep], start[keep], level[keep]


def merge_siblings(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sibling blocks become their parent, level by level upward."""
    out_g, out_s, out_l = [], [], []
    up_g, up_s = group[:0], start[:0]
    for j in range(64):
        here = level == j
        g, s = np.concatenate([group[here], up_g]), np.concatenate([start[here], up_s])
        up_g, up_s = g[:0], s[:0]
        if not len(g):
            continue
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        bit = np.uint64(1) << np.uint64(j)
        pair = np.zeros(len(g), bool)
        if j < 63 and len(g) > 1:
            pair[:-1] = (g[1:] == g[:-1]) & ((s[:-1] & bit) == 0) & (s[1:] == s[:-1] + bit)
        second = np.zeros(len(g), bool)
        second[1:] = pair[:-1]
        up_g, up_s = g[pair], s[pair]
        rest = ~(pair | second)
        out_g.append(g[rest])
        out_s.append(s[rest])
        out_l.append(np.full(int(rest.sum()), j, np.int8))
    if not out_g:
        return group, start, level
    return np.concatenate(out_g), np.concatenate(out_s), np.concatenate(out_l)


def coalesce_blocks(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of touching blocks: group, first point and last point."""
    order = np.lexsort((start, group))
    group, start, last = group[order], start[order], _last(level[order], start[order])
    if not len(group):
        return group, start, last
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] != last[:-1] + np.uint64(1))
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(group)) - 1
    return group[first], start[first], last[end]


def union_of(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods of the signed half-open intervals of each group: group, lo, hi."""
    offset = lambda x: x.astype(np.int64).view(np.uint64) ^ TOP
    g, s, last = coalesce_blocks(*merge_siblings(*drop_covered(*dyadic_blocks(group, offset(lo), offset(hi)))))
    return g, (s ^ TOP).view(np.int64), ((last + np.uint64(1)) ^ TOP).view(np.int64)


_MERGED = "_gid string, lo long, hi long, next long, edge boolean"


def _merge_cells(t: pa.Table) -> pa.Table:
    """Periods of the cells in ``t``, each with where the next one of its cell begins; the first and last of a cell are its edge."""
    codes = t["_gid"].combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    keys = np.stack([codes.indices.to_numpy().astype(np.int64), t["_cell"].to_numpy()], axis=1)
    uniq, idx = np.unique(keys, axis=0, return_inverse=True)
    g, lo, hi = union_of(idx.reshape(-1).astype(np.int64), t["lo"].to_numpy(), t["hi"].to_numpy())
    ends = np.ones(len(g), bool)
    ends[:-1] = g[1:] != g[:-1]
    begins = np.ones(len(g), bool)
    begins[1:] = ends[:-1]
    following = pa.array(np.append(lo[1:], 0), pa.int64(), mask=ends)
    return pa.table({"_gid": codes.dictionary.take(pa.array(uniq[g, 0])), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "next": following, "edge": pa.array(begins | ends)})


def periods(intervals: DataFrame, group: Sequence[str], lo: str, hi: str, *, cell_intervals: int = CELL_INTERVALS) -> DataFrame:
    """Maximal covered ranges per group: ``group columns, lo, hi``; touching intervals join.

    Intervals with a null bound or ``lo >= hi`` cover nothing; a group of such only has no
    period.  Null group values form a group; group columns are numbers, texts or booleans.
    Bounds may be any longs, repeated intervals count once, an empty input gives no rows.

    A group with more than ``cell_intervals`` intervals is cut at quantiles of ``lo`` into cells
    that are merged in parallel; what an interval covers beyond its first and last cell counts
    as whole cells, so long intervals are not copied into every cell they cross.  Only the first
    and last period of each cell are stitched per group; no other can touch one of another cell.
    """
    names, merged, cut = _merged(intervals, group, lo, hi, cell_intervals)
    return _named(_stitch(merged).select("_gid", "lo", "hi") if cut else merged.select("_gid", "lo", "hi"), intervals, names)


def _named(rows: DataFrame, intervals: DataFrame, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f"g{i}", intervals.schema[c].dataType) for i, c in enumerate(names)])
    return rows.withColumn("_g", F.from_json("_gid", schema)).select(*[F.col(f"_g.g{i}").alias(c) for i, c in enumerate(names)], *[c for c in rows.columns if c != "_gid"])


def _merged(intervals: DataFrame, group: Sequence[str], lo: str, hi: str, cell_intervals: int) -> tuple[list[str], DataFrame, bool]:
    """Merged periods of all cells, and whether any group was cut into several."""
    names = list(group)
    ids = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(names)])
    rows = intervals.select(F.to_json(ids).alias("_gid"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi")).where(F.col("lo") < F.col("hi"))
    large = rows.groupBy("_gid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_intervals)
    most = large.agg(F.max("n")).first()[0]
    pieces = rows.withColumn("_cell", F.lit(0).cast("long")) if most is None else _cells(rows, large, -(-most // cell_intervals), cell_intervals)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("_gid", "_cell"), F.lit(parts * 4)).cast("int")
    merged = pieces.select("_gid", F.col("_cell").cast("long"), "lo", "hi", bucket.alias("_bucket")).groupBy("_bucket").applyInArrow(_merge_cells, _MERGED)
    return names, merged, most is not None


def _cells(rows: DataFrame, large: DataFrame, cells: int, cell_intervals: int) -> DataFrame:
    """Pieces of intervals per cell, cells being ranges between quantiles of ``lo`` of a large group."""
    grid = [i / cells for i in range(1, cells)]
    big = rows.join(small_side(large.select("_gid")), "_gid", "left_semi")
    cuts = big.groupBy("_gid").agg(F.percentile_approx("lo", grid, max(10_000, 10 * cells)).alias("q"), F.count(F.lit(1)).alias("n"))
    step = F.floor(F.lit(cells) / F.ceil(F.col("n") / F.lit(cell_intervals))).cast("int")
    cuts = cuts.select("_gid", F.array_sort(F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0))).alias("cuts"))
    cell_of = lambda x: F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c <= x)))
    cut = lambda i: F.try_element_at("cuts", i.cast("int"))
    r = rows.join(small_side(cuts), "_gid", "left").withColumn("a", cell_of(F.col("lo"))).withColumn("b", cell_of(F.col("hi") - 1))
    inner = r.where(F.col("a") == F.col("b")).select("_gid", "lo", "hi", F.col("a").alias("_cell"))
    wide = r.where(F.col("a") < F.col("b"))
    first = wide.select("_gid", "lo", cut(F.col("a") + 1).alias("hi"), F.col("a").alias("_cell"))
    last = wide.select("_gid", cut(F.col("b")).alias("lo"), "hi", F.col("b").alias("_cell"))
    # cells between the first and the last are covered whole: +1 and -1 at the ends, summed along the cells of a group
    ends = F.array(F.struct((F.col("a") + 1).alias("c"), F.lit(1).alias("d")), F.struct(F.col("b").alias("c"), F.lit(-1).alias("d")))
    steps = wide.where(F.col("b") - F.col("a") > 1).select("_gid", F.explode(ends).alias("e")).groupBy("_gid", F.col("e.c").alias("c")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("_gid").orderBy("c")
    runs = steps.select("_gid", "c", F.sum("d").over(w).alias("open"), F.lead("c").over(w).alias("until")).where((F.col("open") > 0) & F.col("until").isNotNull())
    whole = runs.join(small_side(cuts), "_gid").select("_gid", cut(F.col("c")).alias("lo"), cut(F.col("until")).alias("hi"), F.col("c").alias("_cell"))
    return inner.unionByName(first).unionByName(last).unionByName(whole).where(F.col("lo") < F.col("hi"))


def _stitch(merged: DataFrame) -> DataFrame:
    """``_gid, lo, hi``: periods with what the cells of a group left apart joined; all but the edges of the cells stay as they are."""
    edges = merged.where("edge")
    before = Window.partitionBy("_gid").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    flagged = edges.withColumn("_reach", F.max("hi").over(before)).withColumn("_new", (F.col("_reach").isNull() | (F.col("lo") > F.col("_reach"))).cast("long"))
    run = Window.partitionBy("_gid").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    joined = flagged.withColumn("_run", F.sum("_new").over(run)).groupBy("_gid", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")
    return merged.where("NOT edge").select("_gid", "lo", "hi").unionByName(joined)


def periods_and_gaps(intervals: DataFrame, group: Sequence[str], lo: str, hi: str, *, cell_intervals: int = CELL_INTERVALS) -> DataFrame:
    """``group columns, kind, lo, hi``: every period and the gap between two neighbouring ones.

    Gaps within a cell are known where it was merged; those between cells come from the edges of
    the cells alone, so no task holds the periods of a whole group.
    """
    names, merged, cut = _merged(intervals, group, lo, hi, cell_intervals)
    if not cut:
        entries = F.array(F.struct(F.lit("period").alias("kind"), F.col("lo"), F.col("hi")), F.struct(F.lit("gap").alias("kind"), F.col("hi").alias("lo"), F.col("next").alias("hi")))
        rows = merged.select("_gid", F.explode(entries).alias("e")).where(F.col("e.hi").isNotNull()).select("_gid", "e.*")
        return _named(rows, intervals, names).select(*names, "kind", "lo", "hi")
    merged = written(merged, "interval-cells")
    kind = lambda df, name: df.select("_gid", F.lit(name).alias("kind"), "lo", "hi")
    inner = merged.where(F.col("next").isNotNull()).select("_gid", F.col("hi").alias("lo"), F.col("next").alias("hi"))
    edges = merged.where("edge").withColumn("_following", F.lead("lo").over(Window.partitionBy("_gid").orderBy("lo")))
    # within a cell the next edge may lie behind other periods; that gap is known already
    outer = edges.where(F.col("next").isNull() & (F.col("_following") > F.col("hi"))).select("_gid", F.col("hi").alias("lo"), F.col("_following").alias("hi"))
    rows = kind(_stitch(merged), "period").unionByName(kind(inner, "gap")).unionByName(kind(outer, "gap"))
    return _named(rows, intervals, names).select(*names, "kind", "lo", "hi")
