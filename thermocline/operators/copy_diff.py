"""Differences between two copies of a dataset, field by field.

Both sides are hashed into buckets, cogrouped as Arrow tables, aligned by a sorted search
on the key and compared through null-aware masks, one column at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from thermocline.operators.support import partitions_for, written

#: Bytes of file data that one bucket may stand for.
BUCKET_BYTES = 16 << 20

RESULT = "table_id long, pk string, kind string, field_name string"


def _aligned_types(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the same type per field, so that numbers compare by value."""

    def common(a: T.DataType, b: T.DataType) -> T.DataType:
        if a == b:
            return a
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(a, whole) and isinstance(b, whole):
            return T.LongType()
        if isinstance(a, whole) and isinstance(b, T.DecimalType) or isinstance(b, whole) and isinstance(a, T.DecimalType):
            scale = (a if isinstance(a, T.DecimalType) else b).scale
            return T.DecimalType(min(38, 19 + scale), scale)
        if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
            return T.DoubleType()
        return T.StringType()

    kinds = {c: common(left.schema[c].dataType, right.schema[c].dataType) for c in fields}
    cast = lambda df: df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
    return cast(left), cast(right)


def _one_row_per_key(side: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exact repeats folded in the map tasks; ``_several`` marks keys with different rows, told by the lowest and the highest row themselves."""
    row = F.struct(*[F.col(c) for c in fields], F.lit(0).alias("_"))
    folded = side.select("table_id", "pk", row.alias("_r")).groupBy("table_id", "pk").agg(F.min("_r").alias("_r"), F.max("_r").alias("_top"))
    return folded.select("table_id", "pk", *[F.col(f"_r.{c}").alias(c) for c in fields], (~F.col("_r").eqNullSafe(F.col("_top"))).alias("_several"))


def _compare(fields: Sequence[str]):
    names = list(fields)

    def keys(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Keys of both sides as numbers of one dictionary, so that they are sorted and searched as integers."""
        both = [pc.binary_join_element_wise(pc.cast(t["table_id"], pa.string()), t["pk"], "\x1e").cast(pa.large_string()) for t in (left, right)]
        codes = pa.chunked_array([c for side in both for c in side.chunks], pa.large_string()).combine_chunks().dictionary_encode()
        numbers = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        return numbers[: left.num_rows], numbers[left.num_rows :]

    def cells(t: pa.Table, rows: np.ndarray, kind: str, field: str) -> pa.Table:
        at = pa.array(rows)
        n = len(rows)
        return pa.table([t["table_id"].take(at), t["pk"].take(at), pa.array([kind] * n, pa.string()), pa.array([field] * n, pa.string())], names=["table_id", "pk", "kind", "field_name"])

    def differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
        unequal = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(a.type):
            both_nan = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
            unequal = pc.and_(unequal, pc.invert(both_nan))
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        return np.asarray(pc.or_(unequal, one_null))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        lk, rk = keys(left, right)
        order = np.argsort(rk, kind="stable")
        rk = rk[order]
        at = np.searchsorted(rk, lk) if len(rk) else np.zeros(len(lk), dtype=np.int64)
        hit = np.zeros(len(lk), dtype=bool)
        inside = at < len(rk)
        hit[inside] = rk[at[inside]] == lk[inside]
        matched = np.zeros(len(rk), dtype=bool)
        matched[at[hit]] = True
        out = [cells(left, np.flatnonzero(~hit), "heap_only", ""), cells(right, np.sort(order[~matched]), "lake_only", "")]
        li, ri = np.flatnonzero(hit), order[at[hit]]
        if len(li):
            several = np.asarray(pc.or_(left["_several"].take(pa.array(li)), right["_several"].take(pa.array(ri))))
            out.append(cells(left, li[several], "several", ""))
            li, ri = li[~several], ri[~several]
            la, ra = pa.array(li), pa.array(ri)
            for name in names:
                out.append(cells(left, li[differs(left[name].take(la), right[name].take(ra))], "differs", name))
        return pa.concat_tables([t.cast(out[0].schema) for t in out]).select(["table_id", "pk", "kind", "field_name"])

    return compare


def _values_differ(left: DataFrame, right: DataFrame, conflicts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys with several different rows on a side: a field differs if the sets of its values differ."""

    def cells(side: DataFrame, bit: int) -> DataFrame:
        of = side.join(conflicts, ["table_id", "pk"], "left_semi")
        entries = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in fields])
        return of.select("table_id", "pk", F.explode(entries).alias("e"), F.lit(bit).alias("side")).select("table_id", "pk", "e.*", "side")

    both = cells(left, 1).unionByName(cells(right, 2))
    per_value = both.groupBy("table_id", "pk", "field_name", "value").agg(F.bit_or("side").alias("sides"))
    return per_value.where(F.col("sides") != 3).select("table_id", "pk", F.lit("differs").alias("kind"), "field_name").distinct()


def copy_differences(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows missing on either side and every differing field of keys on both sides.

    ``left`` and ``right`` have ``table_id``, ``pk`` (key text) and ``fields``; other columns
    are ignored.  The result has ``table_id, pk, kind, field_name``: ``heap_only`` for keys on
    the left only, ``lake_only`` for keys on the right only (empty field name), ``differs``
    once per field whose values differ.  Numbers compare by value, null equals only null, NaN
    equals NaN, -0.0 equals 0.0.  Exact repeats of a row are one row.  Where a key has several
    different rows on a side, a field differs if the sets of its values on the two sides
    differ.  Rows with a null table or key can't be aligned and are left out.  Empty sides
    are allowed.

    Repeats are folded by a partial aggregate before the exchange, so a bucket holds one row
    per key and side whatever the skew; the number of buckets follows the size of the input.
    """
    pick = lambda df: df.select("table_id", "pk", *fields).where(F.col("table_id").isNotNull() & F.col("pk").isNotNull())
    left, right = _aligned_types(pick(left), pick(right), fields)
    normal = lambda df: df.select(*[(F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) if t in ("double", "float") else F.col(c)).alias(c) for c, t in df.dtypes])
    left, right = normal(left), normal(right)
    parts = max(partitions_for(left, BUCKET_BYTES, 2.0), partitions_for(right, BUCKET_BYTES, 2.0))
    bucket = F.pmod(F.xxhash64("table_id", "pk"), F.lit(parts)).cast("int")
    lb = _one_row_per_key(left, fields).withColumn("_bucket", bucket)
    rb = _one_row_per_key(right, fields).withColumn("_bucket", bucket)
    found = lb.groupBy("_bucket").cogroup(rb.groupBy("_bucket")).applyInArrow(_compare(fields), RESULT)
    found = written(found, "copy-differences")
    plain = found.where(F.col("kind") != "several")
    conflicts = found.where(F.col("kind") == "several").select("table_id", "pk")
    if conflicts.isEmpty():
        return plain
    return plain.unionByName(_values_differ(left, right, conflicts, fields))
