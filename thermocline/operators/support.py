"""Helpers shared by operators: table access, size-checked broadcasts, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: A side is broadcast only when it is counted to have no more rows and bytes of text than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Estimates from here on are Spark's stand-in for an unknown size.
UNKNOWN_BYTES = 1 << 60
#: Tables written by :func:`written` in this process.
_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is counted to be small enough for a broadcast; the count stops at ``rows`` + 1."""
    def width(name: str, dtype: str):
        if dtype in ("string", "binary"):
            return F.octet_length(F.col(name).cast("binary"))
        if dtype.startswith(("array", "map", "struct")):
            return F.octet_length(F.to_json(F.struct(F.col(name))))
        return F.lit(16)

    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    size = sum((F.coalesce(width(c, t), F.lit(0)) for c, t in named.dtypes), F.lit(0))
    n, total = named.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= rows and total <= text_bytes


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be bounded, else as it is: Spark then shuffles, and AQE splits skewed keys."""
    return F.broadcast(df) if bounded(df, rows, text_bytes) else df


def estimated_bytes(df: DataFrame) -> int:
    """Size of what ``df`` reads: the estimates of the leaves of its plan (those of joins multiply their sides).

    Leaves of unknown size, such as rows handed over by the driver, are taken from a count of ``df``.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = [s for s in sizes if s >= UNKNOWN_BYTES]
    return sum(s for s in sizes if s < UNKNOWN_BYTES) + (df.count() * 100 if unknown else 0)


def partitions_for(df: DataFrame, bytes_each: int, expansion: float = 1.0) -> int:
    """Number of parts of about ``bytes_each``, at least the default parallelism."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, -(-estimated_bytes(df) * expansion // bytes_each)))


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, named by ``spark.checkpoint.dir``; where that is unset (a single machine), a temporary one is made and set."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_ = "file://" + tempfile.mkdtemp(prefix="thermocline-")
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors.  ``folders``: columns whose values lie in files of their own; a filter on them reads nothing else."""
    path = scratch_path(df.sparkSession, label)
    _SCRATCH.append(path)
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_seen(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`written`, with named aggregates over all rows that the same pass gives."""
    seen = Observation()
    return written(df.observe(seen, *metrics), label), seen.get


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in at least ``per_core`` parts per core, for steps that work long on each row.

    For a scan only.  Few or small files make fewer splits than there are cores; a large input has
    more splits than wanted and isn't shuffled.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else df.repartition(wanted)


def release_scratch(spark: SparkSession) -> int:
    """Deletes what :func:`written` has written so far; call it when no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    n = 0
    while _SCRATCH:
        p = path(_SCRATCH.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n
