"""Processing only what is new or changed since the last successful run.

The target is the state.  Every output row keeps the key and version of the source row it
came from; a run anti-joins the source against what the current target version holds,
processes the rest and publishes the next target version atomically.  A run that fails
before its publication has no effect, so nothing is skipped and nothing is done twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from thermocline.functions.positions import SIGN_BIT
from thermocline.operators.support import small_side

#: Prefix of columns that must not meet those of the source.
_OWN = "__held_"


@dataclass
class TargetState:
    """What a target version holds.

    ``rows``: keys and versions of processed source rows; ``sealed``: per group the position up
    to which every source row has been processed, a compact stand-in for those rows.  Either may
    be None.
    """

    rows: DataFrame | None = None
    sealed: DataFrame | None = None


def pending(source: DataFrame, state: TargetState, key: Sequence[str], version: str, *, group: str | None = None, position: Column | None = None, sealed_position: str = "position") -> DataFrame:
    """Source rows that the target does not hold yet.

    A row is held if its group is sealed up to its ``position`` or beyond, or if the target has
    a row of the same key and version; nulls match nulls.  A row whose position is null lies
    below every position, so a sealed group holds it.  Groups that aren't sealed are pending as
    a whole.  The sealed side is broadcast only when its counted size is bounded; else the join
    shuffles and AQE splits hot groups.
    """
    out = source
    if state.sealed is not None and group is not None and position is not None:
        of, upto = f"{_OWN}group", f"{_OWN}sealed"
        sealed = state.sealed.select(F.col(group).alias(of), F.col(sealed_position).alias(upto)).where(F.col(upto).isNotNull())
        sealed = sealed.groupBy(of).agg(F.max(upto).alias(upto))
        held_up_to = F.coalesce(position, F.lit(SIGN_BIT)) <= F.col(upto)
        out = out.join(small_side(sealed), (F.col(group) == F.col(of)) & held_up_to, "left_anti")
    if state.rows is not None:
        names = [*key, version]
        held = state.rows.select(*[F.col(c).alias(f"{_OWN}{c}") for c in names]).distinct()
        on = None
        for c in names:
            same = F.col(c).eqNullSafe(F.col(f"{_OWN}{c}"))
            on = same if on is None else on & same
        out = out.join(held, on, "left_anti")
    return out


def after_key(columns: Sequence[Column], last: Sequence[Column]) -> Column:
    """Whether a composite key comes after another one, column by column; null when a deciding value is null."""
    out = columns[-1] > last[-1]
    for c, v in zip(reversed(columns[:-1]), reversed(last[:-1])):
        out = (c > v) | ((c == v) & out)
    return out


class IncrementalTarget:
    """A target kept as versions in a shared folder.

    ``segments/N-<attempt>/`` holds the rows of run N; ``commits/N.json`` names the segments of
    target version N.  A version exists once its commit file does, and the file is put in place
    by a rename that fails if another run was first.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), list(key), version
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def _segments(self, version: int) -> list[str]:
        if version == 0:
            return []
        text = self.spark.read.text(f"{self.path}/commits/{version}.json", wholetext=True).first()[0]
        return json.loads(text)["segments"]

    def rows(self) -> DataFrame | None:
        """All rows of the current version; None before the first."""
        segments = self._segments(self.current())
        return self.spark.read.option("mergeSchema", "true").parquet(*segments) if segments else None

    def pending(self, source: DataFrame) -> DataFrame:
        return pending(source, TargetState(rows=self.rows()), self.key, self.version)

    def adopt(self, done: DataFrame) -> int:
        """Makes the first version of a target from what other records say was processed; returns its rows.

        ``done`` has the key and version columns.  A target that has a version already is left as it is.
        """
        if self.current():
            return 0
        segment = f"{self.path}/segments/1-{uuid.uuid4().hex}"
        seen = Observation()
        done.select(*self.key, self.version).distinct().observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(segment)
        self._publish(0, segment)
        return seen.get["n"]

    def added(self) -> DataFrame:
        """Rows that the newest version added to the one before."""
        return self.spark.read.parquet(self._segments(self.current())[-1])

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Processes what is pending and publishes it; returns the number of rows published.

        ``process`` must keep the key and version columns.  Without pending rows no version is made.
        """
        base = self.current()
        segment = f"{self.path}/segments/{base + 1}-{uuid.uuid4().hex}"
        seen = Observation()
        process(self._once(self.pending(source))).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(segment)
        if seen.get["n"]:
            self._publish(base, segment)
        return seen.get["n"]

    def _once(self, rows: DataFrame) -> DataFrame:
        """One row per key and version: of several the one that sorts first, so that a repeated run takes the same."""
        names = [*self.key, self.version]
        rest = [c for c in rows.columns if c not in names]
        if not rest:
            return rows.distinct()
        if any("map<" in t for c, t in rows.dtypes if c in rest):
            return rows.dropDuplicates(names)
        return rows.groupBy(*names).agg(F.min(F.struct(*rest)).alias(f"{_OWN}rest")).select(*[F.col(c) if c in names else F.col(f"{_OWN}rest.{c}").alias(c) for c in rows.columns])

    def _publish(self, base: int, segment: str) -> None:
        text = json.dumps({"segments": [*self._segments(base), segment]})
        made = self._path(f"{self.path}/commits/_{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        final = self._path(f"{self.path}/commits/{base + 1}.json")
        # this rename, unlike the plain one, is defined to fail where the target exists
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(made, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            raise RuntimeError(f"version {base + 1} was published by another run") from e
