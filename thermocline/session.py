"""Sessions with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def local_session(name: str = "thermocline", cpus: int | None = None, **settings: str) -> SparkSession:
    """A session on this machine, for tests and measurements."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} | settings
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
