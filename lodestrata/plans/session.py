"""A session with the settings the engine assumes; an existing session is reused as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lodestrata", cpus: int | None = None, shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, pass the cluster's own session around instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LODESTRATA_DRIVER_MEMORY", "8g"),
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
