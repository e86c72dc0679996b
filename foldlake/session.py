"""Session helper for tests, benches and scripts. A cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "foldlake", memory: str = "8g") -> SparkSession:
    """A local session. ``spark.checkpoint.dir`` is set only here, where nothing else sets it."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", f"file:///tmp/foldlake-{os.getuid()}/shared")
        .config("spark.sql.warehouse.dir", f"/tmp/foldlake-{os.getuid()}/warehouse")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
