"""Session defaults shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine; a cluster session comes from spark-submit and needs none of this."""
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {memory} pyspark-shell")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace").config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    session = builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
