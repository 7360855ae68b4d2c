"""Sources: text files cut at line ends, and the Parquet tables of a data folder.

Splitting a file into blocks, handing blocks to machines and balancing them is the work of
Spark's file scan: ``spark.sql.files.maxPartitionBytes`` is the block size, the task scheduler
serves the blocks, and no line is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Either character ends a line on its own, so "\\r\\n" makes one empty line, which ``lines`` drops.
LINE_END = r"[\r\n]"


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row per line (``value``), or one per file with ``whole``."""
    return spark.read.text(path, wholetext=whole)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(df: DataFrame, text: str = "text", *keep: str | Column) -> DataFrame:
    """Non-empty lines of a text column as (keep..., pos, line); a null text has none."""
    return df.select(*keep, F.posexplode(F.split(text, LINE_END)).alias("pos", "line")).where("line <> ''")
