"""Word count as a job, for the command line."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.job import Job
from millrace.operators.mappers import tokens
from millrace.operators.reducers import fold


def job(column: str = "value") -> Job:
    return Job(
        mapper=lambda df: tokens(df, column).select("word", F.lit(1).cast("bigint").alias("n")),
        reducer=lambda df: fold(df, ["word"], "sum", "n", "n"),
    )
