"""Exchanges: by hash, to one partition, or by a partition function of the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import murmur2_int, murmur2_string, tuple_hash


def by_hash(df: DataFrame, partitions: int, *keys: str | Column) -> DataFrame:
    """Rows of a key meet in one partition; Spark's own hash decides which."""
    return df.repartition(partitions, *keys)


def to_one(df: DataFrame) -> DataFrame:
    """All rows in one partition. What made them stays parallel: only its result is sent there. For bounded results."""
    return df.repartition(1)


def by_partitioner(df: DataFrame, partitions: int, partition: Column) -> DataFrame:
    """Send each row to exactly the partition numbered by ``partition``."""
    return df.repartitionById(partitions, partition.cast("int"))


def slot(hashed: Column, partitions: int) -> Column:
    """Partition number of a signed 32-bit hash: its magnitude modulo n; the smallest integer has none and goes to 0."""
    smallest = F.lit(-(2**31))
    return F.when(hashed == smallest, F.lit(0)).otherwise(F.abs(hashed) % partitions).cast("int")


def partition_of_int(df: DataFrame, key: str, partitions: int, name: str = "pid") -> DataFrame:
    """Add the partition that the classic 32-bit hash gives an integer key."""
    return murmur2_int(df, key, "_hash").withColumn(name, slot(F.col("_hash"), partitions)).drop("_hash")


def partition_of_string(df: DataFrame, key: str, partitions: int, name: str = "pid") -> DataFrame:
    """Add the partition that the classic 32-bit hash gives a string key; a null key has none."""
    return df.withColumn(name, slot(murmur2_string(F.col(key)), partitions))


def partition_of_tuple(df: DataFrame, hashes: list[str | Column], partitions: int, name: str = "pid") -> DataFrame:
    """Add the partition of a nested key, given the hashes of its leaves."""
    return df.withColumn(name, slot(tuple_hash(*(F.col(h) if isinstance(h, str) else h for h in hashes)), partitions))
