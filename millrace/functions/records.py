"""Record types: tuples of a key and a value, nested to any depth, as Spark structs.

Integers are INT, but their sums are BIGINT: 32 bits overflow, and ANSI mode would raise.
Composite keys compare on all their fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tuple_type(first: T.DataType, second: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("first", first), T.StructField("second", second)])


def pair(first: Column | str, second: Column | str) -> Column:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(as_column(first).alias("first"), as_column(second).alias("second"))


def leading(value: Column, kind: T.DataType) -> Column:
    """The leading leaf of a nested key, for jobs that group by it alone."""
    while isinstance(kind, T.StructType):
        value, kind = value.getField(kind.fields[0].name), kind.fields[0].dataType
    return value
