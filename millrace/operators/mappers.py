"""Mappers: zero or more records per input row, as generator expressions or Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six white-space characters of the C locale, written out: engines differ on what \\s covers.
SPACE = r"[ \t\n\x0B\f\r]+"


def tokens(df: DataFrame, text: str = "text", *keep: str | Column) -> DataFrame:
    """White-space tokens as (keep..., word): case and punctuation stay, none is empty."""
    return df.select(*keep, F.explode(F.split(text, SPACE)).alias("word")).where("word <> ''")


def emit(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """One (first, second) record per row."""
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(as_column(key).alias("first"), as_column(value).alias("second"))


def map_blocks(df: DataFrame, mapper: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """A Python mapper over Arrow batches, for what no expression can say; None emits nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = mapper(batch)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)
