"""Sinks: records as text lines, written once and never over an existing result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.exchange import to_one


def to_string(value: Column, kind: T.DataType) -> Column:
    """Integers in decimal, strings in unescaped quotes, tuples as ``(a, b)``, nested as deep as they go."""
    if isinstance(kind, T.StructType):
        parts: list[Column] = []
        for field in kind.fields:
            parts += [F.lit(", "), to_string(value.getField(field.name), field.dataType)]
        return F.concat(F.lit("("), *parts[1:], F.lit(")"))
    text = F.coalesce(value.cast("string"), F.lit("null"))
    return F.concat(F.lit('"'), text, F.lit('"')) if isinstance(kind, T.StringType) else text


def to_lines(df: DataFrame) -> DataFrame:
    """One ``line`` per record; several columns make one tuple."""
    fields = df.schema.fields
    if len(fields) == 1:
        return df.select(to_string(F.col(f"`{fields[0].name}`"), fields[0].dataType).alias("line"))
    return df.select(to_string(F.struct(*(F.col(f"`{f.name}`") for f in fields)), df.schema).alias("line"))


def write_text(df: DataFrame, path: str, gather: bool = True) -> None:
    """Write records as text; raises if ``path`` exists. An empty result is an empty file and a success.

    ``gather`` makes one part file, as a single reader wants it; pass False where the result is large.
    """
    rows = to_lines(df)
    (to_one(rows) if gather else rows).write.mode("errorifexists").text(path)
