"""Reducers: declarative folds first, streams over key-sorted partitions where a fold can't say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def fold(df: DataFrame, keys: list[str | Column], how: str, value: str | Column | None = None, name: str = "second", separator: str = "") -> DataFrame:
    """Fold the values of each key: sum, count, min, max, concat, union or distinct; ``folds`` has their meaning. ``distinct`` keeps the keys alone."""
    if how == "distinct":
        return df.select(*keys).distinct()
    return folds(df, keys, {name: (how, value)}, separator)


def folds(df: DataFrame, keys: list[str | Column], wanted: dict[str, tuple[str, str | Column | None]], separator: str = "") -> DataFrame:
    """Several folds at once, by name: (how, value).

    All are built-in aggregates, so Catalyst combines on the map side. ``sum`` is BIGINT. ``concat`` joins
    the values in their order, since records of a key come in no defined one; ``union`` does so with each value once.
    Both hold a key's values in one row, as their result does: for keys of unbounded size group by ``part_of`` too.
    """

    def made(how: str, value: str | Column | None) -> Column:
        column = F.col(value) if isinstance(value, str) else value
        if how == "count":
            return F.count(F.lit(1))
        if column is None:
            raise ValueError(f"{how} needs a value")
        joined = lambda values: F.array_join(F.array_sort(values).cast("array<string>"), separator)
        by_name: dict[str, Callable[[Column], Column]] = {
            "sum": lambda c: F.sum(c.cast("bigint")), "min": F.min, "max": F.max,
            "concat": lambda c: joined(F.collect_list(c)), "union": lambda c: joined(F.collect_set(c)),
        }
        return by_name[how](column)

    return df.groupBy(*keys).agg(*(made(*w).alias(name) for name, w in wanted.items()))


def part_of(value: str | Column, parts: int) -> Column:
    """Deals the values of a key to ``parts`` groups, so that a fold of it is in that many rows of bounded size."""
    return F.pmod(F.xxhash64(value), F.lit(parts))


def sorted_stream(df: DataFrame, partitions: int, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Each key in one partition, each partition sorted by key (and within it by ``then``); Spark spills and merges."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys, *then)


def reduce_stream(
    df: DataFrame, keys: list[str], reducer: Callable[[Batches], Batches], schema: str | T.StructType, partitions: int,
    combiner: Callable[[Batches], Batches] | None = None, then: tuple[str, ...] = (),
) -> DataFrame:
    """Call ``reducer`` once per partition that has rows, over its whole key-sorted stream.

    The reducer may keep state across keys. It sees batches, never the partition at once. A ``combiner`` makes fewer records of
    the same type before they are sent: of a frequent key one or a few a task.
    """

    def run(batches: Batches) -> Batches:
        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is not None:
            yield from reducer(chain([first], full))

    sent = df.mapInArrow(combiner, df.schema) if combiner else df
    return sorted_stream(sent, partitions, *keys, then=then).mapInArrow(run, schema)


def combined_sums(key: str, value: str, most: int = 200_000) -> Callable[[Batches], Batches]:
    """A combiner for sums: holds about ``most`` keys at a time."""

    def combiner(batches: Batches) -> Batches:
        held: list[pa.Table] = []
        rows = 0
        kind: pa.Schema | None = None

        def summed() -> pa.Table:
            table = pa.concat_tables(held).group_by(key).aggregate([(value, "sum")])
            return pa.table([table.column(key), table.column(f"{value}_sum")], schema=kind)

        for batch in batches:
            kind = batch.schema
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 2 * most:
                held = [summed()]
                rows = held[0].num_rows
                if rows >= most:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from summed().to_batches()

    return combiner


def runs(batches: Batches, key: str) -> Iterator[tuple[Any, Iterator[pa.RecordBatch]]]:
    """Groups of equal neighbours as (key, slices); a group may go over any number of batches.

    Like itertools.groupby, a group's slices must be read before the next group is asked for.
    """
    pending: list[pa.RecordBatch] = []

    def pull() -> bool:
        if not pending:
            pending.extend(b for b in [next(batches, None)] if b is not None)
        return bool(pending)

    def slices(value: Any) -> Iterator[pa.RecordBatch]:
        while pull():
            batch = pending.pop()
            end = _edges(batch.column(key))[1] if batch.column(key)[0].as_py() == value else 0
            if end < batch.num_rows:
                pending.append(batch.slice(end))
            if end:
                yield batch.slice(0, end)
            if end < batch.num_rows:
                return

    while pull():
        value = pending[0].column(key)[0].as_py()
        group = slices(value)
        yield value, group
        for _ in group:
            pass


def _edges(column: pa.Array) -> np.ndarray:
    """Places where a sorted column changes, with 0 and its length. Nulls equal each other."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def sum_runs(key: str, value: str, name: str) -> Callable[[Batches], Batches]:
    """A reducer that sums ``value`` over runs of ``key``: a batch at a time, with the last run carried over."""

    def reducer(batches: Batches) -> Batches:
        open_key: pa.Array | None = None
        total = 0
        for batch in batches:
            column, edges = batch.column(key), _edges(batch.column(key))
            values = pc.fill_null(batch.column(value), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            sums = np.add.reduceat(values, edges[:-1])
            heads = column.take(pa.array(edges[:-1]))
            if open_key is not None:
                if heads[0].as_py() == open_key[0].as_py():
                    sums[0] += total
                else:
                    yield _batch(key, open_key, name, np.array([total]))
            if len(sums) > 1:
                yield _batch(key, heads.slice(0, len(sums) - 1), name, sums[:-1])
            open_key, total = heads.slice(len(sums) - 1), int(sums[-1])
        if open_key is not None:
            yield _batch(key, open_key, name, np.array([total]))

    return reducer


def rank_runs(keys: list[str], name: str) -> Callable[[Batches], Batches]:
    """A reducer that numbers the records of each key from 1, in the order of the stream; the key is the first of ``keys``, all are kept."""

    def reducer(batches: Batches) -> Batches:
        open_key: pa.Array | None = None
        before = 0
        for batch in batches:
            column, edges = batch.column(keys[0]), _edges(batch.column(keys[0]))
            place = np.arange(batch.num_rows) - np.repeat(edges[:-1], np.diff(edges)) + 1
            if open_key is not None and column[0].as_py() == open_key[0].as_py():
                place[: edges[1]] += before
            open_key, before = column.slice(batch.num_rows - 1), int(place[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(place, pa.int32())], [*keys, name])

    return reducer


def _batch(key: str, keys: pa.Array, name: str, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array(sums, pa.int64())], [key, name])


def reduce_groups(df: DataFrame, keys: list[str], reducer: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """Call ``reducer`` once per key with that key's rows. For keys of bounded size."""
    return df.groupBy(*keys).applyInArrow(reducer, schema)
