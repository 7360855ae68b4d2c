"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt by hash to shards and lie in a seeded order there, end to end, as a
ring of words cut into blocks of equal size. Blocks go to sources by the highest quotients of
target / (2 k + 1), then in the same way to the shards of a source by shard size. A shard takes
its quota of blocks from a seeded place on, round its ring once or more. So each quota is an integer,
documents are whole but for those at the two ends, and the same seed gives the same mix.

Only one row per source comes to the driver, of MOST_SOURCES at most. A source's shards are at most ``MAX_SHARDS``, so that a hot source is spread over
many tasks; a shard's documents are narrow rows (ids and sizes), some 4 million of them where one source holds a third of 50 billion documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import few, packed, quoted, sliced, staged, texts

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2
BLOCK = 8
SHARD_WORDS = 1 << 18
MAX_SHARDS = 4096
#: A table of more is refused: its sources would be held by the driver.
MOST_SOURCES = 1_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEED = 17


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict[str | None, float]:
    """Words per source: shares of ``total`` times all words by weight, the weights repeating over the sources by code point, null last.

    No target is above ``most`` times its source; what is over is shared out again by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = total * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
        left = max(0.0, left)
    return out


def apportion(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Sainte-Laguë with upper bounds: each next seat goes to the highest votes / (2 held + 1), ties to the first.

    A divisor at which rounding hands out no more than the seats is found by bisection; the few left go one by one.
    """
    v, cap = np.asarray(votes, float), np.asarray(caps, np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = min(int(seats), int(cap.sum()))
    if seats <= 0:
        return [0] * len(v)
    held = lambda d: np.minimum(np.floor(v / d + 0.5), cap).astype(np.int64)
    low, high = v.sum() / (4.0 * seats + 4.0) / max(1, len(v)), 2.0 * v.max() + 1.0
    while held(low).sum() < seats:
        low /= 4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if held(middle).sum() <= seats else (middle, high)
    out = held(high)
    queue = [(-v[i] / (2 * out[i] + 1), i) for i in range(len(v)) if out[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(queue, (-v[i] / (2 * out[i] + 1), i))
    return out.tolist()


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc, size): each row's columns, and the words of its whole text; null and empty texts have none."""
    whole = packed(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = [len(t.split()) if t else 0 for t in texts(batch.column(0).field("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc", "size"])

    return whole.mapInArrow(count, T.StructType([*whole.schema.fields, T.StructField("size", T.LongType())]))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: int = MOST, block: int = BLOCK,
    shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, passes and spans.

    ``taken`` words are ``passes`` times the whole document and, once more, the half-open word ``spans`` of it.
    Null or empty texts: size and taken 0; texts of any length are counted whole. Null sources are a source of their own. Rows that repeat count each, documents whose
    places in the order tie are told apart by id and size. Other columns than doc_id, source and text aren't looked at, whatever their names.
    An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = sizes_of(narrow).select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size")
    return allotted(staged(sized, "mix-sizes"), weights, total, most, block, shard_words, max_shards, seed)


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents of which the mix takes any words, with all their columns but in ``text`` the words taken: whole texts, then parts of them, one after the other
    with a line end between. size, source_size, target and taken as in mix() are added, in place of columns of these names.

    Everything else is as in mix(), of whose ``options`` any may be given.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    kept = staged(sizes_of(docs.select(*(F.col(quoted(c)) for c in own))).withColumn("row", F.monotonically_increasing_id()), "sized")
    sized = kept.select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), "size", "row")
    wanted = allotted(sized, **options).where("taken > 0").select("row", "source_size", "target", "taken", "passes", "spans")
    joined = kept.join(wanted.hint("merge"), "row").select("doc", "size", "source_size", "target", "taken", "passes", "spans")
    names = [*joined.columns[:5], "taken_text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(batch.column(0).field("text").to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([taken_text(*r) for r in rows], pa.string())], names)

    made = joined.mapInArrow(cut, T.StructType([*joined.schema.fields[:5], T.StructField("taken_text", T.StringType())]))
    out = [F.col("taken_text" if c.lower() == "text" else f"doc.{quoted(c)}").alias(c) for c in own]
    return made.select(*out, "size", "source_size", "target", "taken")


def taken_text(text: str, passes: int, spans: list[dict[str, int]]) -> str:
    """``passes`` whole texts and the words of ``spans``, with the white space that's between them."""
    parts = [text] * passes
    if spans:
        words = [m.span() for m in WORD.finditer(text)]
        parts += [text[words[s["start"]][0] : words[s["end"] - 1][1]] for s in spans]
    return "\n".join(parts)


def allotted(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: int = MOST, block: int = BLOCK,
    shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = SEED,
) -> DataFrame:
    """mix() of documents whose sizes are known: rows of doc_id, source, size and any others, which stay."""
    spark, others = sized.sparkSession, [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    found = few(sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect(), MOST_SOURCES, "sources")
    totals = {r["source"]: r["words"] for r in found}
    wanted = targets(totals, weights, total, most)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    shards = {s: min(max_shards, -(-totals[s] // shard_words) or 1) for s in order}
    quotas = apportion([wanted[s] for s in order], round(sum(wanted.values()) / block), [most * totals[s] // block for s in order])
    table = spark.createDataFrame(
        [(s, int(totals[s]), float(wanted[s]), int(shards[s]), int(q)) for s, q in zip(order, quotas, strict=True)],
        "of string, source_size bigint, target double, shards bigint, quota bigint",
    )
    dealt = sized.join(table, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        rows["blocks"] = apportion(rows["words"].tolist(), int(rows["quota"].iloc[0]), (most * rows["words"] // block).tolist())
        return rows[["source", "shard", "words", "blocks"]]

    per_shard = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shared = per_shard.groupBy("source").applyInPandas(share, "source string, shard bigint, words bigint, blocks bigint")
    shared = shared.select(
        F.col("source").alias("of"), F.col("shard").alias("at"), "words", (F.col("blocks") * block).alias("quota_words"),
        F.when(F.col("words") > 0, F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.ceil(F.col("words") / block)) * block).alias("start"),
    )
    ring = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum("size").over(ring)).drop("of", "quota")
    placed = laid.join(shared, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))
    first = F.col("end") - F.col("size")
    passes = F.when(F.col("words") > 0, F.floor(F.col("quota_words") / F.col("words"))).otherwise(0)
    rest = F.when(F.col("words") > 0, F.col("quota_words") % F.col("words")).otherwise(0)
    cut = lambda low, high: F.struct(
        F.greatest(F.lit(0), low - first).cast("bigint").alias("start"), F.least(F.col("size"), high - first).cast("bigint").alias("end")
    )
    both = F.array(cut(F.col("start"), F.col("start") + F.col("rest")), cut(F.lit(0), F.col("start") + F.col("rest") - F.col("words")))
    spans = F.filter(both, lambda s: s["end"] > s["start"])
    made = placed.withColumn("passes", passes.cast("bigint")).withColumn("rest", rest).withColumn("spans", spans)
    taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return made.select(*others, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "spans")
