"""Benchmark decontamination by size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by their number of shingles. In a partition whose largest item has u shingles, an item's
MinHash sketch holds its k smallest shingle hashes, k = SAMPLES + the most shingles that an item of u may lack at the
threshold. The share of a sketch found in a document estimates the item's containment there, however long the document is;
an item at or above the threshold can lack no more of its sketch than of itself, which bounds that share from below.
So the search misses nothing, and each hit is verified by exact containment of the full shingle sets.

Documents aren't shuffled and read once. Items are dealt by id to blocks of about ``BLOCK_SHINGLES``, which tasks build and write to the shared
folder; only their names come to the driver. A task that reads documents loads one block at a time: of a large benchmark, each for the
shingles of many documents, ``HELD`` at most.
"""

from __future__ import annotations

import io
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHashes, get, put, rolled, scratch, shingles, sliced, texts

WORDS = 5
THRESHOLD = 0.8
SAMPLES = 8
#: 32 bytes each while a block is loaded, at most twice over while it is built.
BLOCK_SHINGLES = 1_000_000
#: Shingles of documents that a task holds while it goes over several blocks.
HELD = 4_000_000
RESULT = "doc_id bigint, item_id bigint, item_shingles bigint, shared_shingles bigint, containment double"


def needed(size: int, threshold: float) -> int:
    """The least shared shingles of an item of ``size`` at the threshold."""
    return max(1, math.ceil(size * threshold - 1e-9))


class Sketches:
    """A block of items: full sets and sketches, by sorted hash. An item of several texts has the set of all of them, then each one's."""

    def __init__(self, items: dict[int, list[np.ndarray]], threshold: float, samples: int = SAMPLES):
        entries = [(i, s) for i, own in items.items() for s in ([np.unique(np.concatenate(own))] if len(own) > 1 else []) + own]
        self.ids, sets = [i for i, _ in entries], [s for _, s in entries]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.least = np.array([needed(n, threshold) for n in self.sizes.tolist()], np.int64)
        partition = np.array([int(n).bit_length() for n in self.sizes.tolist()], np.int64)
        largest = {p: int(self.sizes[partition == p].max()) for p in set(partition.tolist())}
        k = [min(n, samples + largest[p] - needed(largest[p], threshold)) for n, p in zip(self.sizes.tolist(), partition.tolist(), strict=True)]
        # sets are sorted by hash, and hashes are uniform, so the first k are a bottom-k sketch
        self.hit_least = np.maximum(1, np.array(k, np.int64) - (self.sizes - self.least))
        self.sketch, self.sketch_of = self._index([s[:n] for s, n in zip(sets, k, strict=True)])
        self.full, self.full_of = self._index(sets)
        self._mark()

    def _mark(self) -> None:
        self.bits = np.zeros(1 << max(10, int(len(self.sketch) * 16).bit_length()), bool)
        self.bits[self._slot(self.sketch)] = True

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=np.array(self.ids, np.int64), **{name: getattr(self, name) for name in PACKED})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Sketches:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as arrays:
            made.ids = arrays["ids"].tolist()
            for name in PACKED:
                setattr(made, name, arrays[name])
        made._mark()
        return made

    @staticmethod
    def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], owners[order]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.bits) - 1)).astype(np.int64)

    @staticmethod
    def _hits(index: np.ndarray, owners: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Owners of the index entries that are in ``found``, once per entry."""
        low, high = np.searchsorted(index, found, "left"), np.searchsorted(index, found, "right")
        spans = [owners[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
        return np.concatenate(spans) if spans else np.empty(0, np.int64)

    def search(self, document: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, shared shingles) of each item contained, once; ``document`` is a set of hashes."""
        near = document[self.bits[self._slot(document)]]
        hits = Counter(self._hits(self.sketch, self.sketch_of, near).tolist()) if len(near) else {}
        candidates = [i for i, n in hits.items() if n >= self.hit_least[i]]
        if not candidates:
            return []
        shared = Counter(self._hits(self.full, self.full_of, document).tolist())
        found: dict[int, tuple[int, int, int]] = {}
        for i in sorted(candidates):
            if shared[i] >= self.least[i]:
                found.setdefault(self.ids[i], (self.ids[i], int(self.sizes[i]), shared[i]))
        return list(found.values())


PACKED = ["sizes", "least", "hit_least", "sketch", "sketch_of", "full", "full_of"]


def blocks(items: DataFrame, folder: str, words: int, threshold: float, most: int) -> list[str]:
    """Write the items to blocks in ``folder``; the names of those that have any."""
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    total = known.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    number = max(1, -(-total // most))

    def build(table: pa.Table) -> pa.Table:
        hashes, sets = WordHashes(), {}
        rows = sorted(zip(table.column("item_id").to_pylist(), (t for chunk in table.column("text").chunks for t in texts(chunk)), strict=True))
        for item, text in rows:
            found = hashes.of(text.lower().split())
            if len(found) >= words:
                sets.setdefault(item, []).append(shingles(found, words))
        name = f"{uuid.uuid4().hex}.npz"
        if sets:
            put(folder, name, Sketches(sets, threshold).packed())
        return pa.table({"name": pa.array([name] if sets else [], pa.string())})

    dealt = known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(number)))
    return sorted(r["name"] for r in dealt.groupBy("block").applyInArrow(build, "name string").collect())


class Loaded:
    """The block that a Python worker has loaded last."""

    name, block = "", None

    @classmethod
    def of(cls, folder: str, name: str) -> Sketches:
        if cls.name != f"{folder}/{name}":
            cls.block = None
            cls.block, cls.name = Sketches.unpacked(get(folder, name)), f"{folder}/{name}"
        return cls.block


Hits = list[tuple[int, int, int]]


def searched(folder: str, names: list[str], words: int, column: int, held: int = HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[Hits]]]]:
    """A function that gives batches together with what each of their texts contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Hits]]]:
        hashes, waiting, size = WordHashes(), [], 0

        def found() -> Iterator[tuple[pa.RecordBatch, list[Hits]]]:
            hits: list[list[Hits]] = [[[] for _ in sets] for _, sets in waiting]
            for name in names:
                block = Loaded.of(folder, name)
                for (_, sets), own in zip(waiting, hits, strict=True):
                    for place, document in enumerate(sets):
                        if len(document):
                            own[place] += block.search(document)
            yield from ((batch, own) for (batch, _), own in zip(waiting, hits, strict=True))

        for batch in sliced(batches):
            sets = []
            for text in texts(batch.column(column)):
                own = hashes.of(text.lower().split()) if text else ()
                sets.append(np.unique(rolled(own, words)) if len(own) >= words else np.empty(0, np.uint64))
                size += len(sets[-1])
            waiting.append((batch, sets))
            if len(names) <= 1 or size >= held:
                yield from found()
                waiting, size = [], 0
        if waiting:
            yield from found()

    return run


def find_contained(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, most: int = BLOCK_SHINGLES, held: int = HELD) -> DataFrame:
    """Pairs of a document and a test item at least ``threshold`` of whose word shingles it holds.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns aren't looked at, whatever their names. Words are lower-cased A-Z. Items of fewer than ``words`` words
    can't be told from chance and are never found; null and empty texts hold nothing, and items without id or text are left out. Texts of any length are searched whole.
    An item_id of several texts is found if all of them together are, or else any one of them, whose counts the row then has. Repeated documents are found
    each, repeated items once; a null doc_id is found too. No documents or no items: no pairs.
    """
    folder = f"{scratch(docs.sparkSession)}/items-{uuid.uuid4().hex}"
    search = searched(folder, blocks(items, folder, words, threshold, most), words, 1, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in search(batches):
            rows = [(doc_id, item, size, n, n / size) for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True) for item, size, n in own]
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


SCHEMA = pa.schema([(part.split()[0], pa.float64() if "double" in part else pa.int64()) for part in RESULT.split(", ")])


def decontaminate(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, most: int = BLOCK_SHINGLES, held: int = HELD) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all their columns, whatever their names. Nothing is shuffled or joined.

    What is found is as in find_contained(): null and empty texts stay, rows that repeat stay or go alike, an empty table gives no rows, and no items take nothing away.
    """
    folder = f"{scratch(docs.sparkSession)}/items-{uuid.uuid4().hex}"
    search = searched(folder, blocks(items, folder, words, threshold, most), words, docs.columns.index("text"), held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in search(batches):
            yield batch.filter(pa.array([not own for own in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
