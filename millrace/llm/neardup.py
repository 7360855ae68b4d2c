"""Near-duplicates: MinHash bands for candidates, odd sketches to sift them, full sets to confirm them.

A document is the set of its distinct word shingles. Equal sets are one node, by a 128-bit hash of the set, so copies
are never compared. A node's MinHash has BANDS x ROWS samples; nodes that agree in a band share a bucket. A pair at the
threshold 0.8 misses all buckets with a chance of (1 - 0.8 ** 5) ** 40, about one in ten million. Samples are the least
hashes of as many ranges of hashes; an empty range takes the sample of the first full one in an order of its own, so each sample
is shared with the chance of the similarity, at one look at each shingle.

An odd sketch folds the samples into a bitmap: each flips one bit, picked by its value, so that samples which two nodes share
cancel in their XOR. The XOR's population count says how many samples differ, most precisely where few do. Pairs are
dropped only if it's over what the threshold allows by more than six standard deviations; all others are confirmed on the full sets.

A bucket of m nodes isn't m * m pairs. Links are found in rounds: in each, a bucket's members are held against one
pivot - first its smallest node, then its best linked one - each node against its most similar pivot only, and linked nodes
become components. What is left are buckets with members in different components. Nodes outside of a bucket's largest
component are then held against that component and against each other, in blocks of bounded size. A block sees wide sketches,
which tell a similarity of 0.6 from one of 0.8, and returns the nodes that are near another; the texts of these alone go
to the block, which returns links, whatever the number of pairs. Pairs within a component need no test, as they can't change it.
Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import WordHashes, Workspace, attached, packed, quoted, shingles, shuffle_partitions, sliced, staged, texts

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
#: Of 512; a pair at 0.8 differs in 40 of 200 samples, which flip 69 bits on average, with a deviation of about 9.5.
MOST_ODD = 128
PIVOT_ROUNDS = 2
#: Nodes of a block's two sides, when what the pivots left over is tested.
BLOCK_ONE, BLOCK_TWO = 64, 256
#: Pairs that share a pivot's text in one task; a pivot with more of them is salted.
PIVOT_PAIRS = 512
#: Samples of a wide sketch and its bits, as powers of two.
WIDE_SAMPLES, WIDE_BITS = 12, 12
#: Keys that a task remembers, so that it passes on a text of many copies once.
REMEMBERED = 200_000
_RANDOM = np.random.default_rng(20240229)
_SALT = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
#: For each sample the others in the order in which it asks them.
_PROBES = np.argsort(_RANDOM.random((SAMPLES, SAMPLES)), axis=1)
_BOUNDS = np.array([(i << 64) // SAMPLES for i in range(SAMPLES)], np.uint64)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = "key binary, fresh boolean, n bigint, odd array<bigint>, bands array<bigint>"
BLOCK = "group binary, i bigint, j bigint, one boolean, out boolean, key binary, root binary, n bigint, wide binary"
LINKS = "a binary, b binary"


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def minhash(found: np.ndarray) -> np.ndarray:
    """SAMPLES samples of a sorted set of hashes that isn't empty."""
    starts = np.searchsorted(found, _BOUNDS)
    full = np.append(starts[1:], len(found)) > starts
    out = found[np.minimum(starts, len(found) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities: sample i flips the bit that its value and i pick."""
    x = (samples + _SALT) * _TIMES
    x = (x ^ (x >> np.uint64(32))) * _TIMES
    bits = np.bincount((x >> np.uint64(64 - 9)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(found: np.ndarray) -> bytes:
    """Parities of the least hashes of 4096 ranges in 4096 bits; empty ranges flip none, so that small sets are told apart exactly."""
    ranges = found >> np.uint64(64 - WIDE_SAMPLES)
    least = found[np.flatnonzero(np.diff(ranges, prepend=ranges[:1] + np.uint64(1)))]
    x = (least ^ (least >> np.uint64(32))) * _TIMES
    bits = np.bincount(((x ^ (x >> np.uint64(32))) * _TIMES >> np.uint64(64 - WIDE_BITS)).astype(np.int64), minlength=1 << WIDE_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def most_wide(n: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Bits in which the wide sketches of sets of n and m shingles differ at most, if they reach the threshold.

    Each shingle that isn't shared changes one range and so flips two bits at most: that bounds small sets for certain. For larger ones
    it's the mean of the flipped bits at the threshold, where a set's least hash of a range isn't the other's, and six standard deviations of it.
    """
    both, q, samples, width = (n + m).astype(float), percent / 100, 1 << WIDE_SAMPLES, 1 << WIDE_BITS
    union = both / (1 + q)
    held = lambda size: samples * -np.expm1(-size / samples)  # noqa: E731  ranges that aren't empty
    flips = held(n) + held(m) - 2 * q * held(union)
    mean, kept = width / 2 * -np.expm1(-2 * flips / width), np.exp(-2 * flips / width)
    drawn = 4 * q * (1 - q) * held(union) * (1 - held(union) / union) + flips * union / (union + samples)
    deviation = np.sqrt(drawn * kept**2 + width / 4 * (1 - kept**2))
    return np.minimum(np.floor(2 * both * (1 - q) / (1 + q) + 1e-9), mean + 6 * deviation)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * _TIMES
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def shingle_set(text: bytes, hashes: WordHashes, words: int) -> np.ndarray:
    return shingles(hashes.of(text.lower().split()), words)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc, key, fresh, n, odd, bands) per row: all of its columns, set hash, set size, odd sketch and band hashes.

    Empty sets have no hash. ``fresh``: the first row of its set in a task, or nearly so; sets are told by these rows, however many copies there are.
    """
    whole = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in sliced(batches):
            keys, fresh, sizes, odd, bands = [], [], [], [], []
            for text in texts(batch.column(0).field("text")):
                found = shingle_set(text, hashes, words) if text else ()
                sizes.append(len(found))
                key = set_key(found) if len(found) else None
                keys.append(key)
                new = key is not None and key not in seen
                fresh.append(new)
                samples = minhash(found) if new else None
                odd.append(odd_sketch(samples) if new else None)
                bands.append(band_hashes(samples) if new else None)
                if new:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
            arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(fresh), pa.array(sizes, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "key", "fresh", "n", "odd", "bands"])

    return whole.mapInArrow(run, T.StructType(whole.schema.fields + T.StructType.fromDDL(SIGNATURE).fields))


def odd_bits(a: str, b: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_LONGS)])


def alike(a: str, b: str, percent: int) -> Column:
    """May two nodes reach the threshold? By set size for certain, by sketch all but for certain."""
    least, most = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")
    return (least * 100 >= most * percent) & (odd_bits(f"odd_{a}", f"odd_{b}") <= MOST_ODD)


def confirmed(pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. ``sets`` has a text for each node, bucketed by key.

    Only the texts of the pairs' one side move, to their pivots; those of pivots with many pairs go to several places.
    """
    pivots = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PIVOT_PAIRS).alias("parts"))
    hot = pivots.where("parts > 1")
    left = pairs.select("a", "b").join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    left = left.join(sets.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    right = pivots.join(sets.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    right = right.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "text_b")
    joined = left.join(right, ["b", "part"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, last_set = WordHashes(), None, None
        for batch in sliced(batches):
            keep = []
            for one, two in zip(texts(batch.column(2)), texts(batch.column(3)), strict=True):
                own = shingle_set(one, hashes, words)
                if two != last:  # rows come sorted by b, from its join
                    last, last_set = two, shingle_set(two, hashes, words)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(last_set) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, LINKS)


def components(work: Workspace, links: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) from each node of an undirected graph to the smallest node that it reaches, unless that is itself, by star contraction.

    ``stars`` are such edges of the graph without ``links``: what they have contracted isn't contracted again.
    """
    added = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = work.staged((added if stars is None else added.unionByName(stars)).distinct(), "components")
    while not contracted(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attached(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attached(large, roots, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.staged(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct(), "components")
    return edges


def contracted(edges: DataFrame) -> bool:
    """Are distinct edges from larger to smaller nodes stars? No node then has two edges up, or edges both up and down."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def rooted_nodes(stars: DataFrame) -> DataFrame:
    """(key, root) of every node of the stars, their roots included."""
    roots = stars.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(roots)


def numbered(docs: DataFrame, words: int) -> DataFrame:
    """signatures() with a number for each row, which is fixed once they are written."""
    return signatures(docs, words).withColumn("row", F.monotonically_increasing_id())


def first_rows(work: Workspace, signed: DataFrame, words: int, percent: int) -> DataFrame:
    """Of each set of written rows (key, best): its component's first row.

    ``best`` is (unnamed, doc_id, row) of the row with the smallest doc_id, null ones last, then the smallest row.
    """
    stars = all_stars(work, signed, words, percent)
    place = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("doc_id"), "row")
    firsts = signed.where("key is not null").groupBy("key").agg(F.min(place).alias("best"))
    if stars is not None:
        rooted = firsts.join(rooted_nodes(stars), "key", "left").withColumn("root", F.coalesce("root", "key"))
        whole = rooted.groupBy("root").agg(F.min("best").alias("least"))
        firsts = attached(rooted, whole, "root", "key").select("key", F.col("least").alias("best"))
    return work.staged(firsts, "firsts")  # written, so that adaptive execution may split a set of many copies where it's joined


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept.

    Documents are linked if 100 * shared shingles >= percent * all shingles of both; ``percent`` of 80 or more. Null and empty
    texts have no shingles, are linked with nothing and are their own component. A text of fewer than ``words`` words is one
    shingle; texts of any length are one row in a task. Rows that repeat are copies, ties of no consequence. A null doc_id is linked as any other, but never names a
    component that has another; ``kept`` is doc_id = component_id, so of null ones only those without a named document. An empty table
    gives no rows; other columns than doc_id and text aren't looked at, whatever their names.
    """
    with Workspace(docs.sparkSession, "near") as work:
        signed = work.staged(numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), words), "signatures")
        firsts = first_rows(work, signed, words, percent)
        out = signed.select(F.col("doc.doc_id").alias("doc_id"), "key", F.col("n").alias("n_shingles")).join(firsts, "key", "left")
        out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")))
        return staged(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near-duplicates")


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, of each component one row: that of the smallest doc_id, null ones last, and of rows of that id one.

    Links are as in near_duplicates(); rows without words are linked with nothing, so all of them stay. ``text`` is a string; other columns may have any names.
    """
    signed = staged(numbered(docs, words), "signed")  # stays, as the result is read from it
    with Workspace(docs.sparkSession, "dedup") as work:
        first = staged(first_rows(work, signed, words, percent).select("best.row").distinct(), "first-rows").hint("merge")
    alone = signed.where("key is null").select("doc")
    kept = signed.where("key is not null").select("doc", "row").join(first, "row", "left_semi").select("doc").unionByName(alone)
    return kept.select(*(F.col(f"doc.{quoted(c)}").alias(c) for c in docs.columns))


def all_stars(work: Workspace, signed: DataFrame, words: int, percent: int) -> DataFrame | None:
    """components() of links that connect all that is connected; None if no bucket is shared."""
    fresh = signed.where("fresh")
    banded = fresh.select("key", F.explode("bands").alias("bucket"))
    tag = F.xxhash64("key")
    shared = banded.groupBy("bucket").agg(F.min(tag).alias("low"), F.max(tag).alias("high")).where("low <> high").select("bucket")
    # written, so that adaptive execution may split a bucket that many nodes share
    members = work.staged(banded.join(work.staged(shared, "shared"), "bucket").select("bucket", "key"), "members")
    if members.isEmpty():
        return None
    near = members.select("key").distinct()
    sets = work.bucketed(fresh.select("key", "n", "odd", F.col("doc.text").alias("text")).repartition(shuffle_partitions(work.spark), "key").join(near, "key", "left_semi"), "sets", "key")
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    pivots = members.groupBy("bucket").agg(F.min("key").alias("b"))
    against = attached(members, pivots, "bucket", "key").where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    links = stars = None
    for _ in range(PIVOT_ROUNDS):
        sifted = attached(against.join(one, "a"), two, "b", "a").where(alike("a", "b", percent))
        best = sifted.groupBy("a").agg(F.min_by("b", F.struct(odd_bits("odd_a", "odd_b"), "b")).alias("b"))
        made = work.staged(confirmed(work.staged(best, "tests"), sets, words, percent), "links")
        links = made if links is None else links.unionByName(made)
        stars = components(work, made, stars)
        placed = members.join(rooted_nodes(stars), "key", "left").withColumn("root", F.coalesce("root", "key"))
        split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        placed = work.staged(attached(placed, split, "bucket", "key"), "placed")
        if placed.isEmpty():
            return stars
        members = placed.select("bucket", "key")
        degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
        ranked = placed.join(degree, "key", "left").select("bucket", F.struct(F.coalesce("links", F.lit(0)).alias("links"), "key", "root").alias("hub"))
        hubs = ranked.groupBy("bucket").agg(F.max("hub").alias("hub"))
        against = attached(placed, hubs, "bucket", "key").where("hub.root <> root").select(F.col("key").alias("a"), F.col("hub.key").alias("b")).distinct()
    return components(work, rest(work, placed, sets, words, percent), stars)


def rest(work: Workspace, placed: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the nodes outside of their bucket's largest component, and between them and that component."""
    largest = placed.distinct().groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("most"))
    grouped = attached(placed, largest, "bucket", "key").select(F.col("most.root").alias("group"), "key", "root", (F.col("root") != F.col("most.root")).alias("out")).distinct()
    grouped = work.staged(grouped, "grouped")
    sizes = grouped.groupBy("group").agg(F.ceil(F.sum(F.col("out").cast("int")) / BLOCK_ONE).alias("ones"), F.ceil(F.count(F.lit(1)) / BLOCK_TWO).alias("twos"))
    wide = work.staged(widely_sketched(grouped.select("key").distinct().join(sets, "key"), words), "wide")
    full = attached(grouped, sizes, "group", "key").join(wide, "key")
    sides = F.filter(F.array(F.col("out"), F.lit(False)), lambda s: F.col("out") | ~s)  # outer nodes are on both sides
    dealt = full.withColumn("one", F.explode(F.array_distinct(sides)))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("one"), F.col("ones")).otherwise(F.col("twos")))
    every = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("one"), F.col("twos")).otherwise(F.col("ones")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(every))
    dealt = dealt.select("group", F.when(F.col("one"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("one"), F.col("other")).otherwise(F.col("own")).alias("j"), "one", "out", "key", "root", "n", "wide")
    near = work.staged(dealt.groupBy("group", "i", "j").applyInArrow(lambda table: near_ones(table, percent), BLOCK), "near")
    told = attached(near, sets.select("key", "text"), "key", ["i", "j"])  # a node may be near others in many blocks
    return told.groupBy("group", "i", "j").applyInArrow(lambda table: block_links(table, words, percent), LINKS)


def widely_sketched(sets: DataFrame, words: int) -> DataFrame:
    """(key, n, wide) of rows of key, n and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            made = [wide_sketch(shingle_set(text, hashes, words)) for text in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["key", "n", "wide"])

    return sets.select("key", "n", "text").mapInArrow(run, "key binary, n bigint, wide binary")


class Block:
    """Nodes of a block's two sides, as arrays. Outer nodes are on both."""

    def __init__(self, table: pa.Table):
        flags = lambda name: np.array(table.column(name).to_pylist(), bool)
        self.out, self.left = flags("out"), np.flatnonzero(flags("one"))
        self.right = np.flatnonzero(~flags("one"))
        self.keys, roots = table.column("key").to_pylist(), table.column("root").to_pylist()
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        self.root = np.array([number[r] for r in roots], np.int64)
        self.n = table.column("n").to_numpy()
        self.wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(len(self.n), -1)

    def near(self, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the right side, in other components, that node i may be linked with by size and sketch; and in how many bits they differ."""
        there = self.right[self.root[self.right] != self.root[i]]
        there = there[np.minimum(self.n[there], self.n[i]) * 100 >= np.maximum(self.n[there], self.n[i]) * percent]
        far = np.bitwise_count(self.wide[there] ^ self.wide[i]).sum(axis=1)
        good = far <= most_wide(self.n[there], int(self.n[i]), percent)
        return there[good], far[good]


def near_ones(table: pa.Table, percent: int) -> pa.Table:
    """The rows of a block's nodes that may be linked with one of the other side."""
    block, wanted = Block(table), np.zeros(table.num_rows, bool)
    for i in block.left.tolist():
        near, _ = block.near(i, percent)
        wanted[near] = True
        wanted[i] = len(near) > 0
    return table.filter(pa.array(wanted))


def bitsets(sets: list[np.ndarray], vocabulary: np.ndarray) -> list[int]:
    """Each set's part in the sorted vocabulary, as the bits of an integer."""
    out = []
    for found in sets:
        flags = np.zeros(len(vocabulary), bool)
        flags[np.searchsorted(vocabulary, np.intersect1d(found, vocabulary, assume_unique=True))] = True
        out.append(int.from_bytes(np.packbits(flags).tobytes(), "big"))
    return out


def block_links(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Links from the block's one side to its other, one for each pair of components, best sketches first."""
    block, made = Block(table), []
    if len(block.left) and len(block.right):
        hashes = WordHashes()
        sets = [shingle_set(t, hashes, words) for chunk in table.column("text").chunks for t in texts(chunk)]
        vocabulary = np.intersect1d(np.unique(np.concatenate([sets[i] for i in block.left])), np.unique(np.concatenate([sets[i] for i in block.right])))
        bits = bitsets(sets, vocabulary)
        joined: set[tuple[int, int]] = set()
        for i in block.left.tolist():
            near, far = block.near(i, percent)
            for j in near[np.argsort(far, kind="stable")].tolist():
                if block.out[j] and block.keys[j] < block.keys[i] or (block.root[i], block.root[j]) in joined:
                    continue  # tested from the other side, or known
                both = (bits[i] & bits[j]).bit_count()
                if 100 * both >= percent * (block.n[i] + block.n[j] - both):
                    joined.add((block.root[i], block.root[j]))
                    made.append((block.keys[i], block.keys[j]))
    return pa.table({"a": pa.array([a for a, _ in made], pa.binary()), "b": pa.array([b for _, b in made], pa.binary())})
