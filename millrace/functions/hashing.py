"""MurmurHash2 (Austin Appleby, public domain) as the classic partition hash.

Only needed where placement itself is the result; exchanges use Spark's hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash.
MULTIPLIER = 0x5BD1E995
SEED = 0x82B19283
SHIFT = 24

MASK = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 32) if x >> 31 else x


def murmur2_int(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the signed hash of an integer column's low 32 bits, in native bigint arithmetic.

    Each step is a projection of its own, so that an expression doesn't hold its input twice over.
    """
    start = ((SEED ^ 4) * MULTIPLIER) & MASK
    mixed = lambda c: (c * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))
    folded = lambda c, n: c.bitwiseXOR(F.shiftright(c, n))
    k = F.col("_k")
    steps: list[Column] = [
        mixed(k), folded(k, SHIFT), mixed(k), k.bitwiseXOR(F.lit(start)), folded(k, 13), mixed(k), folded(k, 15),
    ]
    df = df.withColumn("_k", F.col(key).cast("bigint").bitwiseAND(F.lit(MASK)))
    for step in steps:
        df = df.withColumn("_k", step)
    return df.withColumn(name, F.when(k >= 2**31, k - 2**32).otherwise(k)).drop("_k")


def murmur2_bytes(data: bytes, signed_tail: bool = True) -> int:
    """Signed hash of a byte string. ``signed_tail``: the last 1 to 3 bytes count as signed, as ``char`` does on x86."""
    whole = len(data) // 4
    h = SEED ^ len(data)
    for word in np.frombuffer(data, "<u4", whole).tolist():
        word = word * MULTIPLIER & MASK
        h = (h * MULTIPLIER & MASK) ^ ((word ^ word >> SHIFT) * MULTIPLIER & MASK)
    rest = data[4 * whole :]
    if rest:
        for place, byte in enumerate(rest):
            value = byte - 256 if signed_tail and byte > 127 else byte
            h ^= (value << 8 * place) & MASK
        h = h * MULTIPLIER & MASK
    h = (h ^ h >> 13) * MULTIPLIER & MASK
    return _signed(h ^ h >> 15)


def murmur2_strings(values: pa.Array) -> np.ndarray:
    """Signed hashes of all strings of an array, a word of each at a time over those that are long enough; of nulls, what an empty string has."""
    values = pc.fill_null(values, "").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    h = (np.uint64(SEED) ^ lengths.astype(np.uint64)) & np.uint64(MASK)
    times = lambda x: x * np.uint64(MULTIPLIER) & np.uint64(MASK)
    full = lengths // 4
    for word in range(int(full[0]) if len(full) else 0):
        count = np.searchsorted(-full, -word, "left")  # those with more words than this
        at = starts[:count] + 4 * word
        k = sum(data[at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(4))
        k = times(k)
        h[:count] = times(h[:count]) ^ times(k ^ (k >> np.uint64(SHIFT)))
    rest = lengths % 4
    for place in range(3):
        has = np.flatnonzero(rest > place)
        tail = data[starts[has] + 4 * full[has] + place].astype(np.int8).astype(np.int64)  # signed, as char is on x86
        h[has] ^= (tail << (8 * place)).astype(np.uint64) & np.uint64(MASK)
    h = np.where(rest > 0, times(h), h)
    h = times(h ^ (h >> np.uint64(13)))
    h ^= h >> np.uint64(15)
    out = np.empty(len(h), np.int32)
    out[order] = h.astype(np.uint32).view(np.int32)
    return out


@F.arrow_udf(T.IntegerType())
def murmur2_string(values: pa.Array) -> pa.Array:
    """Signed hash of a string's UTF-8 bytes, tail bytes signed; null stays null."""
    return pa.array(murmur2_strings(values), pa.int32(), mask=values.is_null().to_numpy(zero_copy_only=False))


def tuple_hash(*leaves: Column) -> Column:
    """Hash of a nested key: the exclusive or of its leaves' hashes."""
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.bitwiseXOR(leaf)
    return out
