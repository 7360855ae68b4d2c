"""What the operators share: scratch tables in the cluster's shared folder, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What parts words: the white space of ASCII, no more. bytes.split() splits at just these.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python worker unpacks at once: texts may be long. Spark bounds the bytes of a batch itself.
BATCH_ROWS = 1000
#: Places over which rows of one key are spread where they meet what is known of the key.
PARTS = 64
#: A table of more languages is refused: what is learned of each would be held by the driver.
MOST_LANGUAGES = 10_000
#: Temporary folders of sessions on a single machine that name none, by application.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Lineage ends here, and lost executors lose nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder; it stays there until ``delete`` or the end of the application's folder."""
    return write_and_read(df, f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def few(rows: list, most: int, what: str) -> list:
    """``rows`` that were collected with a limit of ``most`` + 1, or an error."""
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Scratch tables of one call, in a folder of their own. All go at the end; what is to stay is ``staged()`` before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.tables = spark, f"{scratch(spark)}/{name}-{uuid.uuid4().hex}", []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error: object) -> None:
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
        delete(self.spark, self.folder)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        return write_and_read(df, f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Like staged(), one row for each ``key``, in as many buckets as ``df`` has partitions by the key: joins on it read them without a shuffle."""
        n, table = shuffle_partitions(self.spark), f"millrace_{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        df.dropDuplicates([key]).write.bucketBy(n, key).sortBy(key).option("path", f"{self.folder}/{table}").saveAsTable(table, format="parquet")
        return self.spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attached(df: DataFrame, known: DataFrame, key: str | list[str], by: str | list[str]) -> DataFrame:
    """Inner join of ``df`` with ``known``, which has one row per ``key``, where a key may hold any share of ``df``.

    The rows of a key are spread by ``by`` over PARTS places; what is known of the key goes to those of them that have rows.
    """
    keys, spread = ([x] if isinstance(x, str) else x for x in (key, by))
    dealt = df.withColumn("part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)))
    places = dealt.select(*keys, "part").distinct()
    return dealt.join(places.join(known, keys), [*keys, "part"]).drop("part")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, name: str = "doc") -> DataFrame:
    """All columns in one struct, so that no name of theirs meets one of an operator's."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias(name))


def appended(df: DataFrame, columns: str, run) -> DataFrame:
    """Append columns that ``run`` makes of each batch, as a dict of arrays; columns of the same names go."""
    new = T.StructType.fromDDL(columns)
    kept = df.drop(*new.names)
    names, old = new.names, kept.columns

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(source):
            made = run(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[n] for n in names)], [*old, *names])

    return kept.mapInArrow(batches, T.StructType(kept.schema.fields + new.fields))


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a text column; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file to any store that Arrow reaches, under its name only once it is whole."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}", compression=None) as out:
        out.write(data)
    store.move(f"{path}/.{name}", f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


class WordHashes(dict):
    """64-bit hashes of words, each computed once; starts over when it has grown to ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_DOWN = np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _DOWN)) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle, none make none."""
    return np.unique(rolled(hashes, min(n, len(hashes)))) if len(hashes) else hashes


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours, in order."""
    count = len(hashes) - n + 1
    out = hashes[:count]
    for k in range(1, n):
        out = mixed(out) + hashes[k : k + count]
    return mixed(out)
