"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a bundle ends with a seek table in a skippable frame (the public
seekable format), and an index maps each record's identifier to bundle, frame and offset within the frame. A reader seeks: it reads the bundle's
end and then the frame that it wants. Of records with equal payloads one is a response, the others are revisits that refer to it.

Tasks write bundles of bounded size under names of their own attempt to the shared folder; the index holds the bundles of attempts that
Spark committed, and readers go by the index. So a lost executor or a second attempt leaves files that nobody reads, never half a result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import PARTS, put, scratch, sliced, staged

FRAME_BYTES, BUNDLE_BYTES, BUNDLE_RECORDS, LEVEL = 256 << 10, 8 << 20, 20_000, 3
#: Tasks that read, at most.
MOST_PARTS = 20_000
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:millrace:page:"
INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; control characters and spaces of the url are percent-encoded."""
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'none' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, length = end + 4, int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    return head, data[body : start + length], start + length + 4


class Bundle:
    """Frames in memory, until there is enough for a file."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record added."""
        place = len(self.frames), self.open_size
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= FRAME_BYTES:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.open:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.open, self.open_size = [], 0

    def packed_size(self) -> int:
        return sum(packed for packed, _ in self.sizes)

    def finished(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(packed, full) size of each frame, from the end of a bundle that holds its seek table."""
    number, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries = tail[len(tail) - 9 - 8 * number : -9]
    return [struct.unpack_from("<II", entries, 8 * i) for i in range(number)]


def unpacked(packed: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)


def frame(bundle: bytes, number: int) -> bytes:
    """One frame of a bundle that is in memory, without unpacking the others."""
    sizes = seek_table(bundle)
    start = sum(packed for packed, _ in sizes[:number])
    return unpacked(bundle[start : start + sizes[number][0]], sizes[number][1])


class Frames:
    """The frames of a stored bundle: its end is read once, then each frame that is asked for."""

    def __init__(self, folder: str, name: str):
        store, path = fs.FileSystem.from_uri(folder)
        self._file = store.open_input_file(f"{path}/{name}")
        size = self._file.size()
        number = struct.unpack("<I", self._at(9, size - 9)[:4])[0]
        table = min(size, 9 + 8 * number)
        self.sizes = seek_table(self._at(table, size - table))
        self.starts = [0, *accumulate(packed for packed, _ in self.sizes)]

    def __enter__(self) -> Frames:
        return self

    def __exit__(self, *error: object) -> None:
        self._file.close()

    def _at(self, size: int, start: int) -> bytes:
        return self._file.read_at(size, start)

    def read(self, number: int) -> bytes:
        packed, full = self.sizes[number]
        return unpacked(self._at(packed, self.starts[number]), full)


def read_record(folder: str, bundle: str, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an indexed record: the bundle's end and the record's frame are read, nothing else."""
    with Frames(folder, bundle) as frames:
        head, payload, _ = parse(frames.read(number), offset)
    return head, payload


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with refers_to and revisit: of equal payloads of at least ``least`` bytes the smallest page_id is the response.

    Rows that repeat that page_id are all responses. Null page_ids revisit another page with their payload, and are responses if there is none.
    Payloads that occur twice or more are found on ids and digests; pages of one payload are spread over PARTS places where they learn its first id.
    """
    page = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS))
    keyed = page.withColumn("key", F.unhex(F.sha1("html"))).withColumn("part", part)
    narrow = keyed.where(F.octet_length("html") >= least).select("key", "part", "page_id")
    parts = narrow.groupBy("key", "part").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
    whole = parts.groupBy("key").agg(F.min("first").alias("first"), F.sum("pages").alias("pages")).where("pages > 1 and first is not null")
    known = parts.select("key", "part").join(whole, "key").select("key", "part", "first")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    # Spark broadcasts what is known where it's small, and pages aren't shuffled then
    joined = keyed.join(staged(known, "payloads"), ["key", "part"], "left")
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def written(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages as bundles to ``folder`` and return the index, a table that is written too. A page of any length is one record, larger than a frame if it must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, count = f"{task.partitionId():06d}-{uuid.uuid4().hex[:12]}", 0
        bundle, rows = Bundle(), []

        def finish() -> pa.RecordBatch:
            nonlocal bundle, rows, count
            name = f"{stem}-{count:05d}.warc.zst"
            put(folder, name, bundle.finished())
            made = pa.RecordBatch.from_pylist([r | {"bundle": name} for r in rows], INDEX_SCHEMA)
            bundle, rows, count = Bundle(), [], count + 1
            return made

        for batch in sliced(batches):
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], row["revisit"])
                number, offset = bundle.add(data)
                rows.append({"page_id": row["page_id"], "frame": number, "offset": offset, "length": len(data)})
                if bundle.packed_size() >= BUNDLE_BYTES or len(rows) >= BUNDLE_RECORDS:
                    yield finish()
        if rows:
            yield finish()

    return staged(planned(pages, least).mapInArrow(run, INDEX), "warc-index")


INDEX_SCHEMA = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def number_of(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix(URN)
    return None if value == "none" else int(value)


def told(head: dict[str, str], payload: bytes) -> dict:
    """What a record says of itself; a response's payload must have the digest and length it names."""
    named, length, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"]), head["WARC-Type"]
    if kind == "response" and (digest(payload), len(payload)) != (named, length):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload isn't what its header says")
    refers = number_of(head["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": number_of(head["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": named, "record_type": kind, "refers_to": refers}


def scanned(folder: str, bundle: str) -> Iterator[dict]:
    """What all records of a bundle say of themselves, without the index."""
    with Frames(folder, bundle) as frames:
        for number in range(len(frames.sizes)):
            data, at = frames.read(number), 0
            while at < len(data):
                head, payload, at = parse(data, at)
                yield told(head, payload)


def read(index: DataFrame, folder: str) -> DataFrame:
    """One row per record of the index, which is looked up by frame and offset and must be the one that the index names.

    A bundle's index entries, BUNDLE_RECORDS at most, meet in one task; it opens bundles one at a time and reads each frame that it needs once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, bundle, number, data = None, None, -1, b""
        for batch in sliced(batches):
            rows = []
            for row in batch.to_pylist():
                if row["bundle"] != bundle:
                    if frames:
                        frames.__exit__()
                    frames, bundle, number = Frames(folder, row["bundle"]), row["bundle"], -1
                if row["frame"] != number:
                    number, data = row["frame"], frames.read(row["frame"])
                head, payload, end = parse(data, row["offset"])
                if (number_of(head["WARC-Record-ID"]), end - row["offset"]) != (row["page_id"], row["length"]):
                    raise ValueError(f"{bundle}, frame {number}, {row['offset']}: not the record that the index names")
                rows.append(told(head, payload))
            yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
        if frames:
            frames.__exit__()

    bundles = max(1, min(index.select("bundle").distinct().count(), MOST_PARTS))  # entries are short: by their size, one task would read all bundles
    return index.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, READ)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives to the shared folder and read each page's record back through the index: one row per page.

    Null html is an empty payload, a null url an empty one. Repeated rows are records of their own, ties in payload go to the smallest page_id. Columns but page_id, url and
    html are left out, whatever their names; an empty table gives no rows.
    """
    folder = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(written(pages, folder, least), folder)
