"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Each three neighbouring lines with a word among them are hashed. Of windows with equal hashes anywhere in the
corpus the first stays, by doc_id and then position; each other one covers its three lines, and covered lines go.
A window is a row of 128 hash bits, written once to a narrow table. Equal windows are counted before they are shuffled; only those
that are repeated are looked at again, and the places of a common one are spread over many tasks where they meet its first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, Workspace, attached, packed, quoted, staged

SIZE = 3


def windows(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per window with a word of rows of doc_id, version and lines: doc_id, version, pos (of its first line, from 0), high and low (its hash)."""

    def window(start: Column) -> Column:
        part = [F.col("lines")[start + k] for k in range(size)]
        return F.struct(
            F.xxhash64(*part).alias("high"), F.xxhash64(F.lit("low"), *part).alias("low"),
            F.concat(*part).rlike(f"[^{SPACE[1:]}").alias("word"),
        )

    made = F.transform(F.sequence(F.lit(0), F.size("lines") - size), window)
    flat = cut.where(F.size("lines") >= size).select("doc_id", "version", F.posexplode(made).alias("pos", "w"))
    return flat.where("w.word").select("doc_id", "version", "pos", "w.high", "w.low")


def later_windows(work: Workspace, cut: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, pos) of every window that isn't the first of its kind."""
    found = work.staged(windows(cut, size), "windows")
    # written, so that adaptive execution may split a window with many places
    repeated = work.staged(found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    places = work.staged(found.join(repeated, ["high", "low"]), "places")
    place = F.struct("doc_id", "version", "pos")
    first = places.groupBy("high", "low").agg(F.min(place).alias("first"))
    return attached(places, first, ["high", "low"], ["doc_id", "pos"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "pos")


def remove_repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Documents with the rest of their text, and n_lines, n_removed as they were counted, in place of columns of these names; other columns stay, whatever their names.

    Null text: stays null, 0 lines. Fewer than ``size`` lines: unchanged. All lines covered: an empty text. Very long texts: each is one row, with all its
    windows. Rows with the same doc_id and text are one document stored repeatedly, so none is a later occurrence of the other; rows with the same
    doc_id and other texts are told apart, ties in order of a hash of the text. A null doc_id comes before all others. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = packed(docs).withColumn("version", F.xxhash64("doc.text")).withColumn("lines", F.split("doc.text", "\n"))
    with Workspace(docs.sparkSession, "lines") as work:
        later = later_windows(work, keyed.select(F.col("doc.doc_id").alias("doc_id"), "version", "lines"), size)
        covered = staged(later.groupBy(F.col("doc_id").alias("id"), F.col("version").alias("of")).agg(F.collect_set("pos").alias("starts")), "covered-lines")
    # merged at any size: what is covered grows with the documents
    joined = keyed.drop("lines").join(covered.hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("of")), "left")
    joined = joined.select("doc", "starts").withColumn("lines", F.split("doc.text", "\n"))
    joined = joined.withColumn("gone", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1))))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("starts").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n"))
    size_of = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    own = [(text if c.lower() == "text" else F.col(f"doc.{quoted(c)}")).alias(c) for c in docs.columns]
    return joined.select(*own, size_of("lines").alias("n_lines"), size_of("gone").alias("n_removed"))
