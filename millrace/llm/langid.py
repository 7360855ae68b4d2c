"""Language identification by rank-order profiles.

A profile is the ``PROFILE`` most frequent letter 1-, 2- and 3-grams in order. A document goes to the language
whose profile is nearest by out-of-place distance: the sum, over the document's own profile, of how far
each n-gram's rank is from its rank in the language, ``PROFILE`` where the language lacks it.

Profiles are fitted on at most about ``SAMPLE`` documents per language, picked by a hash of doc_id at a rate of
SAMPLE / documents of that language; their n-grams are counted over the whole texts. Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import MOST_LANGUAGES, appended, few, sliced

PROFILE = 300
SAMPLE = 3000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Codes of all letter n-grams of a text, case folded; a space stands for the edge of a run of letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of each run of other characters the first, as an edge
    run = np.where(letter, points, 32)[kept].astype(np.int64)
    run = np.concatenate([[32], run, [32]] if run[-1] != 32 else [[32], run])
    run = run[1:] if run[0] == run[1] == 32 else run
    two = (run[:-1] << 21) | run[1:]
    three = ((run[:-2] << 42) | (run[1:-1] << 21) | run[2:])[run[1:-1] != 32]
    return np.concatenate([run[run != 32], two, three])


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; ``codes`` is sorted, so that ties go to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profiles' n-grams (rows, by code) in each language (columns); ``size`` where one is absent."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int = PROFILE

    @staticmethod
    def of(profiles: dict[str, list[int]], size: int = PROFILE) -> Profiles:
        languages = sorted(profiles)
        codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        ranks = np.full((len(codes) + 1, len(languages)), size, np.int64)  # the last row is for all other n-grams
        for column, language in enumerate(languages):
            ranks[np.searchsorted(codes, profiles[language]), column] = np.arange(len(profiles[language]))
        return Profiles(languages, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score, from 0 (no n-gram shared) to 1 (the same profile)."""
        found = grams(text)
        if not len(found):
            return UNKNOWN, 0.0
        if not self.languages:
            return UNKNOWN, 0.0
        own = top(*np.unique(found, return_counts=True), self.size)
        place = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.where(self.codes[place] == own, place, len(self.codes))
        known = self.ranks[place]
        distance = np.where(known < self.size, np.abs(known - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(distance.argmin())  # ties go to the first language by code point
        return self.languages[best], float(1 - distance[best] / (self.size * len(own)))


def held_out(doc_id: Column) -> Column:
    """Every fourth document by CRC-32 of its id is never learned from; null ids are not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from labelled documents that aren't held out. One row per language comes to the driver, then its profile.

    Null texts, languages and ids teach nothing; empty and letterless texts have no n-grams. A row that repeats counts as often as it's there, a text of any
    length counts whole. Other columns than the three named aren't looked at.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    usable = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = few(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).limit(MOST_LANGUAGES + 1).collect(), MOST_LANGUAGES, "languages")
    if not counts:
        return Profiles.of({}, size)
    # one row per language, MOST_LANGUAGES at most: else the texts would be shuffled to meet them
    rates = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["documents"])) for r in counts], "lang string, rate double"))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.join(rates, "lang").where(draw < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            by: dict[str, list[np.ndarray]] = {}
            for language, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(language, []).append(grams(words))
            for language, found in by.items():
                codes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())], ["lang", "code", "n"])

    summed = picked.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return Profiles.of(profiles, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row, in place of columns of these names; other columns stay, whatever their names.

    Null, empty or letterless text: ``und`` and 0. So is every text if nothing could be learned. A text of any length is read whole, as one row.
    Ties go to the first language by code point, n-grams of equal frequency to the smaller code. Rows that repeat are predicted alike; an empty table gives no rows.
    """
    place = docs.drop("lang_pred", "score").columns.index(text)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [profiles.predict(t) for t in batch.column(place).to_pylist()]
        return {"lang_pred": pa.array([m[0] for m in made], pa.string()), "score": pa.array([m[1] for m in made], pa.float64())}

    return appended(docs, "lang_pred string, score double", run)
