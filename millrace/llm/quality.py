"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose ratio is over a cutoff. Combinations of cutoffs are tested on labelled holdouts, per stratum (lang): the null
hypothesis "of the good documents that pass the base rule, the rules together reject ``RISK`` or more" is tested by the exact binomial tail, which is the Clopper-Pearson
upper bound turned round. The combinations of a stratum are one sequence, ordered before any data is seen: each tightens one rule by one cutoff.
They are tested from the loosest on and the strictest before the first failure is taken (fixed-sequence testing needs no correction within
a sequence); over all strata the level is divided by their number (Bonferroni). So with probability 1 - LEVEL at least, no stratum loses over RISK
of its good documents that pass the base rule.

A language whose labels are too few to show anything, even if none were rejected (under 228 of four), is no stratum of its own. It takes the cutoffs of the pool, which is
one more stratum: all labelled languages together. The pool's bound is on all of its documents, not on each of its languages. Documents of a
language without labels lose nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import MOST_LANGUAGES, WordHashes, few, rolled, sliced, staged, texts

RISK, LEVEL = 0.02, 0.05
WINDOW = 8
#: Rule, its ratio, and its cutoffs from the loosest on; the grids are fixed before any data is seen.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0]),
    "short_words": ("- (word_chars / greatest(n_words, 1))", [-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0]),
}
#: (rule, cutoff) in the order in which the rules are tightened: all in proportion to the length of their grids.
SEQUENCE = [(rule, cut) for *_, rule, cut in sorted(((i + 1) / len(grid), k, rule, cut) for k, (rule, (_, grid)) in enumerate(RULES.items()) for i, cut in enumerate(grid))]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def counts(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.split()]
    every = np.frombuffer(text, np.uint8)
    histogram = np.bincount(every, minlength=256)
    points = len(text) - int(histogram[0x80:0xC0].sum())  # all bytes that don't continue a character
    chars = points - sum(int(histogram[c]) for c in _SPACES)
    return len(words), chars, sum(int(histogram[c]) for c in _SYMBOLS), len(lines) - len(set(lines)), repeated_words(hashes.of(words)), len(lines)


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words within windows that occur twice or more."""
    if len(words) <= window:
        return 0
    _, place, n = np.unique(rolled(words, window), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[place] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change) > 0).sum())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and COUNTS per row; null texts count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            rows = np.array([counts(t, hashes) if t else (0,) * len(COUNTS) for t in texts(batch.column(2))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", "lang", *COUNTS])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, ", ".join(["doc_id bigint", "lang string", *(f"{c} bigint" for c in COUNTS)]))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms."""
    if n == 0 or k >= n:
        return 1.0
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(term(i)) for i in range(k + 1)))


def strictest(rejected: list[int], n: int, risk: float, level: float) -> int:
    """How many cutoffs, from the loosest on, are shown to be within the risk; ``rejected`` has the good documents each would lose."""
    for passed, k in enumerate(rejected):
        if k > risk * n or binomial_tail(k, n, risk) > level:
            return passed
    return len(rejected)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def first_rejected() -> Column:
    """Place in SEQUENCE of the first combination that rejects a document; its length if none does."""
    firsts = []
    for rule, (ratio, grid) in RULES.items():
        first = F
        for cut in grid:
            first = first.when(F.expr(ratio) > cut, F.lit(SEQUENCE.index((rule, cut))))
        firsts.append(first.otherwise(F.lit(len(SEQUENCE))))
    return F.least(*firsts)


def fewest(strata: int, risk: float, level: float) -> int:
    """Good documents that a stratum needs, if none of them is rejected, to show anything."""
    return math.ceil(math.log(level / (strata + 1)) / math.log1p(-risk))


def cutoffs(known: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[str | None, dict[str, float]]:
    """Cutoffs of each labelled language from labelled good documents; a document is good if all its labels have quality 1.

    A doc_id counts once, however often it's stored or labelled: in the first of its languages, as rejected by the first combination that rejects any of its rows.
    A count per language and combination comes to the driver, nothing per document.
    """
    good = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = known.where(~base_failed()).select("doc_id", "lang", first_rejected().alias("place")).join(good.select("doc_id"), "doc_id")
    held = held.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("place").alias("place"))
    first: dict[str | None, list[int]] = {}
    most = MOST_LANGUAGES * (len(SEQUENCE) + 1)
    for row in few(held.groupBy("lang", "place").agg(F.count(F.lit(1)).alias("documents")).limit(most + 1).collect(), most, "counts of languages"):
        first.setdefault(row["lang"], [0] * (len(SEQUENCE) + 1))[row["place"]] = row["documents"]
    own = {lang for lang, counted in first.items() if sum(counted) >= fewest(len(first), risk, level)}

    def passing(counted: list[int]) -> dict[str, float]:
        return dict(SEQUENCE[: strictest(list(accumulate(counted[:-1])), sum(counted), risk, level / (len(own) + 1))])

    pool = passing([sum(column) for column in zip(*first.values(), strict=True)]) if first else {}
    return {lang: rules for lang, counted in first.items() if (rules := passing(counted) if lang in own else pool)}


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept, one row per row of ``docs``.

    Null and empty texts have no words and fail the base rule; texts of any length are counted whole. A null lang is a language as others are. Languages without cutoffs, an empty
    label table included, lose nothing beyond the base rule. Repeated rows are judged alike, and are one holdout; ties (a ratio at its cutoff) are kept.
    Columns other than those named are dropped, whatever their names; an empty table gives no rows.
    """
    known = staged(measured(docs), "counts")
    found = cutoffs(known, labels, risk, level)
    rows = [(lang, *(rules.get(rule) for rule in RULES)) for lang, rules in found.items()]
    table = docs.sparkSession.createDataFrame(rows, "of string, " + ", ".join(f"cut_{r} double" for r in RULES))
    joined = known.join(table, F.col("lang").eqNullSafe(F.col("of")), "left")
    within = F.lit(True)
    for rule, (ratio, _) in RULES.items():
        within = within & F.coalesce(F.expr(ratio) <= F.col(f"cut_{rule}"), F.lit(True))
    failed = base_failed()
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & within).alias("kept"))
