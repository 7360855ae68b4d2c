"""The pipeline, stage by stage, against plain Python on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import FOLDER
from pyspark.sql import functions as F
from test_operators import brute_components, grams, odd_documents, words

from millrace.llm.common import staged

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    benchmark = {r.item_id: grams(r.text, 5) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    for (_, stage), kind in zip(pipeline.STAGES, ("language", "lines", "near", "leaks", "mixture"), strict=True):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = staged(stage(spark, docs, FOLDER), "test-stage")
        after = {r.doc_id: r for r in docs.collect()}
        if kind != "mixture":
            assert docs.columns == columns
        if kind == "language":
            assert after.keys() == {d for d, t in before.items() if any(c.isalpha() for c in t)}
        elif kind == "lines":
            seen, expected = set(), {}
            for d in sorted(before):
                lines, gone = before[d].split("\n"), set()
                for i in range(len(lines) - 2):
                    window = tuple(lines[i : i + 3])
                    if window in seen and "".join(window).strip():
                        gone |= {i, i + 1, i + 2}
                    seen.add(window)
                left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                if left.split() or not gone:
                    expected[d] = left
            assert {d: r.text for d, r in after.items()} == expected
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif kind == "near":
            assert after.keys() == {d for d, (_, c) in brute_components(list(before.items()), 5).items() if d == c}
        elif kind == "leaks":
            held = {d: grams(t, 5) for d, t in before.items()}
            assert after.keys() == {d for d in before if not any(len(held[d] & b) >= 0.8 * len(b) for b in benchmark.values())}
        else:
            assert all(0 < r.taken <= 2 * r.size and r.size == len(words(before[d])) for d, r in after.items())
            assert set(columns) <= set(docs.columns) and all(len(words(r.text)) == r.taken and r.n_chars == len(r.text) for r in after.values())


def test_stages_take_odd_documents(spark):
    """Texts and ids that are left, with columns that clash with the stages' own names as they were."""
    docs = odd_documents(spark)
    for name in ("key", "row", "doc", "id", "of", "starts", "lines", "version", "lang_pred", "size", "taken", "_gone", "_version"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("n_chars").cast("string")))
    left = {"language ID": [1, 1, 5, 6, 7, None], "line dedup": [1, 1, 2, 3, 4, 5, 6, 7, 8, None], "MinHash near-dedup": [1, 2, 3, 4, 5, 6, 7, 8], "benchmark decontamination": [1, 1, 2, 3, 4, 5, 6, 7, 8, None]}
    for name, stage in pipeline.STAGES:
        rows = stage(spark, docs, FOLDER).collect()
        if name in left:
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, left[name]))
        for r in rows:
            for c in ("key", "row", "doc", "id", "of", "starts", "lines", "version", "_gone", "_version"):
                assert r[c] is None or name in ("line dedup", "source mixing") or r[c] == f"{c}{r.n_chars}"
                assert r[c] is None or r[c].startswith(c)
        assert stage(spark, docs.where("false"), FOLDER).collect() == []
