"""Cases that the tables don't hold."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import cli
from millrace.functions.hashing import murmur2_bytes, murmur2_int, murmur2_string, murmur2_strings
from millrace.functions.records import leading, pair, tuple_type
from millrace.operators import exchange, mappers, reducers
from millrace.operators.job import Job
from millrace.plans.wordcount import job as word_count_job
from millrace.sources.sinks import to_lines, write_text
from millrace.sources.tables import lines, read_text
from millrace.streaming import counts


def words(spark, text):
    return [r.word for r in mappers.tokens(spark.createDataFrame([(text,)], "text string")).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("a\tb\x0bc\x0cd\re\nf g", list("abcdefg")), ("  a  ", ["a"]), ("   ", []), ("", []), (None, []), ("The the, the", ["The", "the,", "the"])],
)
def test_tokens(spark, text, expected):
    assert words(spark, text) == expected


def test_line_ends(spark):
    df = spark.createDataFrame([("a b\r\nc\rd\n\ne",), ("x",), (None,)], "text string")
    assert [r.line for r in lines(df).collect()] == ["a b", "c", "d", "e", "x"]


def test_text_source_reads_small_files_and_long_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text("y" * 70_000 + "\nlast")
    assert sorted(len(r.value) for r in read_text(spark, str(tmp_path / "in.txt")).collect()) == [4, 70_000]


@pytest.mark.parametrize(
    ("key", "value"), [(0, 454116264), (1, -115137059), (-1, -868021399), (89, 1602188360), (2147483647, -200805934)]
)
def test_murmur2_int(spark, key, value):
    df = spark.createDataFrame([(key,)], "k int")
    assert murmur2_int(df, "k", "h").first().h == value
    assert exchange.partition_of_int(df, "k", 4).first().pid == abs(value) % 4


def test_murmur2_string(spark):
    known = {"": -472742627, "a": -1044501916, "the": -540871617, "hello": -99805834, "Hello from server.": -374714895, "ü": -519502075, "aé": -1932127816}
    df = spark.createDataFrame([(k,) for k in [*known, None]], "s string").select("s", murmur2_string("s").alias("h"))
    assert {r.s: r.h for r in df.collect()} == known | {None: None}
    assert murmur2_bytes("ü".encode(), signed_tail=False) == 1241864274


def test_slot_of_smallest_integer(spark):
    df = spark.createDataFrame([(-(2**31),), (-5,), (7,)], "h bigint")
    assert [r[0] for r in df.select(exchange.slot(F.col("h"), 4)).collect()] == [0, 1, 3]


def test_custom_partitioner_places_rows(spark):
    dealt = exchange.by_partitioner(spark.range(20), 4, F.col("id") % 3)
    assert all(r.pid == r.id % 3 for r in dealt.withColumn("pid", F.spark_partition_id()).collect())


@pytest.mark.parametrize(
    ("how", "expected"),
    [("sum", {"": 3, "k": 2 * 2147483647}), ("count", {"": 2, "k": 2}), ("min", {"": 1, "k": 2147483647}), ("max", {"": 2, "k": 2147483647})],
)
def test_folds(spark, how, expected):
    df = spark.createDataFrame([("", 1), ("", 2), ("k", 2147483647), ("k", 2147483647)], "first string, second int")
    assert {r[0]: r[1] for r in reducers.fold(df, ["first"], how, "second").collect()} == expected


def test_fold_concat_has_a_defined_order(spark):
    df = spark.createDataFrame([("a", "y"), ("a", ""), ("a", "x"), ("b", None)], "first string, second string")
    assert {r[0]: r[1] for r in reducers.fold(df, ["first"], "concat", "second").collect()} == {"a": "xy", "b": ""}
    with pytest.raises(ValueError):
        reducers.fold(df, ["first"], "sum")


def test_composite_keys_compare_on_all_fields(spark):
    df = spark.createDataFrame([("A", 1, 10), ("A", 2, 20)], "a string, b int, v int")
    records = mappers.emit(df, pair("a", "b"), "v")
    assert reducers.fold(records, ["first"], "sum", "second").count() == 2
    key = leading(F.col("first"), records.schema["first"].dataType).alias("k")
    assert reducers.fold(records, [key], "sum", "second").first().second == 30
    assert tuple_type(T.StringType(), T.IntegerType()).fieldNames() == ["first", "second"]


def test_reducer_runs_once_per_partition_with_rows(spark):
    def calls(batches):
        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["n"])

    df = spark.createDataFrame([(k % 2,) for k in range(50)], "k int")
    made = [r.n for r in reducers.reduce_stream(df, ["k"], calls, "n bigint", 8).collect()]
    assert sum(made) == 50 and len(made) <= 2
    assert reducers.reduce_stream(df.where("k > 5"), ["k"], calls, "n bigint", 8).collect() == []


def test_runs_go_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": [1] * len(k)}) for k in ([1, 1, 2], [2], [2, 3, None], [None])]
    groups = [(k, sum(b.num_rows for b in g)) for k, g in reducers.runs(iter(batches), "k")]
    assert groups == [(1, 2), (2, 3), (3, 1), (None, 2)]
    assert [k for k, _ in reducers.runs(iter(batches), "k")] == [1, 2, 3, None]
    summed = [r for b in reducers.sum_runs("k", "v", "n")(iter(batches)) for r in b.to_pylist()]
    assert summed == [{"k": 1, "n": 2}, {"k": 2, "n": 3}, {"k": 3, "n": 1}, {"k": None, "n": 2}]


def test_reduce_groups(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, v int")
    count = lambda t: pa.table({"k": t.column("k").slice(0, 1), "n": pa.array([t.num_rows], pa.int64())})
    assert {r.k: r.n for r in reducers.reduce_groups(df, ["k"], count, "k int, n bigint").collect()} == {1: 2, 2: 1}


def test_map_blocks_may_emit_nothing(spark):
    keep = lambda b: None if b.num_rows == 0 else b.filter(pa.array([v > 3 for v in b.column("id").to_pylist()]))
    assert mappers.map_blocks(spark.range(6), keep, "id bigint").count() == 2


def test_lines_of_records(spark):
    df = spark.createDataFrame([('say"hi', 1)], "w string, n int")
    assert to_lines(df).first().line == '("say"hi", 1)'
    nested = spark.createDataFrame([(("a", 1), "x")], "k struct<a:string,b:int>, v string")
    assert to_lines(nested).first().line == '(("a", 1), "x")'
    assert to_lines(df.select("n")).first().line == "1"


def test_text_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    empty = spark.createDataFrame([], "w string, n int")
    write_text(empty, out)
    assert read_text(spark, out).count() == 0
    with pytest.raises(AnalysisException):
        write_text(empty, out)


def test_jobs(spark):
    source = spark.createDataFrame([("a b a",)], "value string")
    assert {r.word: r.n for r in word_count_job().run_simple(source).collect()} == {"a": 2, "b": 1}
    other = Job(mapper=lambda df: mappers.tokens(df, "value"), reducer=lambda df: df.groupBy("word").count())
    assert other.run_complete(source).count() == 2
    with pytest.raises(TypeError):
        other.run_simple(source)


def test_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("b a\na\n")
    arguments = ["-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "out"), "-j", "millrace.plans.wordcount:job"]
    assert cli.main(arguments) == 0
    assert sorted(r.value for r in read_text(spark, str(tmp_path / "out")).collect()) == ['("a", 2)', '("b", 1)']
    assert cli.main(arguments) == 1


MAPPER = """
import pyarrow as pa
from millrace.operators import mappers, reducers
from millrace.operators.job import Job

def lengths(batch):
    return pa.RecordBatch.from_arrays([pa.array([len(v) for v in batch.column(0).to_pylist()], pa.int64())], ["n"])

job = Job(mapper=lambda df: mappers.map_blocks(df, lengths, "n bigint"), reducer=lambda df: reducers.fold(df, ["n"], "count", name="lines"))
"""


def test_command_line_ships_the_job_to_its_workers(tmp_path):
    """From another folder, with nothing on the workers' path: neither this package nor the job's own module."""
    repo = Path(cli.__file__).parents[1]
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "own_lengths.py").write_text(MAPPER)
    (tmp_path / "in.txt").write_text("aa\nb\ncc\n")
    run = f"import sys; sys.path[:0] = [{str(repo)!r}, {str(tmp_path / 'job')!r}]; from millrace import cli; sys.exit(cli.main({['-i', str(tmp_path / 'in.txt'), '-o', str(tmp_path / 'out'), '-j', 'own_lengths', '-m', 'local[2]']!r}))"
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", run], cwd=tmp_path / "job" / "..", env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr
    assert sorted(line for part in (tmp_path / "out").glob("part-*") for line in part.read_text().split("\n") if line) == ["(1, 1)", "(2, 2)"]


def test_gathering_keeps_the_reduce_parallel(spark):
    counted = word_count_job("text").run_simple(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = exchange.to_one(counted)._jdf.queryExecution().executedPlan().toString()
    gather = plan.index("SinglePartition")
    assert "hashpartitioning" in plan[gather:] and "HashAggregate" in plan[gather:] and "HashAggregate" not in plan[:gather]


def test_combiner_sends_fewer_records(spark):
    batches = [pa.RecordBatch.from_pydict({"k": ["a", "b", "a", None], "v": [1, 2, 3, 4]}) for _ in range(50)]
    out = [r for b in reducers.combined_sums("k", "v", 10)(iter(batches)) for r in b.to_pylist()]
    assert sorted(map(str, out)) == sorted(map(str, [{"k": "a", "v": 200}, {"k": "b", "v": 100}, {"k": None, "v": 200}]))
    many = [pa.RecordBatch.from_pydict({"k": list(range(i, i + 30)), "v": [1] * 30}) for i in range(0, 300, 30)]
    assert sum(r["v"] for b in reducers.combined_sums("k", "v", 10)(iter(many)) for r in b.to_pylist()) == 300
    assert list(reducers.combined_sums("k", "v")(iter([]))) == []


def test_ranks_go_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "o": list(range(len(k)))}) for k in ([1, 1, 2], [2], [2, 3], [3])]
    assert [r["pos"] for b in reducers.rank_runs(["k", "o"], "pos")(iter(batches)) for r in b.to_pylist()] == [1, 2, 1, 2, 3, 1, 2]


def test_union_and_parts(spark):
    df = spark.createDataFrame([("a", 10), ("a", 9), ("a", 10), ("b", 1)], "k string, v int")
    assert {r.k: r.u for r in reducers.fold(df, ["k"], "union", "v", "u", "|").collect()} == {"a": "9|10", "b": "1"}
    parted = reducers.fold(df, ["k", reducers.part_of("v", 2).alias("part")], "concat", "v", "c", ",").collect()
    assert sorted(v for r in parted for v in r.c.split(",")) == ["1", "10", "10", "9"] and all(r.part in (0, 1) for r in parted)


def test_strings_hash_alike_in_arrays_and_alone():
    rng = random.Random(1)
    values = ["".join(rng.choices("aé漢z 😀", k=rng.randint(0, 30))) for _ in range(500)] + ["", "x" * 5000]
    hashed = [murmur2_bytes(v.encode()) for v in values]
    assert murmur2_strings(pa.array(values)).tolist() == hashed and murmur2_strings(pa.array(values).slice(7, 50)).tolist() == hashed[7:57]
    assert murmur2_strings(pa.array([], pa.string())).tolist() == []


def test_entry_keeps_the_core_where_the_rest_cannot_be_imported(monkeypatch):
    import __spark_entry__

    def broken(name):
        raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")

    monkeypatch.setattr(__spark_entry__, "import_module", broken)
    with pytest.warns(UserWarning, match="zstandard"):
        names = __spark_entry__.queries().keys()
    assert "word_count" in names and not any(n.startswith("op") for n in names)


def test_streaming_word_count_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y x\n")
    query = counts.word_counts(counts.text_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("words").start()
    query.processAllAvailable()
    query.stop()
    assert {r.word: r.n for r in spark.table("words").collect()} == {"x": 2, "y": 1}
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    (tmp_path / "ev").mkdir()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    query = counts.event_counts(events).writeStream.outputMode("complete").format("memory").queryName("ev").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("ev").collect()) == 1000
