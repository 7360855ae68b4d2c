"""The query catalogue: each query as a DataFrame, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import murmur2_int, murmur2_string
from millrace.functions.records import pair
from millrace.operators import exchange, mappers, reducers
from millrace.operators.job import Job
from millrace.plans.wordcount import job as word_count_job
from millrace.sources.sinks import to_lines, write_text
from millrace.sources.tables import lines, read_table, read_text

Query = Callable[[SparkSession, str], DataFrame]


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return mappers.tokens(read_table(spark, folder, "documents"), "text", "doc_id")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return word_count_job("text").run_simple(read_table(spark, folder, "documents"))


def word_count_stream(spark: SparkSession, folder: str) -> DataFrame:
    ones = _tokens(spark, folder).select("word", F.lit(1).cast("bigint").alias("one"))
    return reducers.reduce_stream(ones, ["word"], reducers.sum_runs("word", "one", "n"), "word string, n bigint", _partitions(spark), reducers.combined_sums("word", "one"))


def word_count_lines(spark: SparkSession, folder: str) -> DataFrame:
    return to_lines(word_count(spark, folder))


def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reducers.fold(lines(read_table(spark, folder, "documents"), "text", "doc_id"), ["doc_id"], "count", name="n_lines")


def fold_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Postings in one row of a word, as the SQL has them; a corpus-wide job adds ``part_of`` to the keys."""
    words = F.array_distinct(F.split("text", mappers.SPACE))
    postings = read_table(spark, folder, "documents").select("doc_id", F.explode(words).alias("word")).where("word <> ''")
    return reducers.fold(postings, ["word"], "union", "doc_id", "docs", ",")


def fold_string(spark: SparkSession, folder: str) -> DataFrame:
    return reducers.fold(read_table(spark, folder, "nation"), ["n_regionkey"], "concat", "n_name", "names")


def fold_min_max(spark: SparkSession, folder: str) -> DataFrame:
    return reducers.folds(_tokens(spark, folder), ["doc_id"], {"min_word": ("min", "word"), "max_word": ("max", "word")})


def fold_int_key(spark: SparkSession, folder: str) -> DataFrame:
    ones = mappers.emit(read_table(spark, folder, "lineitem"), "l_linenumber", F.lit(1))
    return reducers.fold(ones, ["first"], "sum", "second", "n").withColumnRenamed("first", "l_linenumber")


def nested_tuple_key(spark: SparkSession, folder: str) -> DataFrame:
    records = mappers.emit(read_table(spark, folder, "lineitem"), pair("l_returnflag", "l_linestatus"), F.lit(1))
    folded = reducers.fold(records, ["first"], "sum", "second", "n")
    return folded.select(F.col("first.first").alias("l_returnflag"), F.col("first.second").alias("l_linestatus"), "n")


def nested_tuple_leading(spark: SparkSession, folder: str) -> DataFrame:
    records = mappers.emit(read_table(spark, folder, "lineitem"), pair("l_returnflag", "l_linestatus"), F.lit(1))
    return reducers.fold(records, [F.col("first.first").alias("l_returnflag")], "sum", "second", "n")


def complete_job_ratio(spark: SparkSession, folder: str) -> DataFrame:
    job = Job(
        mapper=lambda df: mappers.emit(df, "lang", "n_chars"),
        reducer=lambda df: df.groupBy(F.col("first").alias("lang")).agg(F.concat(F.sum("second").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("ratio")),
    )
    return job.run_complete(read_table(spark, folder, "documents"))


def sorted_stream_rank(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    ranked = reducers.rank_runs(["o_custkey", "o_orderkey"], "pos")
    return reducers.reduce_stream(orders, ["o_custkey"], ranked, "o_custkey bigint, o_orderkey bigint, pos int", _partitions(spark), then=("o_orderkey",))


def sorted_stream_state(spark: SparkSession, folder: str) -> DataFrame:
    """A reducer with state across keys: it counts the keys of its partition, which sum to all keys."""
    import pyarrow as pa

    def keys(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in reducers.runs(batches, "o_custkey"))], pa.int64())], ["n"])

    orders = read_table(spark, folder, "orders").select("o_custkey")
    return reducers.reduce_stream(orders, ["o_custkey"], keys, "n bigint", _partitions(spark)).agg(F.sum("n").alias("n_keys"))


def distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    return reducers.fold(_tokens(spark, folder), ["word"], "distinct")


def map_emit(spark: SparkSession, folder: str) -> DataFrame:
    ones = mappers.emit(_tokens(spark, folder), "doc_id", F.lit(1))
    return reducers.fold(ones, ["first"], "sum", "second", "n").withColumnRenamed("first", "doc_id")


def map_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, folder).where(F.col("word").startswith("S"))


def map_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A Python mapper over Arrow batches: characters of each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def chars(batch):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.utf8_length(batch.column("text")).cast(pa.int64())], ["doc_id", "n"])

    return mappers.map_blocks(read_table(spark, folder, "documents").select("doc_id", "text"), chars, "doc_id bigint, n bigint")


def project_tuple(spark: SparkSession, folder: str) -> DataFrame:
    made = read_table(spark, folder, "lineitem").select(pair("l_shipdate", "l_linenumber").alias("t"))
    return made.select(F.col("t.second").alias("second"))


def compare_fold(spark: SparkSession, folder: str) -> DataFrame:
    """All comparisons of integers and strings, addition of integers, concatenation of strings."""
    nation = read_table(spark, folder, "nation")
    n, k, r = F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey")
    compared = {"below": k < r, "upto": k <= r, "above": k > r, "from_ten": k >= 10, "same": k == r, "other": k != r}
    compared |= {"before_k": n < "K", "upto_kenya": n <= "KENYA", "after_k": n > "K", "from_kenya": n >= "KENYA", "is_kenya": n == "KENYA", "not_kenya": n != "KENYA"}
    return nation.select(k.alias("n_nationkey"), *(c.alias(name) for name, c in compared.items()), (k + r).alias("total"), F.concat(n, n).alias("twice"))


def hash_partition_invariant(spark: SparkSession, folder: str) -> DataFrame:
    """Keys, and those of them that are in more than one partition."""
    dealt = exchange.by_hash(read_table(spark, folder, "orders").select("o_custkey"), _partitions(spark), "o_custkey")
    placed = dealt.withColumn("pid", F.spark_partition_id()).groupBy("o_custkey").agg(F.count_distinct("pid").alias("places"))
    return placed.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("places") > 1).alias("violations"))


def zero_partition(spark: SparkSession, folder: str) -> DataFrame:
    """What a reduce step made, gathered: its rows and the partitions they are in."""
    gathered = exchange.to_one(reducers.fold(read_table(spark, folder, "orders"), ["o_custkey"], "count", name="n"))
    return gathered.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_orders")).drop("pid")


def partition_of_int(spark: SparkSession, folder: str) -> DataFrame:
    keys = read_table(spark, folder, "lineitem").select("l_orderkey").distinct()
    return exchange.partition_of_int(keys, "l_orderkey", 4)


def partition_of_string(spark: SparkSession, folder: str) -> DataFrame:
    """Words and names of all lengths modulo 4, with letters beyond ASCII."""
    names = read_table(spark, folder, "part").select(F.col("p_name").alias("k"))
    return exchange.partition_of_string(names.unionByName(_tokens(spark, folder).select(F.col("word").alias("k"))).distinct(), "k", 7)


def partition_of_tuple(spark: SparkSession, folder: str) -> DataFrame:
    """A nested key ((part, line), flag) is placed by the exclusive or of its leaves' hashes."""
    keys = read_table(spark, folder, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag").distinct()
    hashed = murmur2_int(murmur2_int(keys, "l_partkey", "h1"), "l_linenumber", "h2").withColumn("h3", murmur2_string("l_returnflag").cast("bigint"))
    return exchange.partition_of_tuple(hashed, ["h1", "h2", "h3"], 5).drop("h1", "h2", "h3")


def custom_partitioner(spark: SparkSession, folder: str) -> DataFrame:
    pid = F.when(F.col("lang") == "en", 0).otherwise(1)
    dealt = exchange.by_partitioner(read_table(spark, folder, "documents").select("doc_id", "lang"), 4, pid)
    return dealt.select("doc_id", F.spark_partition_id().alias("pid"))


def _new_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = _new_folder(spark, "text")
    write_text(word_count(spark, folder), path, gather=False)
    return read_text(spark, path).withColumnRenamed("value", "line")


def gathered_text(spark: SparkSession, folder: str) -> DataFrame:
    """Written as one file, as the default sink does; its lines and the number of files that hold them."""
    path = _new_folder(spark, "gathered")
    write_text(word_count(spark, folder), path)
    return read_text(spark, path).select(F.col("value").alias("line"), F.input_file_name().alias("file")).groupBy("line").agg(F.count_distinct("file").alias("files"))


def refuse_existing(spark: SparkSession, folder: str) -> DataFrame:
    """A second result isn't written over the first, which stays as it was."""
    path, table = _new_folder(spark, "once"), read_table(spark, folder, "nation")
    write_text(table.select("n_name"), path)
    try:
        write_text(table.select("n_nationkey"), path)
        refused = False
    except AnalysisException:
        refused = True
    return read_text(spark, path).select(F.col("value").alias("line"), F.lit(refused).alias("refused"))


def empty_result(spark: SparkSession, folder: str) -> DataFrame:
    """A job without records succeeds: a file without lines."""
    path = _new_folder(spark, "empty")
    none = _tokens(spark, folder).where("word = ' '").select("word", F.lit(1).cast("bigint").alias("n"))
    write_text(reducers.fold(none, ["word"], "sum", "n", "n"), path)
    return read_text(spark, path).agg(F.count(F.lit(1)).alias("n_lines"))


# Every query with its SQL; {PAT} is the tokenizer's class.
T = "(select doc_id, word from (select doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) word from documents) where word <> '')"
WORDS = f"select word, count(*) n from {T} group by 1"
LINES = f"""select '("'||word||'", '||n||')' line from ({WORDS})"""


def _murmur_int(k: str) -> str:
    """The hash of an integer's low 32 bits, step by step."""
    low = lambda x: f"(({x}) & 4294967295)"
    times = lambda x: low(f"{x} * 1540483477")
    first = times(low(f"{k}::bigint"))
    second = times(f"xor({first}, {first} >> 24)")
    start = times("xor(2192675459, 4)")
    return _ended(f"xor({second}, {start})")


def _ended(h: str) -> str:
    """The last mixing of a hash, and its sign."""
    steps = f"list_transform([({h})::bigint], lambda x: ((xor(x, x >> 13) * 1540483477) & 4294967295))"
    steps = f"list_transform({steps}, lambda x: xor(x, x >> 15))"
    return f"list_transform({steps}, lambda x: case when x >= 2147483648 then x - 4294967296 else x end)[1]"


def _murmur_string(k: str) -> str:
    """The hash of UTF-8 bytes: whole words of four, little end first, then the signed rest."""
    x, n = f"hex(encode({k}))", f"octet_length(encode({k}))"
    byte = lambda i: f"('0x' || substr({x}, 2 * ({i}) + 1, 2))::bigint"
    signed = lambda i: f"(case when {byte(i)} > 127 then {byte(i)} - 256 else {byte(i)} end)"
    word = " + ".join(f"{byte(f'4 * i + {b}')} * {256**b}" for b in range(4))
    mixed = f"list_transform(range(0, {n} // 4), lambda i: ((({word}) * 1540483477) & 4294967295))"
    mixed = f"list_transform({mixed}, lambda w: ((xor(w, w >> 24) * 1540483477) & 4294967295))"
    whole = f"list_reduce(list_prepend(xor(2192675459, {n}), {mixed}), lambda h, w: xor((h * 1540483477) & 4294967295, w))"
    shifted = f"(({signed(f'{n} // 4 * 4 + i')} * (1 << (8 * i)::int)) & 4294967295)"
    tail = f"list_reduce(list_prepend(h, list_transform(range(0, {n} % 4), lambda i: {shifted})), lambda a, b: xor(a, b))"
    rest = f"case when {n} % 4 = 0 then h else (({tail}) * 1540483477) & 4294967295 end"
    return _ended(f"list_transform([{whole}], lambda h: {rest})[1]")


def _slot(h: str, n: int) -> str:
    return f"(case when {h} = -2147483648 then 0 else abs({h}) % {n} end)::int"


MURMUR = f"select l_orderkey, {_slot('h', 4)} pid from (select l_orderkey, {_murmur_int('l_orderkey')} h from (select distinct l_orderkey from lineitem))"
MURMUR_STRING = f"select k, {_slot('h', 7)} pid from (select k, {_murmur_string('k')} h from (select p_name k from part union select word from {T}))"
MURMUR_TUPLE = f"""select l_partkey, l_linenumber, l_returnflag, {_slot('xor(xor(h1, h2), h3)', 5)} pid from (select *, {_murmur_int('l_partkey')} h1, {_murmur_int('l_linenumber')} h2, {_murmur_string('l_returnflag')} h3
    from (select distinct l_partkey, l_linenumber, l_returnflag from lineitem))"""

QUERIES: dict[str, tuple[Query, str]] = {
    "word_count": (word_count, WORDS),
    "word_count_stream": (word_count_stream, WORDS),
    "word_count_lines": (word_count_lines, LINES),
    "split_lines": (split_lines, r"select doc_id, count(*) n_lines from (select doc_id, unnest(regexp_split_to_array(text, '[\r\n]')) line from documents) where line <> '' group by 1"),
    "fold_concat": (fold_concat, f"select word, string_agg(doc_id::varchar, ',' order by doc_id) docs from (select distinct word, doc_id from {T}) group by 1"),
    "fold_string": (fold_string, "select n_regionkey, string_agg(n_name, '' order by n_name) \"names\" from nation group by 1"),
    "fold_min_max": (fold_min_max, f"select doc_id, min(word) min_word, max(word) max_word from {T} group by 1"),
    "fold_int_key": (fold_int_key, "select l_linenumber, sum(1)::bigint n from lineitem group by 1"),
    "nested_tuple_key": (nested_tuple_key, "select l_returnflag, l_linestatus, sum(1)::bigint n from lineitem group by 1, 2"),
    "nested_tuple_leading": (nested_tuple_leading, "select l_returnflag, sum(1)::bigint n from lineitem group by 1"),
    "complete_job_ratio": (complete_job_ratio, "select lang, sum(n_chars)::varchar || '/' || count(*)::varchar ratio from documents group by 1"),
    "sorted_stream_rank": (sorted_stream_rank, "select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey))::int pos from orders"),
    "sorted_stream_state": (sorted_stream_state, "select count(distinct o_custkey) n_keys from orders"),
    "distinct_keys": (distinct_keys, f"select distinct word from {T}"),
    "map_emit": (map_emit, f"select doc_id, count(*) n from {T} group by 1"),
    "map_filter": (map_filter, f"select doc_id, word from {T} where starts_with(word, 'S')"),
    "map_blocks": (map_blocks, "select doc_id, length(text) n from documents"),
    "project_tuple": (project_tuple, "select l_linenumber as second from lineitem"),
    "compare_fold": (compare_fold, """select n_nationkey, n_nationkey < n_regionkey below, n_nationkey <= n_regionkey upto, n_nationkey > n_regionkey above, n_nationkey >= 10 from_ten, n_nationkey = n_regionkey same,
        n_nationkey <> n_regionkey other, n_name < 'K' before_k, n_name <= 'KENYA' upto_kenya, n_name > 'K' after_k, n_name >= 'KENYA' from_kenya, n_name = 'KENYA' is_kenya, n_name <> 'KENYA' not_kenya,
        n_nationkey + n_regionkey total, n_name || n_name twice from nation"""),
    "hash_partition_invariant": (hash_partition_invariant, "select count(distinct o_custkey) n_keys, 0::bigint violations from orders"),
    "zero_partition": (zero_partition, "select count(distinct o_custkey) n_rows, count(*) n_orders from orders"),
    "partition_of_int": (partition_of_int, MURMUR),
    "partition_of_string": (partition_of_string, MURMUR_STRING),
    "partition_of_tuple": (partition_of_tuple, MURMUR_TUPLE),
    "custom_partitioner": (custom_partitioner, "select doc_id, (case when lang = 'en' then 0 else 1 end)::int pid from documents"),
    "text_round_trip": (text_round_trip, LINES),
    "gathered_text": (gathered_text, f"select line, 1::bigint files from ({LINES})"),
    "refuse_existing": (refuse_existing, """select '"' || n_name || '"' line, true refused from nation"""),
    "empty_result": (empty_result, f"select count(*) n_lines from {T} where word = ' '"),
}
