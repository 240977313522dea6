"""Queries of the text sources and sinks: tables are written as the files a source reads, and read back by it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.matrix import result_matrix
from millrace.operators.scoring import corpus_report
from millrace.plans.analytics import TARGETS, stub_affinity
from millrace.plans.corpus import table
from millrace.session import scratch
from millrace.sources import lines as src
from millrace.streaming.rollout_log import follow, to_sink


def _files(rows: DataFrame, order: str, line: Column, name: str, ending: str = "txt") -> str:
    """A folder with the lines (a column of strings, or of arrays of them) of the ordered rows; files go by name as rows go."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    ordered = rows.orderBy(order).select(line.alias("value"))
    (ordered.select(F.explode("value").alias("value")) if ordered.schema["value"].dataType.typeName() == "array" else ordered).write.text(path)
    if ending != "txt":
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            own = status.getPath()
            if own.getName().startswith("part-"):
                fs.rename(own, jvm.org.apache.hadoop.fs.Path(folder, f"{own.getName()[:10]}.{ending}"))
    return path


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def reasoning_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an instruction line; blank and undecodable lines between are left out and not counted."""
    line = F.concat(F.array(_json(instruction=F.lit(" Improve "), input=F.col("source"), output=F.col("text"))), F.when(F.col("doc_id") % 10 == 3, F.array(F.lit(""), F.lit("not json"))).otherwise(F.array().cast("array<string>")))
    path = _files(table(spark, sf_dir, "documents"), "doc_id", line, "reasoning", "jsonl")
    return src.reasoning_records(spark, path, "start").select("id", "source", "system", "user", "assistant_raw", "chem_stage")


def chat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a line of messages."""
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    path = _files(said, "conv_id", _json(messages=messages), "chats", "jsonl")
    return src.chat_records(spark, path, None).select("id", "user", "assistant_raw")


def instruction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: documents as lists of three strings or instruction lines by turns; lists of two are left out."""
    data = F.array(F.lit("System: be brief"), F.concat(F.lit("User: "), _text("doc_id")), F.col("text"))
    line = F.when(F.col("doc_id") % 10 == 7, _json(data=F.array(F.lit("a"), F.lit("b")))).when(F.col("doc_id") % 2 == 0, _json(data=data))
    line = F.coalesce(line, _json(instruction=F.lit(" do "), input=_text("doc_id"), output=F.col("text")))
    path = _files(table(spark, sf_dir, "documents"), "doc_id", line, "instructions", "jsonl")
    return src.instruction_records(spark, [path]).select("system", "user", "assistant_raw")


def qa_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as lines, every fourth without an output, and the nations as an array file."""
    answer = F.when(F.col("item_id") % 4 != 0, F.concat(F.lit(" a"), _text("item_id")))
    first = _files(table(spark, sf_dir, "benchmark"), "item_id", _json(instruction=F.col("text"), input=F.concat(F.lit(" q"), _text("item_id")), output=answer), "qa", "jsonl")
    return src.qa_records(spark, [first], [_nation_array(spark, sf_dir)]).select("system", "user", "assistant_raw")


def _nation_array(spark: SparkSession, sf_dir: str) -> str:
    """A file with one JSON array: the nations are 25."""
    nations = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    items = F.to_json(F.transform("names", lambda n: F.struct(n.alias("instruction"))))
    return _files(nations.coalesce(1).withColumn("k", F.lit(0)), "k", items, "array", "json")


def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two turns of each conversation; those of one turn are left out."""
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    path = _files(said, "conv_id", _json(messages=messages, dataset=_text("conv_id")), "messages")
    return src.message_records(spark, path, None).select("user", "assistant_raw", "dataset")


def plain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a plain line, every fifth without a channel."""
    line = _json(text=F.col("text"), channel=F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    return src.plain_records(spark, _files(table(spark, sf_dir, "documents"), "doc_id", line, "plain"), None).select("id", "assistant_raw", "channel")


def _document_arrays(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files that hold all documents, each one array over many lines."""
    path = scratch(spark, "arrays")
    record = _json(instruction=_text("doc_id"), data=F.array(F.struct(F.col("lang").alias("x"))), output=F.col("text"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comma = ""
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        for batch in batches:
            for value in batch.column("value").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [comma + value]})
                comma = ","
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    table(spark, sf_dir, "documents").select(record.alias("value")).mapInArrow(bracketed, "value string").write.text(path)
    return path


def sniffed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as array files that are read in splits, and the benchmark as JSON lines, told apart by their first characters."""
    lines = _files(table(spark, sf_dir, "benchmark"), "item_id", F.array(F.lit(" "), _json(instruction=_text("item_id"), output=F.col("text"))), "lines")
    paths = (("array", _document_arrays(spark, sf_dir)), ("lines", lines))
    read = [src.sniffed(spark, p, "instruction string, output string").select(F.lit(k).alias("kind"), "instruction", "output") for k, p in paths]
    return read[0].union(read[1])


def validation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as JSON lines, with repeats whose fields stand in another order; a bad line ends the rest."""
    name, key = F.col("n_name"), F.col("n_nationkey")
    line = F.array(_json(name=name, key=key), _json(key=key, name=name), F.when(key == 20, "{bad").otherwise(""))
    path = _files(table(spark, sf_dir, "nation").coalesce(1), "n_nationkey", line, "validation")
    return src.validation_records(spark, path).select("record")


def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sections of a file, some twice: the last of a number stays, but for blank ones."""
    head = lambda n: F.concat(F.lit("=== Line "), n.cast("string"), F.lit(" ==="))
    own, again = head(F.col("doc_id")), head(F.col("doc_id") - F.col("doc_id") % 4)
    line = F.array(F.concat(own, F.lit("  "), F.col("text")), F.when(F.col("doc_id") % 8 == 5, F.concat(again, F.lit(" again "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 8 == 2, again).otherwise(F.lit("")))
    found = src.sections(spark, _files(table(spark, sf_dir, "documents"), "doc_id", line, "sections"))
    return found.select("line_no", F.regexp_replace("text", r"\s+", " ").alias("text"))


def smiles_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' names as molecules, numbered without the blank lines between."""
    line = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("  "), F.col("c_name"))).otherwise(F.array(F.col("c_name")))
    return src.smiles_list(spark, _files(table(spark, sf_dir, "customer"), "c_custkey", line, "smiles"))


def molecule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a CSV table, nations as an .smi file with blank lines, whose ids count raw lines."""
    csv = scratch(spark, "molecules") + ".csv"
    table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("id"), F.col("s_name").alias("smiles"), F.lit(1).alias("more")).write.option("header", "true").csv(csv)
    smi = scratch(spark, "molecules") + ".smi"
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.explode(F.array(F.concat("n_name", F.lit(" name")), F.lit(" "))).alias("value")).write.text(smi)
    return src.molecules(spark, csv).union(src.molecules(spark, smi))


def recursive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders by language, found at any depth by their ending."""
    path = scratch(spark, "folders")
    table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), _text("doc_id").alias("value")).write.partitionBy("lang").text(f"{path}/a")
    found = src.lines(spark, path, pattern="*.txt", recursive=True)
    return found.groupBy(F.regexp_extract(src.FILE, "lang=([^/]*)/", 1).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("ids"))


def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box file for each region."""
    path, key = scratch(spark, "boxes"), F.col("r_regionkey").cast("double")
    box = _json(center_x=key, center_y=key + 0.5, center_z=-key, size_x=key * 2, size_y=F.lit(20.0), size_z=F.lit(22.5))
    table(spark, sf_dir, "region").select("r_regionkey", box.alias("value")).write.partitionBy("r_regionkey").text(path)
    numbers = src.boxes(spark, f"{path}/*/*.txt")
    return numbers.select(F.regexp_extract(src.FILE, "r_regionkey=([0-9]+)/", 1).cast("int").alias("region"), "center_x", "center_y", "center_z", "size_x", "size_y", "size_z")


def first_line_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of a file (a sample of one is the feature)."""
    line = _json(instruction=F.lit("Read"), input=F.col("text"), output=F.col("lang"))
    return src.first_sample(spark, _files(table(spark, sf_dir, "documents"), "doc_id", line, "sample"))


def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, A2: the report of all order totals as one JSON line, read back."""
    path = scratch(spark, "report")
    src.write_report(corpus_report(table(spark, sf_dir, "orders"), value="o_totalprice"), path)
    return spark.read.schema("count long, mean double, min double, max double, median double, std double").json(path).withColumn("std", F.round("std", 4))


def log_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in two parts, read back."""
    path, events = scratch(spark, "log"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for k in (0, 1):
        src.append_log(events.where(F.col("event_id") % 2 == k), path)
    return spark.read.schema(events.schema).json(path)


def matrix_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result matrix as CSV, read back: failed targets are empty cells, failed preparations have no row."""
    path = scratch(spark, "matrix")
    items = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("id"), F.col("c_name").alias("smiles"))
    src.write_matrix(result_matrix(items, list(TARGETS), stub_affinity, lambda s: None if s.endswith("7") else s), path)
    return spark.read.option("header", "true").schema("id string, smiles string, north_affinity double, north_rank int, south_affinity double, south_rank int, selectivity double").csv(path).withColumn("selectivity", F.round("selectivity", 6))


def log_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollout log followed by a stream that writes each batch under its number, so that none counts twice."""
    log, out = scratch(spark, "follow"), scratch(spark, "followed")
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("iter"), F.col("value").alias("reward"), (F.col("event_type") == "click").alias("ok_format"), F.length("props").alias("out_len"))
    src.append_log(rows, log)
    to_sink(follow(spark, log), lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows/batch={k}"), f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("iter", "reward", "ok_format", "out_len")


QUERIES = {
    f.__name__: f
    for f in (
        reasoning_scan, chat_scan, instruction_scan, qa_scan, message_scan, plain_scan, sniffed_scan, validation_scan, section_scan, smiles_scan, molecule_scan,
        recursive_scan, box_scan, first_line_sample, report_written, log_appended, matrix_written, log_followed,
    )
}


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x0B\x1c-\x1f\x85]+|[\s\p{{Z}}\x0B\x1c-\x1f\x85]+$', '', 'g')"


_TURN = "coalesce(arg_min({s}, turn) FILTER (role = '{r}' AND {s} <> ''), '')"
_FIRST = "SELECT conv_id, " + ", ".join(f"{_TURN.format(s=_strip('text'), r=r)} AS {n}" for r, n in (("user", '"user"'), ("assistant", "assistant_raw"))) + " FROM conversations GROUP BY conv_id"

ORACLE_SQL = {
    "reasoning_scan": f"SELECT 'chem-' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, 'chem' AS source, 'Improve' AS system, coalesce({_strip('source')}, '') AS \"user\", coalesce({_strip('text')}, '') AS assistant_raw, 'start' AS chem_stage FROM documents",
    "chat_scan": f"SELECT 'chat-' || (row_number() OVER (ORDER BY conv_id) - 1) AS id, \"user\", assistant_raw FROM ({_FIRST}) WHERE \"user\" <> '' OR assistant_raw <> ''",
    "instruction_scan": f"""
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'be brief' ELSE 'do' END AS system, doc_id::VARCHAR AS "user", CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE coalesce({_strip('text')}, '') END AS assistant_raw
        FROM documents WHERE doc_id % 10 <> 7""",
    "qa_scan": f"""
        SELECT 'You are a helpful chemistry assistant.' AS system, {_strip('text')} || 'q' || item_id AS "user", 'a' || item_id AS assistant_raw FROM benchmark WHERE item_id % 4 <> 0
        UNION ALL SELECT 'You are a helpful chemistry assistant.', n_name, '' FROM nation""",
    "message_scan": f"""
        WITH t AS (SELECT conv_id, list(struct_pack(r := role, t := {_strip('text')}) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
        SELECT CASE WHEN m[1].r = 'user' THEN m[1].t ELSE m[2].t END AS "user", CASE WHEN m[2].r = 'assistant' THEN m[2].t ELSE m[1].t END AS assistant_raw, conv_id::VARCHAR AS dataset FROM t WHERE len(m) >= 2""",
    "plain_scan": f"""
        SELECT 'cpt-' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, {_strip('text')} AS assistant_raw, coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, 'unknown') AS channel
        FROM documents WHERE {_strip('text')} <> ''""",
    "sniffed_scan": "SELECT 'lines' AS kind, item_id::VARCHAR AS instruction, text AS output FROM benchmark UNION ALL SELECT 'array', doc_id::VARCHAR, text FROM documents",
    "validation_scan": "SELECT '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS record FROM nation WHERE n_nationkey <= 20",
    "section_scan": rf"""
        WITH s AS (
            SELECT doc_id AS line_no, 2 * doc_id AS pos, text FROM documents UNION ALL SELECT doc_id - doc_id % 4, 2 * doc_id + 1, 'again ' || doc_id FROM documents WHERE doc_id % 8 = 5),
        k AS (SELECT line_no, arg_max({_strip('text')}, pos) AS text FROM s WHERE {_strip('text')} <> '' GROUP BY line_no)
        SELECT line_no, regexp_replace(text, '[\s\x0B]+', ' ', 'g') AS text FROM k""",
    "smiles_scan": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _index, c_name AS smiles FROM customer",
    "molecule_scan": "SELECT s_suppkey::VARCHAR AS id, s_name AS smiles FROM supplier UNION ALL SELECT 'mol_' || (2 * row_number() OVER (ORDER BY n_nationkey) - 1), split_part(n_name, ' ', 1) FROM nation",
    "recursive_scan": "SELECT coalesce(lang, 'none') AS lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "box_scan": "SELECT r_regionkey::INT AS region, r_regionkey::DOUBLE AS center_x, r_regionkey + 0.5::DOUBLE AS center_y, -r_regionkey::DOUBLE AS center_z, r_regionkey * 2::DOUBLE AS size_x, 20::DOUBLE AS size_y, 22.5::DOUBLE AS size_z FROM region",
    "first_line_sample": "SELECT 'Read' || chr(10) || chr(10) || coalesce(text, '') AS \"user\", coalesce(lang, '') AS expected FROM documents ORDER BY doc_id LIMIT 1",
    "report_written": "SELECT count(*) AS count, round(avg(o_totalprice), 4)::DOUBLE AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median, round(stddev_pop(o_totalprice), 4)::DOUBLE AS std FROM orders",
    "log_appended": "SELECT event_id, event_type, value FROM events",
    "matrix_written": """
        WITH n AS (SELECT c_custkey::VARCHAR AS id, c_name AS smiles, coalesce(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), ''), '0')::BIGINT AS n FROM customer WHERE NOT ends_with(c_name, '7')),
        a AS (SELECT id, smiles, -((n * 7) % 100) / 10::DOUBLE AS x, CASE WHEN n % 5 = 0 THEN NULL ELSE -((n * 11) % 100) / 10::DOUBLE END AS y FROM n)
        SELECT id, smiles, x AS north_affinity, 1 AS north_rank, y AS south_affinity, CASE WHEN y IS NULL THEN NULL ELSE 1 END AS south_rank, round(y - x, 6)::DOUBLE AS selectivity FROM a""",
    "log_followed": "SELECT event_id AS iter, value AS reward, event_type = 'click' AS ok_format, length(props)::INT AS out_len FROM events",
}
