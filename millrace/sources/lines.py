"""Text sources with dense line numbers, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import stripped

#: Column names of every line source.
FILE, LINE, VALUE = "_file", "_line", "value"


def lines(spark: SparkSession, path: str | list[str], *, pattern: str | None = None, recursive: bool = False, separator: str | None = None) -> DataFrame:
    """_file, _line (from 1, dense), value of all lines, or of the pieces between separators.

    A line's number is its distance from the first row of its file split plus the lines of the splits before, so
    files of any size are numbered without a sort; only a row for each split is aggregated.
    """
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if separator:
        reader = reader.option("lineSep", separator)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias(VALUE))
    splits = rows.groupBy(FILE, "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(FILE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(placed, [FILE, "_block"]).select(FILE, (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias(LINE), VALUE)


def jsonl(spark: SparkSession, path: str | list[str], schema: str, *, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Lines that hold one JSON object, with its fields; blank and undecodable lines are left out."""
    parsed = F.from_json(VALUE, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines(spark, path, pattern=pattern, recursive=recursive).where((stripped(VALUE) != "") & F.startswith(stripped(VALUE), F.lit("{")))
    return rows.withColumn("_r", parsed).where("_r._corrupt IS NULL").select(FILE, LINE, "_r.*").drop("_corrupt")


def json_array(spark: SparkSession, path: str | list[str], schema: str, *, pattern: str | None = None) -> DataFrame:
    """The objects of files that hold one JSON array, numbered from 1; undecodable ones are left out."""
    from millrace.sources.arrays import array_elements

    parsed = F.from_json(VALUE, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return array_elements(spark, path, pattern=pattern).withColumn("_r", parsed).where("_r._corrupt IS NULL").select(FILE, LINE, "_r.*").drop("_corrupt")


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether the first character of a file that isn't blank is an opening bracket; reads up to there."""
    from millrace.sources.arrays import first_character

    return first_character(spark, path) == "["


def sniffed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file or JSON lines, by the first character."""
    return json_array(spark, path, schema) if is_array_file(spark, path) else jsonl(spark, path, schema)


def clean(c: str | Column) -> Column:
    return stripped(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


#: Lines of a file that are numbered in one window.
SPAN = 1_000_000


def numbered(df: DataFrame, out: str, prefix: str = "") -> DataFrame:
    """df with each row's place among all rows, from 0, by file and line: counted within spans of lines, and before them by a row for each span."""
    spans = df.withColumn("_span", F.floor(F.col(LINE) / SPAN))
    sizes = spans.groupBy(FILE, "_span").agg(F.count("*").alias("_n"))
    before = Window.orderBy(FILE, "_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(FILE, "_span").orderBy(LINE)) - 1
    joined = spans.withColumn("_place", place).join(offsets, [FILE, "_span"])
    number = F.col("_offset") + F.col("_place")
    return joined.withColumn(out, F.concat(F.lit(prefix), number.cast("string")) if prefix else number).drop("_span", "_place", "_offset")


def reasoning_records(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """Chat records of instruction/input/output lines; ids count the accepted lines."""
    rows = numbered(jsonl(spark, path, "instruction string, input string, output string"), "id", "chem-")
    return rows.select("id", F.lit("chem").alias("source"), clean("instruction").alias("system"), clean("input").alias("user"), clean("output").alias("assistant_raw"), F.lit(stage).cast("string").alias("chem_stage"), FILE, LINE)


MESSAGES = "messages array<struct<role: string, content: string>>, prompt string, response string, output string, dataset string"


def _said(role: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter("messages", lambda m: (m["role"] == role) & (clean(m["content"]) != "")), F.lit(1))["content"], F.lit(""))


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by file and line; all of them without a limit.

    Rows are counted by file and span of lines; the counts before tell which spans are taken, and only within the one that
    the limit cuts are rows numbered.
    """
    if limit is None:
        return rows
    spans = rows.withColumn("_span", F.floor(F.col(LINE) / SPAN))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(FILE, "_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each span
    counts = spans.groupBy(FILE, "_span").agg(F.count("*").alias("_n")).withColumn("_left", F.lit(limit) - before).where("_left > 0")
    taken = spans.join(counts, [FILE, "_span"])
    whole = taken.where("_n <= _left").select(*rows.columns)
    place = F.row_number().over(Window.partitionBy(FILE, "_span").orderBy(LINE))
    return whole.union(taken.where("_n > _left").withColumn("_place", place).where("_place <= _left").select(*rows.columns))


def chat_records(spark: SparkSession, folder: str, limit: int | None = 20_000) -> DataFrame:
    """The first user and first assistant text of each line of *.jsonl files, by file and line; at most `limit` kept rows."""
    rows = jsonl(spark, folder, MESSAGES, pattern="*.jsonl")
    has = F.size(F.coalesce("messages", F.array())) > 0
    user = F.when(has, stripped(_said("user"))).otherwise(clean("prompt"))
    reply = F.when(clean("response") != "", clean("response")).otherwise(clean("output"))
    kept = rows.select(FILE, LINE, user.alias("user"), F.when(has, stripped(_said("assistant"))).otherwise(reply).alias("assistant_raw")).where("user <> '' OR assistant_raw <> ''")
    first = numbered(_first(kept, limit), "id", "chat-")
    return first.select("id", F.lit("ultrachat").alias("source"), F.lit("").alias("system"), "user", "assistant_raw", FILE, LINE)


def instruction_records(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Instruction triples, or `data` lists of at least three strings whose prefixes are taken off the first two."""
    schema = "instruction string, input string, output string, data array<string>"
    rows = jsonl(spark, folders, schema, pattern="*.jsonl").unionByName(json_array(spark, folders, schema, pattern="*.json"))
    triple = F.size(F.coalesce("data", F.array())) >= 3
    item = lambda k: F.coalesce(F.get("data", F.lit(k)), F.lit(""))
    kept = rows.where(triple | F.col("instruction").isNotNull())
    return kept.select(
        F.concat(F.lit("inst-"), F.element_at(F.split(FILE, "/"), -1), F.lit("-"), F.col(LINE).cast("string")).alias("id"), F.lit("instruction").alias("source"),
        F.when(triple, stripped(F.replace(item(0), F.lit("System: "), F.lit("")))).otherwise(clean("instruction")).alias("system"),
        F.when(triple, stripped(F.replace(item(1), F.lit("User: "), F.lit("")))).otherwise(clean("input")).alias("user"),
        F.when(triple, item(2)).otherwise(clean("output")).alias("assistant_raw"), FILE, LINE,
    )


QA_SYSTEM = "You are a helpful chemistry assistant."


def qa_records(spark: SparkSession, line_files: list[str], array_files: list[str], per_file: int | None = None, system: str = QA_SYSTEM) -> DataFrame:
    """Question and answer files: instruction and input run on without a space; JSON lines need an output, arrays only an instruction."""
    schema = "instruction string, input string, output string"
    parts = []
    if line_files:
        parts.append(jsonl(spark, line_files, schema).where("instruction IS NOT NULL AND output IS NOT NULL"))
    if array_files:
        parts.append(json_array(spark, array_files, schema).where("instruction IS NOT NULL"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if per_file is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(FILE).orderBy(LINE))).where(F.col("_n") <= per_file).drop("_n")
    user = F.concat(clean("instruction"), clean("input"))
    return rows.select(F.concat(F.lit("qa-"), F.element_at(F.split(FILE, "/"), -1), F.lit("-"), F.col(LINE).cast("string")).alias("id"), F.lit("chem").alias("source"), F.lit(system).alias("system"), user.alias("user"), clean("output").alias("assistant_raw"), FILE, LINE)


def message_records(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """Lines with at least two messages: the first is the user's unless its role differs, the second the assistant's likewise."""
    rows = jsonl(spark, path, MESSAGES).where(F.size("messages") >= 2)
    m = lambda k: F.get("messages", F.lit(k))
    user = F.when(m(0)["role"] == "user", m(0)["content"]).otherwise(m(1)["content"])
    reply = F.when(m(1)["role"] == "assistant", m(1)["content"]).otherwise(m(0)["content"])
    return _first(rows, limit).select(F.lit("chem").alias("source"), F.lit("").alias("system"), clean(user).alias("user"), clean(reply).alias("assistant_raw"), "dataset", FILE, LINE)


def plain_records(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """Plain texts with their channel; empty ones are left out."""
    rows = numbered(_first(jsonl(spark, path, "text string, channel string").where(clean("text") != ""), limit), "id", "cpt-")
    return rows.select("id", F.lit("cpt").alias("source"), F.lit("").alias("system"), F.lit("").alias("user"), clean("text").alias("assistant_raw"), F.coalesce("channel", F.lit("unknown")).alias("channel"), FILE, LINE)


def validation_records(spark: SparkSession, path: str) -> DataFrame:
    """_file, _line and record (JSON) of validation files, of equal records the first by file and line.

    Where a file's first line that isn't blank is JSON, its lines are, up to the first that isn't; else each line is a
    reasoning. Records are equal if they are with their fields sorted by name.
    """
    rows = lines(spark, path).where(stripped(VALUE) != "").select(FILE, LINE, stripped(VALUE).alias(VALUE), F.try_parse_json(stripped(VALUE)).alias("_v"))
    first = rows.groupBy(FILE).agg(F.min_by(F.col("_v").isNotNull(), LINE).alias("_json"), F.min(F.when(F.col("_v").isNull(), F.col(LINE))).alias("_bad"))  # a row for each file
    kept = rows.join(first, FILE).where(~F.col("_json") | F.col("_bad").isNull() | (F.col(LINE) < F.col("_bad")))
    record = F.when(F.col("_json"), F.to_json("_v")).otherwise(F.to_json(F.struct(F.col(VALUE).alias("reasoning"))))
    place = F.struct(FILE, LINE)
    return kept.groupBy(record.alias("record")).agg(F.min(place).alias("_at")).select(F.col(f"_at.{FILE}").alias(FILE), F.col(f"_at.{LINE}").alias(LINE), "record")


#: What marks a section, and its head.
SECTION_MARK, SECTION_HEAD = "=== Line", r"=== Line (\d+) ==="


def sections(spark: SparkSession, path: str) -> DataFrame:
    """line_no and text: of `=== Line N ===` sections (the last of a number that isn't blank stays), or of the lines of the file, from 1.

    Files split: a piece of a line belongs to the last head before it, found within spans of lines and, before them, by
    a row for each span; only a section's own text is gathered in a row. Without a mark anywhere, lines count from the
    first that isn't blank.
    """
    rows = lines(spark, path)
    marked = F.contains(VALUE, F.lit(SECTION_MARK))
    files = rows.groupBy(FILE).agg(F.max(marked).alias("_marked"), F.min(F.when(stripped(VALUE) != "", F.col(LINE))).alias("_start"))  # a row for each file
    rows = rows.join(F.broadcast(files), FILE)
    plain = rows.where(~F.col("_marked")).select((F.col(LINE) - F.col("_start") + 1).alias("line_no"), stripped(VALUE).alias("text"))

    heads = F.transform(F.regexp_extract_all(VALUE, F.lit(SECTION_HEAD), 1), lambda n: n.try_cast("long"))
    pieces = rows.where("_marked").select(FILE, LINE, heads.alias("_heads"), F.posexplode(F.split(VALUE, SECTION_HEAD, -1)).alias("_k", "_piece"))
    at = F.struct(F.col(LINE).alias("line"), F.col("_k").alias("k"), F.get("_heads", F.col("_k") - 1).alias("number"))
    spans = pieces.select(FILE, LINE, "_k", "_piece", F.when(F.col("_k") > 0, at).alias("_head"), F.floor(F.col(LINE) / SPAN).alias("_span"))
    last = spans.groupBy(FILE, "_span").agg(F.max("_head").alias("_last"))
    before = Window.partitionBy(FILE).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(FILE, "_span", F.max("_last").over(before).alias("_carried"))
    within = Window.partitionBy(FILE, "_span").orderBy(LINE, "_k").rowsBetween(Window.unboundedPreceding, 0)
    owned = spans.withColumn("_own", F.max("_head").over(within)).join(carried, [FILE, "_span"]).select(FILE, LINE, "_k", "_piece", F.coalesce("_own", "_carried").alias("_of"))
    texts = owned.where("_of IS NOT NULL").groupBy(FILE, "_of").agg(F.array_sort(F.collect_list(F.struct(LINE, "_k", "_piece"))).alias("_all"))
    cut = texts.select(F.col("_of.number").alias("line_no"), stripped(F.array_join(F.col("_all._piece"), "\n")).alias("text"), F.struct(FILE, "_of").alias("_at")).where("text <> ''")
    kept = cut.groupBy("line_no").agg(F.max_by("text", "_at").alias("text"))
    return kept.union(plain.where("text <> ''"))


def smiles_list(spark: SparkSession, path: str) -> DataFrame:
    """_index (from 0) and smiles of the lines that aren't blank."""
    rows = numbered(lines(spark, path).where(stripped(VALUE) != ""), "_index")
    return rows.select(F.col("_index").cast("long").alias("_index"), stripped(VALUE).alias("smiles"))


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """id and smiles of a CSV file with those columns, or of an .smi file, whose ids count raw lines."""
    if path.endswith(".csv"):
        table = spark.read.option("header", "true").csv(path)
        missing = {"id", "smiles"} - set(table.columns)
        if missing:
            raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
        return table.select("id", "smiles")
    if path.endswith(".smi"):
        return lines(spark, path).where(stripped(VALUE) != "").select(F.concat(F.lit("mol_"), F.col(LINE).cast("string")).alias("id"), F.element_at(F.split(stripped(VALUE), r"\s+"), 1).alias("smiles"))
    raise ValueError(f"{path}: neither .csv nor .smi")


BOX = "center_x double, center_y double, center_z double, size_x double, size_y double, size_z double"


def boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The six numbers of each box file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(FILE), F.from_json("value", BOX).alias("b")).select(FILE, "b.*")


def first_sample(spark: SparkSession, path: str) -> DataFrame:
    """The first record: instruction and input as one prompt, and the expected output."""
    rows = _first(jsonl(spark, path, "instruction string, input string, output string"), 1)
    return rows.select(F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n\n"), F.coalesce("input", F.lit(""))).alias("user"), F.coalesce("output", F.lit("")).alias("expected"))


def write_report(report: DataFrame, path: str) -> None:
    """A report row as one JSON line, nulls included; no row writes no line."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Records appended as JSON lines."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_matrix(rows: DataFrame, path: str) -> None:
    """A result matrix as CSV with a header; empty cells for failed targets."""
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)
