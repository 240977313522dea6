"""Files that hold one JSON array, read in splits: a file of any size is never one row.

Spark reads such a file cut at its closing braces, wherever its splits fall. Whether a cut stands inside a string is the
parity of the quotes before it, and how deep it stands the sum of the brackets outside strings: two running sums over
pieces, taken within spans of pieces and, before them, over a row for each span. An element ends where the depth is back
at one; only its own pieces are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import scratch
from millrace.sources.lines import FILE, LINE, SPAN, VALUE, lines


def running(df: DataFrame, value: Column, out: str) -> DataFrame:
    """df (by file and line) with the sum of a value over the rows of the file before."""
    spans = df.withColumns({"_v": value, "_span": F.floor(F.col(LINE) / SPAN)})
    before = Window.partitionBy(FILE).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.groupBy(FILE, "_span").agg(F.sum("_v").alias("_all")).select(FILE, "_span", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(FILE, "_span").orderBy(LINE).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_within", F.coalesce(F.sum("_v").over(within), F.lit(0))).join(offsets, [FILE, "_span"])
    return placed.withColumn(out, F.col("_offset") + F.col("_within")).drop("_v", "_span", "_within", "_offset")


def _number(c: Column, marks: str) -> Column:
    return F.length(c) - F.length(F.translate(c, marks, ""))


def array_elements(spark: SparkSession, path: str | list[str], *, pattern: str | None = None) -> DataFrame:
    """_file, _line (the element's number, from 1) and value (its text) of the objects of array files.

    Elements that aren't objects are left out and not counted, but an array among them is refused. White space, nesting,
    and braces, quotes and escapes within strings don't matter; a file without elements gives no row.
    """
    pieces = lines(spark, path, pattern=pattern, separator="}")
    # Escapes are masked, character by character, so that quotes are the ends of strings.
    plain = F.regexp_replace(VALUE, r"(?s)\\.", "__")
    outside = lambda text: F.regexp_replace(text, r'"[^"]*("|$)', "")
    change = lambda text: _number(outside(text), "{[") - _number(outside(text), "]")
    counts = pieces.withColumn("_plain", plain).select(FILE, LINE, _number(F.col("_plain"), '"').alias("_n"), change(F.col("_plain")).alias("_out"), change(F.regexp_replace("_plain", r'^[^"]*"?', "")).alias("_in"))
    narrow, placed = scratch(spark, "pieces"), scratch(spark, "elements")
    counts.write.parquet(narrow)  # a few numbers for each piece: the sums below read these, not the texts
    rows = running(spark.read.parquet(narrow), F.col("_n"), "_quotes")
    inside = (F.col("_quotes") + F.col("_n")) % 2 == 1
    rows = rows.select(FILE, LINE, inside.alias("_inside"), (F.when(F.col("_quotes") % 2 == 1, F.col("_in")).otherwise(F.col("_out")) - F.when(inside, 0).otherwise(1)).alias("_change"))
    last = rows.groupBy(FILE).agg(F.max(LINE).alias("_last"))  # what is behind a file's last brace ends no element
    rows = running(rows, F.col("_change"), "_depth").join(F.broadcast(last), FILE)
    rows = rows.withColumn("_ended", (~F.col("_inside") & (F.col("_depth") + F.col("_change") == 1) & (F.col(LINE) < F.col("_last"))).cast("int"))
    running(rows.select(FILE, LINE, "_depth", "_ended"), F.col("_ended"), "_element").write.parquet(placed)
    whole = pieces.join(spark.read.parquet(placed), [FILE, LINE])
    elements = whole.groupBy(FILE, "_element").agg(F.array_sort(F.collect_list(F.struct(LINE, VALUE))).alias("_all"), F.min_by("_depth", LINE).alias("_from"), F.max("_ended").alias("_whole"))
    texts = elements.where("_whole = 1").select(FILE, "_element", "_from", F.concat(F.array_join(F.col(f"_all.{VALUE}"), "}"), F.lit("}")).alias("_text"))
    # What stands before the object: the array's bracket, commas, white space, and elements that aren't objects.
    lead = F.regexp_extract(F.regexp_replace("_text", r"(?s)\\.", "__"), r'^[^{"]*(?:"[^"]*"[^{"]*)*', 0)
    texts = texts.withColumn("_lead", lead).withColumn("_bare", F.regexp_replace("_lead", r'"[^"]*"', ""))
    nested = F.col("_from") + _number(F.col("_bare"), "[") - _number(F.col("_bare"), "]") > 1
    refused = F.when(nested, F.raise_error(F.concat(F.lit("an array is an element in "), F.col(FILE))).cast("string")).otherwise(F.substr("_text", F.length("_lead") + 1))
    return texts.select(FILE, (F.col("_element") + 1).alias(LINE), refused.alias(VALUE))


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file, or of the first file of a folder that has one, that isn't white space; empty without one.

    Only the head of a file is read.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(where) if not f.isDirectory() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    for file in files:
        stream = fs.open(file.getPath())
        try:
            while head := bytes(stream.readNBytes(4096)):
                if text := head.decode("utf-8", "ignore").lstrip("﻿").strip():
                    return text[0]
        finally:
            stream.close()
    return ""
