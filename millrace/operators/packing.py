"""Packed token rows: sequences in order, joined until the next one doesn't fit, without a task that sees them all.

A row that starts at sequence i takes the following ones whose end, in the running total of lengths and separators, is at
most a bound. So what a span of sequences needs to know of all before it is how far the open row's bound reaches into it:
a number from 0 to the limit. Each span is a map from that number to the one it hands on; the maps of all spans are
composed by doubling steps, and then each span places its own sequences.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tokens import IGNORED, padded
from millrace.session import scratch, ship

#: Sequences of a span: three numbers each are held in one task.
SPAN = 250_000


def _next(ends: np.ndarray, limit: int) -> np.ndarray:
    """Of each sequence, the first one that a row starting there doesn't take; ends: running totals of length + 1 behind each."""
    begins = np.concatenate([[0], ends[:-1]])
    return np.maximum(np.searchsorted(ends, begins + limit + 1, side="right"), np.arange(1, len(ends) + 1))


def _handed_on(ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each reach 0 to limit + 1 of the row before: the reach handed on, and how many rows start in the span."""
    n, begins = len(ends), np.concatenate([[0], ends])
    after = np.append(_next(ends, limit), n)  # n: behind the span
    rows, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    step = after
    while (step[:n] < n).any():  # doubling: last row start reached, and rows passed on the way
        rows, last, step = rows + np.where(step < n, rows[step], 0), np.where(step < n, last[step], last), step[step]
    first = np.searchsorted(ends, np.arange(limit + 2), side="right")  # what the row before doesn't take
    reach = np.where(first < n, begins[last[first]] + limit + 1, np.arange(limit + 2)) - ends[-1]
    return np.clip(reach, 0, limit + 1), rows[first]


def pack_numbers(lengths: DataFrame, *, order: str, length: str, limit: int, span: int = SPAN) -> DataFrame:
    """order and pack_id (from 0) of every sequence, greedily in the order of a unique number.

    Each separator between sequences of a row counts; a sequence above the limit has a row of its own, as has any beside
    which no other fits; lengths of 0 take their separator only; null lengths count as 0. No rows give no rows.
    """
    spark = lengths.sparkSession
    ship(spark)
    rows = lengths.select(F.col(order).cast("long").alias("at"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n"))
    spans = rows.withColumn("span", F.floor(F.col("at") / span))
    path = scratch(spark, "spans")

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        ends = np.cumsum(part.sort_values("at")["n"].to_numpy() + 1)
        reach, started = _handed_on(ends, limit)
        return pd.DataFrame({"span": [part["span"].iloc[0]], "reach": [reach], "started": [started]})

    spans.groupBy("span").applyInPandas(summed, "span long, reach array<long>, started array<long>").write.parquet(path)
    written = spark.read.parquet(path)
    # A row for each span: their places are numbered by one window.
    maps = written.withColumn("k", F.row_number().over(Window.orderBy("span")) - 1)
    for step in range(math.ceil(math.log2(max(written.count(), 1)))):
        before = maps.select((F.col("k") + (1 << step)).alias("k"), F.col("reach").alias("r"), F.col("started").alias("s"))
        joined = maps.join(before, "k", "left")
        reach = F.when(F.col("r").isNull(), F.col("reach")).otherwise(F.transform("r", lambda c: F.get("reach", c)))
        started = F.when(F.col("r").isNull(), F.col("started")).otherwise(F.zip_with("r", "s", lambda c, n: n + F.get("started", c)))
        path = scratch(spark, "spans")
        joined.select("span", "k", reach.alias("reach"), started.alias("started")).write.parquet(path)
        maps = spark.read.parquet(path)
    entries = maps.select((F.col("k") + 1).alias("k"), F.col("reach")[0].alias("entry"), F.col("started")[0].alias("before"))
    entered = maps.select("span", "k").join(entries, "k", "left").select("span", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("before", F.lit(0)).alias("before"))

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        ends = np.cumsum(part["n"].to_numpy() + 1)
        after, starts = _next(ends, limit).tolist(), np.zeros(len(ends), np.int64)
        at = int(np.searchsorted(ends, part["entry"].iloc[0], side="right"))
        while at < len(ends):
            starts[at], at = 1, after[at]
        return pd.DataFrame({"at": part["at"], "pack_id": part["before"].iloc[0] - 1 + np.cumsum(starts)})

    return spans.join(F.broadcast(entered), "span").groupBy("span").applyInPandas(placed, "at long, pack_id long").withColumnRenamed("at", order)


def packed_rows(df: DataFrame, *, order: str, ids: str, labels: str, limit: int, separator: int, pad: int, span: int = SPAN) -> DataFrame:
    """pack_id, sequences, used, input_ids, attention_mask and labels of the packed rows of a table of id and label arrays.

    Sequences stand in the order of a unique number, with a separator between them that no label counts, and are padded
    behind to the limit; nothing is cut, so one above the limit stands alone and isn't padded. Null arrays count as empty.
    A row gathers at most the limit's ids.
    """
    own = df.select(F.col(order).cast("long").alias("_at"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("_ids"), F.coalesce(F.col(labels).cast("array<int>"), F.array().cast("array<int>")).alias("_labels"))
    numbers = pack_numbers(own.select("_at", F.size("_ids").alias("_n")), order="_at", length="_n", limit=limit, span=span)
    packs = own.join(numbers, "_at").groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_ids", "_labels"))).alias("_all"))

    def joined(part: str, between: int) -> Column:
        return F.flatten(F.transform("_all", lambda x, k: F.when(k == 0, x[part]).otherwise(F.concat(F.array(F.lit(between)), x[part]))))

    rows = packs.select("pack_id", F.size("_all").alias("sequences"), joined("_ids", separator).alias("_ids"), joined("_labels", IGNORED).alias("_labels"))
    used = F.size("_ids")
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(limit) - used))
    return rows.select("pack_id", "sequences", used.alias("used"), padded(F.col("_ids"), F.lit(limit), pad).alias("input_ids"), mask.alias("attention_mask"), padded(F.col("_labels"), F.lit(limit), IGNORED).alias("labels"))
