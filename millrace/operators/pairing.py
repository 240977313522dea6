"""Samples from three line sources joined by position, with counters taken in the same pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.text import original_smiles, smiles_sane
from millrace.sources.lines import LINE, VALUE

#: What became of a line, in the order in which it is judged.
UNREADABLE, BEYOND, INVALID, USED = "unreadable", "beyond", "invalid", "used"


def asked_molecule(record: Column) -> Column:
    """The molecule that a record's input or instruction asks about."""
    of = lambda field: F.nullif(original_smiles(F.coalesce(F.get_json_object(record, f"$.{field}"), F.lit(""))), F.lit(""))
    return F.coalesce(of("input"), of("instruction"), F.lit(""))


def paired_samples(records: DataFrame, optimized: DataFrame, reasonings: DataFrame | None = None, *, original: Callable[[Column], Column] = asked_molecule, valid: Callable[[Column], Column] = smiles_sane) -> DataFrame:
    """line, record, original, optimized, reasoning and status of every line of one file of records.

    records: lines of JSON (sources.lines.lines), of which bad and blank ones keep their number; optimized: smiles and
    _index from 0 (smiles_list, whose blank lines aren't numbered, so that it may run ahead of the records); reasonings:
    text by line_no (sections), empty where there is none. A line is unreadable, or beyond the end of the list, or its
    optimized molecule isn't valid, or it is used. Numbers are dense and unique, so each source is dealt out evenly and
    once: both joins are by the line.
    """
    own = records.select(F.col(LINE).alias("line"), F.col(VALUE).alias("record"), F.try_parse_json(VALUE).isNotNull().alias("_readable"))
    listed = optimized.select((F.col("_index") + 1).alias("line"), F.col("smiles").alias("optimized"))
    rows = own.join(listed, "line", "left")
    if reasonings is not None:
        rows = rows.join(reasonings.select(F.col("line_no").cast("long").alias("line"), F.col("text").alias("reasoning")), "line", "left")
    else:
        rows = rows.withColumn("reasoning", F.lit(None).cast("string"))
    status = F.when(~F.col("_readable"), UNREADABLE).when(F.col("optimized").isNull(), BEYOND).when(~F.coalesce(valid(F.col("optimized")), F.lit(False)), INVALID).otherwise(USED)
    asked = F.when(F.col("_readable"), original(F.col("record")))
    return rows.select("line", "record", asked.alias("original"), "optimized", F.coalesce("reasoning", F.lit("")).alias("reasoning"), status.alias("status"))


def counters() -> list[Column]:
    """Aggregates over paired_samples: all lines are paired, those that can't be read among them."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    reasoned = F.count(F.when((F.col("status") == USED) & F.rlike("reasoning", F.lit(r"(?U)\S")), 1))
    return [
        F.count("*").alias("paired"), is_(UNREADABLE).alias("unreadable"), is_(BEYOND).alias("beyond"), is_(INVALID).alias("skipped_invalid_after"), is_(USED).alias("used_pairs"),
        reasoned.alias("has_reasoning_count"), F.coalesce(F.round(F.try_divide(reasoned, is_(USED)), 4), F.lit(0.0)).alias("has_reasoning_ratio"),
    ]


def counted(samples: DataFrame, name: str = "samples") -> tuple[DataFrame, Observation]:
    """The used samples, and an observation that holds the counters once an action has run over them: no second pass."""
    seen = Observation(name)
    return samples.observe(seen, *counters()).where(F.col("status") == USED), seen
