"""Token sequences: lengths, budgets, labels, padding, length-sorted batches and lossless packing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ship

IGNORED = -100
#: Smallest and largest prompt budgets by domain, and the share of the length between them.
BUDGETS = {"chem": (512, 1024), "other": (256, 512)}
SHARE = 0.35


def words(c: str | Column) -> Column:
    """The default tokenizer: runs without white space."""
    return F.filter(F.split(F.col(c) if isinstance(c, str) else c, r"\s+"), lambda w: w != "")


def token_length(prompt: Column, answer: Column, tokenizer: Callable[[Column], Column] = words) -> Column:
    """Tokens of a prompt and its answer, without special ones."""
    return F.size(tokenizer(prompt)) + F.size(tokenizer(answer))


def length_cap(df: DataFrame, length: str, *, percent: float = 99.0, most: int = 3072, group: list[str] | None = None) -> DataFrame:
    """The linear percentile of the lengths as an integer, at least 16 and at most `most`."""
    cap = F.greatest(F.lit(16), F.least(F.lit(most), F.percentile(length, F.lit(percent / 100)).cast("int"))).alias("cap")
    return df.groupBy(*(group or [])).agg(cap)


def prompt_budget(limit: int, domain: Column) -> Column:
    """Ids that a prompt may keep: SHARE of the limit, within the domain's bounds."""
    if limit <= max(low for low, _ in BUDGETS.values()):
        raise ValueError("the limit must exceed the smallest prompt budget")
    of = lambda low, high: max(low, min(high, int(SHARE * limit)))
    return F.when(domain == "chem", of(*BUDGETS["chem"])).otherwise(of(*BUDGETS["other"]))


def kept_lengths(prompt_n: Column, answer_n: Column, limit: int, domain: Column) -> Column:
    """Struct of the ids kept of prompt and answer: the answer's tail beside the prompt's budget, then the prompt's tail."""
    budget = prompt_budget(limit, domain)
    over = prompt_n + answer_n > limit
    answer = F.when(over, F.least(answer_n, limit - budget)).otherwise(answer_n)
    return F.struct(F.when(over, F.least(prompt_n, limit - answer)).otherwise(prompt_n).alias("prompt"), answer.alias("answer"))


def tail(ids: Column, n: Column) -> Column:
    """The last n items; none for n of 0."""
    n = F.least(n, F.size(ids))
    return F.when(n <= 0, F.slice(ids, 1, 0)).otherwise(F.slice(ids, F.size(ids) - n + 1, F.greatest(n, F.lit(0))))


def truncated(prompt_ids: Column, answer_ids: Column, limit: int, domain: Column) -> Column:
    kept = kept_lengths(F.size(prompt_ids), F.size(answer_ids), limit, domain)
    return F.struct(tail(prompt_ids, kept["prompt"]).alias("prompt"), tail(answer_ids, kept["answer"]).alias("answer"))


def labels(prompt_ids: Column, answer_ids: Column, masked: Column | int = 0) -> Column:
    """Labels of prompt and answer: the prompt and the answer's first `masked` ids are ignored."""
    masked = F.least(F.lit(masked) if isinstance(masked, int) else masked, F.size(answer_ids))
    skip = F.array_repeat(F.lit(IGNORED), F.size(prompt_ids) + masked)
    return F.concat(skip, F.slice(answer_ids, masked + 1, F.greatest(F.size(answer_ids) - masked, F.lit(0))))


def masked_truncation(ids: Column, label: Column, mask: Column, limit: int, domain: Column | str, *, protected: tuple[int, ...] = (), keep: str = "right", masked: Column | int = 0) -> Column:
    """Struct of ids, labels and mask of a sequence with a label and a loss weight for each id, cut to the limit.

    The answer begins at the first id whose label counts. A sequence above the limit keeps its answer's tail beside the
    domain's prompt budget, then the prompt's tail; the prompt's labels are ignored and weigh 0, and the answer's first
    `masked` labels are ignored, if it has more. Without an answer, or without labels, it is cut to the limit less the
    number of its protected ids (to none, if they are as many): to the last ids (keep left) or the first (keep right), with
    the first labels and weights in either case. Others stay, with labels and weights cut to their length; null labels or
    weights stay null.
    """
    if keep not in ("left", "right"):
        raise ValueError(keep)
    n = F.size(ids)
    domain = F.lit(domain) if isinstance(domain, str) else domain
    head = lambda a, k: F.when(a.isNotNull(), F.slice(a, 1, k))
    first = F.coalesce(F.array_position(F.transform(label, lambda x: x != IGNORED), True), F.lit(0)).cast("int")  # 0: no answer
    prompt_n, answer_n = first - 1, n - first + 1
    kept = kept_lengths(prompt_n, answer_n, limit, domain)
    prompt, answer = tail(head(ids, prompt_n), kept["prompt"]), F.slice(ids, first, answer_n)
    own_mask = F.lit(masked) if isinstance(masked, int) else masked
    own = F.slice(label, first, answer_n)
    own = F.when(own_mask < answer_n, F.transform(own, lambda x, k: F.when(k < own_mask, F.lit(IGNORED)).otherwise(x))).otherwise(own)
    weights = F.when(mask.isNotNull(), F.concat(F.transform(prompt, lambda _: F.lit(0.0)), tail(F.slice(mask, first, answer_n), kept["answer"]).cast("array<double>")))
    answered = F.struct(F.concat(prompt, tail(answer, kept["answer"])).alias("ids"), F.concat(F.transform(prompt, lambda _: F.lit(IGNORED)), tail(own, kept["answer"])).alias("labels"), weights.alias("mask"))
    room = F.greatest(F.lit(limit) - F.size(F.filter(ids, lambda x: x.isin(*protected))), F.lit(0)) if protected else F.lit(limit)
    cut = tail(ids, room) if keep == "left" else F.slice(ids, 1, room)
    bare = F.struct(cut.alias("ids"), head(label, F.size(cut)).alias("labels"), head(mask, F.size(cut)).cast("array<double>").alias("mask"))
    whole = F.struct(ids.alias("ids"), head(label, n).alias("labels"), head(mask, n).cast("array<double>").alias("mask"))
    return F.when(n <= limit, whole).when(first > 0, answered).otherwise(bare)


def padded(ids: Column, to: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), to - F.size(ids)))


def attention(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def length_sorted_batches(df: DataFrame, length: str, order: str, batch: int, group: list[str] | None = None) -> DataFrame:
    """`batch_id` of rows by falling length, ties by order: batch rows each, the last one fewer."""
    group = group or []
    # Rows of one length are numbered behind those of greater lengths, which a small table of lengths counts.
    sizes = df.groupBy(*group, length).agg(F.count("*").alias("_n"))
    longer = Window.partitionBy(*group).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(longer), F.lit(0))).drop("_n")
    numbered = numbered_within(df, [*group, length], order, "_place").join(offsets, [*group, length])
    return numbered.withColumn("batch_id", F.floor((F.col("_offset") + F.col("_place")) / batch)).select(*df.columns, "batch_id")


#: Values of a numeric order that are numbered or summed up in one window.
SPAN = 1_000_000


def numbered_within(df: DataFrame, group: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """df with each row's place (from 0) in its group by a numeric order, counted within spans of it, and before them by a row for each span."""
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    counted = spans.groupBy(*group, "_span").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.withColumn("_earlier", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    place = F.row_number().over(Window.partitionBy(*group, "_span").orderBy(order)) - 1
    return spans.withColumn("_in_span", place).join(earlier, [*group, "_span"]).withColumn(out, F.col("_earlier") + F.col("_in_span")).drop("_span", "_in_span", "_earlier")


def padded_batches(df: DataFrame, batch: str, ids: str, label: str, pad: int, fatal: bool = True) -> DataFrame:
    """input_ids, attention_mask and labels, each padded to its batch's longest row; empty rows are left out.

    A batch of empty rows alone ends the job, or with fatal=False leaves no row.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    checked = F.when(longest > 0, longest).otherwise(F.raise_error(F.concat(F.lit("no row with ids in batch "), F.col(batch).cast("string"))) if fatal else F.lit(0))
    rows = df.withColumn("_to", checked.cast("int")).where((F.col("_to") > 0) & (F.size(ids) > 0))
    own = padded(F.col(ids), F.col("_to"), pad)
    return rows.withColumns({"input_ids": own, "attention_mask": attention(own, pad), "labels": padded(F.col(label), F.col("_to"), IGNORED)}).drop("_to")


def pack_in_order(df: DataFrame, *, length: str, order: str, group: str, limit: int) -> DataFrame:
    """`pack_id` of each sequence within its group, greedily in order; groups are batches, so of bounded size.

    A separator counts, so nothing is cut; sequences longer than the limit stand alone.
    """
    item = F.struct(F.col(order).alias("order"), F.col(length).alias("n"), F.struct(*df.columns).alias("row"))
    batches = df.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(F.lit(-1).cast("long").alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, item: Column) -> Column:
        n = item["n"].cast("long")
        fits = (s["pack"] >= 0) & (s["used"] + 1 + n <= limit)
        pack = F.when(fits, s["pack"]).otherwise(s["pack"] + 1)
        return F.struct(pack.alias("pack"), F.when(fits, s["used"] + 1 + n).otherwise(n).alias("used"), F.concat(s["out"], F.array(pack)).alias("out"))

    packs = F.aggregate("_items", start, step, lambda s: s["out"])
    return batches.select(F.explode(F.arrays_zip(F.col("_items").alias("item"), packs.alias("pack"))).alias("x")).select("x.item.row.*", F.col("x.pack").alias("pack_id"))


def tokenized(df: DataFrame, column: str, tokenizer: Callable[[str], list[int]], out: str = "ids") -> DataFrame:
    """df with the ids that an injected tokenizer gives, in Arrow batches."""

    ship(df.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenizer(t or ""))

    udf = F.pandas_udf(run, "array<int>")
    return df.withColumn(out, udf(column))
