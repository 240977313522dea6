"""Union, replication, caps, seeded order, splits, sets and exact deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_sources(sources: list[DataFrame | None]) -> DataFrame:
    """A bag union in order; absent sources are skipped, missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s for s in sources if s is not None])


def replicate(df: DataFrame, copies: int = 3, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(copies))))


def cap_per_group(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first rows of each group; Spark cuts each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def seeded_key(seed: str, *columns: str) -> Column:
    """A pseudo-random order that is the same however rows are partitioned."""
    return F.md5(F.concat_ws("-", F.lit(seed), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def shuffled(df: DataFrame, seed: str, *columns: str) -> DataFrame:
    return df.orderBy(seeded_key(seed, *columns), *columns)


def bucket(seed: str, *columns: str, buckets: int = 10_000) -> Column:
    return F.conv(F.substring(seeded_key(seed, *columns), 1, 8), 16, 10).cast("bigint") % buckets


def train_validation(df: DataFrame, seed: str, *columns: str, share: float = 0.05) -> DataFrame:
    return df.withColumn("split", F.when(bucket(seed, *columns) < int(share * 10_000), "validation").otherwise("train"))


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the first by order; pre-aggregated, so a key's rows don't meet in one task."""
    own = F.struct(order, *[c for c in df.columns if c != order])
    return df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(F.min_by(own, F.col(order)).alias("_r")).select("_r.*")


def until_cap(df: DataFrame, size: str, group: list[str], order: str, cap: int, span: int = 1_000_000) -> DataFrame:
    """Rows of a group up to and including the one that reaches the cap, by a numeric order.

    Sizes are summed up within spans of the order, and before them by a row for each span; so a group, or with none the
    whole corpus, isn't one window.
    """
    spans = df.where(F.col(size).isNotNull()).withColumn("_span", F.floor(F.col(order) / span))
    lower = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy(*group, "_span").agg(F.sum(size).alias("_total"))
    earlier = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(lower(group, "_span")), F.lit(0))).where(F.col("_earlier") < cap).drop("_total")
    within = F.coalesce(F.sum(size).over(lower([*group, "_span"], order)), F.lit(0))
    placed = spans.join(earlier, [*group, "_span"]).withColumn("_within", within)
    return placed.where(F.col("_earlier") + F.col("_within") < cap).select(*df.columns)
