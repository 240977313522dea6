"""Descriptions, histograms, effect sizes, t-tests and rank correlations."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import bound
from millrace.session import scratch

#: Values are ranked in one range for so many distinct values, in this many ranges at least and at most.
RANGE_VALUES, LEAST_RANGES, MOST_RANGES = 250_000, 64, 4096
#: Cuts that one step of the search for a value's range compares.
STEP = 64


def _range_of(value: Column, cuts: list[float]) -> Column:
    """The number of sorted cuts at or below a value, searched in two steps where they are many."""
    at_or_below = lambda own: sum(((value >= F.lit(c)).cast("int") for c in own), F.lit(0))
    if len(cuts) <= STEP:
        return at_or_below(cuts)
    blocks = [cuts[a : a + STEP] for a in range(0, len(cuts), STEP)]
    block = at_or_below([b[0] for b in blocks])
    table = F.array(*(F.array(*map(F.lit, b)) for b in blocks))
    return F.when(block > 0, (block - 1) * STEP + F.size(F.filter(F.element_at(table, block), lambda c: value >= c))).otherwise(0)


def before_value(counts: DataFrame, value: str, n: str, group: list[str], out: str) -> DataFrame:
    """counts (a row for each group and distinct value, with n rows) with the rows of the group below the value.

    Values are cut at approximate quantiles into ranges in proportion to their number; windows run within a range, and
    the ranges' totals, a few rows for each group, are added from a second small window. No group is sorted in one task.
    The counts are written once, as each step reads them.
    """
    path = scratch(counts.sparkSession, "counts")
    counts.write.parquet(path)
    counts = counts.sparkSession.read.parquet(path)
    ranges = min(max(counts.count() // RANGE_VALUES, LEAST_RANGES), MOST_RANGES)
    cuts = sorted(set(counts.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [k / ranges for k in range(1, ranges)], 0.3 / ranges)))
    own = _range_of(F.col(value).cast("double"), cuts)
    ranged = counts.withColumn("_range", own)
    totals = ranged.groupBy(*group, "_range").agg(F.sum(n).alias("_total"))
    lower = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(lower), F.lit(0))).drop("_total")
    within = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0))).join(offsets, [*group, "_range"])
    return placed.withColumn(out, F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def order_bits(value: Column) -> Column:
    """A long for each double, in their order: sign, exponent and fraction, as the double has them; both zeros are 0, NaN is last."""
    v = value.cast("double")
    size = F.abs(v)
    power = lambda e: F.pow(F.lit(2.0), e)
    about = F.floor(F.log2(size)).cast("double")
    e = F.greatest(about - (size < power(about)).cast("int") + (size >= power(about + 1)).cast("int"), F.lit(-1022.0))
    one = 1 << 52
    normal = (e + 1023).cast("long") * one + ((size / power(e) - 1) * float(one)).cast("long")
    small = (size * float(1 << 1000) * float(1 << 74)).cast("long")  # below 2 ** -1022 there is the fraction alone
    of = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 * one)).when(size < 2.0**-1022, small).otherwise(normal)
    return F.when(F.isnan(v), F.lit(2047 * one + 1)).when(v < 0, -of).otherwise(of)


#: Bits of the order that the passes of a selection look at, highest first.
PASSES = (22, 21, 21)


def order_statistics(df: DataFrame, value: str, group: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, name and value of the rows at given ranks (from 0) of each group's values, nulls left out: a rank is a function of their number.

    Nothing is sorted: three passes count rows by ever lower bits of the values' order, each only where a rank lies, so
    what is shuffled are the counts that tasks have added up. Groups of any size and number go together.
    """
    spark, rest = df.sparkSession, 64
    rows = df.where(F.col(value).isNotNull()).select(*group, value, order_bits(F.col(value)).alias("_bits"))
    at: list[str] = []
    for k, bits in enumerate(PASSES):
        rest -= bits
        part = lambda k, r: F.shiftright("_bits", r).bitwiseAND(F.lit((1 << PASSES[k]) - 1)) if k else F.shiftright("_bits", r)  # noqa: E731, the highest bits hold the sign
        own = rows.withColumn("_at", part(k, rest))
        if k:
            own = own.withColumns({c: part(i, 64 - sum(PASSES[: i + 1])) for i, c in enumerate(at)})
            keys = sought.select(*(F.col(c).alias(f"_k_{c}") for c in (*group, *at))).distinct()
            own = own.join(keys, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*group, *at))), "left_semi")
        counts = own.groupBy(*group, *at, "_at").agg(F.count("*").alias("_n"), F.min(value).alias("_value"))
        inside = Window.partitionBy(*group, *at)
        before = F.coalesce(F.sum("_n").over(inside.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumns({"_before": before, "_all": F.sum("_n").over(inside)})
        if k:
            named = sought.select(*(F.col(c).alias(f"_k_{c}") for c in (*group, *at)), "name", "rank", "n")
            placed = placed.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*group, *at))))
        else:
            wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_all")).cast("long").alias("rank")) for name, rank in ranks.items()))
            placed = placed.withColumn("_w", F.explode(wanted)).select("*", "_w.*").withColumn("n", F.col("_all"))
        found = placed.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        path = scratch(spark, "ranks")
        found.select(*group, *at, F.col("_at").alias(f"_b{k}"), "name", (F.col("rank") - F.col("_before")).alias("rank"), "n", "_value").write.parquet(path)
        sought = spark.read.parquet(path)  # a row for each group and rank
        at.append(f"_b{k}")
    return sought.select(*group, "name", "n", F.col("_value").alias("value"))


def upper_median(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """sorted[n // 2] of each group."""
    return order_statistics(df, value, group, {"upper_median": lambda n: F.floor(n / 2)}).select(*group, F.col("value").alias("upper_median"))


def quantiles(df: DataFrame, value: str, group: list[str], shares: dict[str, float]) -> DataFrame:
    """The linear quantiles of each group, by name."""
    at = lambda n, share: (n - 1) * F.lit(float(share))
    sides = {f"{name}/{side}": (lambda n, s=share, f=fn: f(at(n, s))) for name, share in shares.items() for side, fn in (("lo", F.floor), ("hi", F.ceil))}
    found = order_statistics(df, value, group, sides)
    of = lambda name, side: F.max(F.when(F.col("name") == f"{name}/{side}", F.col("value").cast("double")))
    ends = found.groupBy(*group).agg(F.max("n").alias("_n"), *(of(name, side).alias(f"_{name}_{side}") for name in shares for side in ("lo", "hi")))
    part = lambda share: at(F.col("_n"), share) - F.floor(at(F.col("_n"), share))
    return ends.select(*group, *((F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * part(s)).alias(n) for n, s in shares.items()))


def described(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Count, mean, median, population deviation, bounds and quartiles of each group."""
    plain = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    cut = quantiles(df, value, group, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return plain.join(cut, group, "left") if group else plain.join(F.broadcast(cut), how="left")


def closed_histogram(df: DataFrame, value: Column, bins: int = 5) -> DataFrame:
    """Counts of [0, 1] in equal bins, the last one closed; values outside are dropped."""
    own = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")
    return df.where(value.between(0, 1)).groupBy(own.alias("bin")).agg(F.count("*").alias("n"))


def two_groups(df: DataFrame, value: str, first: Column, second: Column, group: list[str] | None = None) -> DataFrame:
    """Moments of two sides of each group, or of all, Cohen's d, and the equal-variance t with its degrees of freedom and two-sided p."""
    group = group or []
    of = lambda fn, which: fn(F.when(which, F.col(value).cast("double")))
    m = df.groupBy(*group).agg(*(of(fn, g).alias(f"{name}{k}") for k, g in ((1, first), (2, second)) for name, fn in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop), ("v", F.var_samp))))
    pooled = F.sqrt((F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) / 2)
    d = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0)
    dof = F.col("n1") + F.col("n2") - 2
    spread = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), dof)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(spread * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2")))))
    out = m.select(*group, "n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), d.alias("cohens_d"), t.alias("t"), dof.alias("dof"))
    return out.withColumn("p", t_probability(F.col("t"), F.col("dof")))


#: Steps of the continued fraction of the incomplete beta function, and of the recurrence before its constant's series.
FRACTION, SHIFT = 200, 20


def t_probability(t: Column, dof: Column) -> Column:
    """The two-sided P of a t value: the incomplete beta function of dof / 2 and 1/2 at dof / (dof + t t), its continued fraction folded over columns (Lentz). Null without both, or without a degree of freedom."""
    nu, square = dof.cast("double"), t.cast("double") * t.cast("double")
    x, rest, half = nu / (nu + square), square / (nu + square), nu / 2
    # ln of Gamma(half + 1/2) / Gamma(half): a recurrence up to where the series holds.
    up = half + SHIFT
    series = F.log(up) / 2 - 1 / (8 * up) + 1 / (192 * up * up * up) - 1 / (640 * F.pow(up, F.lit(5.0)))
    ratio = series + F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, k: s + F.log((half + k) / (half + k + 0.5)))
    front = ratio - F.lit(math.log(math.pi) / 2) + half * F.log(x) + F.log(rest) / 2
    swapped = x > (half + 1) / (half + 2.5)
    a, b = F.when(swapped, 0.5).otherwise(half), F.when(swapped, half).otherwise(0.5)
    z = F.when(swapped, rest).otherwise(x)
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        p = s["p"]
        m = m.cast("double")
        even = m * (p["b"] - m) * p["z"] / ((p["a"] + 2 * m - 1) * (p["a"] + 2 * m))
        odd = -(p["a"] + m) * (p["a"] + p["b"] + m) * p["z"] / ((p["a"] + 2 * m) * (p["a"] + 2 * m + 1))
        half_way = F.struct(p.alias("p"), tiny(1 + even / s["c"]).alias("c"), (1 / tiny(1 + even * s["d"])).alias("d"), s["out"].alias("out"))
        whole = bound(half_way, lambda h: F.struct(h["p"].alias("p"), tiny(1 + odd / h["c"]).alias("c"), (1 / tiny(1 + odd * h["d"])).alias("d"), (h["out"] * h["c"] * h["d"]).alias("out")))
        return bound(whole, lambda w: F.struct(w["p"].alias("p"), w["c"].alias("c"), w["d"].alias("d"), (w["out"] * w["c"] * w["d"]).alias("out")))

    def fraction(p: Column) -> Column:
        d = 1 / tiny(1 - (p["a"] + p["b"]) * p["z"] / (p["a"] + 1))
        return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION)), F.struct(p.alias("p"), F.lit(1.0).alias("c"), d.alias("d"), d.alias("out")), step, lambda s: s["out"])

    value = F.exp(front) / a * bound(F.struct(a.alias("a"), b.alias("b"), z.alias("z")), fraction)
    return F.when((nu > 0) & t.isNotNull(), F.when(square == 0, 1.0).otherwise(F.when(swapped, 1 - value).otherwise(value)))


def two_sided_p(t: float, dof: float) -> float:
    """P of a t value, by the continued fraction of the incomplete beta function (Lentz)."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1, ties at their mean; counts of distinct values are ranked, not rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    placed = before_value(counts, value, "_n", [], "_before")
    ranks = placed.select(F.col(value).alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """The correlation of two columns; 0 without rows or where one of them hardly varies."""
    m = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    flat = (F.col("n") == 0) | (F.col("va") * F.col("n") <= 1e-12) | (F.col("vb") * F.col("n") <= 1e-12)
    return m.select(F.when(flat, 0.0).otherwise(F.col("r")).alias("pearson"))


def tier_agreement(df: DataFrame, a: str, b: str, cuts: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """Share of rows whose two scores fall in the same third, to 4 places; a bound belongs to the lower third."""
    tier = lambda c: F.when(F.col(c) <= cuts[0], 0).when(F.col(c) <= cuts[1], 1).otherwise(2)
    return df.agg(F.round(F.coalesce(F.avg((tier(a) == tier(b)).cast("double")), F.lit(0.0)), 4).alias("agreement"))


def binary_f1(predicted: Column, actual: Column) -> Column:
    tp, fp, fn = (F.sum(x.cast("int")) for x in (predicted & actual, predicted & ~actual, ~predicted & actual))
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
