"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the epoch over its own size. Each document draws its number
of copies by inverting the Poisson distribution with that mean at a uniform number hashed from seed and id; copies
are exploded and dealt out by a hash of (seed, id, copy), then ordered by it within partitions: a global shuffle
that is the same however the input is partitioned. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import fresh, materialize

#: Shares of sources go as their sizes to this power, unless target weights are given.
TEMPERATURE = 0.7
SEED = "mix-1"
#: A mean above this is a sum of equal parts with their own draws, so that each inversion is short.
LARGEST_MEAN = 16.0
#: Terms of an inversion; the tail of a mean of LARGEST_MEAN beyond them is below 2^-52.
TERMS = 64
#: Rows of a table of rates or of repeated ids up to which it is broadcast, a few MB; a larger one is joined by shuffle,
#: to rows dealt out by source and one of SALTS numbers, or by id.
MOST_BROADCAST = 50_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.when(s["upto"] > u, s).otherwise(F.struct(p.alias("p"), (s["upto"] + p).alias("upto"), (s["k"] + 1).alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def repetitions(id_text: Column, mean: Column, seed: str = SEED) -> Column:
    """Copies of a document: Poisson with that mean, of its id alone."""
    parts = F.greatest(F.ceil(mean / LARGEST_MEAN), F.lit(1)).cast("int")
    draw = lambda j: poisson_inverse(uniform(F.lit(seed), id_text, j.cast("string")), mean / parts)
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, j: total + draw(j))


def rates(docs: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epoch: float | None = None, source_col: str = "source") -> DataFrame:
    """source and its mean repetition rate; sources without a given weight get none of the epoch (default: as many documents as there are)."""
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    if weights is None:
        share = F.pow(n, F.lit(float(temperature)))
    else:
        share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))), F.coalesce("source", F.lit(""))), F.lit(0.0))
    totals = sizes.agg(F.sum(share).alias("shares"), F.sum(n).alias("documents"))
    size = F.lit(float(epoch)) if epoch is not None else F.col("documents")
    return sizes.join(F.broadcast(totals), how="inner").select("source", F.coalesce(F.try_divide(size * share, F.col("shares") * n), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epoch: float | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, repeated, with `copy` (from 0), in a global pseudo-random order.

    A null source is a source of its own (with given weights: that of the empty string). A row draws by its id; rows
    whose id is null or repeats draw each for itself, by their places in the input, and are dealt out so too. Null
    and empty texts of any length are rows like others; an empty table stays empty; all columns of docs are kept as
    they are, and where one is named `copy` the number is `copy_`.
    """
    source, rate, n, salt, name, again, copy = (fresh(docs, c) for c in ("_source", "_rate", "_n", "_salt", "_name", "_again", "copy"))
    means = materialize(rates(docs, weights=weights, temperature=temperature, epoch=epoch, source_col=source_col).select(F.col("source").alias(source), F.col("rate").alias(rate)), "rates")
    own = F.col(id_col).cast("string")
    repeated = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(own.alias(again)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(again), "repeated")
    small = lambda table: table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    # Rows that one scan task reads are told apart by their numbers there.
    placed = docs.withColumn(salt, F.monotonically_increasing_id())
    same_source = F.col(source_col).cast("string").eqNullSafe(F.col(source))
    if small(means):
        counted = placed.join(F.broadcast(means), same_source)
    else:
        spread = means.withColumn(again, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = placed.join(spread, same_source & (F.pmod(salt, F.lit(SALTS)) == F.col(again))).drop(again)
    if repeated.isEmpty():
        counted = counted.withColumn(again, F.lit(None).cast("string"))
    else:
        counted = counted.join(F.broadcast(repeated) if small(repeated) else repeated, own == F.col(again), "left")
    each = F.concat_ws("#", F.coalesce(own, F.lit("null")), F.col(salt).cast("string"))
    named = counted.withColumn(name, F.when(F.col(id_col).isNotNull() & F.col(again).isNull(), own).otherwise(each))
    copies = named.withColumn(n, repetitions(F.col(name), F.col(rate), seed)).where(F.col(n) > 0)
    exploded = copies.select(*docs.columns, name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    key = F.xxhash64(F.lit(seed), F.col(name), F.col(copy))
    return exploded.repartition(key).sortWithinPartitions(F.xxhash64(key, F.lit("order")), name, copy).drop(name)


ORACLE = f"""
    WITH sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
    totals AS (SELECT sum(pow(n, {TEMPERATURE}::DOUBLE)) AS shares, sum(n) AS documents FROM sizes),
    rates AS (SELECT source, documents * pow(n, {TEMPERATURE}::DOUBLE) / (shares * n) AS rate FROM sizes, totals),
    parts AS (SELECT source, rate, greatest(ceil(rate / {LARGEST_MEAN}), 1)::INT AS parts FROM rates),
    terms AS (
        SELECT source, parts, k, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
        FROM parts, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
    draws AS (
        SELECT doc_id, d.source, j, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u
        FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, (SELECT unnest(range(1, 65)) AS j) WHERE j <= parts),
    counts AS (
        SELECT doc_id, sum(c) AS n FROM (
            SELECT doc_id, j, count(*) FILTER (WHERE upto <= u) AS c
            FROM draws JOIN terms ON draws.source IS NOT DISTINCT FROM terms.source GROUP BY doc_id, j) GROUP BY doc_id)
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(0, n::BIGINT))::INT AS copy FROM documents d JOIN counts c ON d.doc_id = c.doc_id"""
