"""Vector distances, centroids and novelty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scoring import novelty, novelty_tier
from millrace.functions.text import reasoning_slice, sentences, stripped
from millrace.operators.stats import quantiles
from millrace.session import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_centroid(vectors: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """`distance` and `centroid` (from 0) of the nearest of a fixed, small list of centroids; ties to the first."""
    table = F.array(*(F.array(*map(F.lit, c)) for c in centroids))
    far = F.transform(table, lambda c: cosine_distance(F.col(vector), c))
    return vectors.withColumn("_d", far).withColumn("distance", F.array_min("_d")).withColumn("centroid", F.array_position("_d", F.col("distance")).cast("int") - 1).drop("_d")


def mean_centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Component-wise means by label, as long rows folded back in order."""
    long = vectors.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))


def cluster_count(n: int) -> int:
    return min(64, max(8, n // 50))


def lloyd_round(vectors: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """centroid (from 0) and the mean vector of those nearest to it by Euclidean distance, ties to the first; one without any has no row."""
    table = F.array(*(F.array(*map(F.lit, c)) for c in centroids))
    far = F.transform(table, lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    near = vectors.select(vector, far.alias("_far")).select(vector, (F.array_position("_far", F.array_min("_far")) - 1).cast("int").alias("nearest"))
    return mean_centroids(near, "nearest", vector).withColumnsRenamed({"nearest": "cluster"})


def seeded_starts(vectors: DataFrame, k: int, seeds: list[int], vector: str = "embedding") -> np.ndarray:
    """k different vectors for each seed, those of least hash with it: the same however rows are partitioned. Fewer where there are fewer."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    drawn = rows.withColumn("at", F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.md5(F.concat_ws(",", F.lit(str(s)), F.col("v").cast("array<string>")).cast("binary")).alias("hash")) for s in seeds))))
    once = drawn.groupBy("at.seed", "at.hash").agg(F.first("v").alias("v"))
    found = once.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("hash"))).where(F.col("_n") <= k)  # tasks cut their own first
    by: dict[int, list] = {s: [] for s in seeds}
    for r in found.orderBy("seed", "hash").collect():  # k for each seed
        by[r["seed"]].append(r["v"])
    return np.array([by[s] for s in seeds], float)


def lloyd_fits(vectors: DataFrame, starts: np.ndarray, *, rounds: int = 20, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Centroids and costs (sums of squared distances to them) of k-means from several starts, all in one pass over the vectors a round.

    A start whose centroids stay is settled and takes part no more. A vector goes to its nearest centroid, ties to the
    first; a centroid without vectors stays. Tasks add up their own vectors; what is shuffled and comes to the driver is a
    row for each start and centroid. Null vectors take no part.
    """
    spark, (n_starts, k, width) = vectors.sparkSession, starts.shape
    ship(spark)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    centroids, costs, open_ = starts.copy(), np.full(n_starts, np.inf), list(range(n_starts))
    schema = ", ".join(["start int", "cluster int", "n long", "cost double", *(f"x{j} double" for j in range(width))])
    for last in range(rounds + 1):
        shared = spark.sparkContext.broadcast((open_, centroids[open_]))  # starts x k x width numbers

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, table = shared.value
            n, cost, total = np.zeros((len(own), k)), np.zeros((len(own), k)), np.zeros((len(own), k, width))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for i, c in enumerate(table):
                    far = ((x[:, None, :] - c[None]) ** 2).sum(2) if x.size * k < 1 << 22 else (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
                    near = far.argmin(1)
                    n[i] += np.bincount(near, minlength=k)
                    cost[i] += np.bincount(near, np.maximum(far[np.arange(len(x)), near], 0), minlength=k)
                    np.add.at(total[i], near, x)
            at = np.argwhere(n > 0)
            columns = [pa.array(np.array(own)[at[:, 0]], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[n > 0].astype(np.int64)), pa.array(cost[n > 0]), *(pa.array(total[n > 0][:, j]) for j in range(width))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        sums = rows.mapInArrow(summed, schema).groupBy("start", "cluster").agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in schema.split(", ")[2:])).collect()
        costs[open_] = 0
        moved = centroids.copy()
        for r in sums:
            costs[r["start"]] += r["cost"]
            moved[r["start"], r["cluster"]] = np.array(r[4:]) / r["n"]
        still = [s for s in open_ if not np.array_equal(moved[s], centroids[s])]
        if last == rounds or not still:
            break  # costs are of the centroids as they are
        centroids[still], open_ = moved[still], still
    return centroids, costs


def fit_centroids(vectors: DataFrame, *, k: int | None = None, tries: int = 10, rounds: int = 20, vector: str = "embedding") -> list[list[float]]:
    """Centroids of the cheapest of several seeded k-means fits, which run together; ties to the first seed."""
    k = k or cluster_count(vectors.count())
    centroids, costs = lloyd_fits(vectors, seeded_starts(vectors, k, list(range(tries)), vector), rounds=rounds, vector=vector)
    return centroids[int(costs.argmin())].tolist()


def distance_norm(distances: DataFrame, share: float = 0.9, distance: str = "distance") -> DataFrame:
    """The linear quantile of the distances at a share within [0.75, 0.99]; 1 if it is next to nothing."""
    cut = quantiles(distances, distance, [], {"q": min(max(share, 0.75), 0.99)})
    return cut.select(F.when(F.col("q") < 1e-6, 1.0).otherwise(F.col("q")).alias("norm"))


def text_novelty(distances: DataFrame, norm: DataFrame, *, text: str = "text_id", distance: str = "distance") -> DataFrame:
    """Distance statistics of each text's sentences, and its novelty."""
    per = distances.groupBy(text).agg(F.avg(distance).alias("mean"), F.stddev_pop(distance).alias("std"), F.min(distance).alias("min"), F.max(distance).alias("max"))
    joined = per.crossJoin(F.broadcast(norm.limit(1)))  # one row
    x = F.col("mean") / F.col("norm")
    return joined.select(text, "mean", "std", "min", "max", novelty(x).alias("novelty"), novelty_tier(x).alias("tier"))


def encoded(sentences: DataFrame, encoder: Callable[[list[str]], list[list[float]]], column: str = "sentence") -> DataFrame:
    """sentences with the vectors of an injected encoder, in Arrow batches."""
    ship(sentences.sparkSession)
    run = F.pandas_udf(lambda s: pd.Series([[float(x) for x in v] for v in encoder(s.tolist())]), "array<float>")
    return sentences.withColumn("embedding", run(column))


def evaluated(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], centroids: list[list[float]], norm: float, *, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """Distance statistics, novelty and tier of a batch of texts by their sentences; a text without sentences has no row."""
    parts = texts.select(F.col(id_col).alias("text_id"), F.explode(sentences(text_col)).alias("sentence"))
    near = nearest_centroid(encoded(parts, encoder), centroids)
    return text_novelty(near, texts.sparkSession.range(1).select(F.lit(float(norm)).alias("norm")))


def evaluated_file(lines: DataFrame, encoder: Callable[[list[str]], list[list[float]]], centroids: list[list[float]], norm: float, most_lines: int | None = None) -> DataFrame:
    """The same of the reasoning in a file's JSON lines (a row of sources.lines each), text_id the line's number.

    most_lines caps raw lines, blank and unreadable ones included; the reasoning is the field of that name, else what
    stands behind its tag in the output field.
    """
    read = lines.where(F.col("_line") <= most_lines) if most_lines else lines
    record = F.from_json("value", "reasoning string, output string")
    said = F.coalesce(F.nullif(stripped(record["reasoning"]), F.lit("")), F.nullif(reasoning_slice(record["output"], F.lit("")), F.lit("")))
    rows = read.select(F.col("_line").alias("text_id"), said.alias("text")).where("text IS NOT NULL")
    return evaluated(rows, encoder, centroids, norm)
