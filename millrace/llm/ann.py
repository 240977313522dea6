"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are trained on a bounded sample; every vector is indexed with the error of its code. A query
goes to the lists of its nearest centroids; there, tables of squared distances from its residual to each subspace's
codewords give every member an asymmetric distance. Less the code's error that is a lower bound of the true distance,
so members are reranked exactly but for those that can't be among the k nearest. A first round visits the nearest
lists; the k-th distance found there bounds what the other lists rerank and return.

Of copies of one vector the first K + 1 ids are indexed, as others can't be in any answer (ties go to smaller ids).
Lists are cut by hash into parts of at most PART vectors, and a list's queries into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, materialize

K = 10
#: Vectors the centroids and codebooks are trained on at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
MOST_LISTS, CODES, SUBSPACE = 1024, 256, 4
#: Share of the sample's true neighbours that the lists visited must hold, and queries of the sample it is measured by.
TARGET, TRIALS = 0.97, 256
#: One in so many of the lists to visit is visited in the first round.
FIRST = 16
#: Vectors of a part of a list, queries of a block, and distances held at once.
PART, BLOCK, HELD = 16_384, 2048, 1 << 20


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    far = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    if n == 1:
        return far.argmin(1)[:, None]
    near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
    return np.take_along_axis(near, np.take_along_axis(far, near, 1).argsort(1, kind="stable"), 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty cluster keeps its centre."""
    x = np.ascontiguousarray(x, np.float32)
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[a : a + 4096], centres)[:, 0] for a in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centroids, and for each slice of dimensions the codewords of residuals."""

    centroids: np.ndarray
    slices: list[slice]
    codebooks: list[np.ndarray]
    probes: int

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x.astype(np.float32) - self.centroids[lists]
        return np.stack([_nearest(rest[:, s], book)[:, 0] for s, book in zip(self.slices, self.codebooks, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.codebooks)], 1)

    def distances(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to members of a list, [queries, members], by tables of residuals to codewords."""
        rest, far = q.astype(np.float32) - self.centroids[which], np.zeros((len(q), len(codes)), np.float32)
        for j, (s, book) in enumerate(zip(self.slices, self.codebooks, strict=True)):
            table = ((rest[:, None, s] - book[None]) ** 2).sum(2)
            far += table[:, codes[:, j]]
        return np.sqrt(far)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _sampled(vectors: DataFrame, rows: int) -> np.ndarray:
    h = F.xxhash64("vec_id", F.lit("fit"))
    bound = vectors.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if bound is None:
        return np.empty((0, 0), np.float32)
    table = vectors.where(h <= F.lit(bound)).select("vec_id", F.col("v").cast("array<float>").alias("v")).limit(2 * rows).toArrow().sort_by("vec_id")
    return np.ascontiguousarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1))


def probes_for(sample: np.ndarray, centroids: np.ndarray, own: np.ndarray, target: float) -> int:
    """How many lists a query must visit for the target share of its K nearest in the sample; more rows only bring neighbours nearer."""
    ask = sample[np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)].astype(np.float64)
    far = (sample.astype(np.float64) ** 2).sum(1)[None, :] - 2 * ask @ sample.astype(np.float64).T
    near = np.argsort(far, 1, kind="stable")[:, : K + 1]
    place = np.argsort(_nearest(ask.astype(np.float32), centroids, len(centroids)), 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(int(target * len(needed)), len(needed) - 1)]) + 1


def fit(vectors: DataFrame, *, fit_rows: int = FIT_ROWS, target: float = TARGET) -> Index | None:
    """Train on the sample; lists are twice the square root of the number of vectors, MOST_LISTS at most."""
    sample = _sampled(vectors, fit_rows)
    if not len(sample):
        return None
    lists = min(MOST_LISTS, max(int(2 * math.sqrt(vectors.count())), 1))
    centroids = kmeans(sample, lists)
    own = np.concatenate([_nearest(sample[a : a + 4096], centroids)[:, 0] for a in range(0, len(sample), 4096)])
    rest, d = sample - centroids[own], sample.shape[1]
    slices = [slice(a, min(a + SUBSPACE, d)) for a in range(0, d, SUBSPACE)]
    books = [kmeans(rest[:, s], CODES, seed=j) for j, s in enumerate(slices)]
    return Index(centroids, slices, books, probes_for(sample, centroids, own, target))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _best(index: Index, which: int, own: pa.Table, ask: pa.Table, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query_id, vec_id, score) of the k nearest ids of each query among the members of a list, within the query's bound."""
    ids, x, error = own["vec_id"].to_numpy(), _matrix(own["v"].combine_chunks()), own["error"].to_numpy()
    codes = np.frombuffer(b"".join(own["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
    queries, q, bound = ask["query_id"].to_numpy(), _matrix(ask["q"].combine_chunks()), ask["bound"].to_numpy()
    step = max(HELD // len(ids), 1)
    for a in range(0, len(queries), step):
        least = index.distances(q[a : a + step], which, codes) - error
        least[ids[None, :] == queries[a : a + step, None]] = np.inf
        for i, near in enumerate(least):
            limit, at = bound[a + i], np.flatnonzero(near <= bound[a + i])
            if len(at) > 4 * k:  # rerank the most promising first, for a tighter bound
                some = at[np.argpartition(near[at], k)[: 2 * k]]
                exact = np.sqrt(((x[some] - q[a + i]) ** 2).sum(1))
                distinct = np.unique(ids[some])
                if len(distinct) == len(some):
                    limit = min(limit, np.partition(exact, k - 1)[k - 1])
                at = at[near[at] <= limit]
            at = at[near[at] < np.inf]
            if len(at):
                exact = np.sqrt(((x[at] - q[a + i]) ** 2).sum(1))
                order = np.lexsort((ids[at], exact))
                order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]  # an id counts once
                order = order[exact[order] <= limit]
                yield np.full(len(order), queries[a + i]), ids[at][order], exact[order]


def search(embeddings: DataFrame, *, queries: Column | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other ids, by Euclidean distance.

    queries: which rows ask (default: ids divisible by 100). probes: lists to visit, None for as many as hold the
    target share of the sample's neighbours; the number of lists or more gives exact answers, as within the lists
    visited nothing is missed. Vectors that are null, zero, or hold null or non-finite components, rows without an
    id, and vectors of another than the most common length take no part. Rows with the query's id are never its
    neighbours. Equal rows count once; an id with several vectors asks with each and is as near as its nearest one.
    Ties go to smaller ids; equal vectors of other ids are neighbours at 0. A query with fewer than k candidates in
    the lists it visits also visits the rest. An empty table gives no row. Other columns are not read.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    rows = materialize(rows.where(F.size("v") == lengths["d"]).dropDuplicates(["vec_id", "v"]), "vectors")
    asks = rows.where(F.pmod("vec_id", F.lit(100)) == 0 if queries is None else queries)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = fit(rows, target=target)
    n_lists = len(index.centroids)
    visits = min(max(probes or index.probes, 1), n_lists)
    first_visits = -(-visits // FIRST)
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids and CODES codewords a slice at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                own = _nearest(x.astype(np.float32), shared.value.centroids)[:, 0]
                codes = shared.value.encode(x, own)
                # A little more than the code's error makes up for single precision.
                error = np.sqrt(((x - shared.value.decode(codes, own)) ** 2).sum(1)) + 1e-5 * (1 + np.sqrt((x**2).sum(1)))
                columns = [b.column("vec_id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "list", "codes", "error"])

    def visit(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = _nearest(_matrix(b.column("v")).astype(np.float32), shared.value.centroids, last)[:, first:]
                    which = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(which) for c in ("query_id", "v", "bound")), pa.array(near.ravel().astype(np.int32))], ["query_id", "q", "bound", "list"])

        return run

    members = materialize(rows.withColumn("rn", rank).where(F.col("rn") <= k + 1).select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, list int, codes binary, error double"), "index")

    def scan(key: tuple[pa.Scalar, ...], own: pa.Table, ask: pa.Table) -> pa.Table:
        found = list(_best(shared.value, key[0].as_py(), own, ask, k)) if len(own) and len(ask) else []
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    def searched(asked: DataFrame, first: int, last: int) -> DataFrame:
        probes = asked.mapInArrow(visit(first, last), "query_id long, q array<double>, bound double, list int")
        parts = members.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        blocks = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sizes = parts.join(blocks, "list")  # a row for each list at most
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = members.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("block", each("blocks"))
        dealt_asks = probes.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", each("parts"))
        keys = ["list", "part", "block"]
        return dealt.select(*keys, "vec_id", "v", "codes", "error").groupBy(*keys).cogroup(dealt_asks.select(*keys, "query_id", "q", "bound").groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")

    # An id is found once in each list that holds a vector of it; the k-th of a query's ids bounds the lists that follow.
    kth = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.count("*").alias("n"), F.expr(f"try_element_at(array_sort(collect_list(score)), {k})").alias("bound"))
    questions = asks.select(F.col("vec_id").alias("query_id"), "v")
    found = materialize(searched(questions.withColumn("bound", F.lit(float("inf"))), 0, first_visits), "found")
    if visits > first_visits:
        bounded = questions.join(kth(found), "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        found = materialize(found.union(searched(bounded, first_visits, visits)), "found")
    if visits < n_lists:
        short = questions.join(kth(found).where(F.col("n") >= k), "query_id", "left_anti").withColumn("bound", F.lit(float("inf")))
        if not short.isEmpty():
            found = found.union(searched(short, visits, n_lists))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    nearest = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
