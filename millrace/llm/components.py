"""Connected components of an edge table, by alternating stars on written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import fresh, materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half round (Kiveris et al., "Connected Components in MapReduce and Beyond").

    Large: each node links its larger neighbours to its smallest one; small: its smaller ones and itself. The smallest
    neighbour is a pre-aggregated minimum joined back, so a hub's neighbours never meet in one task as a group.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, with their count and a sum over them."""
    written = materialize(edges, "edges")
    return written, tuple(written.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of the edges (u, v) that isn't its component's smallest node.

    known: components (node, root) of some edges already, which these extend. Rounds end when a round changes nothing;
    edges then are stars around the smallest nodes. No edges: no rows.
    """
    if known is not None:
        edges = edges.select("u", "v").union(known.select("node", "root"))
    edges, mark = _marked(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        edges, now = _marked(_stars(_stars(edges, True), False))
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row, nulls told apart by place."""
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain, *(F.col(f"`{f.name}`").isNull() for f in docs.schema))


def keep_one(docs: DataFrame, placed: DataFrame, id_col: str) -> DataFrame:
    """One row of docs of each root of placed (id, row, root of every row; row is its row_key): least id, nulls last, then least row."""
    key, kept_id, kept_row, repeats = (fresh(docs, n) for n in ("_key", "_kept", "_row", "_repeats"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    counted = placed.groupBy("root", "id", "row").agg(F.count("*").alias("n"))
    first = counted.groupBy("root").agg(F.min(F.struct(order.alias("at"), "n")).alias("m")).select(F.col("m.at.id").alias(kept_id), F.col("m.at.row").alias(kept_row), (F.col("m.n") > 1).alias(repeats))
    keyed = docs.withColumn(key, row_key(docs))
    kept = keyed.join(first, (F.col(key) == F.col(kept_row)) & F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)))
    # Only rows that repeat are shuffled again; both parts read the join's one shuffle of the texts.
    once, again = kept.where(~F.col(repeats)), kept.where(F.col(repeats)).dropDuplicates([id_col, key])
    return once.select(*docs.columns).union(again.select(*docs.columns))
