"""The corpus form of SimHash near-dedup: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. Fingerprints of the five-word shingles go through the byte-position index of `simhash`, whose links are candidates.
2. No Hamming radius holds a Jaccard similarity of 0.8: fingerprints of such pairs differ in a dozen bits and more,
   and eight spread bits already leave no byte position in common. The other candidates hence come from prefixes: in
   any order that all documents share, two sets that similar have a common shingle among the first n - ceil(0.8 n) + 1
   of each. The order puts shingles that a bounded sample shows to be common last and goes by hash else; it decides
   the length of posting lists, never what is found.
3. Stars: each member of a posting list meets one other member of it, in later rounds some of the list's most frequent
   component if it is outside, and goes on with its best candidate of all its lists. A large group of near copies so
   becomes few components without a square of its size.
4. What is left are pairs across components, in lists where several meet. A pair goes on only if its sketches allow
   it: 1024 bits, each the parity of the shingles hashed to it, differ in no more bits than the sets in shingles.

Candidates are verified on whole sets, so links are exact; 4 misses none that 1 to 3 leave, which only save work. Only
one document of each distinct set takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm._common import SMALL_BATCH_BYTES, bound_batches, handing_back, materialize, release
from millrace.llm.components import connected_components, keep_one, row_key

SHINGLE = 5
SEED = 42
#: Documents of the sample, and of them those in which a shingle is common.
SAMPLE, COMMON = 20_000, 8
#: Words of 64 bits of a sketch.
SKETCH = 16
#: Rounds of stars between components, and members of a list's most frequent component that the others meet in each.
ROUNDS, HUBS = 2, 4
#: Meetings across components, for a node, up to which they are left to the pairs without a round of stars.
FEW = 32
#: Bits of the broadcast filter of rows whose whole sets are needed, in words of 64.
WORDS = 1 << 18


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 hashes of the word shingles, sorted; a shorter text is one shingle, one without words none."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))) if len(words) > shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def digest(h: np.ndarray) -> int:
    """64 bits that name a set."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def prefix(h: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of which two sets with at least 4/5 of their union in common share one, and the last one's place in the order."""
    n = len(h)
    if not n:
        return h, 0
    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(n, bool)
    first = np.concatenate([h[~late], h[late]])[: n - (4 * n + 4) // 5 + 1]
    return first, (int(first[-1]) >> 2) | int(len(first) > n - late.sum()) << 62


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their lowest bits: sketches differ in no more bits than sets in shingles."""
    odd = np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def _fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of the distinct shingles."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles in at least COMMON documents of the sample, sorted."""
    share = min(SAMPLE / max(texts.count(), 1), 1.0)
    drawn = texts.where(F.pmod("text_hash", F.lit(1 << 30)) < int(share * (1 << 30)))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([_lists(sets).flatten()], ["shingle"])

    often = drawn.select("text").mapInArrow(handing_back(compute), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    return np.sort(often.select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def _own(texts: DataFrame) -> DataFrame:
    """id, row and text_hash of every row, with digest, size, prefix, fingerprint and sketch of its set."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts))  # at most the sample's shingles / COMMON

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            prefixes = [prefix(h, common.value) for h in sets]
            long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            columns = [batch.column(c) for c in ("id", "row", "text_hash")]
            columns += [long([digest(h) for h in sets]), pa.array([len(h) for h in sets], pa.int64())]
            columns += [pa.array([last for _, last in prefixes], pa.int64()), _lists([p for p, _ in prefixes])]
            columns += [long([_fingerprint(h) for h in sets]), _lists([sketch(h) for h in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "text_hash", "node", "n", "last", "prefix", "fp", "sketch"])

    schema = "id long, row long, text_hash long, node long, n long, last long, prefix array<long>, fp long, sketch array<long>"
    return materialize(texts.select("id", "row", "text_hash", "text").mapInArrow(handing_back(compute), schema), "prefixes")


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and set of the wanted rows, made again from the texts: sets of all documents are larger than the texts.

    A few other rows pass the filter too; that repeats or adds a node, which changes no result.
    """
    bit = F.pmod("row", F.lit(64 * WORDS))
    word, mask = F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = wanted.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))  # at most WORDS rows
    near = texts.select("text", word, mask.alias("own")).join(F.broadcast(words), "word").where(F.col("mask").bitwiseAND(F.col("own")) != 0)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([digest(h) for h in sets], np.uint64).view(np.int64)), _lists(sets)], ["node", "shingles"])

    return materialize(near.select("text").mapInArrow(handing_back(compute), "node long, shingles array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sets have at least 4/5 of their union in common."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    return both.where(5 * shared >= 4 * (F.size("u_set") + F.size("v_set") - shared)).select("u", "v")


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH)), F.lit(0))


def _sizes_allow(n: str, m: str) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _sketches_allow(a: str, b: str, n: str, m: str) -> Column:
    """Sets with at least 4/5 of their union in common differ in at most a ninth of their shingles together."""
    return 9 * _apart(a, b) <= F.col(n) + F.col(m)


def _bounded(met: DataFrame, last: DataFrame) -> DataFrame:
    """Pairs (u, v) that may be similar, of a row (u, v, n, m) for each shingle two prefixes share."""
    counted = met.groupBy("u", "v", "n", "m").agg(F.count("*").alias("shared"))
    side = lambda c: last.select(F.col("node").alias(c), F.col("last").alias(f"{c}_last"))
    left = lambda c: F.ceil(F.col(c) * 4 / 5) - 1  # noqa: E731, what is behind the prefix
    behind = F.when(F.col("u_last") < F.col("v_last"), left("n")).when(F.col("u_last") > F.col("v_last"), left("m")).otherwise(F.greatest(left("n"), left("m")))
    return counted.join(side("u"), "u").join(side("v"), "v").where(9 * (F.col("shared") + behind) >= 4 * (F.col("n") + F.col("m"))).select("u", "v")


def similar_components(texts: DataFrame, own: DataFrame) -> DataFrame:
    """node and root of the distinct sets that a similarity of 0.8 or more connects to a smaller one; own is used up."""
    spark = texts.sparkSession
    nodes = materialize(own.groupBy("node").agg(F.min(F.struct("row", "n", "last", "fp")).alias("m"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")).select("node", "m.*", "sketch", "prefix"), "nodes")
    dealt = nodes.select(F.explode("prefix").alias("shingle"), "node", "n").repartition("shingle")  # one shuffle for both sides
    several = dealt.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1").select("shingle")
    met = materialize(dealt.join(several, "shingle", "left_semi"), "met")
    whole, nodes = nodes, materialize(nodes.drop("prefix"), "nodes")
    release(spark, whole, own)
    sketches = nodes.select("node", "n", "sketch")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs, name)
        wanted = nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("row")
        sets = _sets(texts, wanted)
        links = materialize(_verified(pairs, sets).distinct(), "links")
        release(spark, sets, pairs)
        return links

    def best(pairs: DataFrame) -> DataFrame:
        """Of each node's pairs (u, v) that sketches allow, the one whose sketches differ least."""
        side = lambda c, n: sketches.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(f"{c}_sketch"))
        told = pairs.distinct().join(side("u", "n"), "u").join(side("v", "m"), "v")
        allowed = told.where(_sizes_allow("n", "m") & _sketches_allow("u_sketch", "v_sketch", "n", "m"))
        return allowed.groupBy("u").agg(F.min_by("v", F.struct(_apart("u_sketch", "v_sketch"), "v")).alias("v"))

    def drawn(round_: int) -> Column:
        return F.xxhash64("node", F.lit(round_))

    # Sets of one fingerprint meet its first one; fingerprints within two bits meet by their first sets.
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    names = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    near = simhash.near_links(firsts.select("fp")).join(names("u"), "u").join(names("v"), "v").select(F.col("v_first").alias("u"), F.col("u_first").alias("v"))
    hubs = met.groupBy("shingle").agg(F.min_by("node", drawn(0)).alias("v"))
    stars = met.join(hubs, "shingle").where("node <> v").select(F.col("node").alias("u"), "v")
    links = verified(best(same.union(near).union(stars)), "candidates")

    n_nodes, roots = nodes.count(), connected_components(links)
    for round_ in range(1, ROUNDS + 1):
        of = roots.withColumnRenamed("node", "of")
        placed = met.join(of, met["node"] == of["of"], "left").select("shingle", "node", "n", F.coalesce("root", "node").alias("root"))
        placed = placed.repartition("shingle")  # one shuffle for both sides
        parts = placed.groupBy("shingle", "root").agg(F.count("*").alias("members"), F.array(*(F.min_by("node", F.xxhash64("node", "shingle", F.lit(HUBS * round_ + k))) for k in range(HUBS))).alias("hubs"))
        main = parts.groupBy("shingle").agg(F.max_by(F.struct("root", "hubs"), F.struct("members", "root")).alias("main"), F.max("members").alias("most"), F.sum("members").alias("all"), F.count("*").alias("parts")).where("parts > 1")
        main = main.select("shingle", "main", (F.col("all") - F.col("most")).alias("outside"))
        mixed = materialize(placed.join(main, "shingle").select("outside", "shingle", "node", "n", "root", F.col("main.root").alias("main"), F.when(F.col("root") != F.col("main.root"), F.array_distinct("main.hubs")).alias("hubs")), "mixed")
        met = mixed.select("shingle", "node", "n")  # lists of one component stay so
        if (mixed.agg(F.sum("outside")).first()[0] or 0) <= FEW * n_nodes:
            break
        found = verified(best(mixed.where("root <> main").select(F.col("node").alias("u"), F.explode("hubs").alias("v"))), "stars")
        roots = connected_components(found, roots)

    # Of each list, the members outside its most frequent component meet all others, each pair once.
    of = roots.withColumnRenamed("node", "of")
    rooted = met.join(sketches.select("node", "sketch"), "node").join(of, F.col("node") == F.col("of"), "left").select("shingle", "node", "n", "sketch", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    main = rooted.groupBy("shingle", "root").agg(F.count("*").alias("members")).groupBy("shingle").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    left = rooted.join(main.select("shingle", "main"), "shingle")
    right = left.where("root <> main").select("shingle", F.col("node").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("other_sketch"), F.col("root").alias("other_root"))
    once = (F.col("root") == F.col("main")) | (F.col("node") < F.col("other"))
    across = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("root") != F.col("other_root")) & once & _sizes_allow("n", "m") & _sketches_allow("sketch", "other_sketch", "n", "m"))
    ordered = F.col("node") < F.col("other")
    pick = lambda a, b: F.when(ordered, F.col(a)).otherwise(F.col(b))
    pairs = across.select(pick("node", "other").alias("u"), pick("other", "node").alias("v"), pick("n", "m").alias("n"), pick("m", "n").alias("m"))
    return connected_components(verified(_bounded(pairs, nodes), "across"), roots)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are: one of each component over links of a similarity of 0.8 or more.

    It is the one with the smallest id; rows with null ids stand last, and rows with equal ids go by a hash of the
    whole row. Texts without words count as equal, null ones among them; texts of any length go whole; equal rows
    leave one; an empty table stays empty.
    """
    bound_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), row_key(docs).alias("row"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    own = _own(texts)
    rows = materialize(own.select("id", "row", "node"), "rows")
    roots = similar_components(texts, own).select(F.col("node").alias("of"), "root")
    placed = rows.join(roots, rows["node"] == roots["of"], "left").select("id", "row", F.coalesce("root", "node").alias("root"))
    return keep_one(docs, placed, id_col)
