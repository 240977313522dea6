"""MinHash near-dedup: documents whose sets of three-word shingles have a similarity of 0.85 or more.

1. A set's signature is CHUNKS chunks of LANES minima, BITS bits of each; sets that agree in s of their union differ in
   about (1 - s) of the lanes. Signatures in THRESHOLD lanes or fewer have a chunk in which they differ in at most ERRORS
   lanes (pigeonhole). So the index holds each chunk once for every choice of ERRORS lanes to leave out, and two
   signatures under the threshold always meet in a list. A pair of similarity 0.85 is above it once in 4.7 million times.
2. Stars: each member of a list meets two others of it, in later rounds some of the list's most frequent component if
   it is outside, and its nearest one of all its lists is verified. A large group of near copies so becomes few
   components without a square of its size.
3. What is left are pairs across components, in lists where several meet. They go on if their signatures are under the
   threshold, and their sizes and sketches (1024 bits, each the parity of the shingles hashed to it, which differ in no
   more bits than the sets in shingles) allow the similarity.

Every link is verified on whole sets, made again from the texts of candidates only. Equal sets are one node, told by 128
bits of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, id_and_text, materialize, release
from millrace.llm.components import connected_components
from millrace.llm.similar import SKETCH, shingles, sketch

SHINGLE = 3
#: Similarity in percent.
PERCENT = 85
CHUNKS, LANES, BITS, ERRORS = 10, 4, 14, 1
#: Lanes in which signatures may differ: one more, and every chunk may have more than ERRORS.
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
#: Rounds of stars after the first, members of a list's most frequent component that the others meet in each, and links for
#: each node that a round must find for another one to follow. They decide how many pairs are left, never what is found.
ROUNDS, HUBS, FEW = 3, 3, 0.01
#: Pairs of a list that are compared at a time.
PAIRS = 1 << 20
#: Members of a list that meet in one task; larger lists are dealt out in blocks.
BLOCK = 1024
#: Rows of 16 bytes up to which the rows whose texts are wanted are broadcast; beyond that they are joined.
MOST_BROADCAST = 1_000_000
#: A lane stands at each multiple of STEP, with a free bit above it; all bits of all lanes, and the free ones.
STEP = BITS + 1
_FULL = sum(((1 << BITS) - 1) << STEP * lane for lane in range(LANES))
_FREE = sum(1 << STEP * lane + BITS for lane in range(LANES))

_drawn = np.random.default_rng(85)
_FLIPS = _drawn.integers(0, 1 << 63, CHUNKS * LANES, dtype=np.uint64)[:, None]
_FACTORS = (_drawn.integers(0, 1 << 63, CHUNKS * LANES, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def signature(h: np.ndarray) -> np.ndarray:
    """CHUNKS words of LANES lanes: BITS bits of the least of the shingles in each of CHUNKS * LANES orders."""
    least = np.full(CHUNKS * LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, ((h[None, at : at + 4096] ^ _FLIPS) * _FACTORS).min(1))
    lanes = (least * _SPREAD >> np.uint64(64 - BITS)).astype(np.int64).reshape(CHUNKS, LANES)
    return (lanes << STEP * np.arange(LANES)).sum(1)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [shingles(t, SHINGLE) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _long_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *(v.view(np.int64) for v in values)])))


def _own(rows: DataFrame) -> DataFrame:
    """doc_id and row of every row, with its set's 128 bits (hi, lo), size, signature and sketch."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets_of(batch)
            names = np.frombuffer(b"".join(hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets), "<i8").reshape(-1, 2)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(h) for h in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, _long_lists([signature(h) for h in sets]), _long_lists([sketch(h) for h in sets])], ["doc_id", "row", "hi", "lo", "n", "sig", "sketch"])

    return materialize(rows.mapInArrow(compute, "doc_id long, row long, hi long, lo long, n long, sig array<long>, sketch array<long>"), "signatures")


def _lists(nodes: DataFrame) -> DataFrame:
    """no, key and id: a posting of every chunk of every node without each of its lanes; no tells chunk and lane."""
    rest = [_FULL & ~(((1 << BITS) - 1) << STEP * lane) for lane in range(LANES)]
    keys = [F.struct(F.lit(c * LANES + lane).alias("no"), F.col("sig")[c].bitwiseAND(F.lit(rest[lane])).alias("key")) for c in range(CHUNKS) for lane in range(LANES)]
    return nodes.select(F.explode(F.array(*keys)).alias("at"), "id").select("at.no", "at.key", "id")


def _total(a: str, b: str, count: Callable[[Column], Column]) -> Column:
    """The sum of a count over the words in which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _lanes_apart(a: str, b: str) -> Column:
    """Lanes in which two signatures differ: a sum reaches a lane's free bit if any bit of the lane does."""
    return _total(a, b, lambda x: F.bit_count((x + F.lit(_FULL)).bitwiseAND(F.lit(_FREE))))


def _bits_apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return _total(a, b, F.bit_count)


def _may_link(a: str, b: str) -> Column:
    """Whether sizes, signatures and sketches of rows with columns n, sig and sketch under two prefixes allow a link."""
    n, m, bits = F.col(f"{a}n"), F.col(f"{b}n"), _bits_apart(f"{a}sketch", f"{b}sketch")
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (_lanes_apart(f"{a}sig", f"{b}sig") <= THRESHOLD) & ((100 + PERCENT) * bits <= (100 - PERCENT) * (n + m))


def _prefixed(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(prefix + c) for c in columns))


def _nearest(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each node's pairs (u, v) that may link, the one whose sketches, then signatures, differ least for the sizes; ties to the smaller v."""
    told = pairs.join(_prefixed(nodes, "u_", "id", "n", "sig", "sketch"), F.col("u") == F.col("u_id")).join(_prefixed(nodes, "v_", "id", "n", "sig", "sketch"), F.col("v") == F.col("v_id"))
    apart = _bits_apart("u_sketch", "v_sketch") / (F.col("u_n") + F.col("v_n"))
    return told.where(_may_link("u_", "v_")).groupBy("u").agg(F.min(F.struct(apart.alias("bits"), _lanes_apart("u_sig", "v_sig").alias("lanes"), "v")).alias("m")).select("u", "m.v")


def _whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and set of the wanted nodes (row, id), made from the text of one row of each."""
    few = wanted.count() <= MOST_BROADCAST
    texts = rows.select("row", "text").join(F.broadcast(wanted) if few else wanted, "row").dropDuplicates(["row"]).select("id", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _long_lists(_sets_of(batch))], ["id", "shingles"])

    return materialize(texts.mapInArrow(compute, "id long, shingles array<long>"), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The written pairs (u, v) whose sets have PERCENT of their union in common; pairs are used up."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = materialize(nodes.select("row", "id").join(ends, "id", "left_semi"), "wanted")
    sets = _whole_sets(rows, wanted)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
    shared = F.size(F.array_intersect("u_set", "v_set"))
    links = pairs.join(side("u"), "u").join(side("v"), "v").where(100 * shared >= PERCENT * (F.size("u_set") + F.size("v_set") - shared))
    links = materialize(links.select("u", "v"), "links")
    release(pairs.sparkSession, sets, wanted, pairs)
    return links


def _placed(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df with the root of its id."""
    return df.join(roots.select(F.col("node").alias("of"), F.col("root").alias("found")), F.col("id") == F.col("of"), "left").select(*df.columns, F.coalesce("found", "id").alias("root"))


def _mixed(met: DataFrame, roots: DataFrame, draw: int) -> DataFrame:
    """no, key, id and root of the lists in which several components meet, with the most frequent one (main), some of its members (hubs), and the number of all members."""
    placed = materialize(_placed(met, roots), "placed")
    drawn = F.array(*(F.min_by("id", F.xxhash64("id", "no", F.lit(HUBS * draw + k))) for k in range(HUBS)))
    parts = placed.groupBy("no", "key", "root").agg(F.count("*").alias("members"), drawn.alias("hubs"))
    main = F.max_by(F.struct("root", "hubs"), F.struct("members", "root"))
    lists = parts.groupBy("no", "key").agg(main.alias("main"), F.sum("members").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    lists = lists.select("no", "key", F.col("main.root").alias("main"), F.array_distinct("main.hubs").alias("hubs"), "all")
    mixed = materialize(placed.join(lists, ["no", "key"]), "mixed")
    release(met.sparkSession, placed)
    return mixed


def _linkable(no: int, ids: np.ndarray, roots: np.ndarray, out: np.ndarray, part: np.ndarray, n: np.ndarray, sig: np.ndarray, sketches: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a list, by chunk and lane `no`, that may link: of its two parts, or of its one part (same).

    One of a pair is outside the list's most frequent component (out), and the list is the first in which the two meet.
    """
    a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(part == 0), np.flatnonzero(part == 1))
    found = []
    for k in range(0, len(a), max(PAIRS // max(len(b), 1), 1)):
        x, y = a[k : k + max(PAIRS // max(len(b), 1), 1)][:, None], b[None, :]
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        open_ = (roots[x] != roots[y]) & (out[x] | out[y]) & (100 * least >= PERCENT * most) & (ids[x] < ids[y] if same else True)
        i, j = np.nonzero(open_)
        i, j = x[i, 0], y[0, j]
        apart = np.bitwise_count((sig[i] ^ sig[j]) + _FULL & _FREE)
        near = apart.sum(1) <= THRESHOLD
        i, j, apart = i[near], j[near], apart[near]
        bits = np.bitwise_count(sketches[i] ^ sketches[j]).sum(1, dtype=np.int64)
        near = (100 + PERCENT) * bits <= (100 - PERCENT) * (n[i] + n[j])
        i, j, apart = i[near], j[near], apart[near]
        first = (apart <= ERRORS).argmax(1)
        lanes = (sig[i, first] ^ sig[j, first])[:, None] >> STEP * np.arange(LANES) & (1 << BITS) - 1
        here = first * LANES + (lanes != 0).argmax(1) == no  # the lane left out; the first one, if none differs
        found.append((ids[i[here]], ids[j[here]]))
    u, v = (np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
    return np.minimum(u, v), np.maximum(u, v)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by no, key and the two blocks; the last group of a batch waits for the next one."""
    held: pa.Table | None = None

    def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, low, high, no, ids, roots, out, part, n = (rows.column(c).to_numpy() for c in ("key", "low", "high", "no", "id", "root", "out", "part", "n"))
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        sig, sketches = flat("sig"), flat("sketch")
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (no[1:] != no[:-1])))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            s = slice(a, b)
            u, v = _linkable(int(no[a]), ids[s], roots[s], out[s], part[s], n[s], sig[s], sketches[s], bool(low[a] == high[a]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = [rows.column(c).to_numpy() for c in ("no", "key", "low", "high")]
        at = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in last])))
        held = rows.slice(at)
        if at:
            yield from groups(rows.slice(0, at))
    if held is not None:
        yield from groups(held)


def _across(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of different components that meet in a list and may link, each once; mixed is used up.

    A list of more than BLOCK members is dealt out in blocks, each pair of blocks to be compared by itself, so that no
    task holds the list.
    """
    block, blocks = F.pmod(F.xxhash64("id"), F.col("blocks")), F.ceil(F.col("all") / BLOCK)
    own = mixed.select("no", "key", "id", "root", (F.col("root") != F.col("main")).alias("out"), blocks.alias("blocks")).withColumn("block", block)
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("no", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("part"), "id", "root", "out")
    rows = dealt.join(_prefixed(nodes, "", "id", "n", "sig", "sketch"), "id")
    by_list = rows.repartition("no", "key", "low", "high").sortWithinPartitions("no", "key", "low", "high")
    pairs = materialize(by_list.mapInArrow(_meetings, "u long, v long"), "across")
    release(mixed.sparkSession, mixed)
    return pairs


def similar_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and root of the nodes (id, row, n, sig, sketch; one for each set) that links connect to a smaller one."""
    postings = _lists(nodes)
    several = postings.groupBy("no", "key").agg(F.count("*").alias("members"), F.min("id").alias("least"), F.max("id").alias("most")).where("members > 1")
    met = materialize(postings.join(several.select("no", "key", "least", "most"), ["no", "key"]), "met")
    stars = met.select(F.col("id").alias("u"), F.explode(F.array("least", "most")).alias("v")).where("u <> v").distinct()
    links = _verified(materialize(_nearest(stars, nodes), "stars"), rows, nodes)
    roots = connected_components(links)
    n_nodes, mixed = nodes.count(), _mixed(met.select("no", "key", "id"), roots, 0)
    release(rows.sparkSession, met)
    for draw in range(1, ROUNDS + 1):
        if links.count() <= FEW * n_nodes:
            break
        stars = mixed.where("root <> main").select(F.col("id").alias("u"), F.explode("hubs").alias("v")).distinct()
        links = _verified(materialize(_nearest(stars, nodes), "stars"), rows, nodes)
        roots = connected_components(links, roots)
        # Lists of one component stay so, and are left out.
        old, mixed = mixed, _mixed(mixed.select("no", "key", "id"), roots, draw)
        release(rows.sparkSession, old)
    pairs = _across(mixed, nodes)
    # Of each node the nearest one of another component first: what these links join need not be verified again.
    links = _verified(materialize(_nearest(pairs, nodes), "nearest"), rows, nodes)
    roots = connected_components(links, roots)
    ends = _placed(_placed(pairs.withColumnRenamed("u", "id"), roots).withColumnsRenamed({"id": "u", "root": "u_root", "v": "id"}), roots)
    left = materialize(ends.where("u_root <> root").select("u", F.col("id").alias("v")), "left")
    release(rows.sparkSession, pairs)
    return connected_components(_verified(left, rows, nodes), roots)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    component_id is the smallest doc_id reachable over links, a null one only where the component has no other; kept
    tells rows whose id that is. Null and empty texts, and those of white space, have no shingle and are linked with
    nothing: each is its own component. Texts of any length go whole; rows of equal sets are linked, repeated rows among
    them, and rows that repeat an id are judged by their own texts; an empty table gives no row. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    own = _own(rows)
    firsts = own.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    nodes = materialize(firsts.select(F.monotonically_increasing_id().alias("id"), "*"), "nodes")
    placed = _placed(nodes.select("id", "hi", "lo", "least"), similar_sets(rows, nodes.select("id", "row", "n", "sig", "sketch")))
    placed = materialize(placed, "classes")
    named = placed.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "of")
    classes = placed.join(named, F.col("root") == F.col("of")).select("hi", "lo", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = own.select("doc_id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL for the same rows; documents of no word are linked with nothing.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sets AS MATERIALIZED (
  SELECT list_sort(s) AS s, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY 1
), x AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.id AS u, b.id AS v, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM shared WHERE 100 * k >= 85 * (n + m - k)
), both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(id, other) AS (
  SELECT u, v FROM both_ways UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON r.other = b.u
), root AS (SELECT id, least(id, min(other)) AS root FROM reach GROUP BY id),
of_set AS (SELECT list_sort(s) AS s, doc_id FROM s)
SELECT o.doc_id, CAST(len(o.s) AS BIGINT) AS n_shingles, coalesce(r.root, t.id, o.doc_id) AS component_id, o.doc_id = coalesce(r.root, t.id, o.doc_id) AS kept
FROM of_set o LEFT JOIN sets t ON o.s = t.s LEFT JOIN root r ON r.id = t.id
"""
