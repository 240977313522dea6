"""SimHash fingerprints and their near duplicates, by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most DISTANCE = 2 bits agree in at least 6 of their 8 byte positions. The
index starts from lists of single positional bytes and splits each by further positions until those that its members
share reach that guaranteed minimum: a list stands for a choice of six positions and the bytes there, so what meets in
it has the tally, and what lacks the tally meets nowhere. Each list is verified bit by bit in its two other bytes.

The index holds each distinct fingerprint once, so copies of a text meet no one, and a list holds at most the 65,536
values of two bytes. It isn't paired out: two members are within two bits just if flipping at most one bit of each
makes them equal, so a list's links come from 17 flips of each member's two bytes, and what the list gives is a star
of each of its components. Work and links are in proportion to the index, however crowded a list is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, id_and_text, materialize
from millrace.llm.components import connected_components, keep_one, row_key

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: The two byte positions that each choice of six leaves out.
_OPEN = list(combinations(range(8), 2))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint fp as a signed long, for every row; null and empty texts have 0."""
    return _fingerprints(id_and_text(docs, id_col, text_col), shingle)


def _fingerprints(texts: DataFrame, shingle: int) -> DataFrame:
    """The columns of texts, all longs, with fp in place of text."""
    bound_batches(texts.sparkSession)
    others = [c for c in texts.columns if c != "text"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(fp)], [*others, "fp"])

    return texts.mapInArrow(compute, ", ".join(f"{c} long" for c in [*others, "fp"]))


def list_links(choice: np.ndarray, shared: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least member, member) of the components under two bits of each list; rows are sorted by choice, shared bytes and fp."""
    new = np.ones(len(fp), bool)
    new[1:] = (choice[1:] != choice[:-1]) | (shared[1:] != shared[:-1])
    which = np.cumsum(new) - 1
    met = np.flatnonzero(np.bincount(which)[which] > 1)
    which, low, high = which[met], 8 * np.array(_OPEN)[choice[met], 0], 8 * np.array(_OPEN)[choice[met], 1]
    x = fp[met].view(np.uint64)
    rest = (x >> low.astype(np.uint64) & np.uint64(255)) | (x >> high.astype(np.uint64) & np.uint64(255)) << np.uint64(8)
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(16, dtype=np.uint64)])
    near = ((which.astype(np.uint64)[:, None] << np.uint64(16)) | rest[:, None] ^ flips[None, :]).ravel()
    member = np.repeat(np.arange(len(met)), len(flips))
    order = np.argsort(near, kind="stable")
    near, member = near[order], member[order]
    starts = np.flatnonzero(np.append(True, near[1:] != near[:-1])) if len(near) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(near)))
    label = np.arange(len(met))  # members are in order of fp within a list
    while len(met):
        least = np.repeat(np.minimum.reduceat(label[member], starts), sizes)
        now = label.copy()
        np.minimum.at(now, member, least)
        now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    linked = np.flatnonzero(label != np.arange(len(met)))
    return fp[met[label[linked]]], fp[met[linked]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by choice, shared and fp; the last list of a batch waits for the next one."""
    held: list[np.ndarray] | None = None

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in list_links(*rows)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in range(3)]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        at = int(np.argmax(last))
        held = [c[at:] for c in rows]
        if at:
            yield links([c[:at] for c in rows])
    if held is not None:
        yield links(held)


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp that connect all within two bits, each list's components by their least members."""
    if distance != 2:
        raise ValueError("the index is laid out for two bits")
    masks = [sum(0 if k in open_ else 255 << 8 * k for k in range(8)) for open_ in _OPEN]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("shared")) for n, m in enumerate(signed)))
    postings = fps.select("fp", F.explode(lists).alias("at")).select("at.choice", "at.shared", "fp")
    return postings.repartition("choice", "shared").sortWithinPartitions("choice", "shared", "fp").mapInArrow(_linked, "u long, v long").distinct()


def _classes(own: DataFrame) -> DataFrame:
    """fp, the least doc_id of its rows, and the root of its component."""
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct.select("fp")))
    root = F.coalesce("root", "fp")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", root.alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row.

    component_id is the smallest doc_id reachable over links of at most two differing bits. Texts without words have
    fingerprint zero and are linked like any other; repeated rows are linked as equals; a null doc_id is linked but
    never names a component unless the component has no other id; texts of any length are hashed whole; an empty
    table gives no row. Other columns are not read.
    """
    own = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = _classes(own)
    linked = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    # A text with many copies, or a component of many texts, is a hot key of these joins only on their long sides, which
    # Spark splits, as the other side has one row for it.
    named = classes.select("fp", "root").join(linked, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, columns as they are: one of each component, as components.keep_one chooses it.

    Ids that repeat, or are null, in several components name a row of each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(docs).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = materialize(_fingerprints(texts, shingle), "fingerprints")
    placed = own.join(_classes(own).select("fp", "root"), "fp").select(F.col("doc_id").alias("id"), "row", "root")
    return keep_one(docs, placed, id_col)
