"""Periodic runs of words: maximal stretches that repeat with a smallest period at least four times.

A run of period q and at least 4 q words holds 3 q places in a row whose word comes again q places later, so a multiple
of 3 q is among them. The pairs (q, multiple of 3 q) over all periods of a text are a harmonic grid of about n ln(n) / 3
points. Points whose words q apart differ extend nowhere; for all others at once, binary searches over prefix hashes find
how far the stretch reaches to either side. Of stretches found under several periods the smallest one is the run's: the
others are its multiples (Fine and Wilf). Hashes never hide a match, so a stretch is too long at worst; the words
of each are compared, and one that fails is walked word by word. All of it is numpy over the texts of an Arrow batch,
a bounded number of grid points at a time, and no row leaves its task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm._common import bound_batches, id_and_text

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Prefix hashes are modulo this prime, so that products of two fit 64 bits.
PRIME = (1 << 31) - 1
BASE = 1_664_525
#: Grid points at a time; one period of a long text may have more.
POINTS = 1 << 19
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _powers(n: int) -> np.ndarray:
    """BASE ** 0 to BASE ** n, modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        step = np.uint64(pow(BASE, len(out), PRIME))
        out = np.concatenate([out, out * step % PRIME])
    return out[: n + 1]


class Words:
    """Ids of the words of several texts, end to end, with their prefix hashes."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.offsets = ids, offsets
        self.power = _powers(len(ids))
        drawn = np.random.default_rng(7).integers(1, PRIME, int(ids.max()) + 1 if len(ids) else 0, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(drawn[ids] * self.power[: len(ids)] % PRIME) % PRIME]) if len(ids) else np.zeros(1, np.uint64)

    def alike(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of the n words from `at` and of those q places later are equal."""
        side = lambda a: self.sums[a + n] + PRIME - self.sums[a]
        return side(at) % PRIME * self.power[q] % PRIME == side(at + q) % PRIME

    def reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest common extension of places `at` and `at + q`, at most `most` words: from them on, or of the words before."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.alike(at[open_] - mid if back else at[open_], q[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
        return low


def _grid(offsets: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """text, period and place of the grid points, at most POINTS or those of one period at a time."""
    sizes = np.diff(offsets)
    periods = np.where(sizes >= least, sizes // times, 0)
    first = np.concatenate([[0], np.cumsum(periods)])
    for lo in range(0, int(first[-1]), POINTS):
        k = np.arange(lo, min(lo + POINTS, int(first[-1])))
        text = np.searchsorted(first, k, side="right") - 1
        q = k - first[text] + 1
        count = -((q - sizes[text]) // ((times - 1) * q))  # places 0, 3 q, ... below size - q
        ends = np.cumsum(count)
        at = 0
        while at < len(k):
            end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, side="right")), at + 1)
            n = count[at:end]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            own, period = np.repeat(text[at:end], n), np.repeat(q[at:end], n)
            yield own, period, offsets[own] + (times - 1) * period * nth
            at = end


def _smallest(text: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each stretch once, under its smallest period, in order of text, start and period."""
    order = np.lexsort((q, end, start, text))
    text, start, end, q = text[order], start[order], end[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, q = text[new], start[new], end[new], q[new]
    order = np.lexsort((q, start, text))
    return text[order], start[order], end[order], q[order]


def _walked(ids: np.ndarray, lo: int, hi: int, at: int, q: int) -> tuple[int, int]:
    """The stretch of period q around places `at` and `at + q`, by comparing words."""
    differ = np.flatnonzero(ids[lo : hi - q] != ids[lo + q : hi]) + lo
    k = int(np.searchsorted(differ, at))
    start = int(differ[k - 1]) + 1 if k else lo
    return start, int(differ[k]) + q if k < len(differ) else hi


def find_runs(ids: np.ndarray, offsets: np.ndarray, *, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """text, start (place in ids), end and period of every run of several texts' word ids, in order of text, start and period."""
    words = Words(ids, offsets)
    found = [np.empty((5, 0), np.int64)]
    for text, q, at in _grid(offsets, least, times):
        same = ids[at] == ids[at + q]
        text, q, at = text[same], q[same], at[same]
        end = at + q + words.reach(at, q, offsets[text + 1] - at - q, False)
        start = at - words.reach(at, q, at - offsets[text], True)
        long = end - start >= np.maximum(least, times * q)
        found.append(np.stack([text, start, end, q, at])[:, long])
    text, start, end, q, at = np.concatenate(found, axis=1)
    if not len(q):
        return text, start, end, q
    order = np.lexsort((q, end, start, text))  # the smallest period of each stretch, with a grid point of it
    text, start, end, q, at = (c[order] for c in (text, start, end, q, at))
    new = np.ones(len(q), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    settled = []
    for t, s, e, p, g in zip(*(c[new].tolist() for c in (text, start, end, q, at)), strict=True):
        settled.append((t, s, e, p))
        if not np.array_equal(ids[s : e - p], ids[s + p : e]):
            # A hash was equal by chance: all periods of the stretch are walked.
            settled.pop()
            for other, near in zip(*(c[(text == t) & (start == s) & (end == e)].tolist() for c in (q, at)), strict=True):
                a, b = _walked(ids, int(offsets[t]), int(offsets[t + 1]), near, other)
                if b - a >= max(least, times * other):
                    settled.append((t, a, b, other))
    return _smallest(*np.array(settled, np.int64).reshape(-1, 4).T)


def _splits(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch, the word ids of all its texts, and where each text begins."""
    parts = pc.ascii_split_whitespace(column)
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(parts.flatten())
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[ids] if len(ids) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return coded.dictionary, ids[real], before[np.concatenate([[0], np.cumsum(lengths)])]


def _repeated(ids: np.ndarray, offsets: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """Ids in which one in ten texts goes on with its own words again and again, as the text's number draws."""
    out = ids.copy()
    for k, doc_id in enumerate(doc_ids):
        n = int(offsets[k + 1] - offsets[k])
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[offsets[k] + a : offsets[k + 1]] = ids[offsets[k] + a + np.arange(n - a) % p]
    return out


def periodic_runs(docs: DataFrame, *, planted: bool = False, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and the collapsed text, for every row.

    runs: start (word number), length and period of every maximal run of at least `least` words and `times` periods, by
    start, then period. collapsed: the words that no run holds after its first period, joined by one space. With
    `planted`, one text in ten repeats its own words first, as the contract of the query says; a null id plants nothing.
    Null and empty texts, and those of white space, have no words and no runs; texts of any length are searched whole;
    repeated rows and ids are judged each by itself; an empty table gives no row. Other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dictionary, ids, offsets = _splits(batch.column("text").cast(pa.large_string()))
            if planted:
                ids = _repeated(ids, offsets, batch.column("doc_id").to_pylist())
            text, start, end, q = find_runs(ids, offsets, least=least, times=times)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start + q, 1)
            np.add.at(edge, end, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept), dictionary.take(pa.array(ids[keep]))), pa.scalar(" ", pa.large_string()))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (start - offsets[text], end - start, q)], ["start", "length", "period"])
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(bounds), runs), collapsed.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(compute, SCHEMA)


def most_repeated(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) of the greatest exact length / period; ties to the smallest start, then period."""
    if not runs:
        return None
    of = np.array(runs, np.int64)
    ratio = of[:, 1] / of[:, 2]
    best = None
    for s, n, p in of[ratio >= ratio.max() * (1 - 1e-12)].tolist():  # whole numbers decide among those too near to tell
        if best is None or n * best[2] > best[1] * p or n * best[2] == best[1] * p and (s, p) < (best[0], best[2]):
            best = (s, n, p)
    return best


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of the contract, of the table of periodic_runs."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [[(r["start"], r["length"], r["period"]) for r in row] for row in batch.column("runs").to_pylist()]
            best = [most_repeated(row) for row in of]
            column = lambda pick: pa.array([None if b is None else pick(b) for b in best], pa.int64())
            lines = ["".join(f"{s},{n},{p}\n" for s, n, p in row) for row in of]
            sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(row) for row in of], pa.int64()), column(lambda b: b[0]), column(lambda b: b[1]), column(lambda b: b[2]),
                    column(lambda b: 1000 * b[1] // b[2]), sha(x.encode() for x in lines), sha(batch.column("collapsed").cast(pa.large_binary()).to_pylist()),
                ],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    return found.mapInArrow(compute, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
