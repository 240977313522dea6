"""Exact removal of repeated byte strings, judged on suffix arrays of shards built by induced sorting.

A byte goes if it is covered by a LENGTH-byte string (a window) that also starts earlier: in a smaller document, or
in the same one before. Only windows that may repeat get into a suffix array:

1. Each window picks an anchor, the GRAM bytes inside it with the smallest hash; equal windows pick equal anchors, so
   windows of different anchors need no comparison. Consecutive windows with the same anchor are a block.
2. Blocks meet by anchor. Of blocks with equal bytes, by a cryptographic digest of 128 bits, the first stays (a task
   drops its own repeats before the shuffle); an anchor left with one block is settled. Blocks of anchors that a bounded
   sample shows to be common meet by their digests instead, and the first ones stay open, so that no anchor's blocks
   meet in one task for being many.
3. The other blocks' bytes, cut in two on either side of the anchor, meet by the bytes all their windows share
   (the core). Cores with several different segments form shards. A shard's suffixes are sorted by induced sorting;
   neighbours in the suffix array whose permuted common prefix reaches LENGTH hold equal windows, and of equal windows
   the first stays. Segments of common anchors are halved as often as HALVED says before they meet; and a core with more than MOST_SEGMENTS segments isn't sorted in one task: its windows are halved by
   how far before the core they start, which lengthens the cores, and meet again; at one window a core is the window.

Places are (document, start), and their order is total: a document is its id and 120 bits of its text's MD5 (tag, tag2),
so that rows of one id, or of none, with different texts are documents of their own, in the order of these bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, buffers, fresh, materialize, runs_of_rows

LENGTH = 100
GRAM = 24
#: Bytes anchored at a time; positions take its bits in the keys of the sliding minimum.
STEP_BITS = 20
#: Blocks a task holds to drop its own repeats, and segments of a core and bytes of a shard sorted at once.
MOST_BLOCKS, MOST_SEGMENTS, SHARD_BYTES = 1 << 20, 4096, 1 << 20
NO_ID = -(1 << 63)
_DOCUMENT = ["did", "tag", "tag2"]
#: Documents of the sample that shows which anchors are common, the share of it that makes one common, and how often its
#: segments are halved at once. They decide where blocks meet, never what is found.
HOT_SAMPLE, HOT_SHARE, HALVED = 20_000, 0.005, 3
#: Marks a block of a common anchor, on the anchor's offset.
_HOT = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK_SCHEMA = "core long, seg long, seg2 long, did long, tag long, tag2 long, q int, n int, a int"
_PLACE_SCHEMA = "kind int, did long, tag long, tag2 long, q int, n int, a int"
_SEGMENT_SCHEMA = "key long, did long, tag long, tag2 long, q int, seg binary, c int, d int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, up to the nth."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    if not _POWERS or len(_POWERS[0][0]) < len(data) + 1:
        _POWERS[:] = [_powers(max(len(data), 1 << STEP_BITS))]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _POWERS[0][0][: len(data)])])


def _hash_of(upto: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, the same wherever they stand."""
    return _mixed((upto[end] - upto[start]) * _POWERS[0][1][start] + (end - start).astype(np.uint64))


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Blocks of the documents in data: document, first window's start, windows, anchor's offset in it, hash of the anchor, digest of the bytes in two."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return (none,) * 7
    upto = _prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = _hash_of(upto, at, at + gram)
    key = (grams >> np.uint64(STEP_BITS) << np.uint64(STEP_BITS)) | at.astype(np.uint64)
    width, low, span = length - gram + 1, key, 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & np.uint64((1 << STEP_BITS) - 1)).astype(np.int64)  # of the window that starts at each place
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(begins)
    if not len(start):
        return (none,) * 7
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~begins[1:], False)) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    a = anchor[start]
    whole, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    digests = b"".join([digest(whole[b:e], digest_size=16).digest() for b, e in zip(start.tolist(), (stop + length - 1).tolist(), strict=True)])
    seg, seg2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    return doc, start - offsets[doc], stop - start, a - start, grams[a].view(np.int64), seg, seg2


def _steps(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows a to b with the bytes from lo to hi of them: whole rows, or an overlapping part of a long one."""
    most = 1 << STEP_BITS
    for a, b in runs_of_rows(offsets, most):
        size = int(offsets[b] - offsets[a])
        for lo in range(0, max(size - length + 1, 1), most - length + 1) if size > most else (0,):
            yield a, b, lo, min(lo + most, size)


def _merged(did: np.ndarray, tag: np.ndarray, tag2: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows, with neighbouring runs of a document joined."""
    order = np.lexsort((q, tag2, tag, did))
    did, tag, tag2, q, n = did[order], tag[order], tag2[order], q[order], n[order]
    new = np.ones(len(q), bool)
    new[1:] = (did[1:] != did[:-1]) | (tag[1:] != tag[:-1]) | (tag2[1:] != tag2[:-1]) | (q[1:] != q[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return did[at], tag[at], tag2[at], q[at], np.add.reduceat(n, at) if len(at) else n


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds[k]) if k in kinds else c) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _after(place: tuple[np.ndarray, ...], first: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which places (did, tag, tag2, q) differ from the first ones of their windows, which none comes before."""
    return np.logical_or.reduce([a != b for a, b in zip(place, first, strict=True)])


#: Rows of a batch of blocks: what a task holds goes out in parts, so that it isn't copied whole on its way.
_OUT = 1 << 15


def _settle_own(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """A task's blocks, used up: the first of equal ones as they are; the rest, as runs of windows that go, under n below 0."""
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    rows.clear()
    did, tag, tag2, q, n, a, core, seg, seg2 = columns
    order = np.lexsort((q, tag2, tag, did, seg2, seg, core))
    for k, c in enumerate(columns):
        columns[k] = c[order]
    del order
    did, tag, tag2, q, n, a, core, seg, seg2 = columns
    columns.clear()
    new = np.ones(len(q), bool)
    new[1:] = (core[1:] != core[:-1]) | (seg[1:] != seg[:-1]) | (seg2[1:] != seg2[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    gone = _after((did, tag, tag2, q), (did[first], tag[first], tag2[first], q[first]))
    rd, rt, rt2, rq, rn = _merged(did[gone], tag[gone], tag2[gone], q[gone], n[gone])
    spread = _mixed((rd * 31 + rq).astype(np.int64).view(np.uint64)).view(np.int64)
    keep = ~gone
    for at in range(0, len(q), _OUT):
        k = np.flatnonzero(keep[at : at + _OUT]) + at
        if len(k):
            yield _batch(_BLOCK_SCHEMA, core[k], seg[k], seg2[k], did[k], tag[k], tag2[k], q[k], n[k], a[k])
    for at in range(0, len(rd), _OUT):
        part = slice(at, at + _OUT)
        yield _batch(_BLOCK_SCHEMA, spread[part], spread[part], spread[part], rd[part], rt[part], rt2[part], rq[part], -rn[part], np.zeros(len(rd[part]), np.int64))


def _block_rows(length: int, gram: int, common: np.ndarray):
    """common: sorted hashes of the common anchors."""

    def dealt(core: np.ndarray, seg: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where blocks meet, and the anchor's offset with its mark: blocks of common anchors by their digests."""
        if not len(common):
            return core, a
        hot = common[np.minimum(np.searchsorted(common, core), len(common) - 1)] == core
        return np.where(hot, seg, core), np.where(hot, a + _HOT, a)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, tags, tags2 = (batch.column(c).to_numpy() for c in ("did", "tag", "tag2"))
            for a, b, lo, hi in _steps(offsets, length):
                own = offsets[a : b + 1] - offsets[a]
                own = np.array([0, hi - lo]) if hi - lo < own[-1] else own
                doc, q, n, at, core, seg, seg2 = blocks(data[offsets[a] + lo : offsets[a] + hi], own, length, gram)
                core, at = dealt(core, seg, at)
                held.append((ids[a + doc], tags[a + doc], tags2[a + doc], q + lo, n, at, core, seg, seg2))
                count += len(q)
                if count > MOST_BLOCKS:
                    yield from _settle_own(held)
                    held, count = [], 0
        if count:
            yield from _settle_own(held)

    return make


def _anchors(length: int, gram: int):
    """The anchors' hashes of a document's blocks, each once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b, lo, hi in _steps(offsets, length):
                own = offsets[a : b + 1] - offsets[a]
                own = np.array([0, hi - lo]) if hi - lo < own[-1] else own
                doc, _, _, _, core, _, _ = blocks(data[offsets[a] + lo : offsets[a] + hi], own, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.stack([doc, core]), axis=1)[1])], ["core"])

    return make


def _settle_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by anchor, bytes and place: kind 0 for runs of windows that go, kind 1 for first blocks of anchors with several."""
    core0 = seg0 = place0 = pending = None
    for batch in batches:
        core, seg, seg2, did, tag, tag2, q, n, a = (batch.column(k).to_numpy() for k in range(9))
        if not len(core):
            continue
        ready = n < 0
        new_core, new_seg = np.ones(len(q), bool), np.ones(len(q), bool)
        new_core[1:] = core[1:] != core[:-1]
        new_seg[1:] = new_core[1:] | (seg[1:] != seg[:-1]) | (seg2[1:] != seg2[:-1])
        if core0 is not None:
            new_core[0] = core[0] != core0
            new_seg[0] = new_core[0] or (seg[0], seg2[0]) != seg0
        at = np.maximum.accumulate(np.where(new_seg, np.arange(len(q)), -1))
        place = (did, tag, tag2, q)
        first = tuple(np.where(at >= 0, c[at], c0) for c, c0 in zip(place, place0 or (0,) * 4, strict=True))
        gone = ready | ~new_seg & _after(place, first)
        firsts = np.flatnonzero(new_seg)
        several = ~new_core[firsts]
        if len(firsts):
            if pending is not None and several[0]:
                yield _batch(_PLACE_SCHEMA, np.ones(1), *pending)
            hot = a[firsts] >= _HOT
            open_ = several | hot
            open_[:-1] |= several[1:]
            k = firsts[open_ & ~ready[firsts]]
            yield _batch(_PLACE_SCHEMA, np.ones(len(k)), did[k], tag[k], tag2[k], q[k], n[k], a[k])
            last = firsts[-1]
            pending = None if several[-1] or hot[-1] or ready[last] else tuple(c[last : last + 1] for c in (did, tag, tag2, q, n, a))
        merged = _merged(did[gone], tag[gone], tag2[gone], q[gone], np.abs(n[gone]))
        yield _batch(_PLACE_SCHEMA, np.zeros(len(merged[0])), *merged, np.zeros(len(merged[0])))
        core0, seg0, place0 = core[-1], (seg[-1], seg2[-1]), tuple(c[-1] for c in first)


def _key_of(core: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "did", "tag", "tag2", "q", "seg", "c", "d"])


def _segment(did: int, tag: int, tag2: int, q: int, seg: bytes, c: int, d: int, length: int) -> tuple:
    """A segment whose windows start up to d bytes before the core that they share, which starts at c."""
    return _key_of(seg[c : c + length - d]), did, tag, tag2, q, seg, c, d


def _halves(row: tuple, length: int) -> Iterator[tuple]:
    """The segment's windows in two: those that start in the far half before the core, and those in the near half."""
    _, did, tag, tag2, q, seg, c, d = row
    n, near = len(seg) - length + 1, d // 2
    far = min(max(c - near, 0), n)
    if far:
        yield _segment(did, tag, tag2, q, seg[: far - 1 + length], c - near - 1, d - near - 1, length)
    if n > far:
        yield _segment(did, tag, tag2, q + far, seg[far:], c - far, near, length)


def _segments(length: int, gram: int):
    """The bytes of open blocks, in two where their windows lie on both sides of the middle anchor offset."""
    middle = (length - gram) // 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for k, (did, tag, tag2, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("did", "tag", "tag2", "places")), strict=True)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                for p in places:
                    q, n, a, hot = p["q"], p["n"], p["a"] % _HOT, p["a"] >= _HOT
                    left = min(max(a - middle, 0), n)  # windows with more than `middle` bytes before the anchor
                    for first, m, c, d in ((q, left, a - middle - 1, length - middle - 1 - gram), (q + left, n - left, a - left, middle)):
                        if m:
                            own = [_segment(did, tag, tag2, first, text[first : first + m - 1 + length], c, d, length)]
                            for _ in range(HALVED if hot else 0):
                                own = [half for row in own for half in (_halves(row, length) if row[7] else (row,))]
                            rows += own
                            size += sum(len(row[5]) for row in own)
                if size > 4 << 20:
                    yield _segment_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _segment_batch(rows)

    return make


# --- suffix arrays ---------------------------------------------------------------------------------------------


def _by_bucket(into: list[list[np.ndarray]], places: np.ndarray, chars: np.ndarray) -> None:
    """Append places to their characters' buckets, in order."""
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    chars, places = chars[order], places[order]
    cut = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(places, cut), chars[np.concatenate([[0], cut])].tolist(), strict=True):
        into[c].append(part)


def _induced(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes that the given order of leftmost-smaller suffixes induces, one bucket of a first character at a time."""
    own: list[list[np.ndarray]] = [[] for _ in range(size)]
    _by_bucket(own, lms, s[lms])
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    empty = np.empty(0, np.int64)
    for c in range(size):
        scan, front = [], np.concatenate(large[c]) if large[c] else empty
        while len(front):
            scan.append(front)
            before = front[front > 0] - 1
            front = before[(s[before] == c) & ~is_s[before]]
        large[c] = scan
        scan = [*scan, *own[c]]
        if scan:
            before = np.concatenate(scan)
            before = before[before > 0] - 1
            chars = s[before]
            up = (chars > c) & ~is_s[before]
            _by_bucket(large, before[up], chars[up])
    for c in range(size - 1, -1, -1):
        scan, front = [], np.concatenate(small[c]) if small[c] else empty
        while len(front):
            scan.append(front)
            before = front[front > 0] - 1
            front = before[(s[before] == c) & is_s[before]]
        small[c] = scan
        scan = [*scan, *(part[::-1] for part in reversed(large[c]))]
        if scan:
            before = np.concatenate(scan)
            before = before[before > 0] - 1
            chars = s[before]
            down = (chars < c) & is_s[before]
            _by_bucket(small, before[down], chars[down])
    out = [part for c in range(size) for part in (*large[c], *(x[::-1] for x in reversed(small[c])))]
    return np.concatenate([np.array([len(s) - 1]), *out])


#: Characters up to which a bucket's places are induced together in numpy; the names of a recursion are more, and their
#: places are induced one by one.
_MOST_BUCKETS = 512


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the leftmost of each run of these, in order of place."""
    n = len(s)
    differs = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    next_change = differs[np.searchsorted(differs, np.arange(n))]
    is_s = np.ones(n, bool)
    is_s[:-1] = s[next_change[:-1]] < s[next_change[:-1] + 1]
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _induced_each(s: np.ndarray, is_s: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The order of all suffixes that an order of leftmost-smaller ones induces, place by place, as a function of that order."""
    n, counts = len(s), np.bincount(s)
    ends = np.cumsum(counts)
    firsts = (ends - counts).tolist()
    # Of each place the character before it, and whether that one's suffix is larger, or smaller, than the next; a free slot holds n.
    before, larger, smaller = np.append(np.roll(s, 1), 0).tolist(), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    larger[1:n], smaller[1:n] = ~is_s[:-1], is_s[:-1]
    larger, smaller = larger.tolist(), smaller.tolist()

    def induce(lms: np.ndarray) -> np.ndarray:
        # Each bucket's leftmost-smaller suffixes stand at its end, in their order.
        out, chars = np.full(n, n), s[lms]
        by_char = np.argsort(chars, kind="stable")
        own, at = chars[by_char], np.arange(len(lms))
        last = np.searchsorted(own, own, side="right")
        out[ends[own] - (last - at)] = lms[by_char]
        out, heads, tails = out.tolist(), firsts.copy(), ends.tolist()
        for p in out:  # filled ahead of the loop
            if larger[p]:
                c = before[p]
                out[heads[c]] = p - 1
                heads[c] += 1
        for p in reversed(out):
            if smaller[p]:
                c = before[p]
                tails[c] -= 1
                out[tails[c]] = p - 1
        out[0] = n - 1
        return np.array(out)

    return induce


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """A name for each leftmost-smaller substring (by rank of its place), equal ones alike, compared character by character.

    lms: their places in order; ranked: the same places sorted by substring.
    """
    n, at = len(s), np.empty(len(s), np.int64)
    at[lms] = np.arange(len(lms))
    size = np.append(lms[1:], n - 1) - lms
    a, b = ranked[:-1], ranked[1:]
    same = size[at[a]] == size[at[b]]
    live = np.flatnonzero(same)
    for k in range(int(size.max()) + 1 if len(size) else 0):
        live = live[k <= size[at[a[live]]]]
        if not len(live):
            break
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
    names = np.empty(len(lms), np.int64)
    names[at[ranked]] = np.concatenate([[0], np.cumsum(~same)])
    return names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of s, whose last character is its one 0 and smallest, by induced sorting.

    Leftmost-smaller substrings, sorted by induction from any order, get names; the string of names is sorted by
    recursion until all differ, and its order induces that of all suffixes.
    """
    n, size = len(s), int(s.max()) + 1
    if n < 3:
        return np.argsort(s, kind="stable")
    s = s.astype(np.int64)
    is_s, lms = _types(s)
    if size > _MOST_BUCKETS:
        induce = _induced_each(s, is_s)
    else:
        induce = lambda places: _induced_all(s, is_s, places, size)
    if len(lms) < 2:
        return induce(lms if len(lms) else np.array([n - 1]))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = induce(lms)
    names = _names(s, lms, order[is_lms[order]])
    if names.max() + 1 < len(lms):
        return induce(lms[suffix_array(names)])
    ranked = np.empty(len(lms), np.int64)
    ranked[names] = lms
    return induce(ranked)


def _induced_all(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Induction from leftmost-smaller suffixes of which one is the closing 0; its bucket holds nothing else."""
    order = _induced(s, is_s, lms, size)
    return order[1:] if order[1] == len(s) - 1 else order


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position of the text, the length of the prefix (up to `most`) that it shares with its neighbour before it in the suffix array.

    Lengths are in order of position (permuted), so texts are compared as they lie. They are found by halving steps, of
    which each compares its bytes 8 at a time for the positions that still agree: work in proportion to the text.
    """
    n, step = len(text), 8
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    room = np.minimum(n - np.arange(n), n - before)
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    while len(live):  # whole words first
        at = out[live]
        equal = words[live + at] == words[before[live] + at]
        live = live[equal & (at < most)]
        out[live] += step
    close = np.flatnonzero((before >= 0) & (out < most))
    apart = words[close + out[close]] ^ words[before[close] + out[close]]
    low = apart & (~apart + np.uint64(1))  # the lowest bit that differs
    same = np.where(apart == 0, 8, np.floor(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64) >> 3)
    out[close] += same
    return np.minimum(np.minimum(out, room), most) * (before >= 0)


def repeats_in_shard(segs: list[bytes], doc: tuple[np.ndarray, ...], q: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of each window of the segments that occurs in them at an earlier place; doc (did, tag, tag2) and q place the segments."""
    sizes = np.array([len(x) for x in segs])
    raw = np.frombuffer(b"".join(x + b"\0" for x in segs), np.uint8)
    s = raw.astype(np.int64) + 2
    seps = np.cumsum(sizes + 1) - 1
    s[seps] = 1
    order = suffix_array(np.append(s, 0))
    order = order[order < len(raw)]
    same = permuted_prefixes(raw, order, length) >= length
    seg = np.repeat(np.arange(len(segs)), sizes + 1)
    offset = np.arange(len(raw)) - np.repeat(seps - sizes, sizes + 1)
    whole = offset + length <= sizes[seg]
    in_order = order[whole[order]]
    new = np.ones(len(in_order), bool)
    # Windows within segments: neighbours among all suffixes with an equal window are windows themselves, or end in one segment.
    linked = same[order]
    group = np.cumsum(~linked)
    group = group[whole[order]]
    new[1:] = group[1:] != group[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ranks = np.empty(len(in_order), np.int64)
    _, nth = np.unique(np.stack(doc, axis=1), axis=0, return_inverse=True)  # documents, in order
    wd, wq = nth.ravel()[seg[in_order]], q[seg[in_order]] + offset[in_order]
    place = np.lexsort((wq, wd))
    step = np.concatenate([[0], np.cumsum((wd[place][1:] != wd[place][:-1]) | (wq[place][1:] != wq[place][:-1]))])
    ranks[place] = step
    least = np.repeat(np.minimum.reduceat(ranks, start), np.diff(np.append(start, len(in_order))))
    late = in_order[ranks > least]
    return seg[late], offset[late]


# --- shards ----------------------------------------------------------------------------------------------------


def _settle_segments(length: int):
    """Segments sorted by key, bytes and place: kind 0 for windows that go, kind 1 (with bytes) for halves of crowded cores."""
    schema = ["kind", "key", "did", "tag", "tag2", "q", "n", "seg", "c", "d"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema)

    def sorted_shard(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
        did, tag, tag2, q = (np.array([r[k] for r in shard], np.int64) for k in (1, 2, 3, 4))
        seg, offset = repeats_in_shard([r[5] for r in shard], (did, tag, tag2), q, length)
        merged = _merged(did[seg], tag[seg], tag2[seg], q[seg] + offset, np.ones(len(seg), np.int64))
        if len(merged[0]):
            yield batch([(0, 0, *place_and_n, None, 0, 0) for place_and_n in zip(*(c.tolist() for c in merged), strict=True)])

    def halves(row: tuple) -> Iterator[tuple]:
        for key, did, tag, tag2, q, seg, c, d in _halves(row, length):
            yield (1, key, did, tag, tag2, q, 0, seg, c, d)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []  # closed cores with several segments
        size, out = 0, []
        core: list[tuple] = []  # different segments of the open core, the first of each
        key = seg = place = None
        crowded = False
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if row[0] != key:
                    if len(core) > 1:
                        shard += core
                        size += sum(len(r[5]) for r in core)
                    core, key, seg, crowded = [], row[0], None, False
                    if size > SHARD_BYTES:
                        yield from sorted_shard(shard)
                        shard, size = [], 0
                if row[5] == seg:
                    if row[1:5] != place:
                        out.append((0, 0, *row[1:5], len(seg) - length + 1, None, 0, 0))
                else:
                    seg, place = row[5], row[1:5]
                    if crowded:
                        out += halves(row)
                    else:
                        core.append(row)
                        # A core of one window is that window: it has one segment.
                        if len(core) > MOST_SEGMENTS:
                            out += [half for r in core for half in halves(r)]
                            core, crowded = [], True
                if len(out) > 50_000:
                    yield batch(out)
                    out = []
        if len(core) > 1:
            shard += core
        if shard:
            yield from sorted_shard(shard)
        if out:
            yield batch(out)

    return settle


_SETTLED_SCHEMA = "kind int, key long, did long, tag long, tag2 long, q int, n int, seg binary, c int, d int"


def _kept(length: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            size, removed, spans, kept = [], [], [], []
            for k, places in enumerate(batch.column("places").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                runs: list[list[int]] = []
                for q, n in sorted((p["q"], p["n"]) for p in places or ()):
                    end = q + n - 1 + length
                    if runs and q <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([q, end])
                edges = [0, *(x for run in runs for x in run), len(text)]
                size.append(len(text))
                spans.append(len(runs))
                removed.append(sum(b - a for a, b in runs))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [pa.array(c, pa.int64()) for c in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return make


def _document(id_col: str, text_col: str, names: tuple[str, str, str] = ("did", "tag", "tag2")) -> list[Column]:
    """What a row is told apart by, and ordered: its id, null first, and twice 60 bits of its text's MD5."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bits = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    return [c.alias(name) for c, name in zip((F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), *bits), names, strict=True)]


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(own.alias("doc_id"), *_document(id_col, text_col), text.alias("text"))


def _common_anchors(docs: DataFrame, texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """Sorted hashes of the anchors that are in HOT_SHARE of a sample's documents or more: at most its blocks / (HOT_SHARE * HOT_SAMPLE)."""
    n = docs.count()
    share = min(HOT_SAMPLE / max(n, 1), 1.0)
    drawn = texts.where(F.pmod(F.xxhash64("did", "tag", F.lit("anchors")), F.lit(1 << 30)) < int(share * (1 << 30)))
    blocks_ = drawn.mapInArrow(_anchors(length, gram), "core long")
    often = blocks_.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") >= max(int(HOT_SHARE * min(n, HOT_SAMPLE)), 50))
    return np.sort(often.select("core").toArrow()["core"].to_numpy())


def repeated_places(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of windows that go: did, tag and tag2 (the document), q (first start), n (starts)."""
    bound_batches(docs.sparkSession)
    rows = _placed(docs, id_col, text_col)
    long_enough = rows.where(F.octet_length("text") >= length).select(*_DOCUMENT, "text")
    found = long_enough.mapInArrow(_block_rows(length, gram, _common_anchors(docs, long_enough, length, gram)), _BLOCK_SCHEMA)
    met = found.repartition("core").sortWithinPartitions("core", "seg", "seg2", *_DOCUMENT, "q")
    settled = materialize(met.mapInArrow(_settle_blocks, _PLACE_SCHEMA), "blocks")
    gone = settled.where("kind = 0").select(*_DOCUMENT, "q", "n")
    unsure = settled.where("kind = 1").groupBy(*_DOCUMENT).agg(F.collect_list(F.struct("q", "n", "a")).alias("places"))
    segments = long_enough.join(unsure, _DOCUMENT).mapInArrow(_segments(length, gram), _SEGMENT_SCHEMA)
    while True:
        by_core = segments.repartition("key").sortWithinPartitions("key", "seg", *_DOCUMENT, "q")
        judged = materialize(by_core.mapInArrow(_settle_segments(length), _SETTLED_SCHEMA), "segments")
        gone = gone.union(judged.where("kind = 0").select(*_DOCUMENT, "q", "n"))
        segments = judged.where("kind = 1").select("key", *_DOCUMENT, "q", "seg", "c", "d")
        if segments.isEmpty():
            return gone


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept, for every row.

    Null and empty texts, and texts shorter than `length`, lose nothing; rows that repeat an id and a text are one
    document, so neither removes the other; rows with one id and different texts are documents in the order of their
    texts' MD5, null ids before all others; an empty table gives no row. Other columns are not read.
    """
    gone = repeated_places(docs, length=length, gram=gram, id_col=id_col, text_col=text_col)
    by_doc = gone.groupBy(*_DOCUMENT).agg(F.collect_list(F.struct("q", "n")).alias("places"))
    rows = _placed(docs, id_col, text_col).join(by_doc, _DOCUMENT, "left").select("doc_id", "text", "places")
    return rows.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def keep_unrepeated(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs, columns as they are, with only the kept bytes in their texts; bytes of a cut character are left out.

    A null text stays null, empty and short ones lose nothing, and texts of any length are judged whole. Rows are told
    apart by id and whole text: those of one id, or of none, come in the order of their texts' MD5, null ids first;
    equal rows lose the same bytes; an empty table stays empty.
    """
    gone = repeated_places(docs, length=length, gram=gram, id_col=id_col, text_col=text_col)
    *document, places = (fresh(docs, c) for c in ("_did", "_tag", "_tag2", "_places"))
    by_doc = gone.groupBy(*_DOCUMENT).agg(F.collect_list(F.struct("q", "n")).alias(places)).withColumnsRenamed(dict(zip(_DOCUMENT, document, strict=True)))
    keyed = docs.select("*", *_document(id_col, text_col, tuple(document)))
    joined = keyed.join(by_doc, document, "left").select(*docs.columns, places)
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(at), []
            for t, places in zip(texts.to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if places:
                    raw, mask = t.encode(), np.ones(len(t.encode()), bool)
                    for p in places:
                        mask[p["q"] : p["q"] + p["n"] - 1 + length] = False
                    t = np.frombuffer(raw, np.uint8)[mask].tobytes().decode(errors="ignore")
                out.append(t)
            columns = [pa.array(out, texts.type) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(cut, docs.schema)
