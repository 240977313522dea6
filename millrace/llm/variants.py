"""Spelling variants: words one inserted, deleted or replaced letter apart, by a positional q-gram index with count filter.

1. The words of all texts with their counts; each task adds up its own before they are shuffled.
2. A word of L letters, padded on both sides, has L + q - 1 grams of q letters, each at a place. One edit spoils at most q
   of them, and moves no other by more than the difference in length. So words one edit apart share at least
   max(L) - 1 grams under these limits, and one of the q + 1 rarest of each. Those go into the index.
3. The postings of a gram and a length, those of the next length with them, are shuffled to one task and come sorted by
   place, merged from sorted runs by Spark. There each word meets the ones at its own place in its length, and at its own
   and the next place in the next length. All their grams are tallied; pairs that reach the bound are verified.
4. A pair counts in the first list that holds both words, in an order of grams that all tasks share, so no pair is
   shuffled: a task passes on, for each word, the number of its near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, materialize

#: Letters of words; only A-Z are lower-cased.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
#: Letters of a word and its occurrences, at least; a form has at least TIMES the occurrences of its word.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
Q = 5
#: What letters count as in a gram's number: 26 + 64 of them, and the two pads.
_ALPHABET = 92
#: Counters of grams, which share them by hash: 8 MB to broadcast.
COUNTERS = 1 << 20
#: Letters of pairs that are compared at a time.
STEP = 1 << 21
#: Words that a task adds up before it passes their counts on.
HELD = 200_000
#: Forms of forms end after so many doublings of a step, as each has TIMES the occurrences of the one before.
DOUBLINGS = 5


def misspelt(doc_id: int | None, word: str) -> str:
    """One word in 31 of a text without one of its letters, as the contract of the query says; a null id leaves all."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, *, change: Callable[[int | None, str], str] | None = None, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the words of all texts with that many letters and occurrences at least; change: applied to each word of a row."""
    bound_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own: Counter[str] = Counter()
                for word, n in Counter(LETTERS.findall(text)).items():
                    own[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                for word, n in own.items():
                    if len(word) >= least_letters and len(word := change(doc_id, word) if change else word) >= least_letters:
                        held[word] += n
            if len(held) > HELD:
                yield _counted(held)
                held = Counter()
        yield _counted(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(compute, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the padded words' grams, end to end, and where each word's begin."""
    points = np.frombuffer("".join("\x01" * (Q - 1) + w + "\x02" * (Q - 1) for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where(points < 3, points + 89, np.where(points < 128, points - 97, points - 0xC0 + 26))
    sizes = np.array([len(w) for w in words], np.int64) + Q - 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(begins[-1]) + np.repeat(np.arange(len(words)) * (Q - 1), sizes)
    gram = np.zeros(len(at), np.int64)
    for k in range(Q):
        gram = gram * _ALPHABET + code[at + k]
    return gram, begins


def _counter(gram: np.ndarray) -> np.ndarray:
    return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def _gram_counts(words: DataFrame) -> np.ndarray:
    """About how often each gram occurs in the vocabulary, by its counter."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_counter(_grams(batch.column("word").to_pylist())[0]), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    found = words.select("word").mapInArrow(compute, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def _rarest(words: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and place of the Q + 1 rarest grams of each word, a row for each; of equally rare ones the smaller number, then place, is first."""
    gram, begins = _grams(words)
    which = np.repeat(np.arange(len(words)), np.diff(begins))
    place = np.arange(len(gram)) - begins[which]
    order = np.lexsort((place, gram, often[_counter(gram)], which))
    order = order[np.arange(len(gram)) - begins[which] <= Q]
    return gram[order].reshape(-1, Q + 1), place[order].reshape(-1, Q + 1)


_POSTINGS = "gram long, low int, more int, place int, id long, n long, word string"


def _postings(words: DataFrame, often) -> DataFrame:
    """Each word's rarest grams: among those of its length (low, more 0) and of the length below (more 1)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            gram, place = _rarest(texts, often.value)
            letters = np.repeat([len(w) for w in texts], Q + 1).astype(np.int32)
            row = pa.array(np.repeat(np.arange(len(texts)), Q + 1))
            for more in (0, 1):
                columns = [pa.array(gram.ravel()), pa.array(letters - more, pa.int32()), pa.array(np.full(len(letters), more, np.int32)), pa.array(place.ravel().astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(row) for c in ("id", "n", "word"))], ["gram", "low", "more", "place", "id", "n", "word"])

    return words.mapInArrow(compute, _POSTINGS)


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, j) for each j from lo[k] up to hi[k], about `most` of them at a time, ranges cut where need be."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    for at in range(0, int(ends[-1]) if len(ends) else 0, most):
        nth = np.arange(at, min(at + most, int(ends[-1])))
        k = np.searchsorted(ends, nth, side="right")
        yield k, lo[k] + nth - (ends[k] - sizes[k])


def _whole_grams(same: np.ndarray) -> np.ndarray:
    """Where grams are alike, of where letters are: windows of Q letters, the pads alike."""
    edge = np.ones((len(same), Q - 1), bool)
    padded = np.concatenate([edge, same, edge], axis=1)
    out = padded[:, Q - 1 :].copy()
    for k in range(1, Q):
        out &= padded[:, Q - 1 - k : -k]
    return out


def _near(points: np.ndarray, begins: np.ndarray, a: np.ndarray, b: np.ndarray, letters: int, more: int) -> np.ndarray:
    """Which pairs of words a, of so many letters, and b, of `more` more, share enough grams at allowed places and are one edit apart."""
    at = np.arange(letters)
    left = points[begins[a][:, None] + at]
    same = left == points[begins[b][:, None] + at]
    if not more:
        enough = np.flatnonzero(_whole_grams(same).sum(1) >= letters - 1)
        return enough[letters - same[enough].sum(1) == 1]
    later = left == points[begins[b][:, None] + at + 1]
    enough = np.flatnonzero((_whole_grams(same) | _whole_grams(later)).sum(1) >= letters)
    begin = np.logical_and.accumulate(same[enough], axis=1).sum(1)
    end = np.logical_and.accumulate(later[enough, ::-1], axis=1).sum(1)
    return enough[begin + end >= letters]


def _first_meeting(grams: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, gram: np.ndarray, place: np.ndarray, more: int) -> np.ndarray:
    """Which pairs have no list in common before that of their rows a and b, whose gram and place are given."""
    off = places[b][:, None, :] - places[a][:, :, None]
    alike = ((grams[a][:, :, None] == grams[b][:, None, :]) & (off >= 0) & (off <= more)).reshape(len(a), (Q + 1) ** 2)
    first = alike.argmax(1)
    x, y = first // (Q + 1), first % (Q + 1)
    return (grams[a, x] == gram[a]) & (places[a, x] == place[a]) & (places[b, y] == place[b])


def _meet(often):
    """Near words of the postings of a task, which come sorted by gram, low, more and place: sums and best words for each id."""

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, low, more, place, ids, n = (rows.column(c).to_numpy() for c in ("gram", "low", "more", "place", "id", "n"))
        words = rows.column("word").to_pylist()
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        new = np.append(True, (gram[1:] != gram[:-1]) | (low[1:] != low[:-1]))
        key = (2 * np.cumsum(new) + more << 32) + place
        own = np.flatnonzero(more == 0)
        met: list[np.ndarray] = []
        for extra in (0, 1):
            k = key[own] + (extra << 32)
            lo, hi = (np.searchsorted(key, k), np.searchsorted(key, k + 1, side="right")) if extra else (own + 1, np.searchsorted(key, k, side="right"))
            for letters in np.unique(low[own[hi > lo]]).tolist():
                mine = np.flatnonzero((low[own] == letters) & (hi > lo))
                for i, j in _ranges(lo[mine], hi[mine], max(STEP // letters, 1)):
                    a, b = own[mine[i]], j
                    good = _near(points, begins, a, b, letters, extra)
                    if len(good):
                        met.append(np.stack([a[good], b[good], np.full(len(good), extra)]))
        if not met:
            return
        a, b, extra = np.concatenate(met, axis=1)
        rows_met, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        grams, places = _rarest([words[r] for r in rows_met.tolist()], often.value)
        x, y = at[: len(a)], at[len(a) :]
        keep = np.zeros(len(a), bool)
        for m in (0, 1):
            pick = np.flatnonzero(extra == m)
            for part in np.array_split(pick, len(pick) // 100_000 + 1):
                keep[part] = _first_meeting(grams, places, x[part], y[part], gram[rows_met], place[rows_met], m)
        u, v = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
        best: dict[int, tuple[int, str, int]] = {}
        count: Counter[int] = Counter()
        for of, near_n, near in zip(ids[u].tolist(), n[v].tolist(), v.tolist(), strict=True):
            count[of] += 1
            if of not in best or (-near_n, words[near]) < best[of][:2]:
                best[of] = (-near_n, words[near], int(ids[near]))
        order = list(best)
        columns = [pa.array(order, pa.int64()), pa.array([count[o] for o in order], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([best[o][k] for o in order], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64())))], ["of", "near", "order", "form", "form_id"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            gram, low = (rows.column(c).to_numpy() for c in ("gram", "low"))
            at = int(np.argmax((gram == gram[-1]) & (low == low[-1])))  # the last group may go on in the next batch
            held = rows.slice(at)
            if at:
                yield from judged(rows.slice(0, at))
        if held is not None:
            yield from judged(held)

    return compute


def near_words(words: DataFrame) -> DataFrame:
    """of, near, order, form and form_id: for each of the words (id, n, word) that has near ones, how many, and the best: minus its n, the word and its id."""
    often = words.sparkSession.sparkContext.broadcast(_gram_counts(words))
    postings = _postings(words.select("id", "n", "word"), often).repartition("gram", "low").sortWithinPartitions("gram", "low", "more", "place")
    met = postings.mapInArrow(_meet(often), "of long, near long, order long, form string, form_id long")
    best = F.min(F.struct("order", "form", "form_id")).alias("best")
    return met.groupBy("of").agg(F.sum("near").alias("near"), best).select("of", "near", "best.*")


def _roots(forms: DataFrame) -> DataFrame:
    """id and root of the ids that have a form, following forms to the last."""
    roots = materialize(forms.select("id", F.col("form_id").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        on = roots.select(F.col("id").alias("of"), F.col("root").alias("next"))
        moved = roots.join(on, F.col("root") == F.col("of"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "roots")
        roots = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            break
    return roots


def spelling_variants(counts: DataFrame, *, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of counts (word, n).

    Words are near if one inserted, deleted or replaced letter makes them equal. A word's form is its near word of
    largest n (ties: the smallest in code-point order), if that n is at least `times` its own, else null; root follows
    forms to the last. Words are expected to be distinct and of LETTERS, lower-cased, as word_counts gives them; words of
    any length count whole; no words give no rows.
    """
    bound_batches(counts.sparkSession)
    words = materialize(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_words(words)
    has = -F.col("order") >= times * F.col("n")
    told = words.join(near, words["id"] == near["of"], "left").select("id", "word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), *(F.when(has, c).alias(a) for c, a in ((F.col("form"), "form"), (-F.col("order"), "form_n"), (F.col("form_id"), "form_id"))))
    told = materialize(told, "forms")
    roots = _roots(told.where("form_id is not null")).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select(F.col("id").alias("of"), "root_word")
    return told.join(roots, F.col("id") == F.col("of"), "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
