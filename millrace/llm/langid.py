"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a shuffle of sparse (language, bucket, count) sums over a bounded sample of labelled rows; the
log-probability matrix (languages x BUCKETS) is broadcast; batches are scored sparsely in numpy: each n-gram of a
text picks one cell of every language's row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import SMALL_BATCH_BYTES, bound_batches, handing_back

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
ALPHA = 0.1
UNDETERMINED = "und"
#: Characters scored at a time.
STEP = 1 << 19
#: Languages learned at most, those with the most rows of the sample: their matrix has 256 KB each, 64 MB in all.
MOST_LANGUAGES = 256
_GAP = "\n\n"


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls in fold 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def has_letter(text: str | None) -> bool:
    """Whether there is a letter of any script (category L: numerals such as \u2167 or \u00bd are none)."""
    return text is not None and any(map(str.isalpha, text))


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of about STEP lower-cased characters, a gap behind each text; where their parts of texts begin and end, and whose they are.

    A text longer than STEP goes in several parts; what its next part begins with stands behind an end, for the n-grams that reach there.
    """
    held, begins, ends, owners, size = [], [], [], [], 0

    def points() -> tuple[np.ndarray, ...]:
        return np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4"), np.array(begins), np.array(ends), np.array(owners)

    for k, text in enumerate(texts):
        low = text.lower() + _GAP
        for at in range(0, len(low), STEP):
            part = low[at : at + STEP]
            if size and size + len(part) > STEP:
                yield points()
                held, begins, ends, owners, size = [], [], [], [], 0
            begins.append(size)
            ends.append(size + len(part))
            owners.append(k)
            held += [part, low[at + STEP : at + STEP + len(_GAP)] if at + STEP < len(low) else ""]
            size += sum(map(len, held[-2:]))
    if held:
        yield points()


def features(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each character; n-grams that reach into the next text hold its gap."""
    h = np.zeros(len(points), np.uint32)
    padded = np.concatenate([points, np.full(max(ORDERS), 10, np.uint32)])
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ padded[n - 1 : n - 1 + len(points)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield ((h * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their log priors, and log probabilities as float32 [languages, BUCKETS]."""

    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its posterior probability; a null text or one without letters is undetermined, at 0."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        total = np.tile(self.prior, (len(known), 1))
        for points, begins, ends, owners in _parts([texts[k] for k in known]):
            cuts = np.stack([begins, ends], 1).ravel()  # what lies between an end and the next begin isn't summed
            for bucket in features(points):
                for j in range(len(self.languages)):
                    sums = np.add.reduceat(np.append(self.log_p[j].take(bucket), np.float32(0)), cuts, dtype=np.float64)[::2]
                    np.add.at(total[:, j], owners, sums)
        if known:
            best = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i, k in enumerate(known):
                names[k], scores[k] = self.languages[best[i]], float(min(p[i], 1.0))
        return names, scores


def fit(docs: DataFrame, *, fit_rows: int = FIT_ROWS, most_languages: int = MOST_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most fit_rows rows outside the held-out fold that have a language and a text; without any, no language is known.

    Two passes: one over ids and languages finds the hash below which fit_rows rows lie, one reads those rows' texts.
    Of these rows, those of the most_languages languages with the most of them are the sample (ties to the smaller
    name), so that the matrix is bounded. Repeated rows count as often as they occur.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    bound = rows.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    if bound is None:
        return LanguageModel([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                docs_of[lang] = docs_of.get(lang, 0) + len(own)
                table = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for points, begins, ends, _ in _parts(own):
                    inside = np.zeros(len(points) + 1, np.int64)
                    inside[begins] += 1
                    inside[ends] -= 1
                    inside = np.cumsum(inside[:-1]) > 0
                    for bucket in features(points):
                        table += np.bincount(bucket[inside], minlength=BUCKETS)
        for lang, table in sums.items():
            at = np.flatnonzero(table)
            at, n = np.append(at, -1), np.append(table[at], docs_of[lang])  # bucket -1: documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    sample = rows.where(F.col("h") <= F.lit(bound))
    often = sample.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sums = sample.join(F.broadcast(often.select("lang")), "lang").select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    # At most BUCKETS + 1 rows for each of most_languages languages.
    table = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, bucket, n = (table[c].to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
    names = sorted(set(langs.tolist()))
    log_p, prior = np.zeros((len(names), BUCKETS), np.float32), np.zeros(len(names))
    for j, name in enumerate(names):
        counts = np.zeros(BUCKETS + 1)
        counts[bucket[langs == name]] = n[langs == name]  # -1 is the last
        prior[j] = counts[-1]
        log_p[j] = np.log(counts[:-1] + ALPHA) - np.log(counts[:-1].sum() + ALPHA * BUCKETS)
    return LanguageModel(names, np.log(prior / prior.sum()), log_p)


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text alone.

    Null texts and texts without letters are `und` with score 0; of languages that tie the first by name is taken; a
    text of any length is scored whole, in parts; equal texts get equal results, repeated rows repeated ones; an empty
    table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, *, least: float = 0.0, languages: tuple[str, ...] | None = None, text_col: str = "text", into: str | None = None) -> DataFrame:
    """The rows of docs, columns as they are, whose language is determined, has at least that score, and is wanted.

    into: a string column that gets the language instead of what it holds.
    Null, empty and letterless texts go; texts of any length are scored whole; repeated rows stay or go together; ids may
    be null or repeat, as only texts are read; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark, SMALL_BATCH_BYTES)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    named = None if into is None else docs.columns.index(into)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            if named is not None:
                batch = batch.set_column(named, batch.schema.field(named), pa.array(names, batch.schema.field(named).type))
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least and (languages is None or n in languages) for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(handing_back(keep), docs.schema)
