"""Recall of the vector search, and the pipeline's stages."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_similar import survivors
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import ann, langid, mixing, packing

SF = "/root/testdata/sf0.001"


def exact(ids, x, q, k=10):
    at = int(np.flatnonzero(ids == q)[0])
    far = np.sqrt(((x - x[at]) ** 2).sum(1))
    far[ids == q] = np.inf
    order = np.lexsort((ids, far))[:k]
    return ids[order], far[order]


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = ann.search(table, queries=F.col("vec_id") % 10 == 0).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        near, _ = exact(ids, x, q)
        hits += len(set(near) & set(own["vec_id"]))
        assert own["rank"].tolist() == list(range(1, 11)) and q not in set(own["vec_id"])
        far = [np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()) for v in own["vec_id"]]
        assert np.allclose(own["score"], far, rtol=1e-12) and sorted(far) == far
    assert hits >= 0.9 * len(got)


def test_visiting_all_lists_is_exact(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = ann.search(table, queries=F.col("vec_id") % 25 == 0, probes=1 << 20).toPandas().sort_values(["query_id", "rank"])
    for q, own in got.groupby("query_id"):
        near, far = exact(ids, x, q)
        assert own["vec_id"].tolist() == near.tolist() and np.allclose(own["score"], far, rtol=1e-12)


def test_repeated_rows_and_ids(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id < 200")
    rows = {r["vec_id"]: list(r["embedding"]) for r in table.collect()}
    far = rows[7]
    more = [(0, rows[0])] * 3 + [(100, rows[100])] * 12 + [(205, rows[100]), (3, rows[3]), (300, rows[50]), (300, far), (8, rows[0])]
    got = ann.search(table.union(spark.createDataFrame(more, table.schema)), probes=1 << 20).toPandas().sort_values(["query_id", "rank"])
    points = [(i, v) for i, v in [*rows.items(), *more]]
    assert got.groupby("query_id").size().to_dict() == {0: 10, 100: 10, 300: 10}
    for q, own in got.groupby("query_id"):
        asked = [np.array(v) for i, v in points if i == q]
        least = {}
        for i, v in points:
            if i != q:
                least[i] = min(least.get(i, np.inf), *(float(np.sqrt(((np.array(v) - a) ** 2).sum())) for a in asked))
        want = sorted(least.items(), key=lambda p: (p[1], p[0]))[:10]
        assert own["vec_id"].tolist() == [i for i, _ in want] and np.allclose(own["score"], [d for _, d in want])
    assert got[got.query_id == 100]["vec_id"].iloc[0] == 205 and got[got.query_id == 0]["vec_id"].iloc[0] == 8


def test_odd_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [inf, 1.0]), (1, [None, 1.0]), (2, []), (3, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (4, [float("nan"), 1.0])]
    rows += [(k, [1.0, 0.0]) for k in range(10, 60)] + [(k, [0.0, 5.0]) for k in range(60, 63)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = ann.search(table).toPandas().sort_values(["query_id", "rank"])
    assert got["query_id"].unique().tolist() == [0, 100]
    assert got[got.query_id == 0]["vec_id"].tolist() == list(range(10, 20))
    assert got[got.query_id == 100]["vec_id"].tolist() == [0, *range(10, 19)] and (got["score"] == 0).all()
    few = ann.search(table.where("vec_id IN (0, 100, 60, 61)")).toPandas().sort_values(["query_id", "rank"])
    assert few[few.query_id == 0]["vec_id"].tolist() == [100, 60, 61]
    assert ann.search(table.limit(0)).count() == 0
    assert ann.search(table.where("vec_id = 0")).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "123 !", "en", None, 5), (9003, "é è", None, None, 3)], docs.schema)
    table = docs.union(odd)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "packing"]
    kept = corpus_pipeline.language(spark, table, SF)
    assert kept.columns == docs.columns
    assert {r[0] for r in table.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {9001, 9002}
    first = corpus_pipeline.near_duplicates(spark, kept, SF)
    ids = sorted(r["doc_id"] for r in first.collect())
    assert ids == survivors([(r["doc_id"], r["text"]) for r in kept.collect()]) and first.columns == docs.columns
    cut = corpus_pipeline.repeated_passages(spark, first, SF)
    assert sorted(r["doc_id"] for r in cut.collect()) == ids and cut.columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, cut, SF)
    assert mixed.columns == docs.columns
    # As many copies as the Poisson counts of the kept documents' sources say, each as it was.
    sizes = {r["source"]: r["count"] for r in cut.groupBy("source").count().collect()}
    shares = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    for s, n in sizes.items():
        rate = sum(sizes.values()) * shares[s] / (sum(shares.values()) * n)
        own = cut.where(F.col("source").eqNullSafe(F.lit(s)))
        want = {r[0]: r[1] for r in own.select("doc_id", mixing.repetitions(F.col("doc_id").cast("string"), F.lit(rate))).collect()}
        drawn = mixed.where(F.col("source").eqNullSafe(F.lit(s)))
        assert {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()} == {d: c for d, c in want.items() if c}
    assert mixed.where("lang IS NOT NULL AND source IS NOT NULL").join(cut, docs.columns, "left_anti").isEmpty()
    packed = corpus_pipeline.packed(spark, mixed, SF).toPandas()
    assert list(packed.columns[:2]) == ["doc_id", "start"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed["length"].sum() == want and packed.groupby("sequence_id")["length"].sum().max() <= packing.WINDOW


def test_identified_language_reaches_the_pieces(spark):
    """Stated languages that are null or wrong are replaced by the identified ones, and packed pieces carry these."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = docs.where("lang IS NOT NULL").orderBy("doc_id").limit(30).collect()
    odd = spark.createDataFrame([(9100 + 2 * k + j, r["text"], lang, r["source"], r["n_chars"]) for k, r in enumerate(first) for j, lang in enumerate((None, "xx"))], docs.schema)
    model = langid.fit(docs.union(odd))
    rows = docs.union(odd).collect()
    want = {r["doc_id"]: name for r, name in zip(rows, model.predict([r["text"] for r in rows])[0], strict=True)}
    named = corpus_pipeline.language(spark, docs.union(odd), SF)
    got = {r["doc_id"]: r["lang"] for r in named.collect()}
    assert got == {d: name for d, name in want.items() if name != langid.UNDETERMINED}
    assert any(got[r["doc_id"]] != r["lang"] for r in rows if r["doc_id"] in got)
    pieces = corpus_pipeline.packed(spark, named, SF)
    assert {(r["doc_id"], r["lang"]) for r in pieces.select("doc_id", "lang").collect()} == set(got.items())


def test_run_on_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.fit(docs.limit(0)).languages == [] and packing.WINDOW == 2048
