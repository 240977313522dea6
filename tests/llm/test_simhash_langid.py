"""Near duplicates against all pairs; language ID on held-out rows."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, langid, similar, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(0)
    links = [(k, k + 1) for k in range(50)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    want = plain_components({x for p in links for x in p}, links)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("spread", [30, 400])
def test_links_join_what_all_pairs_join(spark, spread):
    """Sparse lists, and lists crowded with dozens of members: one path."""
    rng = random.Random(2)
    fps = {0, 3}
    for _ in range(6):
        centre = rng.getrandbits(64)
        bits = [rng.randrange(64) for _ in range(9)]
        for _ in range(spread):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << (rng.choice(bits) if spread > 99 else rng.randrange(64))
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert len(links) <= 28 * len(signed)
    assert plain_components(signed, links) == plain_components(signed, pairs)


def test_a_crowded_list_is_linked_as_its_pairs(spark):
    rng = random.Random(4)
    for n in (2, 3, 20, 24, 25, 300, 3000):
        fp = np.array(sorted(rng.sample(range(1 << 16), n)), np.int64) | 5 << 40
        u, v = simhash.list_links(np.zeros(n, np.int32), fp >> 16, fp)
        got = plain_components(fp.tolist(), list(zip(u.tolist(), v.tolist(), strict=True)))
        flips = [0, *(1 << a for a in range(16)), *(1 << a | 1 << b for a in range(16) for b in range(a))]
        own = set(fp.tolist())
        assert got == plain_components(fp.tolist(), [(a, a ^ f) for a in own for f in flips if a ^ f in own]) and len(u) < n


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, " \t"), (9003, "One"), (9004, "one"), (9004, "one"), (None, "one"), (9005, "A b"), (9006, "x " * 5000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd).withColumn("fp", F.lit("clash"))
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    fp = [plain_fingerprint(t) for _, t in texts]
    n = range(len(texts))
    group = plain_components(n, [(a, b) for a in n for b in n if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    least = {}
    for k in n:
        if texts[k][0] is not None:
            least[group[k]] = min(least.get(group[k], texts[k][0]), texts[k][0])
    want = sorted(((texts[k][0], format(fp[k], "016x"), least.get(group[k])) for k in n), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(rows).collect()), key=str) == want
    kept = simhash.keep_first(rows.withColumn("_kept", F.lit(1))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values()))
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("keep_first", [simhash.keep_first, similar.keep_first])
def test_one_row_of_each_component(spark, keep_first):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(40))
    rows = [(None, text(1), "a"), (None, text(2), "a"), (None, text(3), None), (5, text(3), "a"), (7, text(4), "a"), (7, text(5), None), (7, text(5), None), (None, text(6), "a"), (None, text(6), "a"), (8, text(7), "b"), (8, text(7), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = keep_first(docs).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert got == sorted([(None, text(1)), (None, text(2)), (5, text(3)), (7, text(4)), (7, text(5)), (None, text(6)), (8, text(7))], key=str)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, fit_rows=300)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 %", 1), (4, "the other and the", 1), (None, "the other and the", 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1, 2, 3))
    assert got[4]["lang_pred"] == got[None]["lang_pred"] == "en" and got[4]["score"] == got[None]["score"] and 0 < got[4]["score"] <= 1
    assert sorted(r["doc_id"] or 0 for r in langid.keep_identified(odd, model).collect()) == [0, 4]
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_only_letters_determine_a_language(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    symbols = ["½ ②", "Ⅷ", "１２", "_", "\n", "🙂"]
    names, scores = model.predict([*symbols, "Ⅷ é"])
    assert names[:-1] == ["und"] * len(symbols) and scores[:-1] == [0.0] * len(symbols) and names[-1] in model.languages
    # Long texts go in parts, with n-grams across their borders.
    texts = [r["text"] for r in docs.limit(40).collect()] + ["İstanbul ve " * 40]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "STEP", 50)
    cut = model.predict(texts)
    assert cut[0] == whole[0] and cut[1] == pytest.approx(whole[1], abs=1e-9)


def test_languages_learned_are_bounded(spark):
    rows = [(k, "some text", f"dirty{k}") for k in range(300)] + [(k, "mehr text", "de") for k in range(300, 320)] + [(k, "more text", "en") for k in range(320, 340)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=2)
    assert model.languages == ["de", "en"] and model.log_p.shape == (2, langid.BUCKETS)


def test_stage_rejects_und_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "12 %", "en"), (9003, "", "en"), (9004, "zzz qqq xxj", "en")], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(odd), SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {9004}
    assert "und" in corpus_pipeline.language.__doc__


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(wrong).languages
    nothing = langid.fit(docs.limit(0))
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
