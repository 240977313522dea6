"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import queries, variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
            n[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(n):
    near = {w: [] for w in n}
    words = sorted(n, key=len)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(rows))
    assert found(queries.QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert any(w[1] for w in want)


def test_crowded_words(spark):
    """Few letters, so that grams repeat and lists are crowded; forms of forms; ties."""
    rng = random.Random(3)
    n = {}
    for _ in range(700):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))
        n[word] = rng.choice([2, 3, 30, 31, 400, 5000, 60_000])
    n |= {"a" * k: 10 ** (k - 6) * 3 for k in range(7, 15)} | {"zzzzzzz×": 5, "zzzzzzz÷": 50, "zzzzzzzÿ": 50, "b" * 5000: 2, "b" * 5001: 40}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(variants.spelling_variants(counts)) == plain_variants(n)
    assert variants.spelling_variants(counts.limit(0)).count() == 0


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty texts, upper case beyond A-Z, repeated rows and ids, a long text, clashing columns, counts passed on early."""
    monkeypatch.setattr(variants, "HELD", 3)
    long = " ".join(f"w{'abcdefghij'[k % 10]}ordings{'abcdefghij'[k // 10 % 10]}" for k in range(50_000))
    rows = [(1, None), (2, ""), (None, "ÉCOLIERS écoliers Écoliers"), (None, "Weather weather wether weathers"), (4, long), (4, long), (5, "a1b2 ß" * 9), (6, "weather, WEATHER; weather" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "id": F.lit(None).cast("int")})
    got = found(variants.spelling_variants(variants.word_counts(docs, change=variants.misspelt)))
    assert got == plain_variants(plain_counts(rows))
    assert variants.word_counts(docs.limit(0)).count() == 0
