"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import periods, queries

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def check(spark, docs, rows):
    got = periods.run_digests(periods.periodic_runs(docs, planted=True)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(*r)) for r in rows)


@pytest.mark.parametrize("prime", [periods.PRIME, 13])
@pytest.mark.parametrize("points", [periods.POINTS, 50])
def test_runs_equal_brute_force(monkeypatch, prime, points):
    """Also with hashes that are often equal by chance, and few grid points at a time."""
    monkeypatch.setattr(periods, "PRIME", prime)
    monkeypatch.setattr(periods, "BASE", 5)
    monkeypatch.setattr(periods, "POINTS", points)
    rng = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 120), rng.choice([1, 2, 3, 20])
            words = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.7:
                a, p = rng.randrange(n), rng.randint(1, n // 4 + 1)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        text, start, end, q = periods.find_runs(np.array([w for t in texts for w in t], np.int64), offsets)
        got = [[] for _ in texts]
        for k, s, e, p in zip(text.tolist(), start.tolist(), end.tolist(), q.tolist(), strict=True):
            got[k].append((s - offsets[k], e - s, p))
        assert got == [plain_runs(t) for t in texts]


def test_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(*r)) for r in rows)
    assert sum(r["n_runs"] for r in got) > 5


def test_odd_rows(spark):
    """Nulls, empty texts, white space, characters that aren't white space here, repeats, a long text, clashing columns."""
    long = " ".join(str(k % 7 if k < 30_000 else k % 1000) for k in range(60_000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b a b " * 4, "a " * 6, "a " * 5, "A a A a A a A a A", "x y z " * 9 + "x", "\x1c \x1c \x1c \x1c \x1c \x1c"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "b c " * 8), (None, "b c " * 8), (3, None), (7, "x y z " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "words": F.lit("x"), "collapsed": F.lit(None).cast("string")})
    check(spark, docs, rows)
    assert periods.run_digests(periods.periodic_runs(docs.limit(0))).count() == 0
    found = periods.periodic_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 30_000, 7), (30_000, 30_000, 1000)]


def test_greatest_exponent_is_exact():
    assert periods.most_repeated([]) is None
    assert periods.most_repeated([(5, 9, 2), (1, 9, 2), (0, 8, 2)]) == (1, 9, 2)
    big = 1 << 55
    assert periods.most_repeated([(0, 4 * big, big), (9, 4 * big + 1, big)]) == (9, 4 * big + 1, big)
