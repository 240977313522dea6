"""Suffix arrays and repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(200):
        n, size = rng.randint(1, 300), rng.choice([1, 2, 3, 5, 200])
        s = [rng.randint(1, size) for _ in range(n)]
        if rng.random() < 0.3:
            s = s[:7] * (n // 7 + 1)
        s = np.array([*s, 0])
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_arrays_of_many_letters():
    rng = random.Random(2)
    for n, size in ((2000, 1500), (3000, 600), (4000, 3)):
        s = [rng.randint(1, size) for _ in range(n // 2)]
        s = np.array([*s, *s[: n // 3], *s, 0])
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_permuted_prefixes():
    rng = random.Random(3)
    for most in (7, 100):
        text = "".join(rng.choice("ab") for _ in range(400)) * 2 + "a" * 150
        raw = np.frombuffer(text.encode(), np.uint8)
        order = suffix.suffix_array(np.append(raw.astype(np.int64) + 1, 0))
        order = order[order < len(raw)]
        want = [0] * len(raw)
        for x, y in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            k = 0
            while k < most and max(x, y) + k < len(text) and text[x + k] == text[y + k]:
                k += 1
            want[y] = k
        assert suffix.permuted_prefixes(raw, order, most).tolist() == want


def test_one_passage_in_all_documents(spark, monkeypatch):
    """A common anchor's blocks meet by their bytes, and its segments by lengthened cores."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(300)
    table = [(d, word(rng.randint(0, 150)) + passage[rng.randint(0, 9) :] + word(rng.randint(0, 150))) for d in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    met = []
    monkeypatch.setattr(suffix, "materialize", lambda df, name, make=suffix.materialize: met.append((name, make(df, name))) or met[-1][1])
    common = suffix._common_anchors(docs, suffix._placed(docs, "doc_id", "text"), 100, 24)
    assert len(common) >= 5
    got = suffix.remove_repeats(docs).collect()
    assert sorted(((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in got), key=str) == brute(table, 100)


def document(d, t):
    """Ids in order, null first; of one id, or none, by the text's MD5."""
    return suffix.NO_ID if d is None else d, hashlib.md5((t or "").encode()).hexdigest()[:30]


def brute(rows, length):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            place = (document(d, t), i)
            seen[b[i : i + length]] = min(seen.get(b[i : i + length], place), place)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if (document(d, t), i) > seen[b[i : i + length]]:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((d, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]

    def part():
        if rng.random() < 0.5:
            return "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 80)))
        a = rng.randint(0, 300)
        return rng.choice(base)[a : a + rng.randint(20, 260)]

    own = [(d, "".join(part() for _ in range(rng.randint(0, 6)))) for d in range(120)]
    return [*own, (200, "a" * 3000), (201, "ab" * 2000 + "x"), (202, None), (203, ""), (204, own[3][1]), (204, own[3][1]), (204, "other " + own[3][1]), (None, own[5][1]), (205, own[7][1] * 3)]


@pytest.mark.parametrize(("length", "gram", "most"), [(100, 24, 4096), (100, 24, 3), (30, 8, 2)])
def test_repeats(spark, monkeypatch, length, gram, most):
    monkeypatch.setattr(suffix, "MOST_SEGMENTS", most)
    docs = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, places int").repartition(5)
    got = suffix.remove_repeats(docs, length=length, gram=gram).collect()
    assert sorted(((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in got), key=str) == brute(rows(), length)


def test_many_rows_without_ids_or_of_one_id(spark):
    """Rows of one id, or none, are documents of their own: clean ones lose nothing, and passages go in all but the first."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, start = word(150), word(300)
    table = [(None, word(rng.randint(0, 40)) + (passage if k % 2 else word(150)) + word(9)) for k in range(2000)]
    table += [(None, start + word(20)) for _ in range(20)] + [(7, start + word(20)) for _ in range(20)] + [(7, word(200)) for _ in range(20)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(docs).collect()
    want = brute(table, 100)
    assert sorted(((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in got), key=str) == want
    assert sum(r[2] > 0 for r in want) == 999 + 19 + 20
    kept = {r["text"] for r in suffix.keep_unrepeated(docs).collect()}
    assert {t for k, (_, t) in enumerate(table) if k < 2000 and not k % 2 or k >= 2040} <= kept


def test_long_texts_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffix, "STEP_BITS", 9)
    offsets = np.array([0, 100, 2000, 2050])
    steps = list(suffix._steps(offsets, 100))
    assert all(hi - lo <= 512 for _, _, lo, hi in steps)
    parts = [(lo, hi) for a, b, lo, hi in steps if (a, b) == (1, 2)]
    assert {q for lo, hi in parts for q in range(lo, hi - 99)} == set(range(1801))


def test_kept_rows(spark):
    same = "the same passage of quite some length, that two documents hold; " * 2
    docs = spark.createDataFrame([(1, same + "é", "a"), (2, "é" + same, "b"), (3, None, "c")], "doc_id long, text string, _places string")
    got = {r["doc_id"]: tuple(r) for r in suffix.keep_unrepeated(docs).collect()}
    assert got[1] == (1, same + "é", "a") and got[3] == (3, None, "c")
    assert got[2][1] == "é" and got[2][2] == "b"
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
