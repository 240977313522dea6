"""Documents linked by the multi-index of signatures against all pairs of sets."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash_langid import plain_components

from millrace.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 3]) for k in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def plain_rows(rows):
    sets = [plain_set(t) for _, t in rows]
    n = range(len(rows))
    alike = lambda a, b: a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b)
    group = plain_components(n, [(a, b) for a in n for b in n if a < b and alike(sets[a], sets[b])])
    least = {}
    for k in n:
        if rows[k][0] is not None:
            least[group[k]] = min(least.get(group[k], rows[k][0]), rows[k][0])
    return sorted((str((d, len(sets[k]), least.get(group[k]), d == least.get(group[k]))) for k, (d, _) in enumerate(rows)))


def found(df):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in df.collect())


def planted():
    """Near copies on both sides of the threshold, chains, a large group of near copies, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(10):
        base = [word() for _ in range(rng.randint(30, 200))]
        texts.append(base)
        for changed in range(1, 9):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = word()
            texts.append(copy)
        for _ in range(6):
            texts.append(texts[-1][2:] + [word(), word()])
    line, base = [word() for _ in range(40)], [word() for _ in range(150)]
    for k in range(80):
        texts.append(base[: 150 - k % 40] + [word() for _ in range(k % 7)])
        texts.append(line + [word() for _ in range(5 + k % 3)])
    texts += [["One", "two"], ["one", "TWO"], ["one"], ["a", "b", "c"], ["A", "b", "C"], ["É", "b", "c"], ["é", "b", "c"]]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block, most", [(minhash.BLOCK, minhash.MOST_BROADCAST), (3, 0)])
def test_equals_all_pairs(spark, monkeypatch, block, most):
    """Also with small blocks, and with wanted rows joined instead of broadcast."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "MOST_BROADCAST", most)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(docs)) == plain_rows(rows)


def test_odd_rows(spark):
    """Nulls, empty and blank texts, repeated rows and ids, null ids, a long text and its near copy, clashing columns."""
    long = [str(k * k % 9973) for k in range(40_000)]
    near = " ".join(long[:20_000] + ["x"] + long[20_001:])
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, None), (None, "a b c d"), (None, "A B C D"), (None, "e f"), (4, "e f"), (4, "e f"), (4, "g h"), (9, "G H"), (7, " ".join(long)), (5, near), (8, "x\x1cy z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "id": F.lit("x"), "sig": F.lit(None).cast("string")})
    # A null id alone in its component has none, which counts as equal.
    want = [r.replace("(None, 4, None, True)", "(None, 2, None, True)") for r in plain_rows(rows)]
    assert found(minhash.near_duplicates(docs)) == sorted(want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def lanes_of(signature):
    return signature[:, None] >> minhash.STEP * np.arange(minhash.LANES) & (1 << minhash.BITS) - 1


def test_signatures_meet_in_a_list():
    """All signatures within the threshold share a chunk but for one lane; those of similar sets are within it but once in millions."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        apart = np.zeros(minhash.CHUNKS * minhash.LANES, int)
        apart[rng.choice(len(apart), minhash.THRESHOLD, replace=False)] = 1
        assert apart.reshape(minhash.CHUNKS, -1).sum(1).min() <= minhash.ERRORS
    lanes = minhash.CHUNKS * minhash.LANES
    miss = sum(math.comb(lanes, k) * 0.15**k * 0.85 ** (lanes - k) for k in range(minhash.THRESHOLD + 1, lanes + 1))
    assert miss < 2.2e-7
    apart = []
    for _ in range(300):
        whole = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = minhash.signature(whole[:925]), minhash.signature(whole[75:])
        apart.append((lanes_of(a) != lanes_of(b)).sum())
    assert abs(np.mean(apart) / lanes - 0.15) < 0.01 and max(apart) <= minhash.THRESHOLD


def test_lanes_apart(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for a, _ in itertools.product(range(40), range(5)):
        x = rng.integers(0, 1 << minhash.BITS, minhash.CHUNKS * minhash.LANES)
        y = x.copy()
        at = rng.choice(len(x), a, replace=False)
        y[at] ^= rng.choice([1, 0x2000, 0x2001, 0x1FFF, 0x3FFF, 0x1000], a)
        packed = lambda z: (z.reshape(-1, minhash.LANES) << minhash.STEP * np.arange(minhash.LANES)).sum(1).tolist()
        pairs.append((packed(x), packed(y), a))
    df = spark.createDataFrame(pairs, "u_sig array<long>, v_sig array<long>, n int")
    assert df.where(minhash._lanes_apart("u_sig", "v_sig") != F.col("n")).count() == 0


def test_given_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(str, con.execute(minhash.ORACLE).fetchall()))
    got = queries.QUERIES["op11_minhash_hamming_join"](spark, SF)
    assert found(got) == want and got.where("not kept").count() > 0
