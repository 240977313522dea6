"""Documents of similar shingle sets against all pairs."""

import random
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_simhash_langid import plain_components

from millrace.llm import similar

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {tuple(words)}


def survivors(rows):
    sets = [plain_shingles(t) for _, t in rows]
    n = range(len(rows))
    alike = lambda a, b: min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b)
    group = plain_components(n, [(a, b) for a in n for b in n if a < b and alike(sets[a], sets[b])])
    least = {}
    for k in n:
        least[group[k]] = min(least.get(group[k], rows[k][0]), rows[k][0])
    return sorted(least.values())


def planted():
    """Near copies with 1 to 12 words changed, of 12 texts of 60 to 200 words; chains; and one large group that shares most of a text."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(base)
        for changed in range(1, 13):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = word()
            texts.append(copy)
        for _ in range(4):
            texts.append(texts[-1][3:] + [word()])
    line, base = [word() for _ in range(9)], [word() for _ in range(150)]
    for k in range(80):
        texts.append(base[: 150 - k % 40] + [word() for _ in range(k % 7)])
        texts.append(line + [word() for _ in range(3)])
    texts += [["One", "two"], ["one", "TWO"], ["one"]]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("common", [8, 10**9])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == survivors(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_stage_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.trim("text") != "")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == survivors(rows) and not {2, 56} <= set(kept)


HELD = """
import re
from millrace.llm import _common
resident = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
def compute(batches):
    held = [bytearray(50_000) for _ in range(6000)]
    kept.extend(held[::1000])  # what stays between is why the allocator keeps the rest
    yield from batches
    del held
kept = []
wrap = getattr(_common, "handing_back", lambda f: f)
before = resident()
list(wrap(compute)([]))
print(resident() - before)
"""


def test_a_worker_gives_back_what_a_task_needed():
    grown = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)}).stdout
    assert int(grown) < 30  # MB, of 300


def test_stage_asks_for_small_batches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g")], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
