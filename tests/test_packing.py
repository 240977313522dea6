"""Packed rows against a serial fold."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.packing import pack_numbers, packed_rows


def serial(lengths, limit):
    packs, used = [], None
    for n in lengths:
        if used is None or used + 1 + n > limit:
            packs.append(packs[-1] + 1 if packs else 0)
            used = n
        else:
            packs.append(packs[-1])
            used += 1 + n
    return packs


@pytest.mark.parametrize("span", [1, 3, 50, 10_000])
def test_numbers_equal_a_serial_fold(spark, span):
    rng = random.Random(span)
    for limit, top in ((10, 14), (40, 9), (1, 2)):
        lengths = [rng.choice([0, 1, rng.randint(0, top)]) for _ in range(rng.choice([1, 5, 130]))]
        orders = sorted(rng.sample(range(400), len(lengths)))
        df = spark.createDataFrame(list(zip(orders, lengths)), "o long, n int").repartition(3)
        got = [r["pack_id"] for r in pack_numbers(df, order="o", length="n", limit=limit, span=span).orderBy("o").collect()]
        assert got == serial(lengths, limit)


def test_rows_and_odd_cases(spark):
    """Limit 10, lengths 4, 4, 7, 2: two rows, nothing lost; nulls, empty ones, one above the limit; clashing columns; no rows."""
    rows = [(0, [1] * 4, [1] * 4), (1, [2] * 4, [-100, 2, 2, 2]), (2, [3] * 7, [3] * 7), (3, [4] * 2, [4] * 2), (4, [5] * 12, [5] * 12), (5, None, None), (6, [], [])]
    df = spark.createDataFrame(rows, "k long, ids array<int>, labels array<int>").withColumn("pack_id", F.lit("x"))
    got = packed_rows(df, order="k", ids="ids", labels="labels", limit=10, separator=9, pad=0, span=2).orderBy("pack_id").collect()
    assert [r["sequences"] for r in got] == [2, 2, 1, 2] and [r["used"] for r in got] == [9, 10, 12, 1]
    assert got[0]["input_ids"] == [1] * 4 + [9] + [2] * 4 + [0] and got[0]["attention_mask"] == [1] * 9 + [0]
    assert got[0]["labels"] == [1] * 4 + [-100, -100, 2, 2, 2, -100]
    assert got[1]["input_ids"] == [3] * 7 + [9] + [4] * 2 and got[2]["input_ids"] == [5] * 12 and got[2]["attention_mask"] == [1] * 12
    assert got[3]["input_ids"] == [9] + [0] * 9
    assert packed_rows(df.limit(0), order="k", ids="ids", labels="labels", limit=10, separator=9, pad=0).count() == 0
