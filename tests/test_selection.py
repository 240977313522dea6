"""Order statistics and quantiles by bits against sorted lists."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import stats


def test_bits_keep_the_order_of_doubles(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, math.nextafter(1, 2), math.nextafter(1, 0), 2.0, 0.1, -0.1, 4503599627370497.5]
    values += [np.frombuffer(rng.randbytes(8))[0].item() for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1070, 1024, 7)]
    values = [v for v in values if v == v]
    got = [r["b"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", stats.order_bits(F.col("v")).alias("b")).orderBy("k").collect()]
    bits = lambda v: int(np.float64(abs(v)).view(np.int64)) * (-1 if v < 0 else 1)
    assert got == [bits(v) for v in values]
    assert spark.sql("SELECT double('NaN') AS v").select(stats.order_bits(F.col("v")).alias("b")).first()["b"] > max(got)


def test_statistics_equal_sorted_lists(spark):
    """Many groups, ties, nulls in value and group, one row, no rows."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([rng.gauss(0, 1e6), rng.randint(-3, 3) * 1.0, rng.random() * 1e-9])) for _ in range(900)] + [("one", 7.5), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    got = {r["g"]: r["upper_median"] for r in stats.upper_median(df, "v", ["g"]).collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in by.items()}
    shares = {"p0": 0.0, "p25": 0.25, "p90": 0.9, "p100": 1.0}
    for r in stats.quantiles(df, "v", ["g"], shares).collect():
        assert np.allclose([r[n] for n in shares], np.quantile(by[r["g"]], list(shares.values())), rtol=1e-12)
    everything = [v for _, v in rows if v is not None]
    assert stats.upper_median(df, "v", []).first()["upper_median"] == sorted(everything)[len(everything) // 2]
    assert stats.upper_median(df.limit(0), "v", ["g"]).count() == 0


def test_p_values_of_many_t(spark):
    """Against the plain continued fraction, over small and large degrees of freedom; null without one."""
    pairs = [(t, dof) for t in (0.0, 1e-9, -0.5, 0.7, 2.0, -5.0, 40.0) for dof in (1, 2, 3, 10, 57, 1000, 250_000)]
    rows = spark.createDataFrame([*pairs, (1.0, 0), (None, 4)], "t double, dof long").select("t", "dof", stats.t_probability(F.col("t"), F.col("dof")).alias("p")).collect()
    got = {(r["t"], r["dof"]): r["p"] for r in rows}
    assert all(math.isclose(got[k], stats.two_sided_p(*k), rel_tol=1e-8, abs_tol=1e-12) for k in pairs)
    assert got[(1.0, 0)] is None and got[(None, 4)] is None


def test_limits_cut_across_files(spark, tmp_path, monkeypatch):
    from millrace.sources import lines as src

    monkeypatch.setattr(src, "SPAN", 4)
    for k, n in enumerate((5, 0, 1, 9)):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(f'{{"prompt": "{k}-{i}"}}' for i in range(n)))
    every = [f"{k}-{i}" for k, n in enumerate((5, 0, 1, 9)) for i in range(n)]
    for limit in (0, 1, 4, 5, 6, 7, 15, 99):
        got = src.chat_records(spark, str(tmp_path), limit).collect()
        assert sorted(r["user"] for r in got) == sorted(every[:limit]) and sorted(r["id"] for r in got) == sorted(f"chat-{i}" for i in range(min(limit, 15)))
