"""Every query with a SQL counterpart gives the same rows in DuckDB."""

import math

import duckdb
import numpy as np
import pytest

from millrace import catalogue
from millrace.operators import vectors

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_labels_in_blocks(spark, monkeypatch):
    """Means of labels that are broadcast in several blocks give the same nearest ones."""
    from millrace.plans import analytics

    rows = lambda: sorted(map(tuple, catalogue.QUERIES["cosine_nearest"](spark, SF).collect()))
    whole = rows()
    monkeypatch.setattr(analytics, "MOST_LABELS", 3)
    assert rows() == whole


def test_kmeans_assigns_and_centres(spark):
    """Fitted centroids: each is about the mean of its own vectors, and each vector goes to its nearest by cosine."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = catalogue.QUERIES["kmeans_summary"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == table.count()
    centres = np.array(vectors.fit_centroids(table, k=10, tries=2))
    x = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()], float)
    own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    drift = [np.abs(x[own == k].mean(0) - centres[k]).max() for k in range(10) if (own == k).any()]
    assert max(drift) < 0.1
    far = 1 - x @ centres.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None])
    got = vectors.nearest_centroid(table, centres.tolist()).orderBy("vec_id").collect()
    assert [r["centroid"] for r in got] == far.argmin(1).tolist() and np.allclose([r["distance"] for r in got], far.min(1))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
