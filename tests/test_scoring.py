"""Normalisation, lookups, rules and sample scores."""

import duckdb
import pytest

from millrace import catalogue
from millrace.operators import scoring


def test_normalised_features(spark):
    aliases = spark.createDataFrame([("logp", "logP"), ("clogp", "logP"), ("caco-2", "Caco-2 Permeability"), ("caco2", "Caco-2 Permeability"), ("渗透性", "Caco-2 Permeability")], "alias string, canonical string")
    props = spark.createDataFrame([(1, "orig", "<b>cLogP</b>", "2 mM", 0), (1, "orig", "log_P", "3", 1), (1, "orig", "Caco 2", "++", 2), (1, "orig", "unknown 词", "1", 3), (1, "orig", "x", "n/a", 4)], "sample_id long, role string, name string, raw string, pos int")
    got = {r["feature"]: r["value"] for r in scoring.normalized_features(props, aliases).collect()}
    assert got == {"logP": 3.0, "Caco-2 Permeability": 2.0, "unknown 词": 1.0}


def test_lookup_asks_once(spark):
    rows = spark.createDataFrame([("CCO <END>",), ("CCO",), ("bad",)], "smiles string")

    def client(s):
        if s == "bad":
            raise OSError("down")
        return {"logP": 1.5}

    got = {r["smiles"]: r["props"] for r in scoring.lookup(rows, client, tries=1).collect()}
    assert got == {"CCO": {"logP": "1.5"}, "bad": {}}


def test_sample_scores(spark):
    features = spark.createDataFrame([(1, "orig", "QED", 0.5), (1, "opt", "QED", 0.6), (1, "orig", "DILI", 0.9)], "sample_id long, role string, feature string, value double")
    rules = spark.createDataFrame([("DILI", ">", 0.5, None)], "feature string, flag string, threshold double, upper double")
    bad = scoring.bad_features(features, rules)
    assert [tuple(r) for r in bad.collect()] == [(1, "orig", "DILI")]
    row = scoring.sample_scores(features, bad, scoring.feature_table(spark)).first()
    assert row["base"] == pytest.approx((0.5 * 2.0 + 0.5) / (2 * (1.0 + 3.0)))
    assert row["coverage"] == pytest.approx(0.1 * 2 / 16)
    assert row["efficiency"] == pytest.approx(0.1)


def test_scores_on_the_edge_of_rounding(spark, tmp_path):
    """Orders whose scores lie between two roundings or at zero: terms are added by feature, and penalties are exact."""
    lines = {
        7864: [(1, 16.0, "N"), (2, 21.0, "N"), (3, 28.0, "A"), (5, 39.0, "N"), (6, 5.0, "A"), (7, 43.0, "N")],
        47151: [(1, 14.0, "R"), (2, 18.0, "N"), (3, 1.0, "N"), (5, 7.0, "R"), (6, 9.0, "A"), (7, 3.0, "A")],
        87873: [(1, 21.0, "R"), (2, 48.0, "R"), (4, 16.0, "N"), (6, 21.0, "N")],
        96681: [(1, 3.0, "A"), (2, 32.0, "N"), (3, 33.0, "N"), (4, 15.0, "R"), (5, 45.0, "R")],
    }
    rows = [(order, n, 1, 1, quantity, flag) for order, own in lines.items() for n, quantity, flag in own]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["sample_score_rollup"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.execute(catalogue.ORACLE_SQL["sample_score_rollup"]).fetchall())
    assert [(r[0], r[1], r[4]) for r in got] == [(7864, -0.379688, -0.30375), (47151, 0.0, 0.01), (87873, -0.145312, -0.11625), (96681, -0.060937, -0.04875)]
