"""Golden cases, worked out by hand from the specified semantics."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scoring, text
from millrace.operators import matrix, mixing, rollout, stats, tokens
from millrace.operators import scoring as scoring_op


def value(spark, column, **cells):
    names = list(cells)
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())) if names else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("<5 uM", 5.0), ("2 mM", 2000.0), ("500 nM", 0.5), ("0.9%", 0.9), ("1e-3", 0.001), ("---", -3.0), ("++", 2.0), ("n/a", None), (None, None)])
def test_numbers(spark, raw, want):
    got = value(spark, scoring.number_of(F.lit(raw).cast("string")))
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize(("direction", "orig", "opt", "want"), [
    (1, 0.50, 0.60, 2.0), (1, 0.50, 0.48, -0.252), (1, 0.50, 0.45, -0.63), (1, 0.50, 0.30, -1.02), (1, 0.05, -0.20, 0.9), (1, 0.50, 0.50, 0.0),
    (0, 4.0, 2.5, 2.0), (0, 2.0, 4.0, -1.6), (0, 4.0, 5.0, 1.2), (None, 1.0, 9.0, 0.0),
])
def test_rewards(spark, direction, orig, opt, want):
    reward = scoring.feature_reward(F.lit(orig), F.lit(opt), F.lit(direction).cast("int"), F.lit(1.0), F.lit(3.0), F.lit(None).cast("double"), F.lit(1.0))
    assert value(spark, reward) == pytest.approx(want)


@pytest.mark.parametrize(("bad", "predicted", "want"), [("", "", 1.0), ("", "A", 0.5), ("ABC", "", 0.0), ("ABC", "ABC", 1.0), ("ABC", "AB", 2 / 3), ("ABC", "ABCD", 0.75), ("ABC", "AD", 0.357143), ("A", "D", 0.0)])
def test_set_f_score(spark, bad, predicted, want):
    sets = [F.array(*map(F.lit, s)).cast("array<string>") for s in (bad, predicted)]
    assert value(spark, scoring.set_f_score(*sets, F.lit(True))) == pytest.approx(want, abs=1e-6)
    assert value(spark, scoring.set_f_score(*sets, F.lit(False))) == 0


@pytest.mark.parametrize(("x", "want"), [(0.25, 0.55), (0.5, 0.7), (0.6, 0.833333), (0.65, 0.941111), (0.85, 1.0), (1.05, 0.9), (1.3, 0.6), (1.8, 0.3), (6.0, 0.1)])
def test_novelty(spark, x, want):
    assert value(spark, scoring.novelty(F.lit(x))) == pytest.approx(want, abs=1e-5)


def test_domain_output(spark):
    raw = "Reasoning: a\n\nnoise\nReasoning: b\nOptimized SMILES: CCO"
    assert value(spark, text.domain_output(F.lit(raw), F.lit("chem"))) == "Reasoning: b\nOptimized SMILES: CCO\n<END>"
    assert value(spark, text.domain_output(F.lit("hello"), F.lit("chem"))) == "Reasoning:\nOptimized_SMILES:\n<END>"
    assert value(spark, text.domain_output(F.lit(" x　"), F.lit("other"))) == "x"


@pytest.mark.parametrize(("smiles", "want"), [("CCO", True), ("C1CC", False), ("C)C(", False), ("C C", False), ("", False), (None, False)])
def test_smiles_sane(spark, smiles, want):
    assert value(spark, text.smiles_sane(F.lit(smiles).cast("string"))) is want


def test_outputs(spark):
    assert value(spark, text.longest_component(F.lit("Cl.CCO.CCN"))) == "CCO"
    good = "Reasoning: r\nOptimized_SMILES: CCO"
    assert value(spark, text.strict_format(F.lit(good)))
    assert tuple(value(spark, text.two_lines(F.lit("think</THINK> " + good + " <END>")))) == ("r", "CCO")
    assert not value(spark, text.strict_format(F.lit(good.replace("_", " "))))
    assert tuple(value(spark, text.lenient_output(F.lit("Reasoning: why\nOptimized SMILES: Cl.CCO, extra <END>")))) == ("why", "CCO")
    assert tuple(value(spark, text.lenient_output(F.lit("Optimized SMILES: <END>")))) == ("", "")
    prompts = "Task\nOriginal SMILES: CCN rest"
    assert value(spark, text.original_smiles(F.lit(prompts))) == "CCN"
    assert value(spark, text.original_smiles(F.lit(prompts), "line")) == "CCN rest"
    assert value(spark, text.original_smiles(F.lit("a: b\nc"), "colon")) == "b"
    assert value(spark, text.reasoning_slice(F.lit("x Reasoning: why Optimized_SMILES: C"), F.lit("f"))) == "why"
    assert value(spark, text.vina_affinity(F.lit("MODEL\nREMARK VINA RESULT:    -9.156  0.0 0.0"))) == -9.156


@pytest.mark.parametrize(("limit", "domain", "want"), [(2048, "chem", (716, 1332)), (2048, "other", (512, 1536)), (3072, "chem", (1024, 2048)), (3072, "other", (512, 2560))])
def test_budgets(spark, limit, domain, want):
    kept = value(spark, tokens.kept_lengths(F.lit(9000), F.lit(9000), limit, F.lit(domain)))
    assert (kept["prompt"], kept["answer"]) == want


def test_small_limits_are_rejected():
    with pytest.raises(ValueError):
        tokens.prompt_budget(512, F.lit("chem"))


def test_sequences(spark):
    ids = F.array(*map(F.lit, (1, 2, 3)))
    assert value(spark, tokens.tail(ids, F.lit(2))) == [2, 3]
    assert value(spark, tokens.tail(ids, F.lit(0))) == []
    assert value(spark, tokens.labels(ids, F.array(F.lit(7), F.lit(8)), 1)) == [-100, -100, -100, -100, 8]
    assert value(spark, tokens.padded(ids, F.lit(5), 0)) == [1, 2, 3, 0, 0]
    assert value(spark, tokens.attention(tokens.padded(ids, F.lit(5), 0), 0)) == [1, 1, 1, 0, 0]
    packed = tokens.pack_in_order(spark.createDataFrame([(k, n, "g") for k, n in enumerate((4, 4, 7, 2))], "k long, n int, g string"), length="n", order="k", group="g", limit=10)
    assert [r["pack_id"] for r in packed.orderBy("k").collect()] == [0, 0, 1, 1]
    assert value(spark, rollout.aligned(F.lit(None).cast("array<double>"), ids)) == [0.0, 0.0, 0.0]
    assert value(spark, rollout.generation_cap(F.lit(2090))) == 64


def test_advantages(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 5.0)], "g string, reward double")
    got = sorted((r["g"], round(r["advantage"], 6)) for r in rollout.advantages(rows, "g").collect())
    assert got == [("a", -0.707107), ("a", 0.707107), ("b", 0.0), ("b", 0.0), ("c", 0.0)]


def test_judges_and_selectivity(spark):
    assert value(spark, scoring.judge_blend(F.lit(0.5), F.lit(0.8))) == pytest.approx(0.68)
    assert value(spark, scoring.is_critical(F.lit(0.5), F.lit(0.39)))
    assert value(spark, matrix.selectivity(F.lit(-7.0), F.lit(None).cast("double"), F.lit(-9.1))) == pytest.approx(-2.1)


def test_statistics(spark):
    rows = spark.createDataFrame([(float(x), "g") for x in (1, 5, 2, 9, 4, 7)], "x double, g string")
    assert stats.upper_median(rows, "x", ["g"]).first()["upper_median"] == 5
    d = stats.described(rows, "x", []).first()
    assert stats.described(rows, "x", ["g"]).first()["median"] == 4.5
    assert (d["median"], d["p25"], round(d["std"], 6)) == (4.5, 2.5, 2.748737)
    assert stats.two_sided_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.two_sided_p(-0.5, 3) == pytest.approx(0.6514, abs=1e-4)


def test_orders_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    order = lambda df: [r["doc_id"] for r in mixing.shuffled(df, "s", "doc_id").collect()]
    assert order(rows.repartition(2)) == order(rows.repartition(7)) != list(range(500))
    assert mixing.replicate(rows, 3).count() == 1500
    assert mixing.keep_first(mixing.replicate(rows, 3), ["doc_id"], "copy").count() == 500


def test_record_fields(spark):
    from millrace.functions import records

    def of(**fields):
        return F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))

    reply = "Reasoning: why\nOptimized_SMILES: CCO"
    assert value(spark, records.predicted_smiles(of(output=reply, my_SMILES=" CCN "))) == "CCN"
    assert value(spark, records.optimized_smiles(of(output=reply, my_SMILES="CCN"))) == "CCO"
    assert value(spark, records.optimized_smiles(of(other="x"))) == ""
    assert value(spark, records.record_reasoning(of(output="none", Reasoning_text="r"))) == "r"
    assert value(spark, records.smiles_variants(F.lit(" C[C@H]O.Cl "))) == ["C[C@H]O.Cl", "C[CH]O.Cl", "C[C@H]O", "CO.Cl"]
    assert value(spark, records.smiles_variants(F.lit(" "))) == []
    spans = lambda text, alias: [tuple(x) for x in value(spark, records.alias_spans(F.lit(text), alias))]
    assert spans("the LogP of logp-s, clogp and logP", "logP") == [(4, 8), (12, 16), (30, 34)]
    assert spans("clogps", "logP") == [] and spans(None, "x y") == []
    assert spans("有毒性的毒性", "毒性") == [(1, 3)]
    assert value(spark, records.reasoning_quality(F.lit("Reduce 毒性"))) == pytest.approx((2 * 2 / 25 + 2 * 1 / 24 + 0 + 0) / 4 + 9 / 500)


def test_many_ranges_rank_as_few(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1009).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    few = stats.quantiles(rows, "x", ["g"], {"a": 0.1, "b": 0.77}).collect()
    monkeypatch.setattr(stats, "RANGE_VALUES", 10)
    assert sorted(stats.quantiles(rows, "x", ["g"], {"a": 0.1, "b": 0.77}).collect()) == sorted(few)
    for r in few:
        own = sorted(float(k * 7919 % 1009) for k in range(5000) if k % 3 == r["g"])
        for name, share in (("a", 0.1), ("b", 0.77)):
            at = share * (len(own) - 1)
            assert r[name] == pytest.approx(own[int(at)] + (own[int(at) + 1] - own[int(at)]) * (at - int(at)))


def test_phrases_beyond_one_expression(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, None), (3, "gamma")], "sample_id long, text string")
    phrases = spark.createDataFrame([("alpha", "A", "up", 1), ("beta", "A", "down", 0), ("", "E", "up", 2), ("mm", "G", "up", 3), ("mm", "H", "down", 4)], "phrase string, feature string, direction string, pos int")
    want = [(1, "A", "down"), (1, "E", "up"), (2, "E", "up"), (3, "E", "up"), (3, "G", "up"), (3, "H", "down")]
    rows = lambda **o: sorted(tuple(r) for r in scoring_op.phrase_features(texts, phrases, **o).collect())
    assert rows() == rows(inline=2) == want
    monkeypatch.setattr(scoring_op, "AUTOMATON", 2)
    assert rows(inline=2) == want


def test_caps_and_places_across_spans(spark):
    rows = spark.createDataFrame([(k, k % 4, "g") for k in range(100)], "k long, size long, g string")
    for span in (7, 1000):
        assert [r["k"] for r in mixing.until_cap(rows, "size", ["g"], "k", 20, span).orderBy("k").collect()] == list(range(15))
        assert {r["k"]: r["p"] for r in tokens.numbered_within(rows, ["size"], "k", "p", span).collect()} == {k: k // 4 for k in range(100)}


def test_a_batch_without_ids_ends_the_job(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (1, []), (2, [])], "b long, ids array<int>")
    assert [r["input_ids"] for r in tokens.padded_batches(rows.where("b = 1"), "b", "ids", "ids", 0).collect()] == [[1, 2]]
    assert tokens.padded_batches(rows, "b", "ids", "ids", 0, fatal=False).count() == 1
    with pytest.raises(Exception, match="no row with ids in batch 2"):
        tokens.padded_batches(rows, "b", "ids", "ids", 0).collect()
