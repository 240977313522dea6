"""Queries over orders, lineitem, part, events, embeddings, labels: scoring, statistics, vectors, rollouts, matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scoring
from millrace.operators import matrix, rollout, stats, vectors
from millrace.operators.scoring import corpus_report, sample_scores
from millrace.plans.corpus import table
from millrace.session import scratch
from millrace.streaming.rollout_log import to_sink, windowed


def json_property_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("name", "raw")).select("event_id", "name", scoring.number_of("raw").alias("value"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values written with a unit by id, parsed and taken to micromolar."""
    unit = F.element_at(F.array(*map(F.lit, ("mM", "uM", "nM", "pM", "%"))), (F.col("event_id") % 5 + 1).cast("int"))
    raw = F.concat(F.lit("<"), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit(" "), unit)
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.number_of(raw), 6).alias("converted"))


#: Line numbers repeat within an order.
_IN_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_IN_ORDER)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("o"), F.lead("l_quantity").over(w).alias("p"))
    return rows.where(F.col("p").isNotNull())


def feature_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of the change from a line's quantity to the next, by a direction for each return flag."""
    flag = F.col("l_returnflag")
    d = F.when(flag == "A", 1).when(flag == "N", -1).when(flag == "R", 0)
    reward = scoring.feature_reward(F.col("o"), F.col("p"), d, F.lit(10.0), F.lit(30.0), F.lit(25.0), F.lit(1.5))
    return _changes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(reward, 6).alias("reward"))


def _order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min_by("l_quantity", F.struct(*_IN_ORDER)).alias("o"), F.max_by("l_quantity", F.struct(*_IN_ORDER)).alias("p"))
    both = F.explode(F.array(F.struct(F.lit("orig").alias("role"), F.col("o").alias("value")), F.struct(F.lit("opt").alias("role"), F.col("p").alias("value"))))
    features = lines.select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("feature"), both.alias("x")).select("sample_id", "feature", "x.*")
    bad = features.where("value > 40").select("sample_id", "role", "feature")
    dims = spark.createDataFrame([("A", 1, None, None, 25.0, 2.0, True), ("N", -1, None, None, 25.0, 1.0, False), ("R", 0, 10.0, 30.0, None, 1.5, True)], "feature string, direction int, lo double, hi double, threshold double, weight double, is_core boolean")
    return sample_scores(features, bad, dims)


def sample_score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of orders: their lines' flags as features, the first and the last line of a flag as before and after."""
    return _order_scores(spark, sf_dir).select("sample_id", F.round("base", 6).alias("base"), F.round("coverage", 6).alias("coverage"), F.round("efficiency", 6).alias("efficiency"), F.round("total", 6).alias("total"), "improved", "degraded")


def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, A5: the report of all orders' scores, with their mean coverage of the core features."""
    report = corpus_report(_order_scores(spark, sf_dir), core="n_core")
    return report.select("count", F.round("mean", 3).alias("mean"), *(F.round(c, 4).alias(c) for c in ("min", "max", "median", "std")), "core_coverage")


def upper_median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.upper_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


def describe_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.described(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return d.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "p25", "p75")))


def histogram_closed_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.closed_histogram(table(spark, sf_dir, "lineitem"), F.round(F.col("l_discount") * 10, 6))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.two_groups(rows, "n_chars", F.col("quality") == 1, F.col("quality") == 0)


def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("n1", "n2", F.round("cohens_d", 6).alias("cohens_d"), scoring.effect_label(F.round("cohens_d", 6)).alias("effect"))


def ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select(F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"), F.round("t", 6).alias("t"), "dof", F.round("p", 6).alias("p"))


def ttest_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of good and of other documents, for each language at once, with their P."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.two_groups(rows, "n_chars", F.col("quality") == 1, F.col("quality") == 0, ["lang"]).select("lang", "dof", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_id") % 7 != 0
    reward = scoring.capped_reward(ok, F.col("event_type"), F.col("value") / 10)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(reward, 6).alias("reward"))
    return rollout.advantages(rows, "user_id").select("event_id", "user_id", "reward", F.round("advantage", 5).alias("advantage"))


def clipped_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives with slices of each vector as log probabilities, its label deciding advantage and mask."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    part = lambda k: F.slice(v, 1 + 16 * k, 16)
    loss = rollout.token_objective(part(0), part(1), part(2), F.col("label") - F.lit(4.5))
    mask = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: (k <= F.col("label")).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(rollout.masked_mean(loss, mask), 6).alias("loss"))


#: About how many labels' means are broadcast at a time.
MOST_LABELS = 4096


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_centroids(table(spark, sf_dir, "embeddings"))


def cosine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest label mean of every vector; the means are a row for each label."""
    rows, means = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _centroids(spark, sf_dir)
    # Labels go in blocks, each broadcast as one row of arrays, so that any number of them can be met.
    blocks = -(-max(means.count(), 1) // MOST_LABELS)
    nearest = []
    for k in range(blocks):
        own = means.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("means"))
        far = F.transform("means", lambda m: F.struct(vectors.cosine_distance(F.col("embedding"), m["centroid"]).alias("d"), m["label"].alias("label")))
        nearest.append(rows.join(F.broadcast(own), how="inner").select("vec_id", F.array_min(far).alias("best")))
    found = nearest[0] if blocks == 1 else reduce(DataFrame.union, nearest).groupBy("vec_id").agg(F.min("best").alias("best"))
    return found.select("vec_id", F.col("best.label").alias("nearest"), F.round("best.d", 6).alias("distance"))


def novelty_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of labels as texts, their vectors as sentences."""
    distances = cosine_nearest(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    out = vectors.text_novelty(distances, vectors.distance_norm(distances), text="label")
    return out.select("label", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("novelty", 4).alias("novelty"), "tier")


def kmeans_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    centres = vectors.fit_centroids(rows, k=10, tries=2)
    return vectors.nearest_centroid(rows, centres).groupBy("centroid").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance"))


TARGETS = ("north", "south")


def stub_affinity(smiles: str, target: str) -> float | None:
    """A stand-in for a docking tool: a number from the name's digits; some targets fail."""
    n = int("".join(c for c in smiles if c.isdigit()) or 0)
    if target == "south" and n % 5 == 0:
        raise ValueError("no pose")
    return -((n * (7 if target == "north" else 11)) % 100) / 10


def docking_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("smiles"))
    done = matrix.result_matrix(items, list(TARGETS), stub_affinity)
    return done.withColumn("selectivity", F.round("selectivity", 6))


def judge_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies written from labels, read back: every seventh has no JSON in it."""
    reply = lambda score, flag: F.when(F.col("doc_id") % 7 == 0, "no verdict").otherwise(F.concat(F.lit("Verdict: "), F.to_json(F.struct(score.alias("score"), flag.alias("flag"))), F.lit(" end")))
    rows = table(spark, sf_dir, "labels").select("doc_id", reply(F.col("quality") * 0.6 + 0.2, F.col("toxic") == 1).alias("rigor_reply"), reply(F.col("doc_id") % 10 / 10, F.lit(False)).alias("logic_reply"))
    return matrix.judged(rows).select("doc_id", F.round("rigor", 6).alias("rigor"), F.round("logic", 6).alias("logic"), F.round("score", 6).alias("score"), "critical")


def rollout_stream_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, mean values and shares of clicks by a stream over events that stops when all is read."""
    out = scratch(spark, "rollout")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    ok = stream.withColumn("ok_format", F.col("event_type") == "click").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = windowed(ok, time="ts", reward="value")
    # A batch of the complete mode holds the whole result, so the last one stands for all.
    to_sink(hourly, lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows"), f"{out}/checkpoint", mode="complete").awaitTermination()
    return spark.read.schema(hourly.schema).parquet(f"{out}/rows").select("window_start", "n", F.round("mean_reward", 6).alias("mean_reward"), F.round("ok_share", 6).alias("ok_share"))


QUERIES = {
    f.__name__: f
    for f in (
        json_property_numeric, unit_convert, feature_reward, sample_score_rollup, sample_report, upper_median_by_group, describe_percentiles, histogram_closed_last, cohens_d,
        ttest, ttest_by_language, spearman_rank, group_advantage, clipped_objective, cosine_nearest, novelty_tier, kmeans_summary, docking_matrix, judge_blend, rollout_stream_agg,
    )
}

_REWARD = """
    CASE WHEN d IS NULL THEN 0.0 WHEN d <> 0 THEN
        CASE WHEN g > 0 THEN 2.0 + CASE WHEN (d = 1 AND o < t AND p >= t) OR (d = -1 AND o > t AND p <= t) THEN 2.5 ELSE 0.0 END + 1.5 * least(r, 2.0)
             WHEN g < 0 THEN -1.5 * CASE WHEN r < 0.05 THEN 0.2 WHEN r < 0.15 THEN 0.5 ELSE 1.0 END - CASE WHEN (d = 1 AND o >= t AND p < t) OR (d = -1 AND o <= t AND p > t) THEN 2.0 ELSE 0.0 END + 1.2 * least(r, 2.0)
             ELSE 0.0 END
    ELSE CASE WHEN bo > 0 AND bp = 0 THEN 3.5 WHEN bo = 0 AND bp > 0 THEN -2.8 ELSE 0.0 END + CASE WHEN bo - bp > 0 THEN 1.5 * least(bo - bp, 2.0) WHEN bo - bp < 0 THEN 1.2 * least(bp - bo, 2.0) ELSE 0.0 END END"""
_TERMS = "(d * (p - o))::DOUBLE AS g, abs(p - o) / greatest(abs(o), 0.1) AS r, greatest(10.0 - o, o - 30.0, 0.0) AS bo, greatest(10.0 - p, p - 30.0, 0.0) AS bp"
_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_NEAREST = f"""
    WITH long AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
    means AS (SELECT label, list(x ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS x FROM long GROUP BY label, k) GROUP BY label),
    far AS (SELECT vec_id, m.label AS label, 1 - {_DOT.format('embedding', 'c')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('c', 'c')})) AS d FROM embeddings, means m)
    SELECT vec_id, arg_min(label, d) AS nearest, min(d) AS distance FROM far GROUP BY vec_id"""

_T_AND_DOF = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS dof"
#: The finite sums in the angle atan(t / sqrt(dof)) for even and for odd degrees of freedom.
_P_OF_T = """(1 - CASE WHEN dof % 2 = 0
    THEN abs(t) / sqrt(dof + t * t) * list_sum(list_transform(range(0, dof // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * ln(dof / (dof + t * t)))))
    ELSE 2 / pi() * (atan(abs(t) / sqrt(dof)) + abs(t) / sqrt(dof + t * t) * coalesce(list_sum(list_transform(range(0, (dof - 1) // 2), lambda k: exp(ln(pi()) / 2 + lgamma(k + 1) - ln(2) - lgamma(k + 1.5) + (k + 0.5) * ln(dof / (dof + t * t))))), 0)) END)"""

ORACLE_SQL = {
    "json_property_numeric": "SELECT event_id, k AS name, try_cast(json_extract_string(props, '$.' || k) AS DOUBLE) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "unit_convert": "SELECT event_id, round(round(value * 100)::BIGINT * CASE event_id % 5 WHEN 0 THEN 1000.0::DOUBLE WHEN 2 THEN 1::DOUBLE / 1000 WHEN 3 THEN 1::DOUBLE / 1000000 ELSE 1.0::DOUBLE END, 6)::DOUBLE AS converted FROM events",
    "feature_reward": f"""
        WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS o, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem),
        y AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN -1 WHEN 'R' THEN 0 END AS d, 25.0 AS t FROM x WHERE p IS NOT NULL),
        z AS (SELECT *, {_TERMS} FROM y)
        SELECT l_orderkey, l_linenumber, round(greatest(least(({_REWARD}) * 1.5, 3.0), -3.0), 6)::DOUBLE AS reward FROM z""",
    "sample_score_rollup": f"""
        WITH x AS (SELECT l_orderkey AS sample_id, l_returnflag AS f, first(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS o, last(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem GROUP BY 1, 2),
        y AS (SELECT *, CASE f WHEN 'A' THEN 1 WHEN 'N' THEN -1 WHEN 'R' THEN 0 END AS d, CASE WHEN f <> 'R' THEN 25.0 END AS t, CASE f WHEN 'A' THEN 2.0 WHEN 'N' THEN 1.0 ELSE 1.5 END::DOUBLE AS w, f <> 'N' AS core, o > 40 AS ob, p > 40 AS pb FROM x),
        z AS (SELECT *, {_TERMS} FROM y),
        s AS (SELECT *, greatest(least(({_REWARD})::DOUBLE * w, 2 * w), -2 * w) AS reward FROM z),
        l AS (SELECT *, CASE WHEN ob THEN reward ELSE 0.5 * reward END + CASE WHEN pb AND NOT ob THEN -0.3 ELSE 0.0 END AS part, 1 + (pb AND NOT ob)::INT AS listed FROM s),
        per AS (SELECT sample_id, sum(part) / (2 * sum(listed * w)) AS base, 0.1 * least(coalesce(sum(listed) FILTER (core), 0) / 16.0, 1.0) AS coverage, count(*) FILTER (reward > 0) AS improved, count(*) FILTER (reward < 0) AS degraded FROM l GROUP BY sample_id),
        e AS (SELECT *, CASE WHEN improved + degraded > 0 AND improved / (improved + degraded) > 0.5 THEN 0.2 * (improved / (improved + degraded) - 0.5) ELSE 0.0 END AS efficiency FROM per)
        SELECT sample_id, round(base, 6)::DOUBLE AS base, round(coverage, 6)::DOUBLE AS coverage, round(efficiency, 6)::DOUBLE AS efficiency,
            round(0.8 * CASE WHEN base >= 0 THEN least(base + coverage + efficiency, 1.0) ELSE greatest(base, -1.0) END, 6)::DOUBLE AS total, improved, degraded FROM e""",
    "upper_median_by_group": "SELECT l_returnflag, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_returnflag",
    "describe_percentiles": "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4)::DOUBLE AS mean, round(quantile_cont(o_totalprice, 0.5), 4)::DOUBLE AS median, round(stddev_pop(o_totalprice), 4)::DOUBLE AS std, round(min(o_totalprice), 4)::DOUBLE AS min, round(max(o_totalprice), 4)::DOUBLE AS max, round(quantile_cont(o_totalprice, 0.25), 4)::DOUBLE AS p25, round(quantile_cont(o_totalprice, 0.75), 4)::DOUBLE AS p75 FROM orders GROUP BY o_orderpriority",
    "histogram_closed_last": "SELECT least(floor(x * 5), 4)::INT AS bin, count(*) AS n FROM (SELECT round(l_discount * 10, 6) AS x FROM lineitem) WHERE x BETWEEN 0 AND 1 GROUP BY 1",
    "cohens_d": """
        WITH g AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n2, avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality = 0) AS m2,
            stddev_pop(n_chars) FILTER (quality = 1) AS s1, stddev_pop(n_chars) FILTER (quality = 0) AS s2 FROM documents JOIN labels USING (doc_id)),
        d AS (SELECT n1, n2, round((m1 - m2) / sqrt((s1 * s1 + s2 * s2) / 2), 6)::DOUBLE AS cohens_d FROM g)
        SELECT *, CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d""",
    "ttest": f"""
        WITH g AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n2, avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality = 0) AS m2,
            var_samp(n_chars) FILTER (quality = 1) AS v1, var_samp(n_chars) FILTER (quality = 0) AS v2 FROM documents JOIN labels USING (doc_id))
        SELECT round(m1, 4)::DOUBLE AS mean1, round(m2, 4)::DOUBLE AS mean2, round(t, 6)::DOUBLE AS t, dof, round({_P_OF_T}, 6)::DOUBLE AS p FROM (SELECT *, {_T_AND_DOF} FROM g)""",
    "ttest_by_language": f"""
        WITH g AS (SELECT lang, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n2, avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality = 0) AS m2,
            var_samp(n_chars) FILTER (quality = 1) AS v1, var_samp(n_chars) FILTER (quality = 0) AS v2 FROM documents JOIN labels USING (doc_id) GROUP BY lang)
        SELECT lang, dof, round(t, 6)::DOUBLE AS t, round({_P_OF_T}, 6)::DOUBLE AS p FROM (SELECT *, {_T_AND_DOF} FROM g)""",
    "spearman_rank": """
        WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
        SELECT round(corr(a, b), 6)::DOUBLE AS spearman FROM r""",
    "group_advantage": """
        WITH r AS (SELECT event_id, user_id, round(CASE WHEN event_id % 7 = 0 OR event_type = '' OR value IS NULL THEN -2.0::DOUBLE ELSE greatest(least(value / 10, 10.0), -10.0) END, 6)::DOUBLE AS reward FROM events),
        s AS (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS s FROM r WINDOW w AS (PARTITION BY user_id))
        SELECT event_id, user_id, reward, round(CASE WHEN n < 2 THEN 0 ELSE (reward - m) / greatest(s, 1e-4) END, 5)::DOUBLE AS advantage FROM s""",
    "clipped_objective": """
        WITH t AS (SELECT vec_id, label, unnest(range(1, 17)) AS k, embedding FROM embeddings),
        x AS (SELECT vec_id, label, embedding[k]::DOUBLE AS l, embedding[k + 16]::DOUBLE AS o, embedding[k + 32]::DOUBLE AS r, (label - 4.5)::DOUBLE AS a FROM t WHERE k <= label),
        y AS (SELECT vec_id, avg(-(least(exp(l - o) * a, greatest(least(exp(l - o), 1.2), 0.8) * a) - 0.04 * (exp(r - l) - (r - l) - 1))) AS loss FROM x GROUP BY vec_id)
        SELECT e.vec_id, round(loss, 6)::DOUBLE AS loss FROM embeddings e LEFT JOIN y USING (vec_id)""",
    "cosine_nearest": f"SELECT vec_id, nearest, round(distance, 6)::DOUBLE AS distance FROM ({_NEAREST})",
    "novelty_tier": f"""
        WITH n AS (SELECT vec_id, round(distance, 6)::DOUBLE AS distance FROM ({_NEAREST})),
        q AS (SELECT CASE WHEN quantile_cont(distance, 0.9) < 1e-6 THEN 1.0 ELSE quantile_cont(distance, 0.9) END AS norm FROM n),
        p AS (SELECT label, avg(distance) AS mean, stddev_pop(distance) AS std FROM n JOIN embeddings USING (vec_id) GROUP BY label),
        x AS (SELECT *, mean / norm AS x FROM p, q)
        SELECT label, round(mean, 5)::DOUBLE AS mean, round(std, 5)::DOUBLE AS std, round(CASE WHEN x < 0.5 THEN 0.4 + 0.6 * x WHEN x < 0.65 THEN 0.7 + (x - 0.5) / 0.15 * 0.2
            WHEN x < 1.05 THEN 0.9 + 0.1 * exp(-(x - 0.85) * (x - 0.85) / (2 * 0.15 * 0.15)) WHEN x < 1.3 THEN 0.9 - (x - 1.05) / 0.25 * 0.3 WHEN x < 1.8 THEN 0.6 - (x - 1.3) / 0.5 * 0.3
            ELSE greatest(0.1, 0.3 - (x - 1.8) * 0.05) END, 4)::DOUBLE AS novelty,
            CASE WHEN x < 0.5 THEN 1 WHEN x < 0.65 THEN 2 WHEN x < 1.05 THEN 3 WHEN x < 1.3 THEN 4 WHEN x < 1.8 THEN 5 ELSE 6 END AS tier FROM x""",
    "docking_matrix": r"""
        WITH n AS (SELECT c_custkey::VARCHAR AS id, c_name AS smiles, coalesce(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), ''), '0')::BIGINT AS n FROM customer),
        a AS (SELECT id, smiles, -((n * 7) % 100) / 10::DOUBLE AS x, CASE WHEN n % 5 = 0 THEN NULL ELSE -((n * 11) % 100) / 10::DOUBLE END AS y FROM n)
        SELECT id, smiles, x AS north_affinity, 1 AS north_rank, y AS south_affinity, CASE WHEN y IS NULL THEN NULL ELSE 1 END AS south_rank, round(y - x, 6)::DOUBLE AS selectivity FROM a""",
    "judge_blend": """
        WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE quality * 0.6 + 0.2 END::DOUBLE AS rigor, CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE doc_id % 10 / 10 END::DOUBLE AS logic, doc_id % 7 <> 0 AND toxic = 1 AS flag FROM labels)
        SELECT doc_id, round(rigor, 6)::DOUBLE AS rigor, round(logic, 6)::DOUBLE AS logic, round(0.4 * rigor + 0.6 * logic, 6)::DOUBLE AS score, flag OR rigor < 0.4 OR logic < 0.4 AS critical FROM s""",
    "rollout_stream_agg": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, round(avg(value), 6)::DOUBLE AS mean_reward, round(avg((event_type = 'click')::INT), 6)::DOUBLE AS ok_share FROM events GROUP BY 1",
}

ORACLE_SQL["sample_report"] = f"""
    SELECT count(*) AS count, round(avg(total), 3)::DOUBLE AS mean, round(min(total), 4)::DOUBLE AS min, round(max(total), 4)::DOUBLE AS max, round(list_sort(list(total))[count(*) // 2 + 1], 4)::DOUBLE AS median,
        round(stddev_pop(total), 4)::DOUBLE AS std, round(avg(coverage * 10), 4)::DOUBLE AS core_coverage FROM ({ORACLE_SQL["sample_score_rollup"]})"""
