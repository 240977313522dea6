"""Queries of token sequences, rollouts, vectors and statistics, over texts and vectors of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import matrix, rollout, stats, tokens, vectors
from millrace.operators.scoring import corpus_report
from millrace.plans.analytics import TARGETS, stub_affinity
from millrace.plans.corpus import KEYWORDS, table


def _line(k: int) -> Column:
    return F.substring_index("text", "\n", k)


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document's first line as prompt, and of its whole text as answer."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_length(_line(1), F.col("text")).alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", tokens.words(_line(1)).alias("prompt"), tokens.words("text").alias("answer"))
    return rows.withColumn("domain", F.when(F.col("lang") == "en", "chem").otherwise("other"))


def truncated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a limit of 600 leaves of a prompt and its answer (the cut is the feature), by count and digest."""
    cut = _pairs(spark, sf_dir).select("doc_id", tokens.truncated(F.col("prompt"), F.col("answer"), 600, F.col("domain")).alias("t"))
    digest = lambda c: F.md5(F.concat_ws(" ", c).cast("binary"))
    return cut.select("doc_id", F.size("t.prompt").alias("prompt_n"), F.size("t.answer").alias("answer_n"), digest(F.col("t.prompt")).alias("prompt_md5"), digest(F.col("t.answer")).alias("answer_md5"))


def _turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the lengths of their words as ids; of some turns none are left."""
    ids = F.transform(tokens.words("text"), F.length)
    kept = F.when(F.col("turn") % 5 == 4, F.slice(ids, 1, 0)).otherwise(ids)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", kept.alias("ids"))


def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: labels of a turn's first three ids as prompt and the others as answer, whose first one is ignored too."""
    rows = _turn_ids(spark, sf_dir).select("conv_id", "turn", F.slice("ids", 1, 3).alias("p"), F.slice("ids", 4, 1 << 30).alias("a"))
    label = tokens.labels(F.col("p"), F.col("a"), 1)
    return rows.select("conv_id", "turn", F.size(label).alias("n"), F.size(F.filter(label, lambda x: x == tokens.IGNORED)).alias("ignored"), F.aggregate(label, F.lit(0), lambda s, x: s + x).alias("total"))


def padded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation padded to its longest one; empty ones are left out."""
    rows = _turn_ids(spark, sf_dir).withColumn("label", F.transform("ids", lambda x: x + 1))
    out = tokens.padded_batches(rows, "conv_id", "ids", "label", 0, fatal=False)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return out.select("conv_id", "turn", F.size("input_ids").alias("n"), total("input_ids").alias("ids"), total("attention_mask").alias("attended"), total("labels").alias("labels"))


def prompt_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 2032 words of whole texts as prompts (the clip is the feature), and what they leave to generate."""
    words = tokens.words("text")
    kept = rollout.clipped_prompt(words)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("kept"), F.get(kept, F.lit(0)).alias("first"), rollout.generation_cap(F.size(words)).cast("int").alias("allowed"))


def token_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's label spread over its first ids, and its components as log probabilities aligned with them."""
    ids = F.sequence(F.lit(1), F.col("label") + 60)
    logps = F.when(F.col("vec_id") % 4 != 0, F.transform("embedding", lambda x: x.cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    rewards, aligned = rollout.spread(F.col("label") / 2, ids), rollout.aligned(logps, ids)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(rewards).alias("n"), F.round(total(rewards), 6).alias("rewards"), F.size(aligned).alias("aligned"), F.round(total(aligned), 6).alias("logps"))


def token_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of the label's entry of each vector."""
    logits = F.transform("embedding", lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(rollout.log_softmax_at(logits, F.col("label")), 6).alias("logp"))


def answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of whole texts as candidates of a prompt, keyed by their places; blank ones are left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("answers"))
    return rollout.candidates(rows, "answers", "doc_id").select("doc_id", "j", F.md5(F.col("candidate").cast("binary")).alias("candidate_md5"))


def prompt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and largest of all documents' lengths in words."""
    lengths = table(spark, sf_dir, "documents").select(F.size(tokens.words("text")).alias("n"))
    return rollout.prompt_stats(lengths, "n").withColumn("mean", F.round("mean", 6))


def score_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and agreement in thirds of two scores of every line."""
    rows = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 10, 6).alias("a"), F.round(F.col("l_tax") * 12, 6).alias("b"))
    both = stats.pearson(rows, "a", "b").join(F.broadcast(stats.tier_agreement(rows, "a", "b")), how="inner")
    return both.select(F.round("pearson", 6).alias("pearson"), "agreement")


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: the report of all documents' keyword scores."""
    scores = table(spark, sf_dir, "documents").select(F.round(text.keyword_score("text", KEYWORDS), 4).alias("total"))
    return corpus_report(scores).withColumn("std", F.round("std", 6))


def docking_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules that were prepared and docked, and those that failed."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("smiles"))
    return matrix.outcomes(items, matrix.result_matrix(items, list(TARGETS), stub_affinity, lambda s: None if s.endswith("3") else s))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of k-means over all vectors, from the vectors 1 to 4."""
    rows = table(spark, sf_dir, "embeddings")
    start = [[float(x) for x in r["embedding"]] for r in rows.where("vec_id BETWEEN 1 AND 4").orderBy("vec_id").collect()]
    return vectors.lloyd_round(rows, start).select("cluster", F.posexplode("centroid").alias("k", "x")).select("cluster", "k", F.round("x", 6).alias("x"))


def encode(sentences: list[str]) -> list[list[float]]:
    """A stand-in for a sentence encoder: a sentence's length and its number of e."""
    return [[float(len(s)), float(1 + s.count("e"))] for s in sentences]


_CENTROIDS, _NORM = [[10.0, 1.0], [1.0, 1.0]], 0.05


def text_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of all documents, in one batch."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return vectors.evaluated(docs, encode, _CENTROIDS, _NORM).select("text_id", F.round("mean", 5).alias("mean"), F.round("min", 5).alias("min"), F.round("max", 5).alias("max"), F.round("novelty", 4).alias("novelty"))


def file_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: novelty of the reasonings in a file's first 150 lines, unreadable ones counted (the cap on lines is the feature)."""
    from millrace.plans.readers import _files, _json
    from millrace.sources.lines import lines

    field = F.when(F.col("item_id") % 2 == 0, _json(reasoning=F.col("text"))).otherwise(_json(output=F.concat(F.lit("Reasoning: "), "text", F.lit("\nOptimized_SMILES: C"))))
    path = _files(table(spark, sf_dir, "benchmark").coalesce(1).sortWithinPartitions("item_id"), "item_id", F.when(F.col("item_id") % 7 == 0, "not json").otherwise(field), "richness")
    return vectors.evaluated_file(lines(spark, path), encode, _CENTROIDS, _NORM, 150).select("text_id", F.round("mean", 5).alias("mean"), F.round("novelty", 4).alias("novelty"))


QUERIES = {
    f.__name__: f
    for f in (
        token_lengths, truncated_pairs, label_masks, padded_turns, prompt_clip, token_rewards, token_logprob, answer_candidates, prompt_lengths, score_agreement,
        score_report, docking_outcomes, kmeans_step, text_richness, file_richness,
    )
}

_W = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_FIRST_LINE = "split_part(text, chr(10), 1)"
_IDS = f"SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN []::INT[] ELSE list_transform({_W.format('text')}, lambda w: length(w)::INT) END AS ids FROM conversations"
_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_NOVELTY = """CASE WHEN x < 0.5 THEN 0.4 + 0.6 * x WHEN x < 0.65 THEN 0.7 + (x - 0.5) / 0.15 * 0.2 WHEN x < 1.05 THEN 0.9 + 0.1 * exp(-(x - 0.85) * (x - 0.85) / (2 * 0.15 * 0.15))
            WHEN x < 1.3 THEN 0.9 - (x - 1.05) / 0.25 * 0.3 WHEN x < 1.8 THEN 0.6 - (x - 1.3) / 0.5 * 0.3 ELSE greatest(0.1, 0.3 - (x - 1.8) * 0.05) END"""


def _richness_sql(source: str, columns: str) -> str:
    far = "1 - ({a} * n + {b} * e) / (sqrt(n * n + e * e) * sqrt({a} * {a} + {b} * {b}))"
    return rf"""
        WITH s AS (SELECT text_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\n\.!?]\s+'), lambda p: regexp_replace(p, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda p: length(p) >= 8)) AS s FROM ({source})),
        v AS (SELECT text_id, length(s)::DOUBLE AS n, (1 + length(s) - length(replace(s, 'e', '')))::DOUBLE AS e FROM s),
        d AS (SELECT text_id, least({far.format(a='10.0::DOUBLE', b='1.0::DOUBLE')}, {far.format(a='1.0::DOUBLE', b='1.0::DOUBLE')}) AS d FROM v),
        p AS (SELECT text_id, avg(d) AS mean, min(d) AS min, max(d) AS max, avg(d) / {_NORM} AS x FROM d GROUP BY text_id)
        SELECT text_id, round(mean, 5)::DOUBLE AS mean, {columns} round({_NOVELTY}, 4)::DOUBLE AS novelty FROM p"""


ORACLE_SQL = {
    "token_lengths": f"SELECT doc_id, (len({_W.format(_FIRST_LINE)}) + len({_W.format('text')}))::INT AS n FROM documents",
    "truncated_pairs": f"""
        WITH p AS (SELECT doc_id, {_W.format(_FIRST_LINE)} AS p, {_W.format('text')} AS a, CASE WHEN lang = 'en' THEN 512 ELSE 256 END AS budget FROM documents),
        n AS (SELECT *, len(p) + len(a) > 600 AS over FROM p),
        k AS (SELECT *, CASE WHEN over THEN least(len(a), 600 - budget) ELSE len(a) END AS ka FROM n),
        m AS (SELECT *, CASE WHEN over THEN least(len(p), 600 - ka) ELSE len(p) END AS kp FROM k)
        SELECT doc_id, kp::INT AS prompt_n, ka::INT AS answer_n, md5(coalesce(array_to_string(p[len(p) - kp + 1 :], ' '), '')) AS prompt_md5, md5(coalesce(array_to_string(a[len(a) - ka + 1 :], ' '), '')) AS answer_md5 FROM m""",
    "label_masks": f"""
        SELECT conv_id, turn, len(ids)::INT AS n, least(len(ids), 4)::INT AS ignored, (-100 * least(len(ids), 4) + coalesce(list_sum(ids[5:]), 0))::INT AS total FROM ({_IDS})""",
    "padded_turns": f"""
        WITH m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS top FROM ({_IDS}))
        SELECT conv_id, turn, top::INT AS n, list_sum(ids)::INT AS ids, len(ids)::INT AS attended, (list_sum(ids) + len(ids) - 100 * (top - len(ids)))::INT AS labels FROM m WHERE len(ids) > 0""",
    "prompt_clip": f"""
        WITH w AS (SELECT doc_id, {_W.format('text')} AS w FROM documents)
        SELECT doc_id, least(len(w), 2032)::INT AS kept, w[greatest(len(w) - 2032, 0) + 1] AS first, greatest(64, least(656, 2096 - len(w) - 1))::INT AS allowed FROM w""",
    "token_rewards": """
        SELECT vec_id, (label + 60)::INT AS n, round(label / 2 * (label + 60), 6)::DOUBLE AS rewards, CASE WHEN vec_id % 4 = 0 THEN label + 60 ELSE least(label + 60, 64) END::INT AS aligned,
            round(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE list_sum(embedding[: label + 60]::DOUBLE[]) END, 6)::DOUBLE AS logps FROM embeddings""",
    "token_logprob": """
        WITH l AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 10) AS l FROM embeddings)
        SELECT vec_id, round(l[label + 1] - list_max(l) - ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))), 6)::DOUBLE AS logp FROM l""",
    "answer_candidates": "SELECT doc_id, (j - 1)::INT AS j, md5(c) AS candidate_md5 FROM (SELECT doc_id, unnest(s) AS c, generate_subscripts(s, 1) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(c) <> ''",
    "prompt_lengths": f"SELECT count(n) AS count, round(avg(n), 6)::DOUBLE AS mean, max(n)::INT AS max FROM (SELECT len({_W.format('text')}) AS n FROM documents)",
    "score_agreement": """
        WITH s AS (SELECT round(l_discount * 10, 6) AS a, round(l_tax * 12, 6) AS b FROM lineitem)
        SELECT round(corr(a, b), 6)::DOUBLE AS pearson, round(avg((CASE WHEN a <= 0.33 THEN 0 WHEN a <= 0.66 THEN 1 ELSE 2 END = CASE WHEN b <= 0.33 THEN 0 WHEN b <= 0.66 THEN 1 ELSE 2 END)::INT), 4)::DOUBLE AS agreement FROM s""",
    "score_report": f"""
        WITH s AS (SELECT round(least(len(list_filter({_KEYS}, lambda k: contains(lower(text), k))) / len({_KEYS})::DOUBLE * 2, 1.0), 4)::DOUBLE AS v FROM documents)
        SELECT count(*) AS count, round(avg(v), 4)::DOUBLE AS mean, min(v) AS min, max(v) AS max, list_sort(list(v))[count(*) // 2 + 1] AS median, round(stddev_pop(v), 6)::DOUBLE AS std FROM s""",
    "docking_outcomes": "SELECT count(*) FILTER (NOT ends_with(c_name, '3')) AS successful, count(*) FILTER (ends_with(c_name, '3')) AS failed FROM customer",
    "kmeans_step": """
        WITH s AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cluster, embedding AS c FROM embeddings WHERE vec_id BETWEEN 1 AND 4),
        f AS (SELECT vec_id, cluster, list_distance(embedding::DOUBLE[], c::DOUBLE[]) AS d FROM embeddings, s),
        n AS (SELECT vec_id, arg_min(cluster, d) AS cluster FROM f GROUP BY vec_id),
        x AS (SELECT cluster, (generate_subscripts(embedding, 1) - 1)::INT AS k, unnest(embedding)::DOUBLE AS x FROM n JOIN embeddings USING (vec_id))
        SELECT cluster, k, round(avg(x), 6)::DOUBLE AS x FROM x GROUP BY cluster, k""",
    "text_richness": _richness_sql("SELECT doc_id AS text_id, text FROM documents", "round(min, 5)::DOUBLE AS min, round(max, 5)::DOUBLE AS max,"),
    "file_richness": _richness_sql("SELECT * FROM (SELECT row_number() OVER (ORDER BY item_id) AS text_id, item_id, text FROM benchmark) WHERE text_id <= 150 AND item_id % 7 <> 0", ""),
}
