"""Queries over conversations, documents, pages and benchmark: ingest, mixing, lengths, text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scoring, text
from millrace.operators import mixing, tokens
from millrace.operators.scoring import corpus_report as scoring_report
from millrace.operators.scoring import phrase_features, top_features
from millrace.operators.stats import binary_f1

SEED = "7"
KEYWORDS = ["the", "and", "ing", "tion", "with", "here", "ent", "the"]
PHRASES = [("the", "article", "up", 0), ("tion", "noun", "up", 1), ("ing", "verb", "down", 2), ("and the", "article", "down", 3), ("mente", "adverb", "up", 4), ("keit", "noun", "down", 5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user and first assistant text of each conversation; conversations with neither are left out."""
    said = F.trim("text") != ""
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & said)
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.trim("text")), F.when(F.col("role") == role, F.col("turn")))
    return turns.groupBy("conv_id").agg(first("user").alias("user"), first("assistant").alias("assistant"))


def mixed_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tripled, with first-turn chats: rows by source."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("cpt-"), "lang").alias("source"))
    mixed = mixing.union_sources([mixing.replicate(docs, 3).select("source"), None, chat_first_turn(spark, sf_dir).select(F.lit("chat").alias("source"))])
    return mixed.groupBy("source").agg(F.count("*").alias("n"))


def language_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents of each language (the cap is the feature)."""
    return mixing.cap_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 50)


def seeded_shuffle_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 first documents of a seeded order (a sample of fixed size)."""
    key = mixing.seeded_key(SEED, "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", key.alias("shuffle_key")).orderBy("shuffle_key", "doc_id").limit(100)


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.train_validation(table(spark, sf_dir, "documents").select("doc_id"), SEED, "doc_id")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.size(tokens.words("text")).alias("n"))


def length_cap_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_cap(_lengths(spark, sf_dir), "n", group=["lang"])


def length_sorted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_sorted_batches(_lengths(spark, sf_dir), "n", "doc_id", 32, ["source"]).select("doc_id", "source", "n", F.col("batch_id").cast("long").alias("batch_id"))


def truncation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids kept of each document's first line as prompt and the rest as answer, at 2048."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", "chem").otherwise("ultrachat").alias("domain"), F.substring_index("text", "\n", 1).alias("p"), "text")
    sized = rows.select("doc_id", "domain", F.size(tokens.words("p")).alias("prompt_n"), F.size(tokens.words(F.substr("text", F.length("p") + 1))).alias("answer_n"))
    kept = tokens.kept_lengths(F.col("prompt_n"), F.col("answer_n"), 2048, F.col("domain"))
    return sized.select("doc_id", "domain", "prompt_n", "answer_n", kept["prompt"].cast("int").alias("prompt_kept"), kept["answer"].cast("int").alias("answer_kept"))


def sequence_packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 1024 that each batch of 32 documents of a source packs into, in order; documents above 1024 stand alone."""
    batched = length_sorted_batches(spark, sf_dir).withColumn("batch", F.concat_ws("/", "source", F.col("batch_id").cast("string")))
    packed = tokens.pack_in_order(batched.select("batch", "doc_id", "n"), length="n", order="doc_id", group="batch", limit=1024)
    return packed.groupBy("batch").agg((F.max("pack_id") + 1).alias("packs"), F.count("*").alias("sequences"), F.sum("n").alias("tokens"))


def sentence_split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))


def keyword_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = text.quality_score("text", [KEYWORDS, KEYWORDS[2:6]])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("quality"))


def _found(c: Column) -> list:
    low = F.lower(c)
    return [F.when(F.contains(low, F.lit(k)), k) for k in dict.fromkeys(KEYWORDS)]


def bad_feature_fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of rule-based and keyword-based feature sets of labelled documents, keywords of whole texts."""
    predicted = F.array_compact(F.array(*_found(F.col("text"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", predicted.alias("predicted"))  # before the join, which texts stay out of
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    bad = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "the"), F.when(F.col("quality") == 0, "ing"), F.when(F.col("toxic") == 1, "tion"), F.when(F.col("lang") == "en", "with")))
    sets = rows.select("doc_id", bad.alias("bad"), "predicted", (F.col("n_chars") > 100).alias("reasoned"))
    return sets.select("doc_id", F.round(scoring.set_f_score("bad", "predicted", F.col("reasoned")), 6).alias("f_score"))


def binary_f1_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.agg(F.round(binary_f1(F.col("n_chars") > 1000, F.col("quality") == 1), 6).alias("f1"), F.count("*").alias("n"))


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword scores of all documents by language, with how many are labelled."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    per = rows.select("lang", F.round(text.keyword_score("text", KEYWORDS), 4).alias("score"), "quality", "toxic")
    report = scoring_report(per, value="score", group=["lang"], used="quality", marked="toxic")
    return report.select(
        "lang", F.col("count").alias("paired"), "used", "skipped", F.col("mean").alias("mean_score"), F.col("min").alias("min_score"), F.col("max").alias("max_score"),
        F.round("std", 6).alias("std_score"), F.round("share", 6).alias("labelled_ratio"), F.col("median").alias("median_score"),
    )


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent event types by users (top-k report); ties by first seen."""
    listed = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string")).alias("feature"), F.col("event_id").alias("pos"))
    return top_features(listed).select("feature", "n", "first")


def feature_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of the distinct words of each document and of the document behind its first line."""
    whole, rest = tokens.words("text"), tokens.words(F.substr("text", F.length(F.substring_index("text", "\n", 1)) + 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(whole, rest)).alias("both"), F.size(F.array_except(whole, rest)).alias("only_first"), F.size(F.array_except(rest, whole)).alias("only_last"), F.size(F.array_union(whole, rest)).alias("either"), F.size(F.array_distinct(whole)).alias("distinct_first"))


def phrase_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.createDataFrame(PHRASES, "phrase string, feature string, direction string, pos int")
    return phrase_features(table(spark, sf_dir, "documents"), phrases, id_col="doc_id")


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items beside documents of the same place; every item, with an empty text where there is no document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.col("text").alias("doc_text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), F.col("text").alias("item_text"))
    return items.join(docs, "place", "left").select("place", "item_text", F.coalesce("doc_text", F.lit("")).alias("doc_text"))


def domain_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-line outputs of whole assistant turns that get tags, for even conversations as chem."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    raw = F.concat(F.lit("Reasoning: "), "text", F.lit("\nnoise\nOptimized SMILES: "), F.col("conv_id").cast("string"))
    source = F.when(F.col("conv_id") % 2 == 0, "chem").otherwise("ultrachat")
    return turns.select("conv_id", "turn", text.domain_output(raw, source).alias("output"))


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_KEYS2 = "[" + ", ".join(f"'{k}'" for k in KEYWORDS[2:6]) + "]"
_DISTINCT_KEYS = "[" + ", ".join(f"'{k}'" for k in dict.fromkeys(KEYWORDS)) + "]"
_MD5 = f"md5('{SEED}-' || doc_id::VARCHAR)"
_CHAT = """SELECT conv_id, arg_min(trim(text), turn) FILTER (role = 'user') AS "user", arg_min(trim(text), turn) FILTER (role = 'assistant') AS assistant
        FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id"""
_BATCHES = f"""SELECT doc_id, source, n, ((row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) - 1) // 32)::BIGINT AS batch_id
        FROM (SELECT doc_id, source, len({_WORDS.format('text')})::INT AS n FROM documents)"""


def _score_sql(keys: str) -> str:
    return f"least(len(list_filter({keys}, lambda k: contains(lower(text), k))) / len({keys})::DOUBLE * 2, 1.0)"


QUERIES = {
    f.__name__: f
    for f in (
        chat_first_turn, mixed_corpus_counts, language_cap, seeded_shuffle_sample, train_val_split, length_cap_p99, length_sorted_batches,
        truncation_budget, sequence_packing_stats, sentence_split_count, keyword_quality_score, bad_feature_fscore,
        binary_f1_by_length, corpus_report, top_words, feature_set_algebra, phrase_theta_join, positional_join, domain_normalised,
    )
}

ORACLE_SQL = {
    "chat_first_turn": _CHAT,
    "mixed_corpus_counts": f"""
        SELECT 'cpt-' || lang AS source, 3 * count(*) AS n FROM documents GROUP BY lang
        UNION ALL SELECT 'chat', count(*) FROM ({_CHAT}) HAVING count(*) > 0""",
    "language_cap": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 50",
    "seeded_shuffle_sample": f"SELECT doc_id, lang, {_MD5} AS shuffle_key FROM documents ORDER BY shuffle_key, doc_id LIMIT 100",
    "train_val_split": f"SELECT doc_id, CASE WHEN ('0x' || substr({_MD5}, 1, 8))::BIGINT % 10000 < 500 THEN 'validation' ELSE 'train' END AS split FROM documents",
    "length_cap_p99": f"SELECT lang, greatest(16, least(3072, floor(quantile_cont(n, 0.99))))::INT AS cap FROM (SELECT lang, len({_WORDS.format('text')})::DOUBLE AS n FROM documents) GROUP BY lang",
    "length_sorted_batches": _BATCHES,
    "truncation_budget": f"""
        WITH sized AS (
            SELECT doc_id, CASE WHEN source = 'src0' THEN 'chem' ELSE 'ultrachat' END AS domain, len({_WORDS.format("split_part(text, chr(10), 1)")})::INT AS prompt_n,
                   len({_WORDS.format("substr(text, length(split_part(text, chr(10), 1)) + 1)")})::INT AS answer_n FROM documents),
        b AS (SELECT *, CASE WHEN domain = 'chem' THEN 716 ELSE 512 END AS budget, prompt_n + answer_n > 2048 AS over FROM sized),
        k AS (SELECT *, CASE WHEN over THEN least(answer_n, 2048 - budget) ELSE answer_n END AS answer_kept FROM b)
        SELECT doc_id, domain, prompt_n, answer_n, (CASE WHEN over THEN least(prompt_n, 2048 - answer_kept) ELSE prompt_n END)::INT AS prompt_kept, answer_kept::INT AS answer_kept FROM k""",
    "sequence_packing_stats": f"""
        WITH RECURSIVE b AS (
            SELECT source || '/' || batch_id AS batch, n, row_number() OVER (PARTITION BY source, batch_id ORDER BY doc_id) AS r FROM ({_BATCHES})),
        fold AS (
            SELECT batch, r, n AS used, 1 AS packs FROM b WHERE r = 1
            UNION ALL SELECT b.batch, b.r, CASE WHEN used + 1 + b.n > 1024 THEN b.n ELSE used + 1 + b.n END, packs + CASE WHEN used + 1 + b.n > 1024 THEN 1 ELSE 0 END
            FROM fold JOIN b ON b.batch = fold.batch AND b.r = fold.r + 1)
        SELECT batch, max(packs)::BIGINT AS packs, (SELECT count(*) FROM b WHERE b.batch = fold.batch) AS sequences, (SELECT sum(n)::BIGINT FROM b WHERE b.batch = fold.batch) AS tokens FROM fold GROUP BY batch""",
    "sentence_split_count": r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\n\.!?]\s+'), lambda s: length(trim(s)) >= 8))::INT AS n_sentences FROM documents",
    "keyword_quality_score": f"SELECT doc_id, round(CASE WHEN trim(text) = '' THEN 0.0 ELSE least(({_score_sql(_KEYS)} + {_score_sql(_KEYS2)}) / 2 + least(length(text) / 500, 0.2), 1.0) END, 6)::DOUBLE AS quality FROM documents",
    "bad_feature_fscore": f"""
        WITH sets AS (
            SELECT doc_id, n_chars > 100 AS reasoned,
                list_filter([CASE WHEN n_chars > 2000 THEN 'the' END, CASE WHEN quality = 0 THEN 'ing' END, CASE WHEN toxic = 1 THEN 'tion' END, CASE WHEN lang = 'en' THEN 'with' END], lambda x: x IS NOT NULL) AS bad,
                list_filter({_DISTINCT_KEYS}, lambda k: contains(lower(text), k)) AS pred
            FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT doc_id, reasoned, len(bad)::DOUBLE AS b, len(pred)::DOUBLE AS q, len(list_intersect(bad, pred))::DOUBLE AS t FROM sets),
        f AS (SELECT *, CASE WHEN q > 0 THEN t / q END AS p, CASE WHEN b > 0 THEN t / b END AS r FROM c),
        g AS (SELECT *, CASE WHEN t = 0 OR p IS NULL OR r IS NULL THEN 0.0 ELSE 5 * p * r / (4 * p + r) END AS f2 FROM f)
        SELECT doc_id, round(CASE WHEN NOT reasoned THEN 0 WHEN b = 0 THEN CASE WHEN q = 0 THEN 1 ELSE 0.5 END WHEN q = 0 THEN 0
            WHEN t = b AND t = q THEN 1 WHEN t = q AND q < b THEN t / b WHEN t = b AND b < q THEN t / q
            WHEN p < 0.3 AND r > 0.5 THEN greatest(f2, 0.3) WHEN r < 0.3 AND p > 0.5 THEN greatest(f2, 0.3)
            WHEN p < 0.3 AND r < 0.3 AND t > 0 THEN greatest(f2, 0.1) ELSE f2 END, 6)::DOUBLE AS f_score FROM g""",
    "binary_f1_by_length": """
        SELECT round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1, n FROM (
            SELECT count(*) FILTER (n_chars > 1000 AND quality = 1)::DOUBLE AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1)::DOUBLE AS fp,
                   count(*) FILTER (n_chars <= 1000 AND quality = 1)::DOUBLE AS fn, count(*) AS n FROM documents JOIN labels USING (doc_id))""",
    "corpus_report": f"""
        SELECT lang, count(*) AS paired, count(quality) AS used, count(*) - count(quality) AS skipped, round(avg(score), 4)::DOUBLE AS mean_score, min(score) AS min_score, max(score) AS max_score,
            list_sort(list(score))[count(*) // 2 + 1] AS median_score, round(stddev_pop(score), 6)::DOUBLE AS std_score, round(avg((toxic IS NOT NULL)::INT), 6)::DOUBLE AS labelled_ratio
        FROM (SELECT lang, quality, toxic, round({_score_sql(_KEYS)}, 4)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""",
    "top_words": "SELECT event_type || '/' || (user_id % 20) AS feature, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 ORDER BY n DESC, first, feature LIMIT 10",
    "feature_set_algebra": f"""
        SELECT doc_id, len(list_intersect(list_distinct(a), list_distinct(b)))::INT AS both, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))::INT AS only_first,
            len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x)))::INT AS only_last, len(list_distinct(list_concat(a, b)))::INT AS either, len(list_distinct(a))::INT AS distinct_first
        FROM (SELECT doc_id, {_WORDS.format("text")} AS a, {_WORDS.format("substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS b FROM documents)""",
    "phrase_theta_join": "SELECT doc_id, feature, arg_min(direction, pos) AS direction FROM documents JOIN (VALUES " + ", ".join(str(p) for p in PHRASES) + ") p(phrase, feature, direction, pos) ON contains(lower(text), phrase) GROUP BY doc_id, feature",
    "positional_join": "SELECT item_id AS place, b.text AS item_text, coalesce(d.text, '') AS doc_text FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id",
    "domain_normalised": r"""
        WITH raw AS (SELECT conv_id, turn, 'Reasoning: ' || text || chr(10) || 'noise' || chr(10) || 'Optimized SMILES: ' || conv_id AS said FROM conversations WHERE role = 'assistant'),
        own AS (SELECT *, list_transform(regexp_split_to_array(said, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS l FROM raw),
        two AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*Reasoning\s*:'))[-1] || chr(10) || list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*Optimized[_\s-]*SMILES\s*:'))[-1] AS pair FROM own)
        SELECT conv_id, turn, CASE WHEN conv_id % 2 <> 0 THEN said WHEN contains(pair, '<END>') THEN pair ELSE pair || chr(10) || '<END>' END AS output FROM two""",
}
