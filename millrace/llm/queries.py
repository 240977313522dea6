"""The queries of this subpackage: thin, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, chat, langid, media, minhash, mixing, packing, periods, simhash, suffix, tokens, urlfilter, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_sum_of_squares(_table(spark, sf_dir, "documents")))


def op4_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op5_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_simhash_positional_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.decode_telephony(media.store_telephony(_table(spark, sf_dir, "documents"))))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame([(d,) for d in urlfilter.LISTED_DOMAINS], "domain string")
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), domains)


def op9_incremental_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of the template's own control strings."""
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(said.unionByName(own)))


def op10_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op11_minhash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(_table(spark, sf_dir, "documents"), change=variants.misspelt))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(_table(spark, sf_dir, "documents"), planted=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_sum_of_squares, op2_telephony_media, op3_poisson_mixing, op4_transducer_token_counts, op5_naive_bayes_language,
        op6_simhash_positional_bytes, op7_bloom_cascade_urls, op8_suffix_array_dedup, op9_incremental_chat_format, op10_ivf_pq_search, op11_minhash_hamming_join,
        op12_spelling_variants, op13_periodic_runs, pipeline,
    )
}

#: Queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_poisson_mixing": mixing.ORACLE, "op7_bloom_cascade_urls": urlfilter.ORACLE, "op11_minhash_hamming_join": minhash.ORACLE}
