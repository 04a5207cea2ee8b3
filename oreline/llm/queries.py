"""The operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreline.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    licenses,
    minhash,
    mixing,
    phrases,
    pii,
    ranked_search,
    suffix_dedup,
    text_quality,
    token_output,
    url_rules,
)
from oreline.llm.common import table
from oreline.llm.oracles import LLM_ORACLES
from oreline.llm.rules import URL_RULES
from oreline.sources.paths import scratch_path, stored


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, shingle=3, percent=85).drop("key")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rules_frame(spark, URL_RULES)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_output.read_tokens(spark, path)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("row.doc_id", "lang_pred", "score").select(
        "doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.find_licenses(table(spark, sf_dir, "documents")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return text_quality.judge_quality(docs, labels)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(ranked_search.build_index(table(spark, sf_dir, "documents")), "index")
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


__all__ = ["LLM_ORACLES", "LLM_QUERIES"]

LLM_QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_pii": op5_pii,
    "op6_token_output": op6_token_output,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_licenses": op10_licenses,
    "op11_quality": op11_quality,
    "op12_ranked_search": op12_ranked_search,
    "op13_phrases": op13_phrases,
}
