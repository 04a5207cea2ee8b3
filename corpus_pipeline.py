"""From raw documents to binary token files, stage by stage.

Each stage takes a DataFrame of documents, stored as Parquet between stages, and works on all
that the one before kept.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreline.llm import decontaminate, language_id, minhash, mixing, token_output
from oreline.llm.common import table
from oreline.sources.paths import delete_path, scratch_path, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# A document goes if the model is less sure of its language than this, or finds none.  Of texts in
# ten languages that were not learnt 8 score below it, of 10,000 clean documents 7.
MIN_SCORE = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known with a score of at least ``MIN_SCORE`` stay."""
    found = language_id.predict(docs.select(*COLUMNS), language_id.fit(docs))
    sure = found.where((found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= MIN_SCORE))
    return sure.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash.without_near_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = decontaminate.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("size(runs) = 0").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared scratch folder; one row per document, read back from them."""
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(docs, path)
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("tokens", tokens),
]

# The stages learn, hash and draw; SQL cannot restate them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's input, and what it stored on the way, is deleted when
    its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before is not None:
            delete_path(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
