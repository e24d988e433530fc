"""A training-corpus pipeline: each stage takes documents, works on all of them, and hands on what it keeps.

Stages: language identification, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding.
All but the last return the columns of documents; the last adds n_tokens and token_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilattice.llm.decontaminate import drop_contaminated
from epilattice.llm.jaccard import keep_one
from epilattice.llm.language import keep_known
from epilattice.llm.lines import drop_repeated_lines
from epilattice.llm.queries import VOCABULARY, table
from epilattice.llm.sentencepiece_fst import encode
from epilattice.llm.shared import discard, settle, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go: those without text or without a letter."""
    small_batches(spark)
    return keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike one stays; documents left without any line go. n_chars follows the text."""
    small_batches(spark)
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike one stays."""
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    small_batches(spark)
    return encode(docs, VOCABULARY)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: Language identification and MinHash can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed once the next one's is written; the last is left to the
    caller, who reads from it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
