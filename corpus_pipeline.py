"""The training-data pipeline: five corpus operators in order, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are rows of `documents`. All but the last return the columns of
documents. Stages: quality rules (rejected rows go), line dedup (texts lose lines that came earlier, rows that lose all
their lines go), near-dedup (sets of five-word shingles with a Jaccard similarity of 0.8 or more are near copies; of each group the row with the least id
stays), benchmark decontamination (contaminated rows go), BPE encoding and decoding.

Null and empty texts have too few words for the quality rules and go there. Rows that repeat are judged alike by the rules, lose the same lines, and one of them is left by
near-dedup; of equal ids the row with the least hash of its text comes first. Texts of any length are taken whole. Extra columns are carried along up to the last stage. Empty
tables give no rows; without labels only the base rules hold, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, line_dedup, near_copies, quality
from lodestone.llm.common import forget, stage, table
from lodestone.llm.queries import tokenizer_path

#: No SQL: the vocabulary, the SVD and the labelled thresholds can't be written in it. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
            if before is not None:
                forget(before)  # what this stage has read
            before = docs
    return docs
