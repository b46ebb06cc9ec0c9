"""The corpus pipeline: documents from raw to tokens in five stages, each an operator of loomcount.llm on all that the one before kept.

quality      rejects documents by importance resampling against the labelled good ones
lines        deletes later copies of repeated runs of lines; documents of which nothing is left go
near_copies  keeps one document of each group linked by shared 5-word shingles
mixture      takes documents by the token budgets of their domain, language and source, some in more than one epoch
tokens       encodes and decodes: doc_id, n_tokens and digests of ids and decoded text

Defined results: a null or empty text goes through all stages but the mixture, where it holds no token and is taken as often as its leaf's whole epochs; null ids, very long texts, ties,
repeated rows and clashing names as the operators state; an empty table gives an empty result; all stages but the last return the columns of docs and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcount.llm import bpe, jaccard_join, line_dedup, mixing, quality
from loomcount.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = line_dedup.appended(docs)[1]
    return line_dedup.dedup(docs).filter((F.col(gone) == 0) | (F.col("text") != "")).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), bpe.DIGESTS)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near_copies", near_copies_stage), ("mixture", mixture_stage), ("tokens", tokens_stage)]
#: SQL cannot express the tokens, nor the sampling; tests/llm/test_pipeline.py holds each stage against a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
