"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept: quality rules, language identification, near-duplicate removal, packing. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.llm import language_id, packing, quality, simhash
from strataseek.llm.common import pick
from strataseek.llm.queries import table, tokenizer_path
from strataseek.llm.token_memo import read_spec
from strataseek.sources.scratch import new_dir, remove, scratch

#: A text whose best language has less than this share of the belief is in none.
LEAST_BELIEF = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base rules and the cutoffs of their language and source."""
    return quality.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learned from the documents themselves."""
    known = pick(docs, doc_id="bigint", text="string", lang="string")
    net = language_id.train(known.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep(docs, net, LEAST_BELIEF)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest doc_id. Rows that repeat
    a doc_id or have none are rows like any other."""
    return simhash.keep(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: the ids of each piece of each document, and where it
    lies."""
    return packing.pack(docs, read_spec(tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL has neither the network nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage stored for itself, and its input, go when it is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
