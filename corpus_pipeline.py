"""A training corpus from `documents`: each stage takes what the one before kept.

Toxic documents are rejected, exact duplicates dropped, one document of each near-duplicate group kept, sources mixed
to their target weights, and what is left packed into context windows.

A null text counts as empty in every stage: it is never toxic, equals other empty ones, has fingerprint zero, and size 0,
so that the mix leaves it out. A row without doc_id stays where no row with one is kept for it. Rows that repeat a doc_id
are rows of their own; exact dedup keeps the first of equal ones. All columns of documents go through to packing,
whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import exact_dedup, mixing, packing, simhash, toxicity
from ledgerline.llm.common import discard, materialise, table
from ledgerline.llm.queries import WORD_BPE, tokenizer_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(spark, docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_file(WORD_BPE))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("source mixing", mix_sources), ("packing", pack_windows)]

#: The toxicity model, SimHash components and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(spark, docs, name.replace(" ", "_"))
            discard(spark, before)
    return docs
