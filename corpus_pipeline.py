"""The corpus pipeline over `documents`: toxic texts out, exact and near copies out, sources mixed, the rest packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Documents of the mixture may repeat, as often as their source's quota asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tetrarank.llm import exact_dedup, minhash, mixing, packing, toxicity
from tetrarank.llm.common import stored, table
from tetrarank.llm.workloads import tokenizer_path


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below one half go on."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the row with the largest doc_id goes on."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest doc_id goes on."""
    return minhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture as large as what came in, half way between the sources as they are and equal shares, no source over four times."""
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences. Copies of a document are told apart by `row`."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [("toxicity", not_toxic), ("exact_dedup", exact), ("minhash_near_dedup", near), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Classifier and tokenizer are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after each other, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
