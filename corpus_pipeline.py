"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``.

Edge cases follow from the operators: null and empty texts are rejected by the
quality rules; of rows that repeat an id one stays, and of equal texts without an
id; ties are settled as the operators say; a text of any length passes whole; an
empty table stays empty; further columns, whatever their names, pass through all
stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bandloom.llm import common, near_dup, packing, quality_rules, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    common.tune(spark)
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, by five-word shingles and a similarity of 0.8."""
    common.tune(spark)
    return near_dup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is masked; all documents stay."""
    common.tune(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens. Workers remember fewer pieces than by default, as the near-duplicates' shuffles have grown the executors' heaps to their limit."""
    common.tune(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, remembered=330_000), 2048)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_duplicates), ("secret_scans", secrets), ("best_fit_packing", pack)]

#: The secret scan's guess costs and the tokenizer can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = common.written(made, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
