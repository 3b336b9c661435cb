"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import hilbert_packing, line_templates, near_copies, quality_rules, source_mix
from sparkloom.llm.common import materialize, table
from sparkloom.llm.queries import tokenizer_path


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules reject go."""
    return quality_rules.keep_good(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates go from all documents but the first."""
    return line_templates.cleaned(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the trie join on many prints, confirmed at a Jaccard of 0.8 on five words."""
    return near_copies.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their target shares."""
    return source_mix.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return hilbert_packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("packing", pack_stage),
]
#: Label model, balanced sampling and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
