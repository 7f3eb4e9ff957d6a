"""A corpus pipeline of five stages, each one an operator of ``cutline.llm`` applied to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutline.llm import exact_dedup, mil_quality, ngram_join, packing, secrets
from cutline.llm.common import saved, table

STAGES = [
    ("quality_classifier", mil_quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("secret_scan", secrets.stage),
    ("best_fit_packing", packing.stage),
]

# training a network, a forest and packing bins are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
