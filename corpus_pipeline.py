"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir)
