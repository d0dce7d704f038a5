"""The line parsers and counts over growing trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.sources.readers import parse_instructions, parse_transitions


def stream_transitions(spark: SparkSession, path: str) -> DataFrame:
    """Transition counts of a folder to which trace files are added; complete output mode."""
    return parse_transitions(spark.readStream.text(path)).groupBy("caller", "callee").agg(F.count("*").alias("n"))


def stream_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Executions of each address in a folder to which instruction traces are added; complete output mode."""
    return parse_instructions(spark.readStream.text(path)).groupBy("pc").agg(F.count("*").alias("n"))
