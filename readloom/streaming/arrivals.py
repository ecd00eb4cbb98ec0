"""Reads that arrive as files: the batch expressions over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.functions import records
from readloom.operators.stats import histogram  # noqa: F401


def sam_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of SAM files as they arrive in a folder."""
    return records.parse_sam(spark.readStream.text(folder))
