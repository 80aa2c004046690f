"""Receipts as a stream: new files of texts in, parsed receipts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines (id, text) as they come."""
    return spark.readStream.schema("id string, text string").json(folder)


def extract_stream(receipts: DataFrame, accounts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Row-local, so stateless: each micro-batch appends what it parsed, exactly once by the checkpoint."""
    return extract(receipts, accounts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
