"""Scoring of arriving rows by the rule table: an extension, as the batch operators have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.rules import Rule, evidence


def score_stream(spark: SparkSession, source: str, schema: str, rules: list[Rule], target: str, checkpoint: str) -> StreamingQuery:
    """Score each file that arrives at source once and append it to target; state lies in checkpoint."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    writer = evidence(rows, rules).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
