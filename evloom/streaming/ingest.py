"""Results that arrive as a stream: canonical urls, each once within a time. An extension; the batch stages need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def unique_results(stream: DataFrame, time_col: str = "retrieved_at", delay: str = "24 hours") -> DataFrame:
    """The first result of each question and canonical url within delay; state older than that is dropped."""
    rows = stream.withColumn("canonical_url", urls.canonical(F.col("url"))).withColumn("domain", urls.domain(F.col("url")))
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["question_id", "canonical_url"])
