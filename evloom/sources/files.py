"""JSON files between the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: What a filtered document that lacks a field gets.
DEFAULTS = {"question_id": "q1", "snippet": "", "relevance_score": 0.5, "credibility_score": 0.5, "final_score": 0.5, "source_tier": "unknown", "is_official_domain": False, "extraction_priority": 1, "extraction_mode": "html", "expected_value": "medium"}


def with_defaults(df: DataFrame) -> DataFrame:
    out = df
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType)))
    reasons = F.coalesce("selection_reasons", F.array().cast("array<string>"))
    return out.withColumn("canonical_url", F.coalesce("canonical_url", "url")).withColumn("selection_reasons", reasons).withColumn("published_date", F.lit(None).cast("timestamp"))


def read_filtered(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(schemas.FILTERED_DOCUMENT).json(path, multiLine=True))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


#: The columns that the filter's own output file has.
FILTER_OUTPUT = ["result_id", "url", "domain", "title", "relevance_score", "credibility_score", "final_score", "source_tier", "extraction_priority", "extraction_mode", "expected_value"]


def filter_output(df: DataFrame) -> DataFrame:
    return df.select(*FILTER_OUTPUT)
