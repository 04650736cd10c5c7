"""Command lines of the stages: `python -m evloom.cli search|filter|extract --output ...`."""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import extract, filtering, search
from .plans.config import SearchConfig
from .plans.dims import dashboard_dim, tier_dim
from .sources import cache
from .sources.backends import CallBackend, TableBackend
from .sources.calls import CallTable, fetch_once, shared_folder
from .sources.files import filter_output, read_filtered, write_json
from .sources.search_source import HttpSearch, imported

REPLIES = "question_id string, sub_queries array<struct<text:string,axis:string>>"
RECORDED = "text string, " + schemas.RAW_RESULT


def search_with_cache(spark: SparkSession, questions: DataFrame, replies: DataFrame, backend, old: DataFrame, as_of: dt.datetime, table: CallTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(search results, the cache afterwards): sub-queries are answered from the cache, and by the backend where it has no good entry."""
    subs = search.decompose(questions, replies)
    asked = subs.select("question_id", F.col("ord").alias("sub_query_ord"), "text", cache.cache_key(F.lit(backend.name), F.col("text"), as_of).alias("cache_key"))
    found, new = cache.cache_aside(asked, old, backend, as_of, table)
    raw = found.select("question_id", "sub_query_ord", "pos", "url", "title", "snippet", "published_date")
    return search.search_stage(questions, replies, raw, tier_dim(spark), dashboard_dim(spark), as_of), cache.upsert(old, new)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=["search", "filter", "extract"])
    p.add_argument("--questions", help="JSON lines")
    p.add_argument("--replies", help="search: the model's sub-queries; filter: its decisions, JSON lines")
    p.add_argument("--recorded", help="search: results by query text, JSON lines, that stand in for a search service")
    p.add_argument("--endpoint", help="search: address of a service that answers POSTed JSON, as search_source.HttpSearch has it")
    p.add_argument("--service", help="search: package.module:name of a callable (text, most) that asks a service")
    p.add_argument("--key-variable", help="search: environment variable with the service's key")
    p.add_argument("--cache", help="search: folder of the cache before the run; it is written anew beside the output")
    p.add_argument("--input", help="filter, extract: output of the stage before")
    p.add_argument("--fetched", help="extract: bodies by url; without it they are fetched")
    p.add_argument("--as-of", type=lambda s: dt.datetime.fromisoformat(s).replace(tzinfo=None), help="search: the run's time, now if not given")
    p.add_argument("--output", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    questions = spark.read.schema(schemas.QUESTION).json(a.questions) if a.questions else None
    if a.stage == "search":
        as_of = a.as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        old = spark.read.schema(schemas.CACHE).parquet(a.cache) if a.cache else spark.createDataFrame([], schemas.CACHE)
        if a.recorded:
            backend = TableBackend(spark.read.schema(RECORDED).json(a.recorded))
        else:
            backend = CallBackend(HttpSearch(a.endpoint, os.environ.get(a.key_variable or "", "")) if a.endpoint else imported(a.service), "live", SearchConfig().results_per_query)
        calls = CallTable(spark, f"cache_key string, {schemas.RAW_RESULT}", "cache_key", f"{a.output}/calls")
        found, after = search_with_cache(spark, questions, spark.read.schema(REPLIES).json(a.replies), backend, old, as_of, calls)
        write_json(found, f"{a.output}/results")
        after.write.mode("overwrite").parquet(f"{a.output}/cache")
    elif a.stage == "filter":
        replies = filtering.decisions(spark.read.schema("key string, raw_text string").json(a.replies)) if a.replies else None
        results = spark.read.json(a.input)
        results = results.withColumns({c: F.lit(None).cast(k) for c, k in (("file_type", "string"), ("published_date", "timestamp")) if c not in results.columns})
        out = filtering.filter_stage(results.withColumn("published_date", F.col("published_date").cast("timestamp")).withColumn("ord", F.col("position")), questions, replies)
        write_json(filter_output(out.withColumnRenamed("id", "result_id")), a.output)
    else:
        filtered = read_filtered(spark, a.input)
        if a.fetched:
            fetched = spark.read.schema(schemas.FETCH_RESULT).json(a.fetched)
        else:
            fetched = fetch_once(filtered, CallTable(spark, schemas.FETCH_RESULT, "url", f"{a.output}/fetched"))
        docs, chunks = extract.extract_stage(filtered, fetched, store=shared_folder(spark, "parsed"))
        write_json(docs, f"{a.output}/documents")
        write_json(chunks, f"{a.output}/chunks")


if __name__ == "__main__":
    main()
