"""Search cache as a table: (cache_key, results_json, created_at)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.config import SearchConfig
from .calls import CallTable, once_backend

_PAYLOAD = "array<struct<url:string,title:string,snippet:string,rank:int,published_date:string,score:double>>"


def cache_key(backend: Column, query: Column, as_of: dt.datetime) -> Column:
    """Digest of backend, query (case and outer white space aside) and UTC day: an entry also ends with its day."""
    return F.sha2(F.concat_ws("|", backend, strip(F.lower(query)), F.lit(as_of.strftime("%Y-%m-%d"))), 256)


def lookup(queries: DataFrame, cache: DataFrame, as_of: dt.datetime, hours: int = SearchConfig().cache_hours) -> DataFrame:
    """queries (with cache_key) with results_json and hit; an entry is good up to so many hours."""
    now = F.lit(as_of).cast("timestamp")
    good = cache.filter((F.col("created_at").cast("timestamp") >= now - F.expr(f"interval {hours} hours")) & (F.col("created_at").cast("timestamp") <= now))
    return queries.join(good.select("cache_key", "results_json"), "cache_key", "left").withColumn("hit", F.col("results_json").isNotNull())


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones: of each key the latest row, of equal times the new one."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = both.groupBy("cache_key").agg(F.max_by(F.struct("results_json", "created_at"), F.struct("created_at", "__new")).alias("x"))
    return latest.select("cache_key", "x.results_json", "x.created_at")


def payload(results: DataFrame) -> DataFrame:
    """(cache_key, results_json) from rows of a result list (cache_key and RAW_RESULT columns), in rank order."""
    row = F.struct("rank", F.struct("url", "title", "snippet", "rank", F.col("published_date").cast("string").alias("published_date"), "score").alias("r"))
    return results.groupBy("cache_key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])).alias("results_json"))


def results_of(hits: DataFrame) -> DataFrame:
    """The results of rows with results_json, one row each, pos from 0."""
    return hits.select("*", F.posexplode(F.from_json("results_json", _PAYLOAD)).alias("pos", "r")).select(*[c for c in hits.columns if c != "results_json"], "pos", "r.*")


def cache_aside(queries: DataFrame, cache: DataFrame, backend, as_of: dt.datetime, table: CallTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, new cache entries): hits from the cache, misses from the SearchBackend. A key is asked once: answers go to a table of calls,
    from which both results are read; table is that of an earlier, broken run.

    Queries without a result are cached too, as empty lists.
    """
    found = lookup(queries, cache, as_of)
    hits, misses = found.filter("hit"), found.filter("not hit").drop("results_json", "hit")
    fetched = once_backend(backend, queries.sparkSession, table).search(misses.groupBy("cache_key").agg(F.min("text").alias("text")))
    entries = misses.select("cache_key").distinct().join(payload(fetched), "cache_key", "left").select("cache_key", F.coalesce("results_json", F.lit("[]")).alias("results_json"), F.lit(as_of).cast("timestamp").alias("created_at"))
    every = found.drop("results_json", "hit").join(hits.select("cache_key", "results_json").unionByName(entries.select("cache_key", "results_json")).dropDuplicates(["cache_key"]), "cache_key")
    return results_of(every), entries
