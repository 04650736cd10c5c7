"""Search stage: from questions and raw results to scored, unique sources.

Every operator works on many questions at once and partitions by question_id. Order that matters is a column, `ord`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..plans.config import FilterConfig, SearchConfig
from ..plans.dims import AGGREGATORS, AXES, QUESTION_TYPES, SKIPPED_EXTENSIONS, TIER_SCORE

# ---------------------------------------------------------------- questions


def question_type(reply: Column) -> Column:
    """The type that a model's JSON reply names; `unknown` for anything else."""
    named = F.get_json_object(reply, "$.question_type")
    return F.when(named.isin(list(QUESTION_TYPES)), named).otherwise("unknown")


def allowed_axes(kind: Column) -> Column:
    out = F.array(*map(F.lit, QUESTION_TYPES["unknown"]))
    for k, axes in QUESTION_TYPES.items():
        out = F.when(kind == k, F.array(*map(F.lit, axes))).otherwise(out)
    return out


def decomposition_prompt(q: DataFrame) -> DataFrame:
    """q (QUESTION with question_type) with the prompt as JSON."""
    payload = F.struct(F.lit("Write 5-8 search queries of 2-8 words for the question, each for one of the allowed axes. Answer with JSON: {\"sub_queries\": [{\"text\": ..., \"axis\": ...}]}.").alias("task"), F.col("text").alias("question"), "pathogen", "region", F.date_format("target_date", "yyyy-MM-dd'T'HH:mm:ss").alias("target_date"), allowed_axes(F.col("question_type")).alias("allowed_axes"))
    return q.withColumn("prompt", F.to_json(payload))


def decomposition_requests(q: DataFrame, typed: DataFrame) -> DataFrame:
    """(key, question_type, prompt) for each question: what a model is asked to write sub-queries from. typed: (question_id, raw_text), a model's
    replies that name the type; a question without one is `unknown`, for which every axis is allowed."""
    j = q.join(typed.select(F.col("question_id").alias("id"), "raw_text"), "id", "left").withColumn("question_type", question_type(F.col("raw_text")))
    return decomposition_prompt(j).select(F.col("id").alias("key"), "question_type", "prompt")


def valid_query(x: Column) -> Column:
    """2 to 8 words, joined by single spaces; more are cut, fewer give null."""
    w = text.words(x)
    return F.when(F.size(w) >= 2, F.array_join(F.slice(w, 1, 8), " "))


def fallback_queries(q: DataFrame) -> DataFrame:
    """(question_id, ord, text, axis): queries made from pathogen and region, or from the first words of the question."""
    base = F.concat_ws(" ", F.nullif(F.col("pathogen"), F.lit("")), F.nullif(F.col("region"), F.lit("")))
    start = F.array_join(F.slice(text.words(F.col("text")), 1, 4), " ")
    make = lambda b, rows: F.array(*[F.struct(F.lit(i).alias("ord"), F.concat_ws(" ", b, F.lit(t)).alias("text"), F.lit(a).alias("axis")) for i, (t, a) in enumerate(rows)])
    known = make(base, [("latest cases 2024 2025", "latest_data"), ("outbreak trend", "trend"), ("government response policy", "policy")])
    other = make(start, [("latest", "latest_data"), ("trend", "trend"), ("expert analysis", "expert_opinion")])
    rows = q.select(F.col("id").alias("question_id"), F.inline(F.when(base != "", known).otherwise(other)))
    return rows.withColumn("text", valid_query(F.col("text"))).filter("text is not null")


def decompose(q: DataFrame, replies: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(id, question_id, ord, text, axis) from replies (question_id, sub_queries array<struct<text,axis>>, null for a failed call).

    Wrong axes and too short texts go; below least_sub_queries the fallback follows the valid ones; at most most_sub_queries stay.
    """
    asked = q.select(F.col("id").alias("question_id")).join(replies, "question_id", "left")
    got = asked.select("question_id", F.posexplode("sub_queries").alias("ord", "s")).select("question_id", "ord", valid_query(F.col("s.text")).alias("text"), F.col("s.axis").alias("axis"))
    got = got.filter(F.col("text").isNotNull() & F.col("axis").isin(AXES))
    n = got.groupBy("question_id").agg(F.count("*").alias("n"))
    few = q.join(n, q["id"] == n["question_id"], "left").filter(F.coalesce("n", F.lit(0)) < cfg.least_sub_queries).select(q["*"])
    every = got.withColumn("part", F.lit(0)).unionByName(fallback_queries(few).withColumn("part", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("part", "ord"))
    every = every.withColumn("ord", rank - 1).filter(F.col("ord") < cfg.most_sub_queries)
    return every.select(F.sha2(F.concat_ws("|", "question_id", "ord", "text", "axis"), 256).alias("id"), "question_id", "ord", "text", "axis")


def dashboards(q: DataFrame, dim: DataFrame) -> DataFrame:
    """Known monitoring pages of each question's pathogen, as results of rank 0."""
    key = text.strip(F.lower(F.col("pathogen")))
    j = q.join(small_side(dim), key == F.col("pathogen_key"))
    d = urls.domain(F.col("url"))
    return j.select(F.col("id").alias("question_id"), F.concat(F.lit("dashboard_"), "id").alias("query_id"), F.lit("dashboard").alias("engine"), "url", F.concat(F.lit("Dashboard: "), d).alias("title"), F.concat(F.lit("Known "), "pathogen_key", F.lit(" monitoring dashboard")).alias("snippet"), F.lit(0).alias("rank"), F.lit(1.0).alias("freshness_score"), F.lit("dashboard_lookup").alias("retrieval_reason"), F.col("dash_ord").alias("ord"))


def early_stop(counts: DataFrame, cap: int = SearchConfig().results_cap) -> DataFrame:
    """Of rows (question_id, ord, n_results, n_dashboards) the sub-queries that are run: the first, and each before which fewer
    than cap results, dashboards included, had come."""
    before = Window.partitionBy("question_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("n_dashboards") + F.coalesce(F.sum("n_results").over(before), F.lit(0))
    first = F.row_number().over(Window.partitionBy("question_id").orderBy("ord")) == 1
    return counts.withColumn("total_before", total).withColumn("__first", first).filter(F.col("__first") | (F.col("total_before") < cap)).drop("__first")


# ---------------------------------------------------------------- sources


#: Bytes up to which a lookup table is broadcast.
SMALL_BYTES = 16 << 20


def small_side(dim: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A lookup table for a join: broadcast if its rows take no more bytes, else as it is, for a join by shuffle. The library's own tables, of constants, are known
    to be small; others are added up, once for each frame."""
    if not hasattr(dim, "_evloom_small"):
        row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in dim.columns), F.lit(40))
        dim._evloom_small = (dim.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most
    return F.broadcast(dim) if dim._evloom_small else dim


def second_level(d: Column) -> Column:
    return F.substring_index(d, ".", -2)


def resolve_tier(df: DataFrame, dim: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Adds tier, domain_score, source_tier: the domain in dim, else its last two labels, else the ending, else 5."""
    d = F.lower(F.coalesce(F.col(domain_col), F.lit("")))
    small = small_side(dim)
    j = df.withColumn("__d", d).withColumn("__s", F.when(F.contains(d, F.lit(".")), second_level(d)))
    j = j.join(small.select(F.col("domain").alias("__d"), F.col("tier").alias("__t1"), F.col("label").alias("__l1")), "__d", "left")
    j = j.join(small.select(F.col("domain").alias("__s"), F.col("tier").alias("__t2"), F.col("label").alias("__l2")), "__s", "left")
    named = lambda tier, label: F.struct(F.lit(tier).alias("t"), F.lit(label).alias("l"))
    gov = F.col("__d").endswith(".gov") | F.col("__d").endswith(".gov.uk")
    ending = F.when(F.col("__d").endswith(".int"), named(2, "official")).when(gov, named(3, "official")).when(F.col("__d").endswith(".edu"), named(3, "academic")).otherwise(named(5, "unknown"))
    tier = F.coalesce("__t1", "__t2", ending["t"])
    score = F.lit(None).cast("double")
    for t, s in TIER_SCORE.items():
        score = F.when(tier == t, s).otherwise(score)
    return j.withColumn("tier", tier).withColumn("domain_score", score).withColumn("source_tier", F.coalesce("__l1", "__l2", ending["l"])).drop("__d", "__s", "__t1", "__l1", "__t2", "__l2")


def is_official(tier: Column, label: Column) -> Column:
    return (tier == 1) & (label == "official")


def is_aggregator(d: Column, aggregators: list[str] = AGGREGATORS) -> Column:
    d = F.lower(F.coalesce(d, F.lit("")))
    return d.isin(aggregators) | second_level(d).isin(aggregators)


def search_score(domain_score: Column, freshness: Column, rank: Column) -> Column:
    return text.clamp(F.lit(0.5) * domain_score + F.lit(0.3) * freshness + F.lit(0.2) / F.greatest(rank, F.lit(1)))


def convert(raw: DataFrame, dim: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Raw results (question_id, query_id, engine, axis, pos, ord, url, title, snippet, published_date; and from dashboards() rank,
    freshness_score) as search results. rank is the place in the reply plus 1."""
    have = set(raw.columns)
    rank = F.col("pos") + 1 if "rank" not in have else F.coalesce("rank", F.col("pos") + 1)
    pub = dates.published(F.col("published_date"))
    fresh = dates.freshness(pub, as_of)
    out = raw.withColumn("rank", rank.cast("int")).withColumn("freshness_score", F.coalesce("freshness_score", fresh) if "freshness_score" in have else fresh)
    out = out.withColumn("published_date", pub).withColumn("canonical_url", urls.canonical(F.col("url"))).withColumn("domain", urls.domain(F.col("url")))
    out = resolve_tier(out, dim)
    out = out.withColumn("is_official_domain", is_official(F.col("tier"), F.col("source_tier"))).withColumn("contains_aggregator_forecast", is_aggregator(F.col("domain")))
    return out.withColumn("id", F.sha2(F.concat_ws("|", "question_id", "query_id", "url", "rank"), 256))


def merge_duplicates(df: DataFrame) -> DataFrame:
    """One row for each question and canonical url: the lowest rank, then the first. out_ord is the place of the url's first row.

    Reasons are merged as results come in: a row that loses adds its reason if the winner's text lacks it; one that wins takes
    the old text along, unless its own reason is in it already: then the old text is lost.
    """
    key = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url"))
    rest = [c for c in df.columns if c not in ("question_id", "retrieval_reason")]
    rows = df.withColumn("__key", key)
    history = F.array_sort(F.collect_list(F.struct("ord", "rank", F.col("retrieval_reason").alias("reason"))))

    def step(acc: Column, x: Column) -> Column:
        has = F.contains(acc["reason"], x["reason"])
        lost = F.struct(acc["rank"].alias("rank"), F.when(has, acc["reason"]).otherwise(F.concat_ws(",", acc["reason"], x["reason"])).alias("reason"))
        won = F.struct(x["rank"].alias("rank"), F.when(has, x["reason"]).otherwise(F.concat_ws(",", acc["reason"], x["reason"])).alias("reason"))
        return F.when(acc["rank"].isNull(), F.struct(x["rank"].alias("rank"), x["reason"].alias("reason"))).when(x["rank"] < acc["rank"], won).otherwise(lost)

    start = F.struct(F.lit(None).cast("int").alias("rank"), F.lit("").alias("reason"))
    best = F.min_by(F.struct(*rest), F.struct("rank", "ord")).alias("w")
    merged = rows.groupBy("question_id", "__key").agg(best, F.aggregate(history, start, step)["reason"].alias("retrieval_reason"), F.min("ord").alias("out_ord"))
    return merged.select("question_id", "w.*", "retrieval_reason", "out_ord")


def exclude(df: DataFrame, blocked=FilterConfig().blocked_domains, extensions=SKIPPED_EXTENSIONS) -> DataFrame:
    """Without blocked domains (exactly these) and urls whose path ends in one of the extensions."""
    path = F.regexp_extract(F.lower(F.col("url")), r"^([^?#]*)", 1)
    return df.filter(~F.coalesce(F.col("domain"), F.lit("")).isin(list(blocked)) & ~path.rlike(rf"\.(?:{'|'.join(extensions)})$"))


def top_sources(df: DataFrame, cap: int = SearchConfig().results_cap) -> DataFrame:
    """The cap best rows of each question by score, then by out_ord."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("search_stage_score"), "out_ord"))
    return df.withColumn("position", rank).filter(F.col("position") <= cap)


def search_stage(questions: DataFrame, replies: DataFrame, raw: DataFrame, tier_dim: DataFrame, dashboard_dim: DataFrame, as_of: dt.datetime, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The whole stage. raw: (question_id, sub_query_ord, pos, url, title, snippet, published_date), what a backend or the cache
    gave for each sub-query."""
    subs = decompose(questions, replies, cfg)
    dash = dashboards(questions, dashboard_dim)
    hits = raw.join(subs.select("question_id", F.col("ord").alias("sub_query_ord"), F.col("id").alias("query_id"), "axis"), ["question_id", "sub_query_ord"])
    n_dash = dash.groupBy("question_id").agg(F.count("*").alias("n_dashboards"))
    counts = hits.groupBy("question_id", F.col("sub_query_ord").alias("ord")).agg(F.count("*").alias("n_results")).join(n_dash, "question_id", "left").na.fill({"n_dashboards": 0})
    run = early_stop(counts, cfg.results_cap).select("question_id", F.col("ord").alias("sub_query_ord"))
    hits = hits.join(run, ["question_id", "sub_query_ord"]).select("question_id", "query_id", F.lit("search").alias("engine"), "url", "title", "snippet", F.col("pos").cast("int"), F.col("published_date").cast("string"), F.col("axis").alias("retrieval_reason"), F.struct(F.lit(1).alias("part"), "sub_query_ord", F.col("pos").cast("int").alias("pos")).alias("__o"))
    both = hits.unionByName(dash.select("question_id", "query_id", "engine", "url", "title", "snippet", "rank", "freshness_score", "retrieval_reason", F.struct(F.lit(0).alias("part"), F.col("ord").alias("sub_query_ord"), F.lit(0).alias("pos")).alias("__o")), allowMissingColumns=True)
    both = both.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy("__o"))).drop("__o")
    rows = exclude(merge_duplicates(convert(both, tier_dim, as_of)))
    return top_sources(rows.withColumn("search_stage_score", search_score(F.col("domain_score"), F.col("freshness_score"), F.col("rank"))), cfg.results_cap)
