"""Registered queries of the evidence operators over the driver's tables, each with the same result as SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text, urls
from .operators import chunking, extract, filtering, html, insight, retrieval, search
from .plans.dims import COUNTRIES, DASHBOARDS, MONTHS, TRACKING_KEYS, dashboard_dim, tier_dim
from .sources import cache

AS_OF = dt.datetime(2024, 6, 1)
TEST_TIERS = [("example.org", 1, "official"), ("example.net", 3, "trusted_media"), ("tionsh.example.net", 4, "ngo")]
BLOCKED = ("blog.theran.example.org", "ththon.example.com")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- SQL of the shared expressions

HOST = "regexp_replace(lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '(?:^|.*@)([^@:]*)(?::[0-9]*)?$', 1)), '^www\\.', '')"
_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)
_PAIRS = "list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"
_KV = f"list_transform({_PAIRS}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'v': regexp_extract(p, '^[^=]*=(.*)$', 1)}})"
_QUERY = f"array_to_string(list_transform(list_sort(list_filter({_KV}, lambda x: lower(x.k) not in ({_KEYS}))), lambda x: x.k || '=' || x.v), '&')"
CANON = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {HOST} || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') || case when {_QUERY} = '' then '' else '?' || {_QUERY} end"
DIM = "(values " + ", ".join(f"('{d}', {n}, '{lab}')" for d, n, lab in TEST_TIERS) + ") dim(d, tier, label)"
SLD = "case when contains({0}, '.') then array_to_string(string_split({0}, '.')[-2:], '.') end"
TOKENS = "regexp_extract_all(regexp_replace(trim(lower(coalesce({0}, '')), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'), '[a-zA-Z0-9_\\-]+')"
TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1))"
#: Pages as search results: 8 sub-queries, questions 0 to 3, places by id.
PAGES_SQL = f"""p as (select page_id, url, html, {HOST} as domain, {CANON} as canonical_url, {TITLE} as title, page_id % 4 as question_id, page_id % 8 as sub_query,
 row_number() over (partition by page_id % 8 order by page_id) as rank from pages),
tiered as (select p.*, coalesce(a.tier, b.tier, case when domain like '%.int' then 2 when domain like '%.gov' or domain like '%.edu' then 3 else 5 end) tier,
 coalesce(a.label, b.label, case when domain like '%.int' or domain like '%.gov' then 'official' when domain like '%.edu' then 'academic' else 'unknown' end) source_tier
 from p left join {DIM} on false left join (select * from {DIM}) a on a.d = p.domain left join (select * from {DIM}) b on b.d = {SLD.format('p.domain')}),
scored as (select *, case tier when 1 then 1.0 when 2 then 0.8 when 3 then 0.6 when 4 then 0.4 else 0.2 end::double domain_score,
 (page_id * 37 % 500)::int age, case when page_id % 5 = 0 then null else timestamp '2024-06-01' - to_days((page_id * 37 % 500)::int) end published_date from tiered),
results as (select *, case when published_date is null then 0.5 else greatest(0, least(1, 1 - age / 365.0::double)) end::double freshness_score,
 tier = 1 and source_tier = 'official' is_official_domain from scored),
ranked as (select *, least(1, greatest(0, 0.5 * domain_score + 0.3 * freshness_score + 0.2::double / greatest(rank, 1))) search_stage_score from results)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """The same in DataFrames: search results with every column that the stages ask for."""
    p = t(spark, d, "pages").withColumn("question_id", F.col("page_id") % 4).withColumn("sub_query", F.col("page_id") % 8)
    from pyspark.sql import Window

    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("sub_query").orderBy("page_id")))
    p = p.withColumn("domain", urls.domain(F.col("url"))).withColumn("canonical_url", urls.canonical(F.col("url"))).withColumn("title", html.title_tag(F.col("html")))
    p = search.resolve_tier(p, tier_dim(spark, TEST_TIERS))
    p = p.withColumn("age", (F.col("page_id") * 37 % 500).cast("int")).withColumn("published_date", F.when(F.col("page_id") % 5 != 0, F.lit(AS_OF) - F.make_dt_interval(F.col("age"))))
    p = p.withColumn("freshness_score", dates.freshness(F.col("published_date"), AS_OF)).withColumn("is_official_domain", search.is_official(F.col("tier"), F.col("source_tier")))
    return p.withColumn("search_stage_score", search.search_score(F.col("domain_score"), F.col("freshness_score"), F.col("rank")))


# ---------------------------------------------------------------- search


@query(f"select page_id, {CANON} as canonical_url from pages")
def url_canonical(spark, d):
    return t(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(f"select page_id, {HOST} as domain from pages")
def url_domain(spark, d):
    return t(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query(f"with {PAGES_SQL} select page_id, domain, tier, domain_score, source_tier, is_official_domain, domain in ('example.com') or {SLD.format('domain')} in ('example.com') as is_aggregator from ranked")
def tier_resolve(spark, d):
    return results(spark, d).select("page_id", "domain", "tier", "domain_score", "source_tier", "is_official_domain", search.is_aggregator(F.col("domain"), ["example.com"]).alias("is_aggregator"))


_ORDER_DATE = "case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d/%m/%Y') end"


@query("select o_orderkey, case when o_orderkey % 4 = 3 then null else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as published, case when o_orderkey % 4 = 3 then 0.5 else greatest(0, least(1, 1 - floor(date_diff('second', o_orderdate, timestamp '1998-09-01') / 86400) / 365.0::double)) end as freshness from orders")
def published_freshness(spark, d):
    o = t(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    form = lambda f: F.date_format("ts", f)
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, form("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, form("yyyy-MM-dd")).otherwise(form("dd/MM/yyyy"))
    pub = dates.published(s)
    return o.select("o_orderkey", F.date_format(pub, "yyyy-MM-dd HH:mm:ss").alias("published"), dates.freshness(pub, dt.datetime(1998, 9, 1)).alias("freshness"))


@query(f"with {PAGES_SQL}, x as (select *, row_number() over (partition by question_id order by search_stage_score desc, page_id) position from ranked) select question_id, page_id, position, round(search_stage_score, 9) as search_stage_score from x where position <= 60")
def search_topk(spark, d):
    top = search.top_sources(results(spark, d).withColumn("out_ord", F.col("page_id")))
    return top.select("question_id", "page_id", "position", F.round("search_stage_score", 9).alias("search_stage_score"))


_VARIANTS = """v as (select page_id % 4 question_id, url, 'trend' retrieval_reason, page_id * 3 as ord, page_id * 7 % 13 as rank from pages
 union all select page_id % 4, url || case when contains(url, '#') then '' when contains(url, '?') then '&utm_source=a' else '?utm_source=a' end, 'policy', page_id * 3 + 1, page_id * 5 % 11 from pages
 union all select page_id % 4, url || case when contains(url, '#') then '' when contains(url, '?') then '&fbclid=b' else '?fbclid=b' end, case when page_id % 2 = 0 then 'trend' else 'latest_data' end, page_id * 3 + 2, page_id * 3 % 7 from pages)"""


@query(f"""with recursive {_VARIANTS}, c as (select *, {CANON} canonical_url from v),
o as (select *, row_number() over (partition by question_id, canonical_url order by ord) n, min(ord) over (partition by question_id, canonical_url) out_ord from c),
f(question_id, canonical_url, n, rank, ord, reason, out_ord) as (select question_id, canonical_url, n, rank, ord, retrieval_reason, out_ord from o where n = 1
 union all select o.question_id, o.canonical_url, o.n, case when o.rank < f.rank then o.rank else f.rank end, case when o.rank < f.rank then o.ord else f.ord end,
 case when contains(f.reason, o.retrieval_reason) then case when o.rank < f.rank then o.retrieval_reason else f.reason end else f.reason || ',' || o.retrieval_reason end, f.out_ord
 from f join o on o.question_id = f.question_id and o.canonical_url = f.canonical_url and o.n = f.n + 1)
select question_id, canonical_url, arg_max(rank, n) as rank, arg_max(ord, n) as ord, arg_max(reason, n) as retrieval_reason, min(out_ord) as out_ord from f group by question_id, canonical_url""")
def search_dedup_merge(spark, d):
    p = t(spark, d, "pages")
    add = lambda tail: F.concat("url", F.when(F.contains("url", F.lit("#")), "").when(F.contains("url", F.lit("?")), "&" + tail).otherwise("?" + tail))
    part = lambda url, reason, k, m, mod: p.select((F.col("page_id") % 4).alias("question_id"), url.alias("url"), reason.alias("retrieval_reason"), (F.col("page_id") * 3 + k).alias("ord"), (F.col("page_id") * m % mod).cast("int").alias("rank"))
    v = part(F.col("url"), F.lit("trend"), 0, 7, 13).unionByName(part(add("utm_source=a"), F.lit("policy"), 1, 5, 11)).unionByName(part(add("fbclid=b"), F.when(F.col("page_id") % 2 == 0, "trend").otherwise("latest_data"), 2, 3, 7))
    return search.merge_duplicates(v.withColumn("canonical_url", urls.canonical(F.col("url")))).select("question_id", "canonical_url", "rank", "ord", "retrieval_reason", "out_ord")


_EXT = "url || case page_id % 6 when 0 then '.png' when 1 then '.PDF' when 2 then '.zip' else '' end"


@query(f"with x as (select page_id, {_EXT} url from pages), y as (select page_id, url, {HOST} as domain from x) select page_id, domain from y where domain not in {BLOCKED} and not regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1)), '\\.(zip|exe|msi|dmg|tar|gz|png|jpg|jpeg|gif|svg|mp4|mp3)$')")
def search_exclusions(spark, d):
    k = F.col("page_id") % 6
    x = t(spark, d, "pages").withColumn("url", F.concat("url", F.when(k == 0, ".png").when(k == 1, ".PDF").when(k == 2, ".zip").otherwise("")))
    return search.exclude(x.withColumn("domain", urls.domain(F.col("url"))), BLOCKED).select("page_id", "domain")


_PATHOGEN = "case item_id % 5 when 0 then ' H5N1 ' when 1 then 'Mpox' when 2 then 'unknown virus' when 3 then null else 'ebola' end"


def _questions(spark, d) -> DataFrame:
    k = F.col("item_id") % 5
    pathogen = F.when(k == 0, " H5N1 ").when(k == 1, "Mpox").when(k == 2, "unknown virus").when(k == 4, "ebola")
    return t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", pathogen.alias("pathogen"), F.when(F.col("item_id") % 3 == 0, "Uganda").alias("region"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("resolution_criteria"))


@query(f"""with dim(pathogen_key, url, o) as (values {", ".join(f"('{k}', '{u}', {i})" for i, (k, u) in enumerate(DASHBOARDS))})
select item_id::varchar question_id, 'dashboard_' || item_id query_id, 'dashboard' engine, url, 'Dashboard: ' || {HOST} title, 'Known ' || pathogen_key || ' monitoring dashboard' snippet, 0 as rank, 1.0::double freshness_score, 'dashboard_lookup' retrieval_reason, o as ord
from (select item_id, {_PATHOGEN} p from benchmark) join dim on trim(lower(p)) = pathogen_key""")
def dashboard_inject(spark, d):
    return search.dashboards(_questions(spark, d), dashboard_dim(spark))


_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


@query(f"with w as (select item_id, {_WORDS.format('text')} w, item_id % 12 n from benchmark) select item_id, case when len(w[:n+1]) >= 2 then array_to_string(w[:least(n+1, 8)], ' ') end as query from w")
def subquery_validate(spark, d):
    cut = F.array_join(F.slice(text.words(F.col("text")), F.lit(1), (F.col("item_id") % 12 + 1).cast("int")), "  ")
    return t(spark, d, "benchmark").select("item_id", search.valid_query(cut).alias("query"))


@query(f"""with q as (select item_id::varchar question_id, nullif({_PATHOGEN}, '') p, case when item_id % 3 = 0 then 'Uganda' end r, array_to_string({_WORDS.format('text')}[:4], ' ') s from benchmark),
b as (select question_id, concat_ws(' ', p, r) base, s from q),
x as (select question_id, ord, case when base <> '' then base || ' ' || known else s || ' ' || other end txt, case when base <> '' then a1 else a2 end axis from b cross join
 (values (0, 'latest cases 2024 2025', 'latest', 'latest_data', 'latest_data'), (1, 'outbreak trend', 'trend', 'trend', 'trend'), (2, 'government response policy', 'expert analysis', 'policy', 'expert_opinion')) v(ord, known, other, a1, a2))
select question_id, ord, array_to_string({_WORDS.format('txt')}[:8], ' ') as text, axis from x""")
def subquery_fallback(spark, d):
    return search.fallback_queries(_questions(spark, d))


@query(f"""with recursive p as (select page_id % 3 question_id, page_id % 8 as ord, count(*) n from pages group by all),
b as (select question_id, ord, n, 2 + coalesce(sum(n) over (partition by question_id order by ord rows between unbounded preceding and 1 preceding), 0) total_before, row_number() over (partition by question_id order by ord) k from p)
select question_id, ord, n as n_results, total_before::bigint total_before from b where k = 1 or total_before < 60""")
def search_early_stop(spark, d):
    p = t(spark, d, "pages").groupBy((F.col("page_id") % 3).alias("question_id"), (F.col("page_id") % 8).alias("ord")).agg(F.count("*").alias("n_results"))
    return search.early_stop(p.withColumn("n_dashboards", F.lit(2))).select("question_id", "ord", "n_results", "total_before")


_CACHE = "sha256(concat_ws('|', {0}, trim(lower(text), ' ' || chr(10) || chr(9) || chr(13)), '2024-06-01'))"


@query(f"""with c as (select conv_id, turn, {_CACHE.format("'table'")} cache_key, timestamp '2024-06-01' - to_hours((conv_id % 40)::int) created_at from conversations where turn = 0),
u as (select cache_key, max(created_at) created_at from c where conv_id % 3 <> 0 group by cache_key),
q as (select conv_id, turn, {_CACHE.format("'table'")} cache_key from conversations)
select conv_id, turn, q.cache_key, u.cache_key is not null as hit from q left join u on u.cache_key = q.cache_key and u.created_at >= timestamp '2024-05-31'""")
def cache_hit(spark, d):
    c = t(spark, d, "conversations").withColumn("cache_key", cache.cache_key(F.lit("table"), F.col("text"), AS_OF))
    rows = c.filter("turn = 0 and conv_id % 3 <> 0").select("cache_key", F.concat(F.lit("r"), "conv_id").alias("results_json"), (F.lit(AS_OF) - F.make_dt_interval(hours=(F.col("conv_id") % 40).cast("int"))).alias("created_at"))
    return cache.lookup(c.select("conv_id", "turn", "cache_key"), cache.upsert(rows.limit(0), rows), AS_OF).select("conv_id", "turn", "cache_key", "hit")


_HEADER = "case page_id % 6 when 0 then null when 1 then '' when 2 then 'Text/HTML; charset=utf-8' when 3 then 'application/octet-stream' when 4 then ' application/JSON ' else 'application/octet-stream; x=1' end"
_BODY = "case page_id % 5 when 0 then '%PDF-1.7' when 1 then '  <HTML>' when 2 then 'plain' else substr(html, 1, 64) end"


@query(f"""with x as (select page_id, nullif(trim(lower(split_part({_HEADER}, ';', 1))), '') mime, {_BODY} body from pages)
select page_id, case when mime is null or mime = 'application/octet-stream' then coalesce(case when body like '\\%PDF-%' escape '\\' then 'application/pdf' when lower(ltrim(body)) like '<!doctype%' or lower(ltrim(body)) like '<html%' then 'text/html' end, mime) else mime end as content_type from x""")
def mime_sniff(spark, d):
    p = t(spark, d, "pages")
    k, b = F.col("page_id") % 6, F.col("page_id") % 5
    header = F.when(k == 1, "").when(k == 2, "Text/HTML; charset=utf-8").when(k == 3, "application/octet-stream").when(k == 4, " application/JSON ").when(k == 5, "application/octet-stream; x=1")
    body = F.when(b == 0, "%PDF-1.7").when(b == 1, "  <HTML>").when(b == 2, "plain").otherwise(F.substring("html", 1, 64))
    return p.select("page_id", text.sniff_type(header, body).alias("content_type"))


# ---------------------------------------------------------------- text and filtering


@query(f"with x as (select doc_id, unnest({TOKENS.format('text')}) tok, generate_subscripts({TOKENS.format('text')}, 1) i from documents), c as (select doc_id, tok, count(*) n, min(i) f from x group by all), r as (select *, row_number() over (partition by doc_id order by n desc, f) k from c) select doc_id, tok as token, n, k as position from r where k <= 5")
def token_top_k(spark, d):
    from pyspark.sql import Window

    # a document's texts meet before they become tokens: its counts and its ranks need no further shuffle
    x = t(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(text.tokenize(F.col("text"))).alias("i", "token"))
    c = x.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("i").alias("f"))
    return c.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "f"))).filter("position <= 5").drop("f")


@query(f"""with x as (select doc_id, list_distinct({TOKENS.format('text')}) a, lead(list_distinct({TOKENS.format('text')})) over (order by doc_id) b, lead(doc_id) over (order by doc_id) other from documents)
select doc_id, other, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 9)::double as jaccard from x where other = doc_id + 1""")
def jaccard_pairs(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.array_distinct(text.tokenize(F.col("text"))).alias("a"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("a").alias("b"))
    return x.join(y, "doc_id").select("doc_id", "other", F.round(text.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


def _items(spark, d) -> tuple[DataFrame, F.Column]:
    """The questions with their places k in the order of ids, and the place of each document's question: documents are dealt over all questions. Places come
    from a sort by ranges, whose parts number their rows, and the few counts of the parts; no task sees all questions."""
    b = t(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    parts = b.repartitionByRange("item_id").sortWithinPartitions("item_id").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    starts, total = [], 0
    for r in parts.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, r.first - total))
        total += r.n
    shift = spark.createDataFrame(starts, "part int, shift long")
    return parts.join(F.broadcast(shift), "part").select("item_id", "q", (F.col("at") - F.col("shift")).alias("k")), F.col("doc_id") % max(1, total)


@query(f"""with q as (select item_id, list_distinct({TOKENS.format('text')}) q from benchmark), x as (select doc_id, {TOKENS.format('text')} x from documents)
select doc_id, item_id, round(case when len(q) = 0 then 0 else len(list_intersect(q, x)) / len(q) end, 9)::double as overlap from x join (select *, row_number() over (order by item_id) - 1 k, count(*) over () n from q) q on k = doc_id % n""")
def keyword_overlap(spark, d):
    q, k = _items(spark, d)
    return t(spark, d, "documents").withColumn("k", k).join(q, "k").select("doc_id", "item_id", F.round(text.keyword_overlap(F.col("text"), F.col("q")), 9).alias("overlap"))


_F = f"""{PAGES_SQL},
q as (select item_id, text q_text, {_PATHOGEN} q_pathogen, case when item_id % 3 = 0 then 'Uganda' end q_region from benchmark),
u as (select r.page_id, r.question_id, case when r.page_id % 17 = 0 then url || '/about-us' else url end url, domain, canonical_url, title, case when r.page_id % 3 = 0 then q_text when r.page_id % 3 = 1 then substr(q_text, 1, 80) else '' end snippet, r.published_date,
 case when r.page_id % 7 = 0 then 'pdf' end file_type, source_tier, is_official_domain, domain_score, freshness_score, q_text, q_pathogen, q_region from ranked r join q on q.item_id = r.question_id),
t as (select *, {TOKENS.format("title || ' ' || snippet || ' ' || domain")} tt, list_distinct({TOKENS.format("concat_ws(' ', q_text, q_pathogen, q_region)")}) qq from u),
s as (select *, domain in {BLOCKED} or regexp_matches(lower(url), '/login|/signup|/register|/account|/privacy|/terms|/contact|/about|/careers|/advertise') or regexp_matches(lower(title), 'sign in|login|register|cookie policy|privacy policy|terms of use') or (trim(title) = '' and trim(snippet) = '') low,
 case when len(qq) = 0 then 0 else len(list_intersect(qq, tt)) / len(qq) end::double rel0,
 least(1, greatest(case source_tier when 'official' then 1.0 when 'academic' then 0.9 when 'trusted_media' then 0.65 when 'ngo' then 0.6 else 0.35 end::double, case when is_official_domain then 0.95 else 0 end) + case when file_type = 'pdf' then 0.03 else 0 end) cred0 from t),
w as (select *, case when low then 0 else rel0 end relevance_score, case when low then 0 else cred0 end credibility_score from s),
r as (select *, case when low then 0 else 0.75::double * ((relevance_score * 0.4::double + freshness_score * 0.2::double + domain_score * 0.2::double + case when is_official_domain then 1.0 else 0.0 end * 0.2::double) / 1.0::double) + 0.25::double * credibility_score end priority_score from w),
k as (select *, case when low then 'reject' when priority_score >= 0.72 then 'keep' when priority_score >= 0.45 then 'borderline' else 'reject' end route from r)"""


def _for_filter(spark, d) -> DataFrame:
    q = _questions(spark, d).select(F.col("id").cast("long").alias("question_id"), *[F.col(c).alias(f"q_{c}") for c in ("text", "pathogen", "region", "event_type", "resolution_criteria")])
    k = F.col("page_id")
    r = results(spark, d).join(q, "question_id")
    r = r.withColumn("url", F.when(k % 17 == 0, F.concat("url", F.lit("/about-us"))).otherwise(F.col("url"))).withColumn("snippet", F.when(k % 3 == 0, F.col("q_text")).when(k % 3 == 1, F.substring("q_text", 1, 80)).otherwise("")).withColumn("file_type", F.when(k % 7 == 0, "pdf"))
    return r.withColumn("id", F.col("page_id").cast("string")).withColumn("ord", F.col("page_id"))


from dataclasses import replace  # noqa: E402

CFG = replace(filtering.CFG, blocked_domains=BLOCKED)


@query(f"with {_F} select page_id, low, round(relevance_score, 9)::double relevance_score, round(credibility_score, 9)::double credibility_score, round(priority_score, 9)::double priority_score, route, case when low then 'low_value_page' else concat_ws(',', case when is_official_domain then 'official_domain' end, case when source_tier = 'academic' then 'academic_source' end, case when published_date is not null then 'has_publication_date' end, case when file_type = 'pdf' then 'pdf_candidate' end, case route when 'keep' then 'passed_heuristic_threshold' when 'borderline' then 'borderline_candidate' else 'below_threshold' end) end as reasons from k")
def route3(spark, d):
    r = filtering.route(_for_filter(spark, d).withColumn("low", filtering.low_value(CFG)), CFG)
    return r.select("page_id", "low", *[F.round(c, 9).alias(c) for c in ("relevance_score", "credibility_score", "priority_score")], "route", F.array_join("reason_codes", ",").alias("reasons"))


_R = f"""{_F},
rr as (select *, least(1, case when len(qq) = 0 then 0 else len(list_intersect(qq, tt)) / len(qq) end::double + case when is_official_domain then 0.1 else 0 end + case when source_tier = 'academic' then 0.05 else 0 end) rerank_score from k where route = 'borderline'),
r2 as (select * replace (priority_score * 0.6::double + rerank_score * 0.4::double as priority_score, greatest(relevance_score, rerank_score) as relevance_score) from rr),
r3 as (select *, row_number() over (partition by question_id order by priority_score desc, page_id) rank_ord, case when priority_score >= 0.82 then 'auto_keep' when priority_score <= 0.3 then 'auto_reject' else 'model' end b from r2),
sp as (select *, case when b = 'model' and row_number() over (partition by question_id, b order by rank_ord) > 10 then 'overflow' else b end branch from r3)"""


@query(f"with {_R} select page_id, question_id, rank_ord, branch, round(priority_score, 9)::double priority_score, round(rerank_score, 9)::double rerank_score from sp")
def rerank_split(spark, d):
    r = filtering.split_for_model(filtering.rerank(filtering.route(_for_filter(spark, d), CFG).filter("route = 'borderline'"), CFG), CFG)
    return r.select("page_id", "question_id", "rank_ord", "branch", F.round("priority_score", 9).alias("priority_score"), F.round("rerank_score", 9).alias("rerank_score"))


def _decisions(df: DataFrame) -> DataFrame:
    k = F.col("page_id")
    return df.filter(k % 4 != 0).select(F.col("page_id").cast("string").alias("result_id"), k.alias("ord"), (k % 4 != 1).alias("keep"), F.when(k % 3 == 0, 0.7).alias("relevance_score"), F.lit(None).cast("double").alias("credibility_score"), F.when(k % 2 == 0, 0.9).alias("final_score"), F.when(k % 5 == 0, F.array(F.lit("model_says"))).alias("reason_codes"), F.lit("n").alias("notes"))


@query(f"with {_R} select page_id, coalesce(page_id % 4 > 1, false) and page_id % 4 <> 0 as keep, round(case when page_id % 4 <> 0 and page_id % 3 = 0 then 0.7 else relevance_score end, 9)::double relevance_score, round(case when page_id % 4 <> 0 and page_id % 2 = 0 then 0.9 else priority_score end, 9)::double final_score from sp where branch = 'model'")
def llm_decision_merge(spark, d):
    m = filtering.split_for_model(filtering.rerank(filtering.route(_for_filter(spark, d), CFG).filter("route = 'borderline'"), CFG), CFG).filter("branch = 'model'")
    return filtering.merge_decisions(m, _decisions(t(spark, d, "pages"))).select("page_id", "keep", F.round("relevance_score", 9).alias("relevance_score"), F.round("priority_score", 9).alias("final_score"))


@query(f"with {_R} select page_id, false as keep, 'llm_skipped' as stage from sp where branch = 'model'")
def llm_fail_closed(spark, d):
    m = filtering.split_for_model(filtering.rerank(filtering.route(_for_filter(spark, d), CFG).filter("route = 'borderline'"), CFG), CFG).filter("branch = 'model'")
    return filtering.fail_closed(m).select("page_id", "keep", "stage")


#: Groups of documents of one source and of nearly one length.
_GROUPS = "select doc_id, source || '/' || (n_chars // 50) g, lang, n_chars, text title from documents"


@query(f"""with recursive s as (select *, row_number() over (partition by g order by n_chars desc, doc_id) o, list_distinct({TOKENS.format('title')}) tk from ({_GROUPS})),
r as (select g, 1::bigint o, [{{'id': doc_id, 'l': lang, 'tk': tk}}] kept from s where o = 1
 union all select r.g, s.o, case when len(list_filter(r.kept, lambda e: e.l = s.lang and (len(list_distinct(list_concat(e.tk, s.tk))) = 0 or len(list_intersect(e.tk, s.tk)) / len(list_distinct(list_concat(e.tk, s.tk))) >= 0.5))) > 0 then r.kept else list_append(r.kept, {{'id': s.doc_id, 'l': s.lang, 'tk': s.tk}}) end
 from r join s on s.g = r.g and s.o = r.o + 1),
f as (select g, arg_max(kept, o) kept from r group by g)
select g, unnest(kept).id as doc_id, generate_subscripts(kept, 1) - 1 as kept_ord from f""")
def near_dup_greedy(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.floor(F.col("n_chars") / 50)).alias("g"), F.col("lang").alias("domain"), F.col("n_chars").cast("double").alias("final_score"), F.col("text").alias("title"), F.lit(None).cast("string").alias("canonical_url"), F.lit("").alias("snippet"), F.col("doc_id").alias("ord"))
    return filtering.drop_near_copies(x, 0.5, "g", "doc_id").select("g", "doc_id", "kept_ord")


@query(f"""with recursive s as (select doc_id, g, lang, case when doc_id % 3 = 0 then 'pdf' else 'unknown' end ty, row_number() over (partition by g order by doc_id) o from (select *, source g from documents)),
r as (select g, 1::bigint o, [{{'id': doc_id, 'l': lang, 't': ty}}] kept from s where o = 1
 union all select r.g, s.o, case when len(list_filter(r.kept, lambda e: e.l = s.lang)) >= 2 or len(list_filter(r.kept, lambda e: e.t = s.ty)) >= 3 then r.kept else list_append(r.kept, {{'id': s.doc_id, 'l': s.lang, 't': s.ty}}) end
 from r join s on s.g = r.g and s.o = r.o + 1),
f as (select g, arg_max(kept, o) kept from r group by g)
select g, unnest(kept).id as doc_id, generate_subscripts(kept, 1) - 1 as kept_ord from f""")
def joint_caps(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.col("source").alias("g"), F.col("lang").alias("domain"), F.when(F.col("doc_id") % 3 == 0, "pdf").alias("file_type"), F.col("doc_id").alias("ord"))
    return filtering.joint_caps(x, 2, 3, "g", "doc_id").select("g", "doc_id", "kept_ord")


_REASONS = "concat_ws(',', case when is_official_domain then 'official_domain' end, case when source_tier = 'academic' then 'academic_source' end, case when published_date is not null then 'has_publication_date' end, case when file_type = 'pdf' then 'pdf_candidate' end, {0})"
_BASE = "question_id, page_id, url, canonical_url, domain, title, snippet, file_type, source_tier, is_official_domain"


@query(f"""with recursive {_R},
un as (select {_BASE}, priority_score final_score, {_REASONS.format("'passed_heuristic_threshold'")} reasons, 0 part, page_id wi from k where route = 'keep'
 union all select {_BASE}, priority_score, {_REASONS.format("'borderline_candidate', 'auto_keep_after_rerank'")}, 1, rank_ord from sp where branch = 'auto_keep'
 union all select {_BASE}, case when page_id % 2 = 0 then 0.9 else priority_score end, case when page_id % 5 = 0 then 'model_says' else {_REASONS.format("'borderline_candidate'")} end, 2, rank_ord from sp where branch = 'model' and page_id % 4 > 1),
od as (select *, row_number() over (partition by question_id order by final_score desc, part, wi) o, list_distinct({TOKENS.format("title || ' ' || snippet")}) tk from un),
nd as (select question_id, 1::bigint o, [{{'o': o, 'u': canonical_url, 'd': domain, 'tk': tk}}] kept from od where o = 1
 union all select n.question_id, od.o, case when len(list_filter(n.kept, lambda e: e.u = od.canonical_url or (e.d = od.domain and (len(list_distinct(list_concat(e.tk, od.tk))) = 0 or len(list_intersect(e.tk, od.tk)) / len(list_distinct(list_concat(e.tk, od.tk))) >= 0.92)))) > 0 then n.kept else list_append(n.kept, {{'o': od.o, 'u': od.canonical_url, 'd': od.domain, 'tk': od.tk}}) end
 from nd n join od on od.question_id = n.question_id and od.o = n.o + 1),
un1 as (select question_id, unnest(list_transform(arg_max(kept, o), lambda e: e.o)) o from nd group by question_id),
ud as (select od.* exclude (o), row_number() over (partition by od.question_id order by od.o) o from od join un1 using (question_id, o)),
cp as (select question_id, 1::bigint o, [{{'o': o, 'd': domain, 't': coalesce(file_type, 'unknown')}}] kept from ud where o = 1
 union all select c.question_id, ud.o, case when len(list_filter(c.kept, lambda e: e.d = ud.domain)) >= 2 or len(list_filter(c.kept, lambda e: e.t = coalesce(ud.file_type, 'unknown'))) >= 5 then c.kept else list_append(c.kept, {{'o': ud.o, 'd': ud.domain, 't': coalesce(ud.file_type, 'unknown')}}) end
 from cp c join ud on ud.question_id = c.question_id and ud.o = c.o + 1),
cp1 as (select question_id, unnest(list_transform(arg_max(kept, o), lambda e: e.o)) o from cp group by question_id)
select question_id, page_id::varchar result_id, domain, round(final_score, 9)::double final_score, row_number() over (partition by question_id order by o)::int extraction_priority,
 case when file_type = 'pdf' or lower(url) like '%.pdf' then 'pdf' when lower(url) like 'http%' then 'html' else 'unknown' end extraction_mode,
 case when is_official_domain and final_score >= 0.85 then 'high' when source_tier in ('official', 'academic') then 'medium' else 'low' end expected_value, reasons selection_reasons
from ud join cp1 using (question_id, o)""")
def filtered_docs(spark, d):
    q = _questions(spark, d).withColumn("id", F.col("id").cast("long"))
    out = filtering.filter_stage(_for_filter(spark, d).drop("q_text", "q_pathogen", "q_region", "q_event_type", "q_resolution_criteria"), q, _decisions(t(spark, d, "pages")), CFG)
    return out.select("question_id", F.col("id").alias("result_id"), "domain", F.round("final_score", 9).alias("final_score"), "extraction_priority", "extraction_mode", "expected_value", F.array_join("selection_reasons", ",").alias("selection_reasons"))


# ---------------------------------------------------------------- extraction


@query(f"select page_id, {TITLE} as title, lower(split_part(regexp_extract(html, '(?is)<html[^>]*\\slang=[\"'']?([^\"''\\s>]+)', 1), '-', 1)) as language from pages")
def html_meta(spark, d):
    return t(spark, d, "pages").select("page_id", html.title_tag(F.col("html")).alias("title"), html.language_tag(F.col("html")).alias("language"))


@query()
def html_sections(spark, d):
    return html.parse_sections(t(spark, d, "pages"), "page_id", "html").drop("table_rows")


@query("with x as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')) p from documents) select doc_id, count(*) n, sum(length(p))::bigint n_chars, min(p) first_piece from x group by doc_id")
def paragraph_split(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.explode(chunking.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("p"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("n_chars"), F.min("p").alias("first_piece"))


def _chunks(spark, d) -> DataFrame:
    k = F.col("doc_id") % 3
    body = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).when(k == 1, F.col("text")).otherwise(F.regexp_replace("text", "[.!?]", ""))
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("section_path"), F.lit(None).cast("int").alias("page_number"), body.alias("text"), F.when(F.col("doc_id") % 10 == 9, "table").otherwise("prose").alias("chunk_type"), F.lit(None).cast("array<array<string>>").alias("table_rows"))
    return chunking.normalize_chunks(chunking.build_chunks(x), extract.ExtractConfig(target_tokens=100, most_tokens=200))


_CHUNK_SQL = """b as (select doc_id, case doc_id % 3 when 0 then replace(text, chr(10), chr(10) || chr(10)) when 1 then text else regexp_replace(text, '[.!?]', '', 'g') end t, doc_id % 10 = 9 tab from documents),
pc as (select *, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') ps,
 list_filter(string_split(regexp_replace(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') ss, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') ws from b),
pj as (select doc_id, t, tab, not tab and ceil(length(t) / 4.0) > 200 as big, case when len(ps) > 1 then ps when len(ss) > 1 then ss else ws end p, case when len(ps) > 1 or len(ss) > 1 then chr(10) || chr(10) else ' ' end j from pc),
f as (select doc_id, j, list_reduce(list_transform(p, lambda x: {'done': []::varchar[], 'cur': x}), lambda a, x: case when ceil(length(a.cur || j || x.cur) / 4.0) <= 100 then {'done': a.done, 'cur': a.cur || j || x.cur} else {'done': list_append(a.done, a.cur), 'cur': x.cur} end) r from pj where big and len(p) > 0),
c as (select doc_id, unnest(list_append(r.done, r.cur)) x, generate_subscripts(list_append(r.done, r.cur), 1) - 1 i, true big from f union all select doc_id, t, 0, false from pj where not big)"""


@query(f"with {_CHUNK_SQL} select doc_id::varchar document_id, doc_id || '-c0' || case when big then '-p' || i else '' end chunk_id, i::int chunk_index, sha256(x) text_sha256, ceil(length(x) / 4.0)::int token_count from c")
def chunk_normalise(spark, d):
    return _chunks(spark, d).select("document_id", "chunk_id", "chunk_index", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "token_count")


@query(f"with {_CHUNK_SQL} select doc_id::varchar document_id, count(*) n_chunks, sum(length(x))::bigint char_count, sum(ceil(length(x) / 4.0))::bigint token_count from c group by doc_id")
def doc_stats(spark, d):
    return chunking.document_stats(_chunks(spark, d)).drop("extracted_tables")


_DATES = "'Seen ' || strftime(o_orderdate, '%Y-%m-%d') || ', shipped ' || day(o_orderdate) || ' ' || strftime(o_orderdate, '%B %Y') || ' and on ' || strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) || ' or ' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) || ' again ' || strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""with x as (select o_orderkey, {_DATES} s from orders), y as (select o_orderkey, list_concat(list_concat(regexp_extract_all(s, '(?i)\\d{{1,2}}\\s+(?:{MONTHS})\\s+\\d{{4}}'), regexp_extract_all(s, '(?i)(?:{MONTHS})\\s+\\d{{1,2}},?\\s+\\d{{4}}')), list_concat(regexp_extract_all(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), regexp_extract_all(s, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}'))) l from x)
select o_orderkey, array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i), '; ') as dates from y""")
def date_strings(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    f = lambda p: F.date_format(ts, p)
    s = F.concat(F.lit("Seen "), f("yyyy-MM-dd"), F.lit(", shipped "), f("d MMMM yyyy"), F.lit(" and on "), f("MMMM d, yyyy"), F.lit(" or "), f("M/d/yyyy"), F.lit(" again "), f("yyyy-MM-dd"))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(extract.date_strings(s), "; ").alias("dates"))


# ---------------------------------------------------------------- retrieval


def _sentences(spark, d) -> DataFrame:
    """Documents' lines as chunks."""
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"), F.lit(None).cast("string").alias("heading"))
    return x.withColumn("chunk_id", F.concat("document_id", F.lit("-c"), "chunk_index"))


def _asked(spark, d) -> DataFrame:
    """For each document the question of its number: its own first words and the question's."""
    q, k = _items(spark, d)
    x = t(spark, d, "documents").withColumn("k", k).join(q, "k")
    return x.select(F.col("item_id").alias("question_id"), F.col("doc_id").cast("string").alias("document_id"), F.concat_ws(" ", F.array_join(F.slice(text.words(F.col("text")), 3, 6), " "), F.array_join(F.slice(text.words(F.col("q")), 1, 8), " ")).alias("query"))


_W = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
_BM25 = f"""ch as (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents),
tk as (select doc_id, i, {_W.format('x')} w from ch), sz as (select doc_id, count(*) n, avg(len(w)) al from tk group by doc_id),
tf as (select doc_id, i, l, w, count(*) tf from (select doc_id, i, len(w) l, unnest(w) w from tk) group by all),
df as (select doc_id, w, count(*) df from tf group by all),
id as (select doc_id, w, al, ln(n - df + 0.5) - ln(df + 0.5) raw from df join sz using (doc_id)),
ie as (select doc_id, w, al, case when raw < 0 then 0.25 * avg(raw) over (partition by doc_id) else raw end idf from id),
qs as (select doc_id, item_id, array_to_string({_WORDS.format('d.text')}[3:8], ' ') || ' ' || array_to_string({_WORDS.format('b.text')}[1:8], ' ') q from documents d join (select *, row_number() over (order by item_id) - 1 k, count(*) over () n from benchmark) b on b.k = d.doc_id % b.n),
qt as (select doc_id, item_id, w, count(*) k from (select doc_id, item_id, unnest({_W.format('q')}) w from qs) group by all),
sc as (select doc_id, item_id, i, sum(k * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) s from tf join qt using (doc_id, w) join ie using (doc_id, w) group by all),
al as (select qs.doc_id, qs.item_id, ch.i, ch.x, coalesce(s, 0.0) s from qs join ch using (doc_id) left join sc on sc.doc_id = qs.doc_id and sc.i = ch.i)"""


@query(f"with {_BM25}, r as (select *, row_number() over (partition by doc_id order by round(s, 9) desc, i) p from al) select item_id question_id, doc_id::varchar document_id, doc_id || '-c' || i chunk_id, p as position, round(s, 6)::double bm25_score from r where p <= 12")
def bm25_topk(spark, d):
    s = retrieval.bm25(_sentences(spark, d), _asked(spark, d), ("chunk_index",)).withColumn("r", F.round("bm25_score", 9))
    return retrieval.top_k(s, "r", 12, ["question_id", "document_id"]).select("question_id", "document_id", "chunk_id", "position", F.round("bm25_score", 6).alias("bm25_score"))


@query("""with q as (select vec_id q, label, embedding::double[] e from embeddings where vec_id % 50 = 0), x as (select q.q question_id, v.label::varchar document_id, v.vec_id, list_cosine_similarity(q.e, v.embedding::double[]) s from q join embeddings v on v.label = q.label),
r as (select *, row_number() over (partition by question_id, document_id order by round(s, 9) desc, vec_id) p from x) select question_id, document_id, vec_id, p as position, round(s, 6)::double emb_score from r where p <= 12""")
def cosine_topk(spark, d):
    """Within a document, here a label: the scope that the evidence stages have."""
    v = t(spark, d, "embeddings").select(F.col("label").cast("string").alias("document_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("question_id"), "document_id", "embedding")
    return retrieval.nearest_of_document(v, q, 12).select("question_id", "document_id", F.col("chunk_id").alias("vec_id"), "position", F.round("emb_score", 6).alias("emb_score"))


@query("""with q as (select vec_id question_id, embedding::double[] e from embeddings where vec_id % 50 = 0 and embedding is not null), x as (select question_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 9) s from q cross join embeddings v where v.embedding is not null),
r as (select *, row_number() over (partition by question_id order by s desc, vec_id) p from x) select question_id, p::int as position, vec_id, round(s, 6)::double emb_score from r where p <= 12""")
def nearest_vectors(spark, d):
    """Every vector whose id is divisible by 50 against all vectors, whatever their labels."""
    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return retrieval.nearest(v, q, 12, "vec_id").select("question_id", "position", "vec_id", F.round("emb_score", 6).alias("emb_score"))


@query("with x as (select doc_id, source, n_chars, min(n_chars) over (partition by source) lo, max(n_chars) over (partition by source) hi from documents) select doc_id, round(case when hi = lo then 1.0 else (n_chars - lo) / (hi - lo)::double end, 9)::double as norm from x")
def minmax(spark, d):
    return t(spark, d, "documents").withColumn("norm", retrieval.min_max("n_chars", ["source"])).select("doc_id", F.round("norm", 9).alias("norm"))


@query("select doc_id, case when contains(lower(text || ' ' || source), 'the') or contains(lower(text || ' ' || source), 'src1') then 1.0 else 0.5 end::double soft, case when contains(lower(text || ' ' || source), 'zzqx') then 1.0 else 0.0 end::double hard, 1.0::double none from documents")
def keyword_bias(spark, d):
    x = t(spark, d, "documents")
    kb = lambda ks, hard: retrieval.keyword_bias(F.array(*map(F.lit, ks)).cast("array<string>"), F.col("text"), F.col("source"), hard)
    return x.select("doc_id", kb(["the", "SRC1"], False).alias("soft"), kb(["zzqx"], True).alias("hard"), kb([], False).alias("none"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 0.75 when o_orderdate between timestamp '1994-01-01' and timestamp '1995-06-30' then 1.0 else 0.5 end::double as bias from orders")
def date_bias(spark, d):
    pub = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp"))
    return t(spark, d, "orders").select("o_orderkey", dates.window_bias(pub, dt.datetime(1994, 1, 1), dt.datetime(1995, 6, 30)).alias("bias"))


_HASHED = "list_transform(generate_series(0, 31), lambda k: ('0x' || substr(sha256({0}), k * 2 + 1, 2))::int / 255.0::double)"


@query(f"""with {_BM25}, e as (select doc_id, item_id, i, x, s, list_cosine_similarity({_HASHED.format('x')}, {_HASHED.format('q')}) c from al join qs using (doc_id, item_id)),
n as (select *, case when max(s) over w = min(s) over w then 1.0 else (s - min(s) over w) / (max(s) over w - min(s) over w) end b, case when max(c) over w = min(c) over w then 1.0 else (c - min(c) over w) / (max(c) over w - min(c) over w) end g from e window w as (partition by doc_id)),
h as (select *, 0.5 * b + 0.5 * g + 0.1 * (case when contains(lower(x), 'the') then 0.5 else 0 end) sc from n), r as (select *, row_number() over (partition by doc_id order by round(sc, 7) desc, i) p from h)
select item_id question_id, doc_id::varchar document_id, doc_id || '-c' || i chunk_id, p as position, round(sc, 5)::double score from r where p <= 12""")
def hybrid_topk(spark, d):
    c = _sentences(spark, d).withColumn("embedding", text.hash_embedding(F.col("text")))
    q = _asked(spark, d).withColumn("embedding", text.hash_embedding(F.col("query"))).withColumn("keywords", F.array(F.lit("The")))
    # the double times 1e5 is rounded, as the SQL does, not its shortest decimal: 0.159375 lies below the half
    return retrieval.hybrid(c, q).select("question_id", "document_id", "chunk_id", "position", (F.round(F.col("score") * 1e5) / 1e5).alias("score"))


# ---------------------------------------------------------------- insight


@query("""with x as (select conv_id % 20 run_id, conv_id ord, turn, length(text) // 4 c, conv_id % 7 = 0 skipped from conversations), y as (select run_id, ord, sum(c) cost, bool_or(skipped) skipped from x group by all),
z as (select *, coalesce(sum(case when skipped then 0 else cost end) over (partition by run_id order by ord rows between unbounded preceding and 1 preceding), 0) spent from y),
u as (select *, not skipped and spent >= 2000 o from z), v as (select *, o or coalesce(bool_or(o) over (partition by run_id order by ord rows between unbounded preceding and 1 preceding), false) st from u)
select run_id, ord, cost::bigint cost, spent::bigint spent_before, case when st then 'stopped' when skipped then 'skipped' else 'processed' end decision from v""")
def budget_gate(spark, d):
    x = t(spark, d, "conversations").groupBy((F.col("conv_id") % 20).alias("run_id"), F.col("conv_id").alias("ord")).agg(F.sum(F.floor(F.length("text") / 4)).alias("cost"))
    x = x.withColumn("skipped", F.col("ord") % 7 == 0)
    return insight.budget_gate(x, 2000).select("run_id", "ord", "cost", "spent_before", "decision")


@query("select coalesce(role, null) model, sum(length(text))::bigint input_tokens, sum(turn)::bigint output_tokens, count(*) n_calls from conversations group by rollup(role)")
def usage_rollup(spark, d):
    return insight.usage(t(spark, d, "conversations").select(F.col("role").alias("model"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")))


_PLACES = ["Uganda", "Mubende district, Uganda", "Texas", "Unknown Planet", "drc", " Kenya , Nowhere"]
_EVENTS = f"""ev as (select event_id, user_id, event_type, value, ts, props, (['{"', '".join(_PLACES)}'])[event_id % 6 + 1] place, 'Report:  ' || event_type || ' of ' || value || chr(10) || ' in event ' || event_id body from events),
fa as (select *, case when event_id % 4 = 0 then 'made up ' || event_id else event_type || ' of ' || value end quote from ev)"""


def _facts(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    k = F.col("event_id")
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (k % 6 + 1).cast("int"))
    body = F.concat(F.lit("Report:  "), "event_type", F.lit(" of "), F.col("value").cast("string"), F.lit("\n in event "), k)
    quote = F.when(k % 4 == 0, F.concat(F.lit("made up "), k)).otherwise(F.concat("event_type", F.lit("  of "), F.col("value").cast("string")))
    fact = F.struct(F.when(k % 9 != 0, F.col("event_type")).alias("event_type"), F.when(k % 8 == 1, "x").when(k % 8 != 2, ((k % 100) / 100).cast("string")).alias("confidence"), place.alias("location"), F.col("event_type").alias("metric_name"), k.cast("string").alias("metric_value"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("event_date"), quote.alias("quote"))
    rows = e.select((F.col("user_id") % 5).alias("question_id"), F.col("user_id").cast("string").alias("document_id"), (k % 50).cast("string").alias("chunk_id"), F.lit("u").alias("source_url"), k.alias("ord"), body.alias("text"), F.to_json(F.struct(F.array(fact).alias("facts"))).alias("raw_text"))
    return insight.guarded(insight.facts(rows))


_CODES = "case event_id % 6 when 0 then 'UG' when 1 then 'UG' when 2 then 'US' when 4 then 'CD' when 5 then 'KE' end"


@query(f"with {_EVENTS} select event_id ord, case when event_id % 9 = 0 then 'other' else event_type end event_type, case when event_id % 8 in (1, 2) then 0.5 else (event_id % 100) / 100.0::double end::double confidence, {_CODES} iso_country_code, event_id::double metric_value, strftime(ts, '%Y-%m-%d') event_date from fa where event_id % 4 <> 0")
def fact_flatten_guard(spark, d):
    return _facts(spark, d).select("ord", "event_type", "confidence", "iso_country_code", "metric_value", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in COUNTRIES.items())


@query(f"with m(k, v) as (values {_NAMES}) select n_nationkey, n_name, m.v as iso, m.v as iso_tail from nation left join m on lower(n_name) = m.k")
def country_resolve(spark, d):
    n = t(spark, d, "nation")
    return n.select("n_nationkey", "n_name", insight.country_code(F.col("n_name")).alias("iso"), insight.country_code(F.concat(F.lit("some place , "), "n_name", F.lit(" "))).alias("iso_tail"))


@query("select o_orderkey, case when o_orderkey % 5 = 4 then null else strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') end as event_date from orders")
def event_date(spark, d):
    ts, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    s = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "d MMMM yyyy")).when(k == 2, F.date_format(ts, "MMMM d, yyyy")).when(k == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return t(spark, d, "orders").select("o_orderkey", F.date_format(dates.event_date(s), "yyyy-MM-dd").alias("event_date"))


@query(f"""with {_EVENTS}, g as (select event_id, user_id % 5 question_id, user_id::varchar document_id, (event_id % 50)::varchar chunk_id, case when event_id % 9 = 0 then 'other' else event_type end event_type, event_type metric_name, trim(lower(place)) loc, place, strftime(ts, '%Y-%m-%d') dd, case when event_id % 8 in (1, 2) then 0.5 else (event_id % 100) / 100.0::double end::double confidence from fa where event_id % 4 <> 0),
o as (select question_id, event_type, metric_name, dd, loc, document_id, chunk_id, min(event_id) f, max(confidence) confidence from g group by all)
select question_id, event_type, metric_name, dd event_date, arg_min(g.place, g.event_id) as location, min(g.event_id) as ord, min(g.event_id)::double metric_value, max(o.confidence) confidence, count(distinct (o.document_id, o.chunk_id)) n_sources,
 (select string_agg(p.document_id || '/' || p.chunk_id, ',' order by p.f) from o p where p.question_id = o.question_id and p.event_type = o.event_type and p.metric_name = o.metric_name and p.dd = o.dd and p.loc = o.loc) sources
from o join g using (question_id, event_type, metric_name, dd, loc) group by question_id, event_type, metric_name, dd, loc""")
def record_merge(spark, d):
    r = insight.merge_records(_facts(spark, d))
    return r.select("question_id", "event_type", "metric_name", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "location", "ord", "metric_value", "confidence", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: F.concat(s["document_id"], F.lit("/"), s["chunk_id"])), ",").alias("sources"))


from . import queries_stages  # noqa: E402, F401  registers its queries here
from . import queries_calls  # noqa: E402, F401
