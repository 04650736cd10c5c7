"""Edge values of expressions, worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evloom.functions import dates, text, urls
from evloom.operators import chunking, extract, insight, retrieval, search
from evloom.plans.config import FilterConfig, InsightConfig, from_dict
from evloom.plans.dims import tier_dim


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


URLS = [
    ("HTTPS://WWW.Example.COM:443/Path/?utm_source=x&b=2&a=1&a=0#f", "https://example.com/Path?a=1&a=0&b=2"),
    ("http://x.com:443/", "http://x.com:443"),
    ("https://x.com/?q=h5n1+cases%20x", "https://x.com?q=h5n1+cases+x"),
    ("https://x.com/a;p=1/b;q", "https://x.com/a;p=1/b"),
    ("example.com/p", "https://example.com/p"),
    ("https://user:pw@www.x.com/a//", "https://x.com/a"),
    ("https://x.com/?flag&UTM_ID=3", "https://x.com?flag="),
    ("https://x.com/?a=~*", "https://x.com?a=~%2A"),
    ("https://x.com/?a=%zz", "https://x.com?a=%25zz"),
    ("https://x.com:bad/a", "https://x.com/a"),
]


@pytest.mark.parametrize(("url", "want"), URLS)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


TIERS = [("who.int", 1, "official"), ("data.who.int", 1, "official"), ("nature.com", 1, "academic"), ("news.bbc.co.uk", 5, "unknown"), ("x.gov.uk", 2, "official"), ("a.gov", 3, "official"), ("mit.edu", 3, "academic"), ("un.int", 2, "official"), ("", 5, "unknown"), (None, 5, "unknown"), ("WHO.INT", 1, "official"), ("metaculus.com", 2, "trusted_media")]


def test_tiers(spark):
    df = spark.createDataFrame([(d,) for d, _, _ in TIERS], "domain string")
    got = {r.domain: (r.tier, r.source_tier) for r in search.resolve_tier(df, tier_dim(spark)).collect()}
    assert got == {d: (t, lab) for d, t, lab in TIERS}


def test_freshness_and_score(spark):
    now = dt.datetime(2025, 1, 1)
    ages = {None: 0.5, now - dt.timedelta(days=73): 0.8, now - dt.timedelta(days=400): 0.0, now + dt.timedelta(hours=1): 1.0}
    for pub, want in ages.items():
        assert one(spark, dates.freshness(F.lit(pub).cast("timestamp"), now)) == pytest.approx(want)
    assert one(spark, search.search_score(F.lit(1.0), F.lit(0.8), F.lit(2))) == pytest.approx(0.84)
    assert one(spark, search.search_score(F.lit(1.0), F.lit(1.0), F.lit(0))) == 1.0


def test_dates(spark):
    for s in ("2025-02-03T04:05:06Z", "2025-02-03T04:05:06+00:00", "2025-2-3T4:5:6"):
        assert one(spark, F.date_format(dates.published(F.lit(s)), "yyyy-MM-dd HH:mm:ss")) == "2025-02-03 04:05:06"
    assert one(spark, dates.published(F.lit("soon"))) is None
    assert one(spark, F.date_format(dates.event_date(F.lit("3 march 2025")), "yyyy-MM-dd")) == "2025-03-03"
    assert one(spark, F.date_format(dates.pdf_date(F.lit("D:20241201120000")), "yyyy-MM-dd")) == "2024-12-01"
    assert one(spark, extract.date_strings(F.lit("2025-02-15 and 3 March 2025"))) == ["3 March 2025", "2025-02-15"]


def test_words_and_overlap(spark):
    assert one(spark, search.valid_query(F.lit(" a  b\tc d e f g h i j"))) == "a b c d e f g h"
    assert one(spark, search.valid_query(F.lit("one"))) is None
    assert one(spark, text.tokenize(F.lit("Café  x_1-y"))) == ["caf", "x_1-y"]
    assert one(spark, text.normalize_text(F.lit(" A  B\n"))) == "a b"
    e = F.array().cast("array<string>")
    assert one(spark, text.jaccard(e, e)) == 1.0
    assert one(spark, text.jaccard(e, F.array(F.lit("a")))) == 0.0
    assert one(spark, text.keyword_overlap(F.lit("a b"), F.lit(""))) == 0.0
    assert one(spark, text.keyword_overlap(F.lit("a b"), F.lit("A a c"))) == 0.5
    assert one(spark, text.weighted_sum({"a": F.lit(1.0), "z": F.lit(9.0)}, {"a": 2.0})) == 1.0


def test_merge_of_reasons(spark):
    rows = [("q1", "u", 3, 0, "trend"), ("q1", "u", 1, 1, "latest_data"), ("q2", "u", 5, 0, "trend"), ("q2", "u", 6, 1, "policy"), ("q2", "u", 1, 2, "trend"), ("q3", "u", 1, 0, "a"), ("q3", "u", 1, 1, "b")]
    df = spark.createDataFrame(rows, "question_id string, canonical_url string, rank int, ord int, retrieval_reason string").withColumn("url", F.lit("u"))
    got = {r.question_id: (r.retrieval_reason, r.rank, r.ord) for r in search.merge_duplicates(df).collect()}
    assert got == {"q1": ("trend,latest_data", 1, 1), "q2": ("trend", 1, 2), "q3": ("a,b", 1, 0)}


def test_early_stop(spark):
    df = spark.createDataFrame([("q", i, 10, 2) for i in range(8)], "question_id string, ord int, n_results int, n_dashboards int")
    assert sorted(r.ord for r in search.early_stop(df).collect()) == [0, 1, 2, 3, 4, 5]


def test_bm25_floor(spark):
    chunks = spark.createDataFrame([("d", "c1", "", "a b"), ("d", "c2", "", "a b"), ("d", "c3", "", "a x")], "document_id string, chunk_id string, heading string, text string")
    q = spark.createDataFrame([("q", "d", "x x")], "question_id string, document_id string, query string")
    got = {r.chunk_id: r.bm25_score for r in retrieval.bm25(chunks, q).collect()}
    assert got["c1"] == got["c2"] == 0.0
    assert got["c3"] == pytest.approx(2 * 0.5108256 * 1, abs=1e-5)
    none = retrieval.bm25(chunks.withColumn("text", F.lit("")), q).collect()
    assert [r.bm25_score for r in none] == [0.0, 0.0, 0.0]


def test_min_max_and_budget(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", 2.0)], "k string, x double")
    assert sorted((r.k, r.n) for r in df.withColumn("n", retrieval.min_max("x", ["k"])).collect()) == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.5), ("b", 1.0)]
    docs = spark.createDataFrame([("r", 1, 10, False), ("r", 2, 20, False), ("r", 3, 30, True), ("r", 4, 30, False), ("r", 5, 1, True)], "run_id string, ord int, cost int, skipped boolean")
    decide = lambda limit: [r.decision for r in insight.budget_gate(docs, limit).orderBy("ord").collect()]
    assert decide(25) == ["processed", "processed", "skipped", "stopped", "stopped"]
    assert decide(31) == ["processed", "processed", "skipped", "processed", "skipped"]
    assert decide(0) == ["stopped", "stopped", "stopped", "stopped", "stopped"]


def test_country(spark):
    for place, code in (("Mubende district, Uganda", "UG"), ("DRC", "CD"), ("Unknown Planet", None), (None, None), ("Kenya, nowhere", "KE")):
        assert one(spark, insight.country_code(F.lit(place).cast("string"))) == code


def test_facts_guard_and_merge(spark):
    raw = '{"facts": [{"event_type": "case_count", "confidence": 0.92, "metric_value": "9", "event_date": "2025-02-10", "location": " Uganda ", "quote": "9  confirmed\\ncases"}, {"quote": "made up"}, {"quote": ""}]}'
    rows = spark.createDataFrame([("k1", "q", "d1", "c1", "u", 1, "There are 9 confirmed cases.", raw), ("k2", "q", "d2", "c1", "u", 2, "9 confirmed cases", raw.replace("0.92", '"x"')), ("k3", "q", "d3", "c1", "u", 3, "t", '{"facts": []}'), ("k4", "q", "d3", "c2", "u", 4, "t", "no json")], "key string, question_id string, document_id string, chunk_id string, source_url string, ord int, text string, raw_text string")
    kept = insight.guarded(insight.facts(rows))
    assert sorted((r.document_id, r.confidence, r.metric_value, r.iso_country_code) for r in kept.collect()) == [("d1", 0.92, 9.0, "UG"), ("d2", 0.5, 9.0, "UG")]
    merged = insight.merge_records(kept).collect()
    assert len(merged) == 1
    assert merged[0].confidence == 0.92
    assert [s.document_id for s in merged[0].sources] == ["d1", "d2"]


def test_chunk_cascade(spark):
    split = lambda s, n: one(spark, chunking.split_text(F.lit(s), n))
    assert split("aaaa\n\nbbbb\n\ncccc", 3) == ["aaaa\n\nbbbb", "cccc"]
    assert split("One two. Three four! Five", 4) == ["One two.", "Three four!", "Five"]
    assert split("w " * 10, 2) == ["w w w w", "w w w w", "w w"]
    assert split("", 2) == []


def test_hash_embedding_is_unit(spark):
    v = one(spark, text.hash_embedding(F.lit("x"), 48))
    assert len(v) == 48
    assert sum(x * x for x in v) == pytest.approx(1.0)
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_config_ignores_unknown_keys():
    assert from_dict(InsightConfig, {"top_k": 3, "other": 1}).top_k == 3
    assert FilterConfig().near_duplicate == 0.92
