"""The stages end to end, pages, cache, stream and files."""

import datetime as dt

from pyspark.sql import functions as F

from evloom import schemas
from evloom.operators import extract, filtering, html, insight, search
from evloom.plans.dims import dashboard_dim, tier_dim
from evloom.sources import backends, cache, files
from evloom.streaming import ingest

AS_OF = dt.datetime(2025, 3, 1)
PAGE = """<!doctype html><html lang="en-US"><head><title>T</title><meta property="og:title" content="Bird flu">
<meta property="article:published_time" content="2024-12-15T14:30:00Z"></head><body><nav><p>menu</p></nav><h1>A</h1><p>one <b>two</b><p>three
<h3>B</h3><p>in B</p><h3>C</h3><table><caption>Cap</caption><tr><th>x</th><th>y</th></tr><tr></tr><tr><td>1</td><td>2</td></tr></table><p>47 cases on 3 March 2025</p></body></html>"""


def questions(spark):
    rows = [("Q1", "How many H5N1 cases in the United States herds", "H5N1", "United States"), ("Q2", "Will mpox end", None, None)]
    q = spark.createDataFrame(rows, "id string, text string, pathogen string, region string")
    return q.withColumns({"created_at": F.lit(AS_OF).cast("timestamp"), "target_date": F.lit(None).cast("timestamp"), "event_type": F.lit(None).cast("string"), "resolution_criteria": F.lit(None).cast("string")})


def replies(spark):
    subs = [("H5N1 cases herds", "latest_data"), ("H5N1 trend", "trend"), ("one two three four five six seven eight nine", "policy"), ("bad axis here", "nonsense")]
    return spark.createDataFrame([("Q1", subs), ("Q2", None)], "question_id string, sub_queries array<struct<text:string,axis:string>>")


def raw(spark):
    urls = [("https://www.cdc.gov/a", "H5N1 cases herds", "2025-02-20"), ("https://who.int/b", "H5N1 cases", "2025-02-01T00:00:00Z"), ("https://nature.com/c", "H5N1", None), ("https://www.metaculus.com/q", "H5N1 odds", None), ("https://facebook.com/x", "H5N1", None), ("https://cdc.gov/a?utm_source=t", "H5N1 cases herds", None), ("https://x.com/pic.png", "pic", None)]
    rows = [("Q1", s, i, u, t, "snippet about H5N1 cases in United States herds", d) for s in (0, 1) for i, (u, t, d) in enumerate(urls)]
    return spark.createDataFrame(rows, "question_id string, sub_query_ord int, pos int, url string, title string, snippet string, published_date string")


def test_decompose(spark):
    got = [(r.question_id, r.text) for r in search.decompose(questions(spark), replies(spark)).orderBy("question_id", "ord").collect()]
    assert got[:3] == [("Q1", "H5N1 cases herds"), ("Q1", "H5N1 trend"), ("Q1", "one two three four five six seven eight")]
    assert [t for q, t in got if q == "Q2"] == ["Will mpox end latest", "Will mpox end trend", "Will mpox end expert analysis"]


def test_search_then_filter(spark):
    found = search.search_stage(questions(spark), replies(spark), raw(spark), tier_dim(spark), dashboard_dim(spark), AS_OF).cache()
    rows = found.collect()
    urls = [r.canonical_url for r in rows]
    assert len(urls) == len(set(urls))
    assert not any("facebook" in u or "png" in u for u in urls)
    assert {r.engine for r in rows if r["rank"] == 0} == {"dashboard"}
    assert next(r for r in rows if "metaculus" in r.url).contains_aggregator_forecast
    for r in rows:
        assert abs(r.search_stage_score - min(1, 0.5 * r.domain_score + 0.3 * r.freshness_score + 0.2 / max(r["rank"], 1))) < 1e-9
    results = found.withColumn("file_type", F.lit(None).cast("string")).withColumn("ord", F.col("position"))
    kept = filtering.filter_stage(results, questions(spark)).collect()
    assert any(r.domain == "cdc.gov" for r in kept)
    assert max([sum(r.domain == d for r in kept) for d in {r.domain for r in kept}]) <= 2


def test_joint_caps(spark):
    df = spark.createDataFrame([("q", "1", "D", "A", 1), ("q", "2", "D", "A", 2), ("q", "3", "D", "B", 3)], "question_id string, id string, domain string, file_type string, ord int")
    assert sorted(r.id for r in filtering.joint_caps(df, 2, 1).collect()) == ["1", "3"]


def test_near_copies_are_not_transitive(spark):
    w = [f"w{i}" for i in range(40)]
    titles = {"a": " ".join(w), "b": " ".join(w[2:]), "c": " ".join(w[4:])}
    df = spark.createDataFrame([("q", k, "d", t, "", None, 1.0, i) for i, (k, t) in enumerate(titles.items())], "question_id string, id string, domain string, title string, snippet string, canonical_url string, final_score double, ord int")
    assert sorted(r.id for r in filtering.drop_near_copies(df).collect()) == ["a", "c"]


def test_page():
    p = html.parse_page(PAGE)
    assert (p["title"], p["language"], p["published_date"]) == ("Bird flu", "en", "2024-12-15T14:30:00Z")
    assert [(s["section_path"], s["text"], s["chunk_type"]) for s in p["sections"]] == [(None, "menu", "prose"), ("A", "onetwo\nthree", "prose"), ("A > B", "in B", "prose"), ("A > B > C", "Cap", "table"), ("A > B > C", "47 cases on 3 March 2025", "prose")]
    assert p["sections"][3]["table_rows"] == [["x", "y"], ["1", "2"]]
    assert "menu" not in p["raw_text"]
    assert html.parse_page("")["sections"] == []


class Replies:
    def complete(self, prompts):
        return prompts.select("key", F.lit('{"facts": [{"event_type": "case_count", "metric_name": "cases", "metric_value": 47, "quote": "47 cases"}]}').alias("raw_text"), F.lit(10).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit("m").alias("model"))


def test_extract_then_insight(spark):
    cols = "result_id string, question_id string, url string, canonical_url string, domain string, title string, published_date timestamp, extraction_priority int"
    f = spark.createDataFrame([("r1", "Q1", "http://a", "http://a", "a", "t", None, 1), ("r2", "Q1", "http://b", "http://b", "b", "t", None, 2), ("r3", "Q1", "http://c", "http://c", "c", "t", None, 3), ("r4", "Q1", "http://d", "http://d", "d", "t", None, 4)], cols)
    got = [("http://a", "http://a", 200, "text/html", bytearray(PAGE.encode()), AS_OF, None), ("http://b", "http://b", None, None, None, AS_OF, "connection failed"), ("http://c", "http://c", 200, "text/plain", bytearray(b"47 cases here\n\nmore"), AS_OF, None), ("http://d", "http://d", 200, "application/pdf", bytearray(b"%PDF-1"), AS_OF, None)]
    docs, chunks = extract.extract_stage(f, spark.createDataFrame(got, schemas.FETCH_RESULT))
    by = {r.result_id: r for r in docs.collect()}
    assert [by[k].status for k in ("r1", "r2", "r3", "r4")] == ["success", "failed", "success", "failed"]
    assert by["r1"].extracted_dates == ["3 March 2025"]
    assert by["r1"].title == "Bird flu"
    assert by["r3"].n_chunks == 2
    records, usage, stats = insight.insight_stage(questions(spark), docs, chunks, Replies())
    r = records.collect()
    assert len(r) == 1
    assert {s.document_id for s in r[0].sources} == {"doc-r1", "doc-r3"}
    assert stats.first().documents_skipped == 2
    assert {x.model for x in usage.collect()} == {"m", None}


def test_pdf_spans(spark):
    rows = [("d", 1, 0, 0, 0, "Title", 18.0, 0), ("d", 1, 1, 0, 0, "body one", 10.0, 0), ("d", 1, 1, 1, 0, "goes on", 10.0, 0), ("d", 1, 2, 0, 0, "Bold head", 10.0, 16), ("d", 2, 0, 0, 0, "next page", 10.0, 0)]
    spans = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, text string, size double, flags int")
    got = [(r.section_path, r.page_number, r.text) for r in extract.pdf_sections(extract.pdf_headings(spans)).orderBy("pos").collect()]
    assert got == [("Title", 1, "body one goes on"), ("Bold head", 2, "next page")]


def test_cache_aside(spark):
    q = spark.createDataFrame([("H5N1 Cases ",), ("other",), ("none",)], "text string").withColumn("cache_key", cache.cache_key(F.lit("t"), F.col("text"), AS_OF))
    old = spark.createDataFrame([("h5n1 cases",)], "text string").select(cache.cache_key(F.lit("t"), F.col("text"), AS_OF).alias("cache_key"), F.lit('[{"url":"u","title":"t","snippet":"","rank":1}]').alias("results_json"), F.lit(AS_OF - dt.timedelta(hours=23)).cast("timestamp").alias("created_at"))
    table = spark.createDataFrame([("other", "v", "t", "", 1, None, None), ("h5n1 cases", "never", "t", "", 1, None, None)], "text string, url string, title string, snippet string, rank int, published_date string, score double")
    found, new = cache.cache_aside(q, old, backends.TableBackend(table), AS_OF)
    assert sorted((r.text, r.url) for r in found.collect()) == [("H5N1 Cases ", "u"), ("other", "v")]
    assert sorted(r.results_json for r in new.collect())[0] == "[]"
    assert cache.lookup(q, old.withColumn("created_at", F.lit(AS_OF - dt.timedelta(hours=25)).cast("timestamp")), AS_OF).filter("hit").count() == 0
    assert cache.upsert(old, old.withColumn("results_json", F.lit("[]"))).first().results_json == "[]"


def test_call_backend_survives_failures(spark):
    def call(text, most):
        if text == "bad":
            raise OSError("down")
        return [{"url": "u1", "title": "a"}, {"nothing": 1}, {"url": "u3", "title": "c"}]

    q = spark.createDataFrame([("1", "ok"), ("2", "bad")], "cache_key string, text string")
    got = backends.CallBackend(call, "call").search(q).collect()
    assert [(r.cache_key, r.url, r["rank"]) for r in got] == [("1", "u1", 1), ("1", "u3", 3)]


def test_files(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"result_id": "r1", "url": "http://a", "title": "t"}]')
    row = files.read_filtered(spark, str(tmp_path / "in.json")).first()
    assert (row.question_id, row.canonical_url, row.final_score, row.selection_reasons, row.is_official_domain) == ("q1", "http://a", 0.5, [], False)
    files.write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_fetch_over_http(spark):
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            size = {"/big": 5000, "/stream": 5000}.get(self.path, 20)
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
                self.end_headers()
                return
            self.send_response(404 if self.path == "/gone" else 200)
            if self.path != "/stream":
                self.send_header("Content-Length", str(size))
            self.end_headers()
            self.wfile.write(b"<html>" + b"x" * (size - 6))

        def log_message(self, *a):
            pass

    site = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{site.server_address[1]}"
    urls = [at + x for x in ("/page", "/gone", "/moved", "/big", "/stream")] + ["http://127.0.0.1:9/none"]
    got = {r.url: r for r in backends.fetch_http(spark.createDataFrame([(u,) for u in urls], "url string"), extract.ExtractConfig(most_bytes=1000, timeout_s=5)).collect()}
    site.shutdown()
    assert (got[at + "/page"].content_type, got[at + "/page"].status_code, len(got[at + "/page"].content_bytes)) == ("text/html", 200, 20)
    assert got[at + "/gone"].status_code == 404 and got[at + "/gone"].error is None
    assert got[at + "/moved"].final_url == at + "/page"
    assert "5000" in got[at + "/big"].error and got[at + "/big"].content_bytes is None
    assert "more than 1000" in got[at + "/stream"].error
    assert got[urls[-1]].error and got[urls[-1]].status_code is None


def test_search_with_cache_and_clis(spark, tmp_path):
    import json

    from evloom import cli

    table = raw(spark).select(F.lit("H5N1 trend").alias("text"), "url", "title", "snippet", (F.col("pos") + 1).alias("rank"), "published_date", F.lit(None).cast("double").alias("score")).dropDuplicates(["url"])
    none = spark.createDataFrame([], schemas.CACHE)
    found, after = cli.search_with_cache(spark, questions(spark), replies(spark), backends.TableBackend(table), none, AS_OF)
    urls = {r.canonical_url for r in found.collect()}
    assert "https://who.int/b" in urls and not any("facebook" in u for u in urls)
    kept = after.collect()
    assert sum(r.results_json != "[]" for r in kept) == 1 and len(kept) > 3
    nothing = backends.TableBackend(table.limit(0))
    again, _ = cli.search_with_cache(spark, questions(spark), replies(spark), nothing, after, AS_OF + dt.timedelta(hours=1))
    assert {r.canonical_url for r in again.collect()} == urls
    lines = lambda df, name: (tmp_path / name).write_text("\n".join(df.toJSON().collect())) and str(tmp_path / name)
    q, r, rec = lines(questions(spark), "q.json"), lines(replies(spark), "r.json"), lines(table, "rec.json")
    cli.main(["search", "--questions", q, "--replies", r, "--recorded", rec, "--as-of", "2025-03-01", "--output", f"{tmp_path}/s"])
    assert spark.read.json(f"{tmp_path}/s/results").count() == len(urls)
    cli.main(["filter", "--questions", q, "--input", f"{tmp_path}/s/results", "--output", f"{tmp_path}/f"])
    kept = spark.read.json(f"{tmp_path}/f").collect()
    assert kept and set(kept[0].asDict()) == set(files.FILTER_OUTPUT)
    (tmp_path / "d.json").write_text(json.dumps([{"result_id": "r1", "url": "http://a", "title": "t"}]))
    (tmp_path / "b.json").write_text(json.dumps({"url": "http://a", "final_url": "http://a", "status_code": 200, "content_type": "text/plain", "content_bytes": "aGVsbG8=", "fetched_at": "2025-03-01T00:00:00", "error": None}))
    cli.main(["extract", "--input", str(tmp_path / "d.json"), "--fetched", str(tmp_path / "b.json"), "--output", f"{tmp_path}/e"])
    assert spark.read.json(f"{tmp_path}/e/documents").first().status == "success"
    assert spark.read.json(f"{tmp_path}/e/chunks").first().text == "hello"


def test_filter_asks_a_model(spark):
    found = search.search_stage(questions(spark), replies(spark), raw(spark), tier_dim(spark), dashboard_dim(spark), AS_OF)
    results = found.withColumn("file_type", F.lit(None).cast("string")).withColumn("ord", F.col("position"))
    cfg = filtering.FilterConfig(keep=2.0, borderline=0.01, auto_keep=2.0, auto_reject=0.0)
    assert filtering.filter_stage(results, questions(spark), cfg=cfg).count() == 0

    class Keeps:
        def complete(self, prompts):
            ids = F.from_json("prompt", "candidates array<struct<result_id:string>>")["candidates"]["result_id"]
            reply = F.to_json(F.struct(F.transform(ids, lambda i: F.struct(i.alias("result_id"), F.lit(True).alias("keep"), F.lit(0.9).alias("final_score"))).alias("decisions")))
            return prompts.select("key", reply.alias("raw_text"))

    got = filtering.filter_stage(results, questions(spark), cfg=cfg, model=Keeps()).collect()
    assert got and all(r.final_score == 0.9 for r in got)


def test_embeddings_come_from_the_cache(spark):
    cols = "document_id string, chunk_id string, chunk_index int, heading string, text string"
    c = spark.createDataFrame([("d", f"c{i}", i, None, f"text {i} about mpox") for i in range(4)], cols)
    old = spark.createDataFrame([("c0", [1.0] * 32), ("gone", [0.0] * 32)], "chunk_id string, embedding array<double>")
    from evloom.operators import retrieval

    got = {r.chunk_id: r.embedding for r in retrieval.embed_missing(c, old, insight.text.hash_embedding).collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"} and got["c0"] == [1.0] * 32 and got["c1"] != got["c2"]
    docs = spark.createDataFrame([("Q1", "d", "success", 4, "t", "u", None, 1)], "question_id string, document_id string, status string, n_chunks int, title string, source_url string, published_date timestamp, extraction_priority int")
    _, usage, _ = insight.insight_stage(questions(spark), docs, c, Replies(), embedded=old)
    assert {x.n_calls for x in usage.collect()} == {4}


def test_pdf_with_table_title_and_date(spark):
    spans = [(1, 0, 0, 0, "Outbreak report", 18.0), (1, 1, 0, 0, "Some text of the report", 10.0)]
    spans += [(1, 2, i, j, f"r{i}c{j}", 10.0) for i in range(3) for j in range(4)] + [(1, 3, 0, 0, "short end", 10.0)]
    spans = spark.createDataFrame([("doc-r1", *s, 0) for s in spans], "doc_id string, page int, block int, line int, span int, text string, size double, flags int")
    f = spark.createDataFrame([("r1", "Q1", "http://a", "http://a", "a", None, None, 1)], "result_id string, question_id string, url string, canonical_url string, domain string, title string, published_date timestamp, extraction_priority int")
    got = spark.createDataFrame([("http://a", "http://a", 200, "application/pdf", bytearray(b"%PDF-1"), AS_OF, None)], schemas.FETCH_RESULT)
    info = spark.createDataFrame([("doc-r1", " The title ", "D:20241201093000")], "doc_id string, title string, creation_date string")
    docs, chunks = extract.extract_stage(f, got, spans, pdf_info=info)
    d = docs.first()
    assert (d.title, d.published_date, d.status, d.n_chunks) == ("The title", dt.datetime(2024, 12, 1), "success", 2)
    rows = chunks.orderBy("chunk_index").collect()
    assert rows[0].table_data == [[f"r{i}c{j}" for j in range(4)] for i in range(3)] and rows[0].heading is None  # before the page's own heading
    assert rows[1].heading == "Outbreak report"


def test_fetch_limits(spark):
    pages = spark.createDataFrame([("a", "a", 200, None, bytearray(b"<html>"), AS_OF), ("b", "b", 404, "text/html; x", bytearray(b"x" * 50), AS_OF)], "url string, final_url string, status_code int, header string, content_bytes binary, fetched_at timestamp")
    got = {r.url: r for r in backends.fetch_table(spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), pages, extract.ExtractConfig(most_bytes=20)).collect()}
    assert got["a"].content_type == "text/html"
    assert got["b"].error.startswith("content too large")
    assert got["c"].error == "connection failed"


def test_stream(spark, tmp_path):
    rows = [("q", "https://x.com/?utm_id=1", AS_OF), ("q", "https://www.x.com", AS_OF), ("q", "https://y.com", AS_OF)]
    spark.createDataFrame(rows, "question_id string, url string, retrieved_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("question_id string, url string, retrieved_at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.unique_results(stream).writeStream.format("memory").queryName("unique_results").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.canonical_url for r in spark.table("unique_results").collect()) == ["https://x.com", "https://y.com"]


def test_whole_texts_and_sources(spark, tmp_path):
    import random

    from evloom import queries

    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(400)) for _ in range(n))
    opening, body = words(80), words(400)
    # one opening with different bodies; one body with different openings, ids in different thousands
    texts = [f"{opening} {words(400)}" for _ in range(3)] + [f"{words(80)} {body}" for _ in range(3)] + [words(30) for _ in range(20)]
    rows = [(i * 700, x, rng.choice(["en", "de"]) if i > 5 else "en", "s" if i < 16 else "r", 100 + i) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    near, caps = {}, {}
    for i, x, lang, g, n in sorted(rows, key=lambda r: (-r[4], r[0])):
        kept, a = near.setdefault(f"{g}/{n // 50}", []), set(x.split())
        if not any(lang == l and len(a & b) / len(a | b) >= 0.5 for _, l, b in kept):
            kept.append((i, lang, a))
    for i, _, lang, g, _ in rows:
        kept = caps.setdefault(g, [])
        if sum(l == lang for _, l, _ in kept) < 2 and sum(p == (i % 3 == 0) for *_, p in kept) < 3:
            kept.append((i, lang, i % 3 == 0))
    assert {0, 700, 1400} <= {k[0] for k in near["s/2"]} and len({2100, 2800, 3500} & {k[0] for k in near["s/2"]}) == 1
    for name, want in (("near_dup_greedy", near), ("joint_caps", caps)):
        got = {(r.g, int(r.kept_ord), int(r.doc_id)) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {(g, n, k[0]) for g, ks in want.items() for n, k in enumerate(ks)}, name


def test_sources_as_rows(spark):
    cols = "question_id string, document_id string, chunk_id string, source_url string, ord int, event_type string, confidence double, location string, iso_country_code string, pathogen string, metric_name string, metric_value double, metric_unit string, event_date timestamp, summary string, quote string"
    rows = [("q", f"d{i % 3}", f"c{i % 4}", "u", i, "case_count", i / 100, [None, " Kenya", "kenya "][i % 3], None, None, "cases", float(i), None, None, None, f"quote {i}") for i in range(40)]
    facts = spark.createDataFrame(rows, cols)
    whole, counted = {r.id: r for r in insight.merge_records(facts).collect()}, {r.id: r for r in insight.merge_records(facts, sources=False).collect()}
    apart = insight.record_sources(facts).collect()
    assert set(whole) == set(counted) == {r.id for r in apart} and len(whole) == 2
    for i, r in whole.items():
        assert counted[i].n_sources == len(r.sources) and [(s.document_id, s.chunk_id, s.quote) for s in r.sources] == [(s.document_id, s.chunk_id, s.quote) for s in sorted((x for x in apart if x.id == i), key=lambda x: x.ord)]


def test_lookup_tables_are_broadcast_while_small(spark):
    few, many = tier_dim(spark), spark.range(10**6).select(F.col("id").cast("string").alias("domain"), F.lit(1).alias("tier"), F.lit("x").alias("label"))
    plan = lambda d: search.resolve_tier(spark.createDataFrame([("a.org",)], "domain string"), d)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(few) and "strategy=broadcast" not in plan(many)


def test_recorded_replies_rank_chunks_once(spark):
    """Records, budget and usage read what was ranked; none of them ranks again."""
    from evloom import queries_calls

    for df in queries_calls._by_document(spark, "/root/testdata/sf0.001", insight.CFG):
        assert "FlatMapCoGroupsInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
