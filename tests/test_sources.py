"""The search source, a live service, the cache as a stream's state, and sections by a table function."""

import datetime as dt
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from evloom import cli, schemas
from evloom.functions import udtf
from evloom.sources import backends, cache, search_source
from evloom.streaming import cache_state

AS_OF = dt.datetime(2025, 3, 1)


def service():
    """What stands for one: items by text, some of them malformed."""

    def recorded(text, most):
        if text == "down":
            raise OSError("no answer")
        return [x if i % 3 else {"title": "without a url"} for i, x in enumerate([{"url": f"http://{text}/{i}", "title": f"t{i}", "content": "c", "score": i} for i in range(7)])][:most]

    return recorded


def test_source_is_the_recorded_table(spark):
    recorded = service()
    search_source.register(spark, recorded)
    texts = ["a", "b", "down", "c", "a"]
    read = spark.read.format("evloom_search").option("queries", json.dumps(texts)).option("most", 6).load()
    got = sorted(map(tuple, read.collect()))
    items = {q: recorded(q, 6) for q in "abc"}
    table = spark.createDataFrame([(q, x["url"], x["title"], x["content"], i, None, float(x["score"])) for q, xs in items.items() for i, x in enumerate(xs, 1) if "url" in x], f"text string, {schemas.RAW_RESULT}")
    asked = spark.createDataFrame([(q, q) for q in ("a", "b", "down", "c")], "cache_key string, text string")
    assert got == sorted(map(tuple, backends.TableBackend(table).search(asked).collect())) and {r[4] for r in got} == {2, 3, 5, 6}
    assert spark.read.format("evloom_search").load().count() == 0


def test_filters_reach_the_source(spark, tmp_path):
    log = str(tmp_path)

    def counting(text, most):
        with open(f"{log}/{text}", "a"):
            pass
        return [{"url": f"http://{text}"}]

    search_source.register(spark, counting)
    read = lambda push: spark.read.format("evloom_search").option("queries", json.dumps(list("abcdef"))).option("per_partition", 2).option("push", push).load()
    assert [r.url for r in read(True).filter("text = 'c' and rank > 0").collect()] == ["http://c"]
    assert {x.name for x in tmp_path.iterdir()} == {"c"}
    assert read(True).filter(F.col("text").isin("a", "f")).count() == 2 and {x.name for x in tmp_path.iterdir()} == {"a", "c", "f"}
    plain = read(False)  # a frame that is used twice
    assert (plain.filter("text = 'c'").count(), plain.count(), plain.rdd.getNumPartitions()) == (1, 6, 3)


class Service(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.asked.append(body)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"results": [{"url": f"https://who.int/{len(body['query'])}", "content": "H5N1", "published_date": "2025-02-20"}, {"title": "no url"}]}).encode())

    def log_message(self, *a):
        pass


def test_search_asks_a_live_service(spark, tmp_path, monkeypatch):
    Service.asked = []
    site = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "secret")
    (tmp_path / "q.json").write_text(json.dumps({"id": "Q1", "text": "How many H5N1 cases", "pathogen": "H5N1", "region": "Uganda"}))
    (tmp_path / "r.json").write_text(json.dumps({"question_id": "Q1", "sub_queries": None}))
    args = ["search", "--questions", f"{tmp_path}/q.json", "--replies", f"{tmp_path}/r.json", "--endpoint", f"http://127.0.0.1:{site.server_address[1]}", "--key-variable", "SOME_KEY", "--as-of", "2025-03-01", "--output", f"{tmp_path}/out"]
    cli.main(args)
    first = spark.read.json(f"{tmp_path}/out/results").collect()
    assert {r.domain for r in first} >= {"who.int"} and len(Service.asked) == 3 == len({b["query"] for b in Service.asked})
    assert all(b["api_key"] == "secret" and b["max_results"] == 10 and b["topic"] == "news" for b in Service.asked)
    cli.main(args)  # what was asked is in the table of calls
    assert len(Service.asked) == 3 and len(spark.read.json(f"{tmp_path}/out/results").collect()) == len(first)
    site.shutdown()


def test_cache_state_is_lookup_and_upsert(spark, tmp_path):
    at = lambda h: AS_OF + dt.timedelta(hours=h)
    files = [
        [("k", "put", at(0), "[1]", None), ("k", "get", at(1), None, "g1"), ("other", "get", at(1), None, "g2"), ("k", "get", at(0), None, "g3")],
        [("k", "get", at(24), None, "g4"), ("k", "put", at(10), "[2]", None), ("late", "put", at(26), "[9]", None)],
        [("k", "get", at(34), None, "g5"), ("k", "get", at(35), None, "g6"), ("late", "get", at(30), None, "g7")],
        [("late", "get", at(1), None, "too late"), ("k", "get", at(60), None, "g8"), ("late", "put", at(60), "[10]", None), ("late", "get", at(61), None, "g9")],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, cache_state.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(cache_state.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    q = cache_state.answers(stream).writeStream.format("memory").queryName("cache_answers").outputMode("append").start()
    q.processAllAvailable()
    rows_left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {r.request_id: r.results_json for r in spark.table("cache_answers").collect()}
    seen, want = spark.createDataFrame([], schemas.CACHE), {}
    for rows in files:
        for k, kind, t, body, request in sorted(rows, key=lambda r: (r[2], r[1] == "get")):
            if kind == "put":
                seen = cache.upsert(seen, spark.createDataFrame([(k, body, t)], schemas.CACHE))
            elif request != "too late":
                want[request] = cache.lookup(spark.createDataFrame([(k,)], "cache_key string"), seen, t).first().results_json
    assert got == want and want["g4"] == "[2]" and want["g5"] == "[2]" and want["g6"] is None and want["g9"] == "[10]"
    assert rows_left == 1  # k is gone


def test_table_function(spark):
    udtf.register(spark)
    page = "<body><h1>A</h1><p>one</p><table><tr><td>x</td></tr></table></body>"
    spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("select id, s.* from some_pages, lateral html_sections(html) s order by id, pos").collect()
    assert [(r.id, r.pos, r.section_path, r.text, r.chunk_type, r.table_rows) for r in got] == [(1, 0, "A", "one", "prose", None), (1, 1, "A", "", "table", [["x"]])]
    with pytest.raises(Exception, match="takes a page"):
        spark.sql("select * from html_sections(12)").collect()
