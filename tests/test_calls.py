"""Calls to the outside world are made once, whatever reads their answers."""

import datetime as dt
import http.server
import threading
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evloom import schemas
from evloom.operators import extract, insight
from evloom.plans.config import InsightConfig
from evloom.sources import backends, cache, calls

AS_OF = dt.datetime(2025, 3, 1)


class Counting(http.server.BaseHTTPRequestHandler):
    seen: Counter = Counter()

    def do_GET(self):
        Counting.seen[self.path] += 1
        self.send_response(200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(f"<html><body><h1>H</h1><p>page {self.path}</p></body></html>".encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def site():
    Counting.seen = Counter()
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def filtered(spark, urls):
    cols = "result_id string, question_id string, url string, canonical_url string, domain string, title string, published_date timestamp, extraction_priority int"
    return spark.createDataFrame([(f"r{i}", "Q1", u, u, "d", "t", None, i) for i, u in enumerate(urls)], cols)


def test_one_request_a_url(spark, site, tmp_path):
    urls = [f"{site}/{i}" for i in range(20)]
    f = filtered(spark, urls + urls[:5])
    table = calls.CallTable(spark, schemas.FETCH_RESULT, "url", f"{tmp_path}/fetched", per_task=3)
    docs, chunks = extract.extract_stage(f, calls.fetch_once(f, table))
    assert (docs.count(), chunks.count(), docs.filter("status = 'success'").count()) == (25, 25, 25)
    assert set(Counting.seen.values()) == {1} and len(Counting.seen) == 20
    again = calls.CallTable(spark, schemas.FETCH_RESULT, "url", f"{tmp_path}/fetched")  # another run on the same folder
    assert calls.fetch_once(f, again).count() == 20 and calls.fetch_once(filtered(spark, [f"{site}/20", f"{site}/1"]), again).count() == 2
    assert set(Counting.seen.values()) == {1} and len(Counting.seen) == 21


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def slow_world(broken):
        def answer(frames):
            for f in frames:
                for k in f["key"]:
                    with open(log / f"{k}-{len(list(log.glob(f'{k}-*')))}", "w"):
                        pass
                    if broken and k == "k7":
                        raise ValueError("down")
                yield pd.DataFrame({"key": f["key"], "raw_text": "x", "input_tokens": 1, "output_tokens": 1, "model": "m"})

        return lambda new: new.select("key").mapInPandas(answer, schemas.REPLY)

    table = calls.CallTable(spark, schemas.REPLY, path=f"{tmp_path}/calls", per_task=1)
    asked = spark.createDataFrame([(f"k{i}",) for i in range(12)] + [(None,)], "key string")
    with pytest.raises(Exception, match="down"):
        table.ask(asked, slow_world(True))
    before = {r.key for r in table.answers().collect()}
    assert "k7" not in before
    assert table.ask(asked, slow_world(False)).count() == 12
    times = Counter(x.name.split("-")[0] for x in log.iterdir())
    assert all(times[k] == 1 for k in before) and times["k7"] == 2


class CountingBackend(backends.CallBackend):
    def __init__(self, folder):
        def call(text, most):
            with open(f"{folder}/{text}-{len([x for x in __import__('os').listdir(folder) if x.startswith(text + '-')])}", "w"):
                pass
            return [] if text == "none" else [{"url": f"http://{text}"}, {"title": "no url"}, {"url": f"http://{text}/2", "title": "t", "score": 1}]

        super().__init__(call, "counting")


def test_one_search_a_key(spark, tmp_path):
    q = spark.createDataFrame([("a",), ("b",), ("A ",), ("none",)], "text string").withColumn("cache_key", cache.cache_key(F.lit("t"), F.col("text"), AS_OF))
    old = spark.createDataFrame([], schemas.CACHE)
    found, new = cache.cache_aside(q, old, CountingBackend(tmp_path), AS_OF)
    got = found.collect()
    assert len(got) == 6 and {r["rank"] for r in got} == {1, 3} and {r.title for r in got} == {"", "t"}
    assert sorted(r.results_json == "[]" for r in new.collect()) == [False, False, True]
    assert found.count() == 6 and Counter(x.name.split("-")[0].strip().lower() for x in tmp_path.iterdir()) == {"a": 1, "b": 1, "none": 1}


# ---------------------------------------------------------------- the model and its budget


class CountingModel:
    """Takes other tokens than the prompts' lengths say, and writes down what it is asked."""

    def __init__(self, folder, tokens):
        self.folder, self.tokens = str(folder), tokens

    def complete(self, prompts):
        folder, tokens = self.folder, self.tokens

        def answer(frames):
            import os
            import uuid

            for f in frames:
                for k in f["key"]:
                    with open(os.path.join(folder, f"{k.replace('|', '+')}@{uuid.uuid4().hex}"), "w"):
                        pass
                yield pd.DataFrame({"key": f["key"], "raw_text": '{"facts": [{"event_type": "other", "quote": "case"}]}', "input_tokens": [tokens(k) for k in f["key"]], "output_tokens": 1, "model": "m"})

        return prompts.select("key").mapInPandas(answer, schemas.REPLY)


def run(spark, model, limit, n=14, table=None):
    q = spark.createDataFrame([("Q", "how many", None, None), ("R", "how few", None, None)], "id string, text string, pathogen string, region string")
    docs = spark.createDataFrame([(g, f"{g}{i:02}", "failed" if i == 3 else "success", 2, "t", "u", None, i) for g in "QR" for i in range(n)], "question_id string, document_id string, status string, n_chunks int, title string, source_url string, published_date timestamp, extraction_priority int")
    chunks = spark.createDataFrame([(f"{g}{i:02}", f"{g}{i:02}-c{j}", j, None, f"case {i} {j}") for g in "QR" for i in range(n) for j in range(2)], "document_id string, chunk_id string, chunk_index int, heading string, text string")
    return insight.insight_stage(q, docs, chunks, model, cfg=InsightConfig(most_input_tokens=limit), calls=table)


@pytest.mark.parametrize(("each", "limit"), [(1, 9), (1000, 3500), (200, 1), (7, 10**6)])
def test_budget_stops_where_real_costs_say(spark, tmp_path, each, limit):
    """Estimates are some 60 tokens a prompt; the stage must stop as if documents were asked one by one."""
    records, usage, stats = run(spark, CountingModel(tmp_path, lambda k: each + int(k.split("|")[1][1:]) % 3), limit)
    spent, want = 0, 0
    for i in range(14):
        if i == 3:
            continue
        if spent >= limit:
            break
        spent += 2 * (each + i % 3)
        want += 1
    assert {r.question_id: r.documents_processed for r in stats.collect()} == {"Q": want, "R": want}
    assert {len(r.sources) for r in records.collect()} == {2 * want}
    asked = Counter(x.name.split("@")[0] for x in tmp_path.iterdir())
    assert set(asked.values()) == {1}
    total = next(r for r in usage.collect() if r.model is None)
    assert total.n_calls == len(asked)
    if each >= 200 and limit < 10**6:
        assert len(asked) == 4 * want  # nothing was paid for beyond the stop


def test_a_broken_insight_run_asks_only_for_the_rest(spark, tmp_path):
    table = calls.CallTable(spark, schemas.REPLY, path=f"{tmp_path}/calls")
    (tmp_path / "log").mkdir()
    model = CountingModel(tmp_path / "log", lambda k: 5)
    first = run(spark, model, 25, table=table)[1].collect()
    more = run(spark, model, 1000, table=table)[1].collect()
    names = Counter(x.name.split("@")[0] for x in (tmp_path / "log").iterdir())
    assert set(names.values()) == {1} and len(names) == 52
    assert max(r.n_calls for r in first) < 52 == max(r.n_calls for r in more)
