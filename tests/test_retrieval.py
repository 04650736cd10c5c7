"""Retrieval: one pass over a document's chunks, and nearest vectors by blocks."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evloom import queries
from evloom.functions import text
from evloom.operators import retrieval

from compare import same

CHUNK = "document_id string, chunk_id string, chunk_index int, heading string, text string"


def bm25_by_hand(chunks, query):
    """chunks: of one document."""
    words = [x.lower().split() for x in chunks]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0
    out = []
    for ws in words:
        s = 0.0
        for w in query.lower().split():
            if w in df and (tf := ws.count(w)):
                s += (floor if raw[w] < 0 else raw[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))
        out.append(s)
    return out


def test_bm25_by_hand(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["A", "a", "b", "c.", "d", "é", "x y"]) for _ in range(n))
    docs = {f"d{i}": [words(rng.randrange(9)) for _ in range(rng.randrange(1, 7))] for i in range(20)} | {"empty": [""], "single": ["a"]}
    rows = [(d, f"{d}-{i}", i, None, x) for d, xs in docs.items() for i, x in enumerate(xs)] + [("unasked", "u", 0, None, "a"), ("null", "n", 0, None, None)]
    asked = [(q, d, words(4)) for d in docs for q in ("q1", "q2")] + [("q1", "gone", "a"), ("q1", "null", None)]
    got = retrieval.bm25(spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, "question_id string, document_id string, query string"), ("chunk_index",)).collect()
    have = {(r.question_id, r.document_id, r.chunk_index): r.bm25_score for r in got}
    want = {(q, d, i): s for q, d, x in asked if d in docs for i, s in enumerate(bm25_by_hand(docs[d], x))} | {("q1", "null", 0): 0.0}
    assert set(have) == set(want) and all(have[k] == pytest.approx(v) for k, v in want.items())


def test_a_text_is_shuffled_once(spark):
    """One exchange of each plan holds the chunks' texts."""
    sf = "/root/testdata/sf0.001"
    c = queries._sentences(spark, sf).withColumn("embedding", text.hash_embedding(F.col("text")))
    q = queries._asked(spark, sf).withColumn("embedding", text.hash_embedding(F.col("query"))).withColumn("keywords", F.array(F.lit("The")))
    for df in (retrieval.bm25(c, q, ("chunk_index", "text", "heading")), retrieval.hybrid(c, q)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]
        physical = df._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in re.findall(r"Exchange hashpartitioning\(([^,)]*)", physical)]
        below = physical.split("FlatMapCoGroupsInArrow")[1]
        assert sum("document_id" in x for x in moved) <= 4 and below.count("__body") >= 1
        assert physical.split("FlatMapCoGroupsInArrow")[0].count("Exchange") <= 1  # of what is found, by question and document


@pytest.mark.parametrize("groups", [1, 256])
def test_many_documents_are_one_group(spark, groups, monkeypatch):
    """A call of Python takes a group of documents, each with its own index, its questions and vectors; null is a document too."""
    monkeypatch.setattr(retrieval, "GROUPS", groups)
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    docs = {f"d{i}": [words(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))] for i in range(60)} | {None: ["a b", "c"]}
    vector = lambda i: [1.0, float(i)]
    rows = [(d, f"{d}-{i}", i, None, x, vector(i)) for d, xs in docs.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    asked = [(q, d, words(3), vector(3)) for d in docs for q in ("q1", "q2") if d != "d5"] + [("q1", "gone", "a", vector(1))]
    c = spark.createDataFrame(rows, CHUNK + ", embedding array<double>")
    q = spark.createDataFrame(asked, "question_id string, document_id string, query string, embedding array<double>")
    df = retrieval.bm25(c, q.withColumn("asks", F.col("query")), ("chunk_index",), ("asks",))
    # of the exchanges none deals by the document itself
    assert "hashpartitioning(__group_of_document_id" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.question_id, r.document_id, r.chunk_index): (r.asks, r.bm25_score, r.emb_score) for r in df.collect()}
    cosine = lambda i: (1 + 3 * i) / math.sqrt(10 * (1 + i * i))
    want = {(k, d, i): (x, s, cosine(i)) for k, d, x, _ in asked if d in docs for i, s in enumerate(bm25_by_hand(docs[d], x))}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:]) for k in want)


def test_hash_embedding_is_one_python_call_a_batch(spark):
    texts = [None, "", "a", "é\u2028", "x" * 999]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for dim in (32, 40):
        df = d.select("i", text.hash_embedding(F.col("x"), dim).alias("e"))
        assert "ArrowEvalPython" in df._jdf.queryExecution().optimizedPlan().toString()
        for i, e in df.collect():
            data = (texts[i] or "").encode()
            raw = [b / 255.0 for b in (hashlib.sha256(data).digest() + hashlib.sha256(data + (32).to_bytes(4, "big")).digest())[:dim]]
            total = 0.0
            for v in raw:
                total += v * v
            assert e == [v / math.sqrt(total) for v in raw]


@pytest.mark.parametrize("block_bytes, scores", [(300, 1 << 22), (1 << 24, 1 << 22), (1 << 24, 30), (1 << 24, 1)])
def test_nearest_by_hand(spark, block_bytes, scores, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(retrieval, "SCORES", scores)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)).round(1)
    x[50:60] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None), (902, [1.0, 2.0]), (None, x[3].tolist())]
    asked = [(i, v) for i, v in rows if i is not None and (i % 20 == 0 or i > 899)]
    v, q = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5), spark.createDataFrame(asked, "question_id long, embedding array<double>")
    got = sorted(((r.question_id, r.position, -1 if r.chunk_id is None else r.chunk_id, r.emb_score) for r in retrieval.nearest(v, q, 7).collect()))
    want = []
    unit = lambda a: np.array(a) / (np.linalg.norm(a) or 1)
    for i, e in asked:
        if e is None:
            continue
        found = sorted((-(round(float(unit(e) @ unit(y)), 9) + 0.0), j is None, -1 if j is None else j) for j, y in rows if y is not None and len(y) == len(e))[:7]
        want += [(i, p, j, -s) for p, (s, _, j) in enumerate(found, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    assert retrieval.nearest(v, q.limit(0), 3).count() == retrieval.nearest(v.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("block_bytes, scores", [(300, 1 << 20), (1 << 24, 1 << 20), (1 << 24, 1)])
def test_nearest_of_document_by_hand(spark, block_bytes, scores, monkeypatch):
    """Within a document; chunks without a cosine come last, with a null. No pair becomes a row of a join."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(retrieval, "SCORES", scores)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)).round(1)
    x[50:75] = x[40]  # ties
    rows = [(i, f"d{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(900, "few", None), (901, "few", [1.0, 2.0, 0.0, 1.0]), (902, "few", [1.0]), (903, "few", [1.0, None, 1.0, 1.0]), (904, None, x[0].tolist()), (905, "d0", None)]
    asked = [r for r in rows if r[0] % 20 == 0 or r[0] > 899]
    schema = "chunk_id long, document_id string, embedding array<double>"
    v = spark.createDataFrame(rows, schema).repartition(5)
    found = retrieval.nearest_of_document(v, spark.createDataFrame(asked, schema).withColumnRenamed("chunk_id", "question_id"), 7)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.question_id, r.position, r.chunk_id, r.emb_score) for r in found.collect())
    unit = lambda a: np.array(a) / (np.linalg.norm(a) or 1)
    whole = lambda e: e is not None and None not in e
    want = []
    for i, d, e in asked:
        score = lambda y: float(unit(e) @ unit(y)) if whole(e) and whole(y) and len(e) == len(y) else None  # noqa: B023, E731
        near = sorted(((j, score(y)) for j, c, y in rows if d is not None and c == d), key=lambda p: (p[1] is None, -round(p[1] or 0, 9), p[0]))[:7]
        want += [(i, p, j, s) for p, (j, s) in enumerate(near, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=lambda w: w[:2])]
    assert all(a == b or a == pytest.approx(b) for a, b in zip([g[3] for g in got], [w[3] for w in sorted(want, key=lambda w: w[:2])], strict=True))


def test_a_search_holds_few_scores(spark, monkeypatch):
    """Candidates that are merged stay a small multiple of the best, however many chunks are equally near."""
    seen = []
    merge = retrieval._Best.merge
    monkeypatch.setattr(retrieval._Best, "merge", lambda self: (seen.append(self.n), merge(self))[1])
    best = retrieval._Best(3000, 12, retrieval.pa.int64())
    for start in range(0, 3000, 300):
        best.add(0, np.ones((3000, 300)), np.ones((3000, 300)), retrieval.pa.array(range(start, start + 300)))
    assert max(seen) <= 3 * retrieval.WAITING * 12 * 3000
    assert best.merge()["id"].to_pylist()[:12] == list(range(12))


def test_hybrid_ties_go_by_place(spark):
    """A second chunk better by less than sums in another order differ doesn't pass the first."""
    rows = [("d", f"c{i}", i, None, body, e) for i, (body, e) in enumerate([("x y", [1.0, 3e-5]), ("x y", [1.0, 0.0]), ("z", [0.0, 1.0])])]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, heading string, text string, embedding array<double>")
    q = spark.createDataFrame([("q", "d", "x", [1.0, 0.0], None)], "question_id string, document_id string, query string, embedding array<double>, keywords array<string>")
    got = {r.chunk_id: (r.position, r.score) for r in retrieval.hybrid(chunks, q).collect()}
    assert got["c0"][1] < got["c1"][1] and [got[f"c{i}"][0] for i in range(3)] == [1, 2, 3]


def test_sums_that_differ_in_the_last_bit_are_equal(spark):
    d = spark.createDataFrame([("a", 0.1 + 0.2), ("a", 0.3), ("b", 1.0), ("b", 2.0), ("b", 1.5), ("c", None)], "k string, x double")
    got = sorted((r.k, r.n) for r in d.select("k", retrieval.min_max("x", ["k"]).alias("n")).collect() if r.k != "c")
    assert got == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.5), ("b", 1.0)]


def test_scores_equal_on_paper_are_scaled_as_the_sql_has_them(spark, tmp_path):
    """A second line five times as long with each shared word three times as often scores the same but for the last bit, of which the scaling makes 0 and 1."""
    docs = []
    for i in range(120):
        n, shared, asked = 8 + i % 15, 1 + i // 15, 1 + i % 2
        both = [f"w{k}" for k in range(shared)]
        first = ["a0", "a1", *both[:asked], *(f"a{k}" for k in range(2, 2 + n)), *both[asked:]]
        second = [*both * 3, *(f"b{k}" for k in range(5 * len(first) - 3 * shared))]
        docs.append((i, f"{' '.join(first)}\n{' '.join(second)}"))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "unseen")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    same(queries.hybrid_topk(spark, str(tmp_path)), con.sql(queries.ORACLE_SQL["hybrid_topk"]))


def test_token_counts_take_one_shuffle(spark):
    """Texts are dealt by document, not their tokens: one exchange, below the tokens."""
    d = queries.token_top_k(spark, "/root/testdata/sf0.001")
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_missing_chunks_are_sorted_after_they_are_dealt(spark):
    """No aggregate lies below the exchange of texts; a repeated id is embedded once."""
    rows = [(f"c{i % 40}", None, f"t{i % 40}") for i in range(80)] + [(None, None, "x"), (None, None, "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, heading string, text string")
    cache = chunks.filter("chunk_id like 'c1%'").dropDuplicates(["chunk_id"]).select("chunk_id", F.array(F.lit(9.0)).alias("embedding"))
    got = retrieval.embed_missing(chunks, cache, lambda x: F.array(F.length(x).cast("double")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # one of each id is taken right above the join that the texts were dealt for, not before
    assert "Exchange" not in plan[plan.index("first(__body") : plan.index("LeftAnti")]
    assert sorted((r.chunk_id or "", r.embedding[0]) for r in got.collect()) == sorted([(f"c{i}", 9.0 if str(i).startswith("1") else float(len(f"t{i}"))) for i in range(40)] + [("", 1.0)])
