"""Greedy near copies in rounds give what the walk gives."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evloom.operators import filtering

COLS = "question_id string, id string, domain string, title string, snippet string, canonical_url string, final_score double, ord int"


def by_hand(rows, threshold):
    out = {}
    for q, i, d, title, _, url, score, o in sorted(rows, key=lambda r: (-r[6], r[7], r[1])):
        kept, t = out.setdefault(q, []), set((title or "").lower().split())
        like = lambda k: (url and k[2] == url) or (k[1] == (d or "") and (len(t & k[3]) / len(t | k[3]) if t | k[3] else 1.0) >= threshold)
        if not any(like(k) for k in kept):
            kept.append((i, d or "", url, t))
    return {(q, k[0], n) for q, ks in out.items() for n, k in enumerate(ks)}


@pytest.mark.parametrize(("threshold", "fold_rows"), [(0.4, 0), (0.8, 20), (1.0, 0), (0.8, 1000)])
def test_rounds_are_the_walk(spark, threshold, fold_rows):
    rng = random.Random(int(threshold * 10) + fold_rows)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for q, n in (("a", 150), ("b", 40), ("c", 3)):
        base = [rng.choices(words, k=rng.randrange(1, 14)) for _ in range(12)]
        for i in range(n):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            url = rng.choice([None, None, "", f"http://u/{rng.randrange(25)}"])
            rows.append((q, f"{q}{i}", rng.choice(["d", "e", None]), rng.choice([" ".join(w)] * 9 + [None, ""]), None, url, rng.choice([0.5, 0.7, 0.9]), rng.randrange(20)))
    d = spark.createDataFrame(rows, COLS).repartition(4)
    got = {(r.question_id, r.id, r.kept_ord) for r in filtering.drop_near_copies(d, threshold, fold_rows=fold_rows).collect()}
    assert got == by_hand(rows, threshold)


def test_a_group_of_a_hundred_thousand(spark):
    """Copies, near copies and rows of their own, all in one group."""
    n = 100_000
    k = F.col("id")
    own = F.concat_ws(" ", *[F.concat(F.lit(f"x{j}"), (k * (j + 3)).cast("string")) for j in range(4)])
    copy = F.concat_ws(" ", F.lit(" ".join(f"c{j}" for j in range(40))), (k % 5).cast("string"))
    d = spark.range(n).select(F.lit("q").alias("question_id"), k.cast("string").alias("id"), F.lit("d").alias("domain"), F.when(k % 2 == 0, own).otherwise(copy).alias("title"), F.lit("").alias("snippet"), F.when(k % 10 == 4, F.concat(F.lit("u"), k % 7)).alias("canonical_url"), F.lit(1.0).alias("final_score"), k.cast("int").alias("ord"))
    began = time.time()
    kept = filtering.drop_near_copies(d, 0.9).select("id").collect()
    ids = {int(r.id) for r in kept}
    # of the copies one; of the rows of their own all but those whose url came before
    assert ids == {1} | {i for i in range(0, n, 2) if i % 10 != 4} | {next(i for i in range(4, n, 10) if i % 7 == u) for u in range(7)}
    assert time.time() - began < 600


@pytest.mark.parametrize("threshold", [0.4, 1.0])
def test_blocks_are_the_walk_and_their_number_bounds_the_rounds(spark, threshold, monkeypatch):
    """Texts of which each shares words with the next, but is not like it: a chain as long as the group."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        w = [f"w{j}" for j in range(i * 3, i * 3 + 9)] + rng.sample(["a", "b", "c"], 2)
        rows.append(("q", f"{i}", rng.choice(["d", "d", "e"]), rng.choice([" ".join(w)] * 9 + [None]), None, rng.choice([None, None, f"http://u/{i % 40}"]), 0.5, i))
    rows += [("q", f"c{i}", "d", rows[i % 30][3], None, rows[i % 20][5], 0.5, 60 + i) for i in range(60)]
    tables = []
    monkeypatch.setattr(filtering, "stored", lambda df, name, of=filtering.stored: tables.append(name) or of(df, name))
    d = spark.createDataFrame(rows, COLS).repartition(4)
    got = {(r.question_id, r.id, r.kept_ord) for r in filtering.drop_near_copies(d, threshold, fold_rows=0, block_rows=50).collect()}
    assert got == by_hand(rows, threshold)
    assert tables.count("kept") <= 4
