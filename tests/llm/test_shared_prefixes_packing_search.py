"""The conversation trie, packing and lexical search against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evloom.llm import lexical, packing, queries, trie
from evloom.llm.common import Scratch, scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: v[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def conversations(seed, n=150):
    rng = random.Random(seed)
    words = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(4)))
    rows = []
    for c in rng.sample(range(-100, 400), n):
        if rng.random() < 0.3:  # a third begin, and often end, alike
            turns = [("system", "be kind"), ("user", "hot first turn"), ("assistant", "yes")][: rng.randrange(1, 4)]
        else:
            turns = []
        turns += [(rng.choice(["user", None]), rng.choice([words(), None, ""])) for _ in range(rng.choice([0, 1, 2, 6]))]
        rows += [(c, None if i == 0 and c % 3 == 0 else i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard_turns", [0, 5, 40, 1 << 19])
def test_trie_by_hand(spark, shard_turns):
    """With no room, little room and much room in a shard."""
    rows = conversations(shard_turns)
    c = F.col("c")
    d = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), CONV).repartition(3).withColumns({x: F.lit("clash") for x in ("c", "k", "top", "depth", "n", "s", "base")})
    got = trie.prefix_trie(spark, d, base=c - c % 20, head=F.crc32(c.cast("string")) % 4, shard_turns=shard_turns).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == trie_by_hand(rows)


def test_trie_bounds_its_heavy_prefixes(spark):
    """Shards grow where there would be more heavy prefixes than may be; the result stays."""
    rows = [(c, t, "user", f"turn {min(t, 5)} {c % 3}") for c in range(60) for t in range(8)]
    d = spark.createDataFrame(rows, CONV)
    few, many = (trie.prefix_trie(spark, d, shard_turns=1, heavy=h).collect() for h in (2, 1 << 18))
    assert len(few) == len(many) == 25 and sorted(few) == sorted(many)


def test_trie_on_awkward_rows(spark):
    none = spark.createDataFrame([], CONV)
    assert trie.prefix_trie(spark, none).count() == 0
    assert trie.prefix_trie(spark, spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0
    only = trie.prefix_trie(spark, spark.createDataFrame([(7, 0, "user", "x")], CONV), base=F.lit(5).cast("long"), head=F.lit(3)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in only] == [(7, 0, 1, 1, hashlib.sha256(b"7").hexdigest())]
    long_text = "w " * 50_000
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", long_text), (2, None, "user", long_text)]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(spark, spark.createDataFrame(rows, CONV)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3)} and got[1, 1].saved_tokens == 50_000 and got[1, 1].n_convs == 2


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(3000) for t in range(2)]
    got = {r.depth: r for r in trie.prefix_trie(spark, spark.createDataFrame(rows, CONV).repartition(5)).collect()}
    assert got[2].n_convs == 3000 and got[2].ends_sha256 == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()


def test_louds_walks_both_ways():
    shape = trie.Louds([np.zeros(2, np.int64), np.array([0, 0, 1]), np.array([2, 2])])
    assert shape.bits.tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0]
    assert shape.parent().tolist() == [-1, -1, 0, 0, 1, 4, 4] and shape.children().tolist() == [2, 1, 0, 0, 2, 0, 0]
    x = np.ones(7, np.int64)
    shape.rollup(x)
    assert x.tolist() == [3, 4, 1, 1, 3, 1, 1]


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


ODD = ["", " ", "\n", " a", "a ", "\na", "a\n", "a  b", "a \n b", "a\tb \t c", "x<|endoftext|> y", "  <|endoftext|>  ", "é b ç Ωω 漢字 b", "a\0b c", "\0 a", "don't we'll\n\n\nx", "\x1c a\x1cb \x1c", " " * 5, "a　 b\r\n c", "one\ntwo three\nfour", "\U0001f600 \U0001f600x", "123 45a_b"]


def test_ids_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PIECES", 20)
    with open(queries.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = packing.Encoder(f.read())
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["ab", " ", " ", "\n", "C", "é", "'s", "1", ".", "<|", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    assert enc.fast is not None
    for _ in range(2):
        for part in (texts[:100], texts[100:]):
            for t, x in zip(part, enc.encode(pa.array(part)), strict=True):
                assert np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_fill_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(300):
        room = rng.randrange(1, 40)
        items = [rng.randrange(1, 20) for _ in range(rng.randrange(9))]
        counts = np.bincount(items, minlength=64)
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= room}
        got = packing.fill(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= counts[n] for n, k in got.items())


def hold(rows, texts, library, width=2048):
    """Every token of every document in one piece, sequences gapless, and none padded."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width and at & (at - 1) == 0
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc, len(ids)], key=lambda r: r.start)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and ("ids" not in r or r.ids == part)
        if len([d for d in texts if d == (doc, text)]) == 1:
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own]).tolist()[:-1]] and sum(r.length for r in own) == len(ids)
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)


@pytest.mark.parametrize("window", [4, 4096])
def test_packing_keeps_every_token(spark, library, window, monkeypatch):
    rng = random.Random(window)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gam", "épsilon"]) for _ in range(int(rng.expovariate(1 / 300))))) for i in range(120)]
    texts += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, "long " * 20_000), (5001, None), (None, "no id"), (7000, "same row"), (7000, "same row")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("start", "ids", "offset", "sequence_id")}).coalesce(1)
    monkeypatch.setattr(packing, "WINDOW", window)
    rows = packing.pack(spark, d, queries.tokenizer_path("byte_bpe_50k.json")).collect()
    hold(rows, texts, library)
    if window > 100:  # few documents are cut
        assert len(rows) < len(texts) + 60
    assert packing.pack(spark, d.limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_packing(spark, sf).collect()
    hold(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], library)


# ---------------------------------------------------------------- search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def search_by_hand(docs, items, k=10):
    every = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in every), sum(c.total() for _, c in every)
    df = Counter(t for _, c in every for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c in every:
            m = 10 + 90 * c.total() * n_docs // n_all if n_all else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "item_bytes", "first"), [(1 << 24, 1 << 24, 512), (2000, 300, 4), (1, 1, 1)])
def test_search_by_hand(spark, shard, item_bytes, first, monkeypatch):
    rng = random.Random(shard)
    vocabulary = ["THE", "the", "a1", "é", "Éa", "x_y", "z-z", "漢字", *[f"w{i}" for i in range(80)]]
    words = lambda n: rng.choice([" ", "_", ". "]).join(rng.choice(vocabulary[: rng.choice([4, 88])]) for _ in range(n))
    docs = [(i, words(rng.randrange(40))) for i in range(250)]
    docs += [(i, "same text the a1") for i in range(300, 320)] + [(400, None), (401, ""), (402, "..."), (None, "the é"), (None, "the é"), (403, "w5 " * 5000), (300, "same text the a1")]
    items = [(i, words(rng.randrange(6))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "same TEXT"), (23, "same TEXT"), (24, "the the the"), (None, "é")]
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "FIRST", first)
    clash = {x: F.lit(1) for x in ("id", "score", "rank", "item", "of", "round")}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(clash)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    if item_bytes == 1:
        q, items = q.filter("item_id in (3, 23, 24)"), [x for x in items if x[0] in (3, 23, 24)]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(spark, d, q).collect()), key=str)
    assert got == search_by_hand(docs, items)


def test_search_of_nothing(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(spark, d.limit(0), q).count() == lexical.search(spark, d, q.limit(0)).count() == 0


def test_blocks_cost_the_least(monkeypatch):
    """Against all ways to cut a few steps."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(lexical, "STEP", 2)
    score, off = rng.integers(1, 1000, 23), np.array([0, 1, 13, 23])
    starts = set(lexical.block_starts(score, off).tolist())
    assert {0, 1, 13} <= starts

    def cost(x, cuts):
        ends = [0, *cuts, len(x)]
        return sum((b - a) * x[a:b].max() + lexical.BLOCK_COST * x.mean() for a, b in zip(ends, ends[1:], strict=False))

    for lo, hi in zip(off, off[1:], strict=False):
        x, places = score[lo:hi], list(range(2, hi - lo, 2))
        least = min(cost(x, [p for i, p in enumerate(places) if m >> i & 1]) for m in range(1 << len(places)))
        assert math.isclose(cost(x, sorted(s - lo for s in starts if lo < s < hi)), least)


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    docs = np.sort(rng.choice(20_000, 6000, replace=False))
    term = np.repeat([0, 1, 2], 6000)
    times = np.where(rng.random(18_000) < 0.002, 40, 1)
    shard = lexical.Shard(term, np.concatenate([docs, np.sort(rng.choice(20_000, 6000, replace=False)), docs]), times, np.full(20_000, 800), np.arange(20_000))
    found, score = shard.best(np.array([0, 1, 2]), np.array([5, 3, 9]), 10)
    whole = np.bincount(shard.doc, weights=np.repeat([5, 3, 9], 6000) * shard.score)
    assert sorted(score.tolist()) == sorted(whole.tolist())[-10:] and shard.scored < 9000


# ---------------------------------------------------------------- scratch


def test_nothing_stays_but_results(spark, tmp_path):
    import os

    def kept():
        return set(os.listdir(f"{scratch_dir(spark)}/evloom")) if os.path.isdir(f"{scratch_dir(spark)}/evloom") else set()

    before = kept()
    sf = "/root/testdata/sf0.001"
    for name in ("op11_conversation_trie", "op13_lexical_search"):
        queries.QUERIES[name](spark, sf).count()
    assert all(x.startswith("result-") for x in kept() - before)
    with pytest.raises(RuntimeError), Scratch(spark, "failing") as s:
        s.table(spark.range(3), "x")
        raise RuntimeError
    assert not any("failing" in x for x in kept())
