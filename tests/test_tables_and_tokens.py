"""Tables by where spans stand, and exact token counts."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evloom import queries
from evloom.functions import tokens
from evloom.operators import chunking, extract
from evloom.plans.config import ExtractConfig

SPAN = "doc_id string, page int, block int, line int, span int, text string, size double, flags int, x0 double, x1 double, y double"


def placed(rows, left=50.0, width=100.0, height=14.0):
    """Spans of a grid; a cell is (column, text, columns spanned)."""
    out = []
    for i, row in enumerate(rows):
        for c, t, n in row:
            x0 = left + c * width
            out.append((x0, x0 + (n * width - 12 if n > 1 else min(width - 12, 5.0 * len(t))), i * height, 10.0, t))
    return out


def test_ragged_cells_and_a_row_over_all():
    rows = [[(0, "Region", 1), (1, "Cases", 1), (2, "Deaths", 1)], [(0, "North", 1), (2, "3", 1)], [(0, "All districts of the country together", 3)], [(1, "17", 1), (2, "4", 1)], [(0, "South", 1), (1, "12", 1), (2, "0", 1)]]
    got = extract.tables_of_page(placed(rows))
    assert got == [[["Region", "Cases", "Deaths"], ["North", "", "3"], ["All districts of the country together", "", ""], ["", "17", "4"], ["South", "12", "0"]]]
    prose = [(50.0, 400.0, 100.0 + 14 * i, 10.0, f"a line of prose, number {i}") for i in range(4)]
    assert extract.tables_of_page(prose) == []
    assert extract.tables_of_page([*placed(rows), *prose])[0][:2] == got[0][:2]
    bold = [(50.0, 80.0, 0.0, 10.0, "bold"), (83.0, 200.0, 0.0, 10.0, "and plain"), (50.0, 80.0, 14.0, 10.0, "bold"), (83.0, 190.0, 14.0, 10.0, "again")]
    assert extract.tables_of_page(bold) == []  # neighbours in a line are one cell


def test_grids_against_what_was_drawn():
    rng = random.Random(2)
    for _ in range(200):
        n, m = rng.randrange(2, 12), rng.randrange(2, 6)
        rows = []
        for i in range(n):
            if 0 < i < n - 1 and rng.random() < 0.1 and len(rows[-1]) > 1:
                rows.append([(0, "spans " * m, m)])
                continue
            have = sorted(rng.sample(range(m), rng.randrange(2, m + 1)))
            rows.append([(c, "w" * rng.randrange(1, 25), 1) for c in have])
        used = sorted({c for r in rows for c, _, k in r if k == 1})
        # a column that few rows fill is not told from a crossed gap; every column must be seen often enough
        wide = [r for r in rows if len(r) > 1]
        if any(sum(any(c == u for c, *_ in r) for r in wide) <= len(wide) // extract.CROSSED for u in used):
            continue
        want = [[next((t.strip() for c, t, _ in r if c == u), "") for u in used] if len(r) > 1 else [r[0][1].strip(), *[""] * (len(used) - 1)] for r in rows]
        spans = placed(rows)
        rng.shuffle(spans)
        assert extract.tables_of_page(spans) == [want]


def test_pages_with_and_without_places(spark):
    grid = placed([[(0, "a", 1), (1, "b", 1)], [(0, "c", 1), (1, "d", 1)]])
    rows = [("x", 1, 0, i, 0, t, s, 0, x0, x1, y) for i, (x0, x1, y, s, t) in enumerate(grid)]
    rows += [("x", 2, 0, i, j, f"{i}{j}", 10.0, 0, None, None, None) for i in range(3) for j in range(2)]
    rows += [("x", 300, 0, 0, 0, "cut", 10.0, 0, 1.0, 2.0, 3.0)]
    got = {(r.page, r.ord): r.table_rows for r in extract.pdf_tables(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {(1, 0): [["a", "b"], ["c", "d"]], (2, 0): [["00", "01"], ["10", "11"], ["20", "21"]]}
    assert extract.pdf_tables(spark.createDataFrame([], SPAN)).count() == 0


# ---------------------------------------------------------------- tokens

ODD = ["", " ", "don't we'll  \n\n x", "é漢字 \U0001f600", "a" * 3000, "abc" * 700, "1234567 .,;!", "\tx\r\n y z"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_counts_are_the_librarys(spark, library, name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["the ", "Ou", "tion", "\n", "é", "x1", ". ", "  "]) for _ in range(rng.randrange(80))) for _ in range(200)]
    count = tokens.TokenCounter(spark, public_tokenizers.path(name))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string").withColumn("n", count(F.col("text"))).collect()
    assert [r.n for r in sorted(rows)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts] + [0]


def test_chunks_follow_the_counter(spark, library):
    count = tokens.TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.json"))
    texts = {"s": "One more sentence stands here. " * 60, "p": "\n\n".join(f"paragraph number {i} of it" for i in range(50)), "w": "word " * 300, "short": "short text", "none": None}
    rows = spark.createDataFrame([(k, k, 0, t, "prose", None, None, None) for k, t in texts.items()] + [("t", "t", 0, "cell " * 300, "table", None, None, [["a"]])], "document_id string, chunk_id string, chunk_index int, text string, chunk_type string, heading string, page_number int, table_data array<array<string>>")
    got = chunking.normalize_chunks(rows, ExtractConfig(target_tokens=40, most_tokens=60), count).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert all(r.token_count == size(r.text) for r in got)
    parts = {k: [r.text for r in sorted(got, key=lambda r: r.chunk_index) if r.document_id == k] for k in [*texts, "t"]}
    for k in "spw":
        assert len(parts[k]) > 3 and all(size(x) <= 40 for x in parts[k]) and all(size(a + (" " if k == "w" else "\n\n") + b.split("\n\n")[0].split(" ")[0]) > 30 for a, b in zip(parts[k], parts[k][1:], strict=False))
        assert " ".join(" ".join(parts[k]).split()) == " ".join(texts[k].split())
    assert len(parts["t"]) == len(parts["short"]) == 1 and parts["none"] == [None]


def test_long_words_take_no_square(library):
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.json"))
    for word in ("ab" * 20_000, "=" * 30_000):
        assert tokens.count_word(word.encode(), ranks) == len(library.encode(word, add_special_tokens=False).ids)


def page_walked(spans):
    """tables_of_page() span by span, row by row."""
    rows, cells, runs = [], [], [[]]
    for x0, x1, y, size, t in sorted((s for s in spans if s[4] and s[4].strip()), key=lambda s: (s[2], s[0])):
        if not rows or y - rows[-1][0] > 0.5 * rows[-1][1]:
            rows.append((y, size, []))
        rows[-1][2].append((x0, x1, size, t.strip()))
    for y, size, row in rows:
        out = []
        for x0, x1, z, t in sorted(row):
            if out and x0 - out[-1][1] < extract.CELL_GAP * z:
                out[-1] = (out[-1][0], max(out[-1][1], x1), f"{out[-1][2]} {t}")
            else:
                out.append((x0, x1, t))
        cells.append((y, size, out))
    for r in cells:
        before = runs[-1][-1] if runs[-1] else None
        if before and (r[0] - before[0] > extract.ROW_GAP * r[1] or len(r[2]) == len(before[2]) == 1):
            runs.append([])
        if runs[-1] or len(r[2]) > 1:
            runs[-1].append(r)
    tables = []
    for run in runs:
        run = run[:-1] if run and len(run[-1][2]) == 1 else run
        wide = [c for r in run if len(r[2]) > 1 for c in r[2]]
        few = sum(len(r[2]) > 1 for r in run) // extract.CROSSED
        places = sorted({x for c in wide for x in c[:2]})
        covered = [(a, b) for a, b in itertools.pairwise(places) if sum(c[0] <= a and b <= c[1] for c in wide) > few]
        columns = []
        for a, b in covered:
            if columns and columns[-1][1] == a and sum(c[0] < a < c[1] for c in wide) > few:
                columns[-1] = (columns[-1][0], b)
            else:
                columns.append((a, b))
        if sum(len(r[2]) > 1 for r in run) < 2 or len(columns) < 2:
            continue
        table = []
        for _, _, row in run:
            out = [""] * len(columns)
            for x0, x1, t in row:
                share = [min(x1, b) - max(x0, a) for a, b in columns]
                at = next((i for i, (a, b) in enumerate(columns) if share[i] >= b - a), share.index(max(share)))
                out[at] = f"{out[at]} {t}".strip()
            table.append(out)
        tables.append(table)
    return tables


def drawn_badly(rng):
    """Spans of uneven heights, in ragged columns, some near each other or over several columns."""
    y, out = 0.0, []
    for _ in range(rng.randrange(40)):
        y += rng.choice([0, 0, 0, 1.0, 5.0, 5.5, 14.0, 20.0, 40.0, 41.0])
        x0 = 100.0 * rng.randrange(4) + rng.choice([0.0, 0.0, 3.0, 50.0]) + rng.random() / 8
        out.append((x0, x0 + rng.choice([10.0, 40.0, 88.0, 95.0, 188.0, 300.0]), y, rng.choice([10.0, 10.0, 12.0, 5.0]), rng.choice([None, "", " ", "a", "b ", " c d", "\x1cf", "\xa0g"])))
    rng.shuffle(out)
    return out


def test_many_pages_are_found_as_each_is():
    """Tables of all pages at once, as a walk over each page finds them, also a few cells at a time."""
    rng = random.Random(11)
    pages = [drawn_badly(rng) for _ in range(1500)]
    of, spans = [i for i, p in enumerate(pages) for _ in p], [s for p in pages for s in p]
    x0, x1, y, size = (np.array([s[k] for s in spans]) for k in range(4))
    want = [(i, k, t) for i, p in enumerate(pages) for k, t in enumerate(page_walked(p))]
    assert len(want) > 200
    for pairs in (3, extract.PAIRS):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(extract, "PAIRS", pairs)
            got = extract.tables_by_place(np.array(of), x0, x1, y, size, pa.array([s[4] for s in spans]))
        assert list(zip(got[0].tolist(), got[1].tolist(), got[2].to_pylist(), strict=True)) == want
    assert extract.tables_of_page([]) == []


PAGES = "doc_id string, page int, spans array<struct<block: int, line: int, span: int, text: string, size: double, x0: double, x1: double, y: double>>"


@pytest.mark.parametrize("at_once", [7, 1 << 18])
def test_whole_pages_are_not_shuffled(spark, monkeypatch, at_once):
    """Pages of one row each give what their spans as rows give, in any order, without an exchange or a sort."""
    monkeypatch.setattr(extract, "SPANS", at_once)
    rng = random.Random(at_once)
    pages = [(f"d{i % 7}", i, [(k // 6, k // 2 % 3, k % 2, t, z, *((x0, x1, y) if i % 2 else (None, None, None))) for k, (x0, x1, y, z, t) in enumerate(drawn_badly(rng))]) for i in range(1, 140)]
    pages += [("empty", 1, []), ("null", 1, None), (None, 2, [(0, i, j, f"{i}{j}", 10.0, None, None, None) for i in range(3) for j in range(2)])]
    rows = [(d, p, b, ln, s, t, z, 0, x0, x1, y) for d, p, spans in pages for b, ln, s, t, z, x0, x1, y in spans or ()]
    for _, _, spans in pages[::3]:
        rng.shuffle(spans)
    found = extract.tables_of_pages(spark.createDataFrame(pages, PAGES).coalesce(2))
    key = lambda r: (r.doc_id or "", r.page, r.ord)
    got = sorted(found.collect(), key=key)
    assert len(got) > 20 and {r.page % 2 for r in got} == {0, 1} and max(r.page for r in got) <= 100
    assert got == sorted(extract.pdf_tables(spark.createDataFrame(rows, SPAN)).collect(), key=key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_queries_of_pdf_tables_shuffle_no_spans(spark):
    """Documents are dealt, which are small beside their spans."""
    for name in ("pdf_tables", "pdf_placed_tables"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("Exchange", 1)
        assert "Generate" in above and "Generate" not in below and "Exchange" not in below and "Sort" not in plan


def tables_by_hand(page):
    """Of one page's (block, line, span, text, x0, x1, y): by places where there are some, else by runs of lines."""
    if placed_ := [s for s in page if None not in s[4:]]:
        return extract.tables_of_page([(x0, x1, y, 10.0, t) for *_, t, x0, x1, y in placed_])
    lines = {}
    for block, line, _, t, *_ in sorted(page, key=lambda s: (s[:3], s[3] is not None, s[3] or "")):
        lines.setdefault((block, line), []).append(t)
    text = "\n".join(" ".join(t for t in x if t is not None) for x in lines.values()).strip().split("\n")
    if len(text) < 3 or sum(len(x.strip()) < 60 for x in text) <= len(text) / 2:
        return []
    runs = [[(t or "").strip() for t in x] for x in lines.values()]
    runs = [list(g) for _, g in itertools.groupby(runs, key=len)]
    return [r for r in runs if len(r) > 1 and len(r[0]) > 1]


@pytest.mark.parametrize("per_batch", [3, 10_000])
def test_tables_of_many_pages_in_one_shuffle(spark, per_batch):
    rng = random.Random(per_batch)
    pages, rows = {}, []
    for doc in ("a", "b", "c"):
        for page in range(1, 25):
            with_places = rng.random() < 0.5
            for n in range(rng.randrange(1, 8)):
                for i in range(m := rng.choice([1, 2, 2, 3])):
                    place = (100.0 * i, 100.0 * i + 50, 20.0 * n) if with_places and rng.random() < 0.9 else (None, None, None)
                    t = rng.choice([None, "", " x ", "y ", "long " * 20, "one\ntwo", f"w{n}{m}"])
                    pages.setdefault((doc, page), []).append((n // 3, n % 3, i, t, *place))
    for (doc, page), spans in pages.items():
        rows += [(doc, page, b, ln, s, t, 10.0, 0, *place) for b, ln, s, t, *place in spans]
    rng.shuffle(rows)
    want = sorted((doc, page, k, tab) for (doc, page), spans in pages.items() for k, tab in enumerate(tables_by_hand(spans)))
    assert len(want) > 20
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        found = extract.pdf_tables(spark.createDataFrame(rows, SPAN))
        assert sorted((r.doc_id, r.page, r.ord, r.table_rows) for r in found.collect()) == want
        bare = extract.pdf_tables(spark.createDataFrame(rows, SPAN).drop("x0", "x1", "y"))
        of_lines = sorted((doc, page, k, tab) for (doc, page), spans in pages.items() for k, tab in enumerate(tables_by_hand([(*s[:4], None, None, None) for s in spans])))
        assert sorted((r.doc_id, r.page, r.ord, r.table_rows) for r in bare.collect()) == of_lines
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    for f in (found, bare):
        assert f._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
