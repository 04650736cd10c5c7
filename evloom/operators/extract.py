"""Extraction stage: fetched bodies to documents and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import dates, text
from ..plans.config import ExtractConfig
from ..plans.dims import DATE_PATTERNS
from . import chunking, html

CFG = ExtractConfig()


def parser_of(mime: Column, head: Column) -> Column:
    """html, pdf or plaintext, which takes everything else."""
    mime = F.lower(F.coalesce(mime, F.lit("")))
    opening = F.lower(F.regexp_replace(F.substring(head, 1, 128), r"^\s+", ""))
    return F.when(F.contains(mime, F.lit("html")) | opening.startswith("<!doctype") | opening.startswith("<html"), "html").when(F.contains(mime, F.lit("pdf")) | head.startswith("%PDF-"), "pdf").otherwise("plaintext")


def document_type(mime: Column) -> Column:
    mime = F.lower(F.coalesce(mime, F.lit("html")))
    has = lambda s: F.contains(mime, F.lit(s))
    return F.when(has("pdf"), "pdf").when(has("html"), "html").when(has("json"), "api_json").otherwise("html")


def date_strings(x: Column) -> Column:
    return text.date_strings(x, DATE_PATTERNS)


# ---------------------------------------------------------------- PDF, on spans (doc_id, page, block, line, span, text, size, flags and, if known, x0, x1, y)


def pdf_headings(spans: DataFrame, cfg: ExtractConfig = CFG) -> DataFrame:
    """(doc_id, page, block, text, is_heading, heading): a block is a heading if it is shorter than 200 characters and some span is larger
    than 1.15 times the document's median size (12 without spans), or bold and not smaller than it. heading is the last one before,
    across pages."""
    inside = spans.filter(F.col("page") <= cfg.most_pages)
    median = inside.groupBy("doc_id").agg(F.percentile("size", 0.5).alias("median"))
    big = (F.col("size") > 1.15 * F.coalesce("median", F.lit(12.0))) | ((F.col("flags").bitwiseAND(16) > 0) & (F.col("size") >= F.coalesce("median", F.lit(12.0))))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "span", "text"))), lambda x: x["text"]), " ")
    blocks = inside.join(median, "doc_id").groupBy("doc_id", "page", "block").agg(text.collapse(line).alias("text"), F.max(big).alias("big"))
    blocks = blocks.withColumn("is_heading", F.col("big") & (F.length("text") < 200) & (F.col("text") != "")).drop("big")
    before = Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(before))


def pdf_sections(blocks: DataFrame) -> DataFrame:
    """Prose of pdf_headings() by document, page and run of blocks under one heading; a section never goes beyond its page."""
    order = Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, 0)
    runs = blocks.withColumn("run", F.sum(F.col("is_heading").cast("int")).over(order)).filter("not is_heading and text != ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    out = runs.groupBy("doc_id", "page", "run").agg(F.first("heading").alias("section_path"), body.alias("text"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "run")) - 1
    return out.select(F.col("doc_id").alias("document_id"), pos.alias("pos"), "section_path", F.col("page").alias("page_number"), "text", F.lit("prose").alias("chunk_type"), F.lit(None).cast("array<array<string>>").alias("table_rows"))


def page_text(spans: DataFrame) -> DataFrame:
    """(doc_id, page, text, tabular): a page's lines, and whether they look like a table."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), " ")
    lines = spans.groupBy("doc_id", "page", "block", "line").agg(line.alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "t"))), lambda x: x["t"]), "\n")
    return lines.groupBy("doc_id", "page").agg(whole.alias("text")).withColumn("tabular", looks_tabular(F.col("text")))


#: Spans nearer than this share of their size are one cell, rows farther apart than this many sizes are not one table, and a gap between columns may be
#: crossed by one in so many rows.
CELL_GAP, ROW_GAP, CROSSED = 0.6, 4.0, 5


def tables_of_page(spans: list[tuple[float, float, float, float, str]]) -> list[list[list[str]]]:
    """Tables from where spans (x0, x1, y, size, text) stand on a page: a list of rows of cells each. See tables_by_place()."""
    x0, x1, y, size = np.array([s[:4] for s in spans], float).reshape(-1, 4).T
    return tables_by_place(np.zeros(len(spans), int), x0, x1, y, size, pa.array([s[4] for s in spans], pa.string()))[2].to_pylist()


def tables_by_place(of: np.ndarray, x0: np.ndarray, x1: np.ndarray, y: np.ndarray, size: np.ndarray, said: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(page, number on it, rows of cells) of the tables of many pages at once, from where their spans stand; of: each span's page.

    Spans of one height are a row, near neighbours in it one cell. A table begins and ends with rows of several cells; between them a row of one cell may stand, like one
    that spans the table. A sweep over the cells' x-intervals counts how many of the rows of several cells cover each place: columns are the stretches that are
    covered, up to the few rows that may cross a gap. A cell goes to the column that it overlaps most, the first of equal ones; where a row has none, the cell is empty.

    All steps are over arrays of all pages; only rows of slightly different heights and cells of several spans are walked, all pages a step at a time."""
    said = pc.utf8_trim_whitespace(said)
    some = np.flatnonzero(pc.fill_null(pc.not_equal(said, ""), False).to_numpy(zero_copy_only=False))
    some = some[np.lexsort((x0[some], y[some], of[some]))]
    of, x0, x1, y, size = (v[some] for v in (of, x0, x1, y, size))

    # rows of spans
    line = np.flatnonzero(_changes(of, y))
    begins = np.zeros(len(of), bool)
    begins[line[_row_begins(of[line], y[line], size[line])]] = True
    row_at, row = np.flatnonzero(begins), np.cumsum(begins) - 1
    page, top, height = of[row_at], y[row_at], size[row_at]
    order = np.lexsort((size, x1, x0, row))
    if not _changes(*(v[order] for v in (row, x0, x1, size))).all():
        order = np.lexsort((pc.rank(said.take(pa.array(some)), tiebreaker="dense").to_numpy(), size, x1, x0, row))
    some, x0, x1, size = (v[order] for v in (some, x0, x1, size))

    # cells of rows
    cell_begins = _cell_begins(row, row_at, x0, x1, size)
    cell_at = np.flatnonzero(cell_begins)
    left, right, row_of = x0[cell_at], np.maximum.reduceat(x1, cell_at) if len(cell_at) else x1, row[cell_at]

    # runs of rows; after a row of one cell comes one of several, or the run ends
    wide = np.bincount(row_of, minlength=len(row_at)) > 1
    follows = ~_changes(page)
    after_wide = follows & np.append(False, wide[:-1])[: len(wide)]
    follows[1:] &= ~(top[1:] - top[:-1] > ROW_GAP * height[1:])
    inside = wide | (follows & after_wide)
    goes_on = inside & follows & np.append(False, inside[:-1])[: len(inside)] & (wide | after_wide)
    run = np.maximum(np.cumsum(inside & ~goes_on) - 1, 0)
    inside &= wide | np.append(goes_on[1:], False)[: len(wide)]
    n_wide = np.bincount(run[wide], minlength=run.max(initial=0) + 1)

    # columns of runs
    sides = np.flatnonzero((wide & (n_wide[run] > 1))[row_of])
    x, step, runs = np.append(left[sides], right[sides]), np.repeat([1, -1], len(sides)), np.tile(run[row_of[sides]], 2)
    order = np.lexsort((step, x, runs))
    x, step, runs = x[order], step[order], runs[order]
    depth, crossed = np.cumsum(step), n_wide[runs] // CROSSED
    rises, falls = (depth - step <= crossed) & (crossed < depth), (depth <= crossed) & (crossed < depth - step)
    n_columns = np.bincount(runs[rises], minlength=len(n_wide))
    first_column = np.cumsum(n_columns) - n_columns

    # cells to columns
    rows = np.flatnonzero(inside & (n_columns[run] > 1))
    slots = np.append(0, np.cumsum(n_columns[run[rows]]))
    slot = np.full(len(row_at), -1)
    slot[rows] = slots[:-1]
    cells = np.flatnonzero(slot[row_of] >= 0)
    of_run = run[row_of[cells]]
    goes_to = np.full(len(cell_at), -1)
    goes_to[cells] = slot[row_of[cells]] + _columns_of(left[cells], right[cells], first_column[of_run], n_columns[of_run], x[rises], x[falls])
    to = goes_to[np.cumsum(cell_begins) - 1]
    placed = np.flatnonzero(to >= 0)
    placed = placed[np.argsort(to[placed], kind="stable")]
    words = _lists(np.bincount(to[placed], minlength=slots[-1]), said.take(pa.array(some[placed])))
    found = _lists(n_columns[run[rows]], pc.binary_join(words, " "))
    table_at = np.flatnonzero(_changes(run[rows]))
    pages = page[rows[table_at]]
    return pages, np.arange(len(pages)) - np.searchsorted(pages, pages), _lists(np.diff(np.append(table_at, len(rows))), found)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in some column."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _by_place_in(begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The second, the third.. elements of all stretches that have so many: (stretches, places of the elements)."""
    order = np.argsort(-length, kind="stable")
    longest = -length[order]
    for k in range(1, -int(longest[0]) if len(order) else 0):
        which = order[: np.searchsorted(longest, -k)]
        yield which, begin[which] + k


def _row_begins(page: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a height, in order, begins a row: it is farther than half a size from the one that the row began with."""
    out = _changes(page)
    at = np.flatnonzero(out)
    length = np.diff(np.append(at, len(page)))
    near = np.flatnonzero(~out[1:] & (y[1:] - y[:-1] <= 0.5 * size[:-1])) + 1
    out[:] = True
    # pages of which no height is near the one before are done
    some = np.unique(np.searchsorted(at, near, "right") - 1)
    base = at[some]
    for which, i in _by_place_in(at[some], length[some]):
        out[i] = new = ~(y[i] - y[base[which]] <= 0.5 * size[base[which]])
        base[which[new]] = i[new]
    return out


def _cell_begins(row: np.ndarray, row_at: np.ndarray, x0: np.ndarray, x1: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a span begins a cell: it is no near neighbour of what its row's cell has so far."""
    out = _changes(row)
    length = np.diff(np.append(row_at, len(row)))
    near = np.flatnonzero(~out[1:] & (x0[1:] - x1[:-1] < CELL_GAP * size[1:])) + 1
    out[:] = True
    some = np.unique(row[near])
    end = x1[row_at[some]]
    for which, i in _by_place_in(row_at[some], length[some]):
        out[i] = new = ~(x0[i] - end[which] < CELL_GAP * size[i])
        end[which] = np.where(new, x1[i], np.maximum(end[which], x1[i]))
    return out


#: Cells times columns that are compared at once.
PAIRS = 1 << 20


def _columns_of(left: np.ndarray, right: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each cell its column among n from the first on, which go from a to b. One that spans several whole columns overlaps the widest most, but begins in the first."""
    out = np.zeros(len(left), int)
    ends = np.cumsum(n)
    start = 0
    while start < len(left):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        width = n[start:end]
        at = np.cumsum(width) - width
        within = np.arange(width.sum()) - np.repeat(at, width)
        column = np.repeat(first[start:end], width) + within
        share = np.minimum(np.repeat(right[start:end], width), b[column]) - np.maximum(np.repeat(left[start:end], width), a[column])
        none = len(within)
        whole = np.minimum.reduceat(np.where(share >= b[column] - a[column], within, none), at)
        most = np.minimum.reduceat(np.where(share == np.repeat(np.maximum.reduceat(share, at), width), within, none), at)
        out[start:end] = np.where(whole < none, whole, most)
        start = end
    return out


def pdf_tables(spans: DataFrame, cfg: ExtractConfig = CFG) -> DataFrame:
    """(doc_id, page, ord, table_rows). Where spans have places (x0, x1, y), tables are found by them, page by page: see tables_by_place(). Of pages without places, and of spans that have
    no such columns, those that look tabular have tables in runs of two or more lines, one after another, of equally many spans, two at least; a span is then a cell.

    Spans are shuffled once, by page, and sorted; a task takes many whole pages at a time, so a page costs no call of its own. Where a page's spans are one row already, as a PDF
    library gives them, tables_of_pages() finds the same without a shuffle."""
    inside = spans.filter(F.col("page") <= cfg.most_pages)
    places = [c for c in PLACES if set(PLACES[:3]) <= set(spans.columns)]
    rows = inside.select("doc_id", "page", "block", "line", "span", "text", *[F.col(c).cast("double").alias(c) for c in places])
    schema = T.StructType([spans.schema["doc_id"], spans.schema["page"], *TABLE_FIELDS])

    def work(batches):
        for rows in _whole_pages(batches):
            begins = _begins(rows, ("doc_id", "page"))
            yield from _tables(rows.select(["doc_id", "page"]).filter(pa.array(begins)), np.cumsum(begins) - 1, rows).cast(to_arrow_schema(schema)).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "block", "line", "span", "text").mapInArrow(work, schema)


#: What says where a span stands, the last one may be missing.
PLACES = ("x0", "x1", "y", "size")
TABLE_FIELDS = [T.StructField("ord", T.IntegerType()), T.StructField("table_rows", T.ArrayType(T.ArrayType(T.StringType())))]
#: Spans of whole pages that are taken at once, or one page if it has more.
SPANS = 1 << 18


def tables_of_pages(pages: DataFrame, cfg: ExtractConfig = CFG) -> DataFrame:
    """As pdf_tables(), of pages (doc_id, page, spans) that are one row each; spans: an array of (block, line, span, text and, if known, x0, x1, y, size), in any order. Nothing is shuffled."""
    schema = T.StructType([pages.schema["doc_id"], pages.schema["page"], *TABLE_FIELDS])

    def work(batches):
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column("spans")), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(n), 0
            while start < len(n):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SPANS, "right")))
                part, of = b.slice(start, end - start), np.repeat(np.arange(end - start), n[start:end])
                spans = part.column("spans").flatten()
                rows = _in_order(of, pa.table(spans.flatten(), names=[f.name for f in spans.type]))
                yield from _tables(pa.Table.from_batches([part]).select(["doc_id", "page"]), of, rows).cast(to_arrow_schema(schema)).to_batches()
                start = end

    from pyspark.sql.pandas.types import to_arrow_schema

    return pages.filter(F.col("page") <= cfg.most_pages).select("doc_id", "page", "spans").mapInArrow(work, schema)


def _in_order(of: np.ndarray, spans: pa.Table) -> pa.Table:
    """Spans of pages by block, line and span, and then by text; most come so."""
    keys = ["block", "line", "span"]
    if not any(spans[k].null_count for k in keys):
        up = np.append(True, of[1:] != of[:-1])[: len(of)]
        same = ~up
        for k in keys:
            x = spans[k].to_numpy()
            up[1:] |= same[1:] & (x[1:] > x[:-1])
            same[1:] &= x[1:] == x[:-1]
        if up.all():
            return spans
    by = spans.select([*keys, "text"]).append_column("of", pa.array(of))
    return spans.take(pc.sort_indices(by, sort_keys=[(k, "ascending") for k in ("of", *keys, "text")], null_placement="at_start"))


def _tables(pages: pa.Table, of: np.ndarray, rows: pa.Table) -> pa.Table:
    """Tables of pages with a placed span by places, of the others by spans. of: each row's page."""
    known = np.zeros(len(pages), bool)
    found = []
    if set(PLACES[:3]) <= set(rows.column_names):
        placed = np.logical_and.reduce([rows[c].is_valid().to_numpy() for c in PLACES[:3]])
        known[of[placed]] = True
        spans = rows.filter(pa.array(placed)) if not placed.all() else rows
        x0, x1, y = (spans[c].to_numpy().astype(float) for c in PLACES[:3])
        size = spans["size"].to_numpy().astype(float) if "size" in rows.column_names else np.full(len(spans), np.nan)
        found.append(tables_by_place(of[placed], x0, x1, y, size, spans["text"].combine_chunks()))
    if not known.all():
        rest = ~known[of]
        found.append(_tables_by_spans(of[rest], rows.filter(pa.array(rest))))
    parts = [pages.take(pa.array(at)).append_column("ord", pa.array(order, pa.int32())).append_column("table_rows", tables) for at, order, tables in found]
    return pa.concat_tables(parts)


def _begins(rows: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """For each row whether it differs from the one before in some column; nulls are equal."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        same = np.ones(len(rows) - 1, bool)
        for name in names:
            x = rows[name].combine_chunks()
            a, b = x.slice(1), x.slice(0, len(x) - 1)
            same &= pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
        out[1:] = ~same
    return out


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a page does."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        joint = pa.Table.from_batches([*(h.slice(h.num_rows - 1) for h in held[-1:]), b])
        at = np.flatnonzero(_begins(joint, ("doc_id", "page"))[len(joint) - b.num_rows :])
        if not len(at):
            held.append(b)
            continue
        if held or at[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, at[-1])])
        held = [b.slice(at[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _tables_by_spans(of: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(page, number on it, rows of cells): runs of lines of equally many spans on the pages that look tabular, as looks_tabular() has it."""
    text_ = rows["text"].combine_chunks()
    line_at = np.flatnonzero(_begins(rows, ("block", "line")) | _changes(of))
    n_spans = np.diff(np.append(line_at, len(rows)))
    new_page = _changes(of[line_at])
    page_at = np.flatnonzero(new_page)
    n_lines = np.diff(np.append(page_at, len(line_at)))
    # a null is no part of its line's text, but a cell
    said = np.add.reduceat(text_.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), line_at) if len(line_at) else n_spans
    lines = pc.binary_join(_lists(said, text_.drop_null()), " ")
    parts = pc.split_pattern(pc.utf8_trim_whitespace(pc.binary_join(_lists(n_lines, lines), "\n")), "\n")
    n_parts = pc.list_value_length(parts).to_numpy()
    short = pc.less(pc.utf8_length(pc.utf8_trim_whitespace(parts.flatten())), 60).to_numpy(zero_copy_only=False)
    n_short = np.add.reduceat(short.astype(np.int64), np.append(0, np.cumsum(n_parts)[:-1])) if len(n_parts) else n_parts
    tabular = (n_parts >= 3) & (n_short > n_parts * 0.5)
    page = np.cumsum(new_page) - 1
    run_at = np.flatnonzero(new_page | np.append(True, n_spans[1:] != n_spans[:-1])[: len(n_spans)])
    n_rows = np.diff(np.append(run_at, len(line_at)))
    table = (n_rows >= 2) & (n_spans[run_at] >= 2) & tabular[page[run_at]]
    kept = np.repeat(table, n_rows)
    cells = pc.utf8_trim_whitespace(pc.fill_null(text_, "").filter(pa.array(np.repeat(kept, n_spans))))
    run_at, n_rows = run_at[table], n_rows[table]
    at = of[line_at[run_at]]
    return at, np.arange(len(at)) - np.searchsorted(at, at), _lists(n_rows, _lists(n_spans[kept], cells))


def looks_tabular(page: Column) -> Column:
    """Three lines or more, over half of them shorter than 60 characters."""
    lines = F.split(text.strip(F.coalesce(page, F.lit(""))), "\n")
    short = F.size(F.filter(lines, lambda x: F.length(text.strip(x)) < 60))
    return (F.size(lines) >= 3) & (short > F.size(lines) * 0.5)


def pdf_status(n_pages: Column, has_text: Column, cfg: ExtractConfig = CFG) -> Column:
    """Struct of is_partial, reason and error."""
    cut = n_pages > cfg.most_pages
    return F.struct(cut.alias("is_partial"), F.when(cut, F.concat(F.lit(f"Truncated to {cfg.most_pages} of "), n_pages, F.lit(" pages"))).alias("partial_reason"), F.when(~has_text, "requires_ocr").alias("error"))


# ---------------------------------------------------------------- the stage


def with_tables(prose: DataFrame, tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections of pdf_sections() and tables of pdf_tables(), numbered together: a page's tables come before its prose, under the last heading
    of the pages before. blocks: those of pdf_headings()."""
    ends = blocks.groupBy(F.col("doc_id").alias("document_id"), F.col("page").alias("page_number")).agg(F.max_by("heading", "block").alias("last"))
    t = tables.select(F.col("doc_id").alias("document_id"), F.col("page").alias("page_number"), "ord", "table_rows")
    before = Window.partitionBy("document_id").orderBy("page_number", F.col("ord").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    both = t.withColumn("last", F.lit(None).cast("string")).unionByName(ends.select("document_id", "page_number", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("array<array<string>>").alias("table_rows"), "last"))
    t = both.withColumn("section_path", F.last("last", ignorenulls=True).over(before)).filter("ord is not null")
    every = prose.withColumn("kind", F.lit(1)).withColumn("ord", F.col("pos")).unionByName(t.select("document_id", F.lit(0).alias("pos"), "section_path", "page_number", F.lit("").alias("text"), F.lit("table").alias("chunk_type"), "table_rows", F.lit(0).alias("kind"), "ord"))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "kind", "ord")) - 1).drop("kind", "ord")


def extract_stage(filtered: DataFrame, fetched: DataFrame, pdf_spans: DataFrame | None = None, cfg: ExtractConfig = CFG, pdf_info: DataFrame | None = None, count: chunking.Counter = text.token_count, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks). filtered: FILTERED_DOCUMENT rows; fetched: FETCH_RESULT rows by url, as calls.fetch_once gives them; pdf_spans: what a PDF library found, by doc_id
    (without it PDF bodies fail); pdf_info: (doc_id, title, creation_date) of the files, as they have them. store: a new folder for the parsed
    documents, which are then parsed once, else once for each of the results. Bodies meet their requests in one join and are told apart by a column, parser;
    no document stops another. An empty body is a success without chunks."""
    j = filtered.join(fetched, "url", "left").withColumn("document_id", F.concat(F.lit("doc-"), "result_id"))
    head = F.decode(F.substring("content_bytes", 1, 128), "ISO-8859-1")
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("content_bytes").isNull(), "empty_response")
    j = j.withColumn("fetch_error", bad).withColumn("parser", F.when(bad.isNull(), parser_of(F.col("content_type"), head))).withColumn("body", F.decode("content_bytes", "UTF-8"))
    web = html.parse_html(F.when(F.col("parser") == "html", F.col("body")))
    kind = T.StructType.fromDDL(schemas.PARSED)
    section = lambda t: F.struct(F.lit(None).cast("string").alias("section_path"), F.lit(None).cast("int").alias("page_number"), t.alias("text"), F.lit("prose").alias("chunk_type"), F.lit(None).cast("array<array<string>>").alias("table_rows"))
    known = {"raw_text": F.col("body"), "sections": F.transform(chunking.paragraphs(F.col("body")), section), "is_partial": F.lit(False)}
    plain = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]).cast(kind)
    parsed = j.withColumn("p", web).withColumn("p", F.when(F.col("parser") == "plaintext", plain).otherwise(F.col("p"))).drop("content_bytes", "body")
    if store is not None:
        parsed.write.parquet(store)
        parsed = parsed.sparkSession.read.schema(parsed.schema).parquet(store)
    is_pdf = F.col("parser") == "pdf"
    if pdf_spans is None:
        parsed = parsed.withColumns({"pdf_error": F.when(is_pdf, "parse_error: no PDF spans"), "cut": F.lit(False)})
    else:
        stats = pdf_spans.groupBy(F.col("doc_id").alias("document_id")).agg(F.max("page").alias("n_pages"), F.max(text.strip(F.col("text")) != "").alias("has_text"))
        st = pdf_status(F.coalesce("n_pages", F.lit(0)), F.coalesce("has_text", F.lit(False)), cfg)
        parsed = parsed.join(stats, "document_id", "left").withColumns({"pdf_error": F.when(is_pdf, st["error"]), "cut": is_pdf & st["is_partial"]})
    info = pdf_info.select(F.col("doc_id").alias("document_id"), F.nullif(text.strip("title"), F.lit("")).alias("pdf_title"), dates.pdf_date(F.col("creation_date")).alias("pdf_day")) if pdf_info is not None else None
    parsed = parsed.join(info, "document_id", "left") if info is not None else parsed.withColumns({"pdf_title": F.lit(None).cast("string"), "pdf_day": F.lit(None).cast("timestamp")})
    sections = parsed.filter("p.error is null").select("document_id", F.posexplode("p.sections").alias("pos", "s")).select("document_id", "pos", "s.section_path", "s.page_number", "s.text", "s.chunk_type", "s.table_rows")
    if pdf_spans is not None:
        of_pdf = with_tables(pdf_sections(pdf_headings(pdf_spans, cfg)), pdf_tables(pdf_spans, cfg), pdf_headings(pdf_spans, cfg))
        sections = sections.unionByName(of_pdf.join(parsed.filter(is_pdf & F.col("pdf_error").isNull()).select("document_id"), "document_id", "left_semi"))
    chunks = chunking.normalize_chunks(chunking.build_chunks(sections), cfg, count)
    own = lambda c: F.when(is_pdf, F.col(c))
    docs = parsed.select(
        "document_id", "result_id", "question_id", F.col("url").alias("source_url"), "domain", "canonical_url", "fetched_at", "content_type", F.col("status_code").alias("http_status"), "extraction_priority",
        F.coalesce(F.nullif(F.col("p.title"), F.lit("")), own("pdf_title"), "title").alias("title"), F.coalesce(html.published_date(F.col("p.published_date")), own("pdf_day"), "published_date").alias("published_date"), F.col("p.language").alias("language"),
        date_strings(F.col("p.raw_text")).alias("extracted_dates"), F.coalesce("fetch_error", "p.error", "pdf_error").alias("error_message"), "cut",
    )
    docs = docs.join(chunking.document_stats(chunks), "document_id", "left")
    docs = docs.withColumn("status", F.when(F.col("error_message").isNotNull(), "failed").when(F.col("cut"), "partial").otherwise("success")).withColumn("document_type", document_type(F.col("content_type")))
    return docs.drop("cut"), chunks
