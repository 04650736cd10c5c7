"""Chunks: split to a budget of tokens, number, add up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.config import ExtractConfig

CFG = ExtractConfig()
Counter = Callable[[Column], Column]


def paragraphs(x: Column) -> Column:
    """Pieces between blank lines, without white space at their ends, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\n\s*\n"), text.strip), lambda p: p != "")


def sentences(x: Column) -> Column:
    return F.filter(F.split(text.strip(F.coalesce(x, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def merge_pieces(pieces: Column, target: int, joint: str, count: Counter = text.token_count) -> Column:
    """Neighbouring pieces joined as long as the whole stays within target."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        both = F.concat_ws(joint, acc["open"], p)
        fits = acc["open"].isNull() | (count(both) <= target)
        grown = F.struct(acc["done"].alias("done"), both.alias("open"))
        cut = F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p.alias("open"))
        return F.when(fits, grown).otherwise(cut)

    return F.aggregate(pieces, empty, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def split_text(x: Column, target: int = CFG.target_tokens, count: Counter = text.token_count) -> Column:
    """By paragraphs if there are several, else by sentences if there are several, else by words; one level only, so a long paragraph
    among others stays whole. Pieces are joined by a blank line, words by spaces."""
    ps, ss = paragraphs(x), sentences(x)
    return F.when(F.size(ps) > 1, merge_pieces(ps, target, "\n\n", count)).when(F.size(ss) > 1, merge_pieces(ss, target, "\n\n", count)).otherwise(merge_pieces(text.words(x), target, " ", count))


def build_chunks(sections: DataFrame) -> DataFrame:
    """CHUNK columns from rows (document_id, pos, section_path, page_number, text, chunk_type, table_rows)."""
    return sections.select("document_id", F.concat("document_id", F.lit("-c"), "pos").alias("chunk_id"), F.col("pos").alias("chunk_index"), "text", "chunk_type", F.col("section_path").alias("heading"), "page_number", F.col("table_rows").alias("table_data"))


def normalize_chunks(chunks: DataFrame, cfg: ExtractConfig = CFG, count: Counter = text.token_count) -> DataFrame:
    """Chunks over most_tokens split to target_tokens, except tables; parts are named -p0, -p1...; chunk_index is renewed. count: an expression, or a
    tokens.TokenCounter for exact counts by a vocabulary."""
    large = (F.col("chunk_type") != "table") & (count(F.col("text")) > cfg.most_tokens)
    rows = chunks.withColumn("__large", large)
    if hasattr(count, "split"):  # a counter that runs in Python cuts there too; only large texts go
        parts = F.when(F.col("__large"), count.split(F.when(F.col("__large"), F.col("text")), cfg.target_tokens)).otherwise(F.array(F.col("text")))
    else:
        parts = F.when(large, split_text(F.col("text"), cfg.target_tokens, count)).otherwise(F.array(F.col("text")))
    rows = rows.select("*", F.posexplode(parts).alias("part", "piece"))
    rows = rows.withColumn("chunk_id", F.when(F.col("__large"), F.concat("chunk_id", F.lit("-p"), "part")).otherwise(F.col("chunk_id")))
    table = F.when(~F.col("__large"), F.col("table_data")) if "table_data" in chunks.columns else F.lit(None).cast("array<array<string>>")
    order = Window.partitionBy("document_id").orderBy("chunk_index", "part")
    rows = rows.withColumn("__n", F.row_number().over(order) - 1)
    return rows.select("document_id", "chunk_id", F.col("__n").cast("int").alias("chunk_index"), F.col("piece").alias("text"), "chunk_type", *[c for c in ("heading", "page_number") if c in chunks.columns], table.alias("table_data"), count(F.col("piece")).alias("token_count"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """(document_id, n_chunks, char_count, token_count, extracted_tables), the tables in chunk order."""
    tables = F.transform(F.array_sort(F.collect_list(F.when((F.col("chunk_type") == "table") & (F.size("table_data") > 0), F.struct("chunk_index", "table_data")))), lambda x: x["table_data"])
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("char_count"), F.sum("token_count").alias("token_count"), tables.alias("extracted_tables"))
