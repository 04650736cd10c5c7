"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, lang_id, lexical, line_dedup, lm_score, mixing, ngram_join, packing, quality, secrets_scan, trie, url_filter
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(spark, table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(spark, table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "line-dedup") as s:
        out = line_dedup.drop_lines(spark, table(spark, sf_dir, "documents"))
        return s.result(out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return trie.prefix_trie(spark, table(spark, sf_dir, "conversations"), base=c - c % 20, head=F.crc32(c.cast("string")) % 4, most_head=3)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ids=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_near_dedup, op2_url_filter, op3_language_id, op4_ngram_jaccard_join, op5_mix_sources, op6_secret_scan, op7_quality_rules, op8_bpe, op9_lm_score, op10_line_dedup, op11_conversation_trie, op12_packing, op13_lexical_search)}
ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": embed_dedup.oracle(), "op4_ngram_jaccard_join": ngram_join.oracle(), "op10_line_dedup": line_dedup.oracle(), "op5_mix_sources": f"select doc_id, size, source_size, target, taken from ({mixing.oracle()})", "op7_quality_rules": quality.oracle(), "op11_conversation_trie": trie.oracle(), "op13_lexical_search": lexical.oracle()}
