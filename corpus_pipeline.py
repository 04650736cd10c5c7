"""Corpus pipeline: documents through five operators, each stage a table that the next one reads."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.llm import bpe, lang_id, line_dedup, mixing, ngram_join
from evloom.llm.common import Scratch, discard, text_key
from evloom.llm.queries import table, tokenizer_path

BATCH_ROWS = 2000
#: The columns that stages work on. All others of the input go along unseen, whatever their names.
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def apart(stage):
    """The stage with all columns that aren't OWN as one, `others`, in which no name can clash; the result has the input's columns again, in its order.

    Of columns whose names differ in case only, or not at all, the first that is spelled as in OWN counts as that; the rest are others.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        at = {c: names.index(c) for c in OWN if c in names}
        numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
        rest = [i for i in range(len(names)) if i not in at.values()]
        packed = [F.struct(*[f"c{i}" for i in rest]).alias("others")] if rest else []
        out = stage(spark, numbered.select(*[F.col(f"c{i}").alias(c) for c, i in at.items()], *packed), sf_dir)
        own = {i: c for c, i in at.items()}
        return out.select(*[F.col(own[i]) if i in own else F.col("others")[f"c{i}"].alias(c) for i, c in enumerate(names)])

    return run


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have BATCH_ROWS rows at most, so that texts wait in small pieces between executor and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null texts, texts without a letter, and those whose best language is
    less likely than the others together."""
    small_batches(spark)
    model = lang_id.fit(docs, "doc_id", "text", "lang")
    found = lang_id.predict(spark, docs, model, "doc_id", "text", keep=docs.columns, prefix="found_")
    learned = bool(model[0])
    ok = (F.col("found_lang_pred") != lang_id.UNDETERMINED) & (F.col("found_score") >= 0.5) if learned else F.col("text").rlike(r"\p{L}")
    return found.filter(ok).select(*docs.columns) if learned else docs.filter(ok)


@apart
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that came before; a document of which no line with a word is left goes, unless it never had one."""
    small_batches(spark)
    kept = line_dedup.drop_lines(spark, docs, keep=docs.columns)
    kept = kept.filter((F.col("__n_lines") == 0) | (F.col("__n_lines") > F.col("__n_exact") + F.col("__n_near")))
    columns = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


@apart
def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without an id stay, and of rows that repeat id and text one."""
    small_batches(spark)
    groups = ngram_join.jaccard_components(spark, docs, one_of_each=True)
    stay = groups.filter("first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    named = docs.filter("doc_id is not null").withColumn("__key", text_key(F.col("text")))
    named = named.join(stay.withColumnRenamed("__id", "doc_id"), ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    copies = mixing.mix_sources(docs).select(F.col("doc_id").alias("__id"), "copies").groupBy("__id").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows: ids of each text, with digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe.encode(spark, docs, tokenizer_path(), keep=["doc_id", "lang", "source"])


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_join", join_near_copies), ("mix_sources", mix), ("bpe", encode)]

#: Naive Bayes, BPE and the seating of words have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one is written; what the last one reads stays, as the run's result."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as s:
        for name, stage in STAGES[:-2]:
            before = docs
            docs = s.table(stage(spark, docs, sf_dir), f"stage-{name}")
            if hasattr(before, "_evloom_path"):
                discard(before)
        docs = s.result(STAGES[-2][1](spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
