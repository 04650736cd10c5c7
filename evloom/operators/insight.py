"""Insight stage: model facts to guarded, merged records, within a budget."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, text
from ..plans.config import InsightConfig
from ..plans.dims import COUNTRIES
from ..sources.calls import CallTable, OnceModel, once, stored
from . import retrieval

CFG = InsightConfig()
EVENT_TYPES = ["case_count", "death_count", "outbreak_declared", "intervention", "policy_change", "other"]


def processable(docs: DataFrame) -> DataFrame:
    """Adds skipped: failed, or without chunks. Partial documents are processed."""
    return docs.withColumn("skipped", (F.col("status") == "failed") | (F.coalesce("n_chunks", F.lit(0)) == 0))


def budget_gate(docs: DataFrame, limit: int = CFG.most_input_tokens, keys: tuple = ("run_id",)) -> DataFrame:
    """Rows (keys, ord, cost, skipped) with decision: processed, skipped, or stopped for everything from the first document before
    which limit was reached. Whole documents only, so the last may go beyond it; skipped ones cost nothing."""
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.when(F.col("skipped"), 0).otherwise(F.col("cost"))).over(before), F.lit(0))
    out = docs.withColumn("spent_before", spent)
    upto = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    over = out.withColumn("__over", ~F.col("skipped") & (F.col("spent_before") >= limit))
    stopped = F.col("__over") | F.coalesce(F.max("__over").over(upto), F.lit(False))
    return over.withColumn("decision", F.when(stopped, "stopped").when(F.col("skipped"), "skipped").otherwise("processed")).drop("__over")


#: What the model is told before each prompt.
SYSTEM = (
    "You read one passage of a document for a team that forecasts disease outbreaks. List the facts in the passage that bear on the given question. "
    "A fact must stand in the passage itself; leave out conclusions of your own and what you know from elsewhere, and do not answer the question. "
    "Copy for each fact the words that show it, unchanged and no longer than 200 characters, as its quote. Most passages hold no such fact: then the list is empty. "
    "Give a low confidence where the passage is vague, and do not let the first or the most striking number stand for the whole. Answer in JSON by the schema."
)


def reply_schema() -> dict:
    """JSON schema of a reply: the fields of schemas.FACTS, of which type, confidence and quote must be there."""
    optional = lambda kind: {"type": [kind, "null"]}
    fact = {name: optional("string") for name in ("location", "pathogen", "metric_name", "metric_unit", "event_date", "summary")} | {"metric_value": optional("number")}
    fact |= {"event_type": {"type": "string", "enum": EVENT_TYPES}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "quote": {"type": "string"}}
    closed = lambda fields, needed: {"type": "object", "properties": fields, "required": needed, "additionalProperties": False}
    return closed({"facts": {"type": "array", "items": closed(fact, ["event_type", "confidence", "quote"])}}, ["facts"])


def prompts(chunks: DataFrame) -> DataFrame:
    """Adds key, system, prompt and reply_schema to rows with the question's (q_text, q_pathogen, q_region), the document's (title, source_url,
    published_date) and the chunk's columns. The prompt is JSON without empty fields; tables' cells are not part of it."""
    said = lambda c: F.nullif(F.col(c), F.lit("")) if isinstance(c, str) else c
    about = F.struct(said("q_text").alias("asks"), said("q_pathogen").alias("pathogen"), said("q_region").alias("region"))
    origin = F.struct(F.coalesce(said("title"), F.col("source_url")).alias("name"), F.col("source_url").alias("url"), F.date_format("published_date", "yyyy-MM-dd").alias("day"))
    passage = F.struct(said("heading").alias("under"), F.coalesce("text", F.lit("")).alias("words"))
    out = chunks.withColumn("prompt", F.to_json(F.struct(about.alias("question"), origin.alias("source"), passage.alias("passage"))))
    return out.withColumn("system", F.lit(SYSTEM)).withColumn("reply_schema", F.lit(json.dumps(reply_schema()))).withColumn("key", F.concat_ws("|", "question_id", "document_id", "chunk_id"))


def country_code(location: Column, countries: dict[str, str] = COUNTRIES) -> Column:
    """ISO code of the whole text or of its last part between commas that names a country."""
    table = F.create_map(*[F.lit(x) for kv in countries.items() for x in kv])
    whole = text.strip(F.lower(location))
    parts = F.transform(F.reverse(F.split(whole, ",")), lambda p: F.try_element_at(table, text.strip(p)))
    return F.coalesce(F.try_element_at(table, whole), F.try_element_at(F.filter(parts, lambda c: c.isNotNull()), F.lit(1)))


def facts(replies: DataFrame) -> DataFrame:
    """One row for each fact of replies (raw_text JSON, and whatever identifies the chunk), fact_ord from 0.

    No facts: no row. A missing type is `other`, a missing confidence .5; numbers that can't be read are null (confidence .5)."""
    parsed = replies.withColumn("__f", F.from_json("raw_text", schemas.FACTS)["facts"])
    rows = parsed.select(*replies.columns, F.posexplode("__f").alias("fact_ord", "f"))
    number = lambda c, t="double": F.expr(f"try_cast(f.{c} as {t})")
    return rows.select(*[c for c in replies.columns if c != "raw_text"], "fact_ord", F.coalesce("f.event_type", F.lit("other")).alias("event_type"), F.coalesce(number("confidence"), F.lit(0.5)).alias("confidence"), "f.location", "f.pathogen", "f.metric_name", number("metric_value").alias("metric_value"), "f.metric_unit", dates.event_date(F.col("f.event_date")).alias("event_date"), "f.summary", F.coalesce("f.quote", F.lit("")).alias("quote"))


def guarded(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Facts whose quote is in the chunk's text, but for white space and with its case; the quote cut to 200 characters."""
    return rows.filter(text.quote_in_text(F.col("quote"), F.col(text_col))).withColumn("quote", F.substring("quote", 1, 200)).withColumn("iso_country_code", country_code(F.col("location")))


_FIELDS = ["event_type", "location", "iso_country_code", "pathogen", "metric_name", "metric_value", "metric_unit", "event_date", "summary"]


def _mentions(rows: DataFrame, extra_keys: tuple) -> tuple[DataFrame, list[str]]:
    """(the first fact of each record and chunk, the columns that make a record)."""
    day = F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit(""))
    keys = {"__e": F.col("event_type"), "__m": F.coalesce("metric_name", F.lit("")), "__d": day, "__l": text.strip(F.lower(F.coalesce("location", F.lit(""))))}
    keys |= {f"__x{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(extra_keys)}
    group = ["question_id", *keys]
    one = rows.withColumns(keys).groupBy(*group, "document_id", "chunk_id").agg(F.min_by(F.struct("ord", *_FIELDS, "source_url", "quote"), "ord").alias("r"), F.max("confidence").alias("confidence"))
    return one.select(*group, "document_id", "chunk_id", "r.*", "confidence"), group


def _record_id(group: list[str]) -> Column:
    return F.concat(F.lit("ins-"), F.substring(F.sha2(F.concat_ws("|", *group), 256), 1, 12))


def merge_records(rows: DataFrame, extra_keys: tuple = (), sources: bool = True) -> DataFrame:
    """One record for each question, event type, metric, day and place (lower case, without outer white space): the first fact's fields,
    the greatest confidence, and every (document_id, chunk_id) once, in order of ord. extra_keys, like pathogen, may split further.

    The sources are one array of a record, some 300 bytes each. Where a record may have millions of them, like one without metric, day and place over a whole
    archive, take sources=False, which gives n_sources instead and gathers nothing, and record_sources() beside it."""
    one, group = _mentions(rows, extra_keys)
    src = F.struct("ord", F.struct("document_id", "chunk_id", "source_url", "quote").alias("s"))
    last = F.transform(F.array_sort(F.collect_list(src)), lambda x: x["s"]).alias("sources") if sources else F.count("*").alias("n_sources")
    out = one.groupBy(*group).agg(F.min_by(F.struct(*_FIELDS), "ord").alias("r"), F.max("confidence").alias("confidence"), last, F.min("ord").alias("ord"))
    return out.select(_record_id(group).alias("id"), "question_id", "r.*", "confidence", "sources" if sources else "n_sources", "ord")


def record_sources(rows: DataFrame, extra_keys: tuple = ()) -> DataFrame:
    """(id, question_id, ord, document_id, chunk_id, source_url, quote): the sources of merge_records() as rows; no record is gathered anywhere."""
    one, group = _mentions(rows, extra_keys)
    return one.select(_record_id(group).alias("id"), "question_id", "ord", "document_id", "chunk_id", "source_url", "quote")


def usage(calls: DataFrame, keys: tuple = ()) -> DataFrame:
    """(model, input_tokens, output_tokens, n_calls) by model, and in total where model is null."""
    rolled = calls.rollup(*keys, "model") if not keys else calls.groupingSets([[*map(F.col, keys), F.col("model")], [*map(F.col, keys)]], *keys, "model")
    return rolled.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("n_calls"))


def _paid(documents: DataFrame, keys: DataFrame, replies: DataFrame) -> DataFrame:
    """documents (question_id, document_id, ord, estimate, skipped) with cost, the input tokens of their replies, and asked: whether any prompt of
    theirs has a reply. keys: (key, question_id, document_id) of all prompts."""
    got = keys.join(replies.select("key", "input_tokens"), "key").groupBy("question_id", "document_id").agg(F.sum("input_tokens").alias("cost"))
    return documents.join(got, ["question_id", "document_id"], "left").withColumn("asked", F.col("cost").isNotNull()).withColumn("cost", F.coalesce("cost", F.lit(0)))


def next_wave(paid: DataFrame, tried: DataFrame, limit: int) -> DataFrame:
    """(question_id, document_id) of the documents to be asked for next: in order, those that by the estimates, times what real costs were of the
    estimates so far, take half of what is left of the limit, and one at least while any is left. tried: those of the waves before."""
    both = paid.join(tried.withColumn("tried", F.lit(True)), ["question_id", "document_id"], "left").withColumn("tried", F.coalesce("tried", F.lit(False)))
    spent = both.groupBy("question_id").agg(F.sum("cost").alias("spent"), F.greatest(F.lit(1.0), F.coalesce(F.max(F.when(F.col("asked") & (F.col("estimate") > 0), F.col("cost") / F.col("estimate"))), F.lit(1.0))).alias("factor"), F.max("tried").alias("any"))
    left = both.filter("not tried and not skipped").join(spent, "question_id").filter(F.col("spent") < limit)
    order = Window.partitionBy("question_id").orderBy("ord", "document_id")
    place, upto = F.row_number().over(order), F.sum("estimate").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("any") & (F.col("factor") * F.col("upto") * 2 <= limit - F.col("spent"))
    return left.withColumn("place", place).withColumn("upto", upto).filter((F.col("place") == 1) | fits).select("question_id", "document_id")


def ask_in_waves(asked: DataFrame, documents: DataFrame, model: OnceModel, limit: int) -> DataFrame:
    """REPLY rows of a model that is asked as long as its real input tokens are below the limit, question by question.

    asked: prompts with question_id and document_id; documents: (question_id, document_id, ord, estimate, skipped). The first document of a question shows how
    its costs compare with the estimate; each further wave asks for documents that fill half of what is left, so the waves are as many as it takes to
    halve the limit down to a document, and then one for each. The table of calls says what was asked: a run that broke goes on where it stopped.
    """
    keys = asked.select("key", "question_id", "document_id")
    spark = asked.sparkSession
    tried = spark.createDataFrame([], "question_id string, document_id string")
    rows: list = []
    while True:
        replies = model.table.answers()
        new = next_wave(_paid(documents, keys, replies), tried, limit).collect()  # ids of a wave's documents, not of the corpus
        if not new:
            return replies.join(keys.select("key"), "key", "left_semi")
        rows += [(r.question_id, r.document_id) for r in new]
        tried = spark.createDataFrame(rows, "question_id string, document_id string")
        model.complete(asked.join(spark.createDataFrame(new, tried.schema), ["question_id", "document_id"], "left_semi").select("key", "system", "prompt", "reply_schema"))


def insight_stage(questions: DataFrame, documents: DataFrame, chunks: DataFrame, model, embed=text.hash_embedding, cfg: InsightConfig = CFG, embedded: DataFrame | None = None, calls: CallTable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, usage, run statistics). Two phases: chunks are ranked first, then the model (a ModelClient) is asked in waves, until what its
    replies say they took reaches the budget; the documents up to there count, as if they had been asked one by one. Prompts and calls are tables: each prompt is asked once, whatever reads the results. calls: the
    table of an earlier, broken run. Recorded replies need no waves. embedded: (chunk_id, embedding) of chunks that were embedded before; only the others are."""
    spark = questions.sparkSession
    run = processable(documents)
    q = questions.select(F.col("id").alias("question_id"), F.col("text").alias("q_text"), F.col("pathogen").alias("q_pathogen"), F.col("region").alias("q_region"))
    query = F.concat_ws(" ", "q_text", "q_pathogen", "q_region")
    pairs = run.filter("not skipped").join(q, "question_id").select("question_id", "document_id", query.alias("query"), embed(query).alias("embedding"), F.array_compact(F.array("q_pathogen", "q_region")).alias("keywords"))
    if embedded is None:
        vectors = chunks.withColumn("embedding", embed(retrieval.chunk_text(F.col("heading"), F.col("text"))))
    else:
        vectors = chunks.join(retrieval.embed_missing(chunks, embedded, embed), "chunk_id")
    best = retrieval.hybrid(vectors, pairs, cfg)
    ranked = best.join(run.select("question_id", "document_id", "title", "source_url", "published_date", "extraction_priority"), ["question_id", "document_id"]).join(q, "question_id")
    if getattr(model, "recorded", False):
        ranked = stored(ranked, "ranked")  # once, not for the budget and again for the facts
    asked = prompts(ranked)
    asked = asked.select("key", "system", "prompt", "reply_schema", "question_id", "document_id", "chunk_id", "source_url", "text", "position", "extraction_priority")
    docs = run.select("question_id", "document_id", F.coalesce("extraction_priority", F.lit(0)).alias("ord"), "skipped")
    if getattr(model, "recorded", False):
        replies = model.complete(asked.select("key", "system", "prompt", "reply_schema"))
    else:
        asked = stored(asked, "prompts")
        cost = asked.groupBy("question_id", "document_id").agg(F.sum(text.token_count(F.col("prompt"))).alias("estimate"))
        docs = stored(docs.join(cost, ["question_id", "document_id"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0))), "costs")
        replies = ask_in_waves(asked, docs, once(model, spark, calls), cfg.most_input_tokens)
    gate = budget_gate(_paid(docs, asked, replies), cfg.most_input_tokens, ("question_id",))
    go = asked.join(gate.filter("decision = 'processed'").select("question_id", "document_id"), ["question_id", "document_id"])
    used = replies.join(go.select("key", "question_id", "document_id", "chunk_id", "source_url", "text", "position", "extraction_priority"), "key")
    found = guarded(facts(used))
    found = found.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy("extraction_priority", "document_id", "position", "fact_ord")))
    stats = gate.groupBy("question_id").agg(F.count_if(F.col("decision") == "processed").alias("documents_processed"), F.count_if(F.col("decision") == "skipped").alias("documents_skipped"))
    # what was paid for: of recorded replies those that would have been asked for
    return merge_records(found), usage(used if getattr(model, "recorded", False) else replies), stats
