"""Filtering stage: route, rerank, merge a model's decisions, take near copies out, cap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.config import FilterConfig
from ..sources.calls import stored

CFG = FilterConfig()


def query_terms(with_criteria: bool = True) -> Column:
    """The question's words, from its columns prefixed q_."""
    cols = ["q_text", "q_pathogen", "q_region", "q_event_type"] + (["q_resolution_criteria"] if with_criteria else [])
    return F.concat_ws(" ", *cols)


def low_value(cfg: FilterConfig = CFG) -> Column:
    """Blocked domain, a low-value part of the url or the title, or neither title nor snippet."""
    url, title = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    blank = (text.strip(F.coalesce("title", F.lit(""))) == "") & (text.strip(F.coalesce("snippet", F.lit(""))) == "")
    return F.lower(F.coalesce("domain", F.lit(""))).isin(list(cfg.blocked_domains)) | url.rlike("|".join(cfg.low_value_url)) | title.rlike("|".join(cfg.low_value_title)) | blank


def relevance() -> Column:
    return text.keyword_overlap(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("domain", F.lit(""))), query_terms())


def credibility(cfg: FilterConfig = CFG) -> Column:
    base = F.lit(0.35)
    for label, s in cfg.tier_scores.items():
        base = F.when(F.col("source_tier") == label, s).otherwise(base)
    base = F.when(F.col("is_official_domain"), F.greatest(base, F.lit(0.95))).otherwise(base)
    return F.least(F.lit(1.0), base + F.when(F.col("file_type") == "pdf", 0.03).otherwise(0.0))


def priority(rel: Column, cred: Column, cfg: FilterConfig = CFG) -> Column:
    mean = text.weighted_sum({"keyword_overlap": rel, "freshness": F.col("freshness_score"), "domain": F.col("domain_score"), "official_bonus": F.when(F.col("is_official_domain"), 1.0).otherwise(0.0)}, cfg.weights)
    return F.lit(0.75) * mean + F.lit(0.25) * cred


def route(df: DataFrame, cfg: FilterConfig = CFG) -> DataFrame:
    """Adds relevance_score, credibility_score, priority_score, route (keep, borderline, reject), keep (null if borderline), stage and reason_codes."""
    out = df.withColumn("__low", low_value(cfg))
    zero = lambda c: F.when(F.col("__low"), 0.0).otherwise(c)
    out = out.withColumn("relevance_score", zero(relevance())).withColumn("credibility_score", zero(credibility(cfg)))
    out = out.withColumn("priority_score", zero(priority(F.col("relevance_score"), F.col("credibility_score"), cfg)))
    p = F.col("priority_score")
    kind = F.when(F.col("__low"), "reject").when(p >= cfg.keep, "keep").when(p >= cfg.borderline, "borderline").otherwise("reject")
    out = out.withColumn("route", kind)
    code = F.when(F.col("route") == "keep", "passed_heuristic_threshold").when(F.col("route") == "borderline", "borderline_candidate").otherwise("below_threshold")
    reasons = F.array_compact(F.array(F.when(F.col("is_official_domain"), "official_domain"), F.when(F.col("source_tier") == "academic", "academic_source"), F.when(F.col("published_date").isNotNull(), "has_publication_date"), F.when(F.col("file_type") == "pdf", "pdf_candidate"), code))
    out = out.withColumn("reason_codes", F.when(F.col("__low"), F.array(F.lit("low_value_page"))).otherwise(reasons))
    return out.withColumn("keep", F.when(F.col("route") == "keep", True).when(F.col("route") == "reject", False)).withColumn("stage", F.lit("heuristic")).drop("__low")


def rerank(df: DataFrame, cfg: FilterConfig = CFG, group: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Borderline rows with priority and relevance renewed by a cheap score. rank_ord is the order in the group: priority, then ord."""
    content = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("domain", F.lit("")))
    score = text.keyword_overlap(content, query_terms(False)) + F.when(F.col("is_official_domain"), 0.10).otherwise(0.0) + F.when(F.col("source_tier") == "academic", 0.05).otherwise(0.0)
    out = df.withColumn("rerank_score", F.least(F.lit(1.0), score))
    a, b = cfg.rerank_weights
    out = out.withColumn("priority_score", F.col("priority_score") * a + F.col("rerank_score") * b).withColumn("relevance_score", F.greatest("relevance_score", "rerank_score")).withColumn("stage", F.lit("reranker"))
    return out.withColumn("rank_ord", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("priority_score"), "ord")))


def split_for_model(df: DataFrame, cfg: FilterConfig = CFG, group: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Adds branch: auto_keep, auto_reject, model for the first most_candidates of the others, overflow for the rest."""
    p = F.col("priority_score")
    kind = F.when(p >= cfg.auto_keep, "auto_keep").when(p <= cfg.auto_reject, "auto_reject").otherwise("model")
    out = df.withColumn("branch", kind)
    place = F.row_number().over(Window.partitionBy(*group, "branch").orderBy("rank_ord"))
    out = out.withColumn("reason_codes", F.when(F.col("branch") == "model", F.col("reason_codes")).otherwise(F.array_append("reason_codes", F.concat("branch", F.lit("_after_rerank")))))
    return out.withColumn("__n", place).withColumn("branch", F.when((F.col("branch") == "model") & (F.col("__n") > cfg.most_candidates), "overflow").otherwise(F.col("branch"))).drop("__n")


def model_prompts(df: DataFrame) -> DataFrame:
    """(question_id, prompt): a question's candidates, at most most_candidates, as one JSON."""
    candidate = F.struct("rank_ord", F.struct(F.col("id").alias("result_id"), "url", "domain", "title", "snippet", F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss").alias("published_date"), "file_type", "source_tier", "is_official_domain", "search_stage_score").alias("c"))
    grouped = df.filter("branch = 'model'").groupBy("question_id").agg(F.first("q_text").alias("text"), F.first("q_region").alias("region"), F.first("q_pathogen").alias("pathogen"), F.first("q_event_type").alias("event_type"), F.first("q_resolution_criteria").alias("resolution_criteria"), F.array_sort(F.collect_list(candidate)).alias("c"))
    task = F.lit("Decide for each candidate whether it is likely to hold facts that bear on the question. Prefer primary, official, recent and specific sources. Answer with JSON: {\"decisions\": [{\"result_id\", \"keep\", \"relevance_score\", \"credibility_score\", \"final_score\", \"reason_codes\", \"notes\"}]}.")
    return grouped.select("question_id", F.to_json(F.struct(task.alias("task"), F.struct("text", "region", "pathogen", "event_type", "resolution_criteria").alias("question"), F.transform("c", lambda x: x["c"]).alias("candidates"))).alias("prompt"))


def decisions(replies: DataFrame) -> DataFrame:
    """Rows for merge_decisions() from a model's replies (key, raw_text): JSON with a list `decisions`. Replies that are no such JSON have none."""
    kind = "decisions array<struct<result_id:string,keep:boolean,relevance_score:double,credibility_score:double,final_score:double,reason_codes:array<string>,notes:string>>"
    return replies.select(F.posexplode(F.from_json("raw_text", kind)["decisions"]).alias("ord", "d")).select("d.result_id", F.col("ord").cast("long").alias("ord"), "d.keep", "d.relevance_score", "d.credibility_score", "d.final_score", "d.reason_codes", "d.notes")


def merge_decisions(df: DataFrame, replies: DataFrame) -> DataFrame:
    """Model rows with the model's word: replies (result_id, ord, keep, relevance_score, credibility_score, final_score, reason_codes, notes).

    Of several replies for an id the last counts; missing fields keep the old value; a row without a reply is not kept.
    """
    last = replies.filter("result_id is not null").groupBy("result_id").agg(F.max_by(F.struct("keep", "relevance_score", "credibility_score", "final_score", "reason_codes", "notes"), "ord").alias("r"))
    j = df.join(last, df["id"] == last["result_id"], "left")
    none = F.col("r").isNull()
    out = j.withColumn("keep", F.when(none, False).otherwise(F.coalesce("r.keep", F.lit(False)))).withColumn("stage", F.lit("llm_filter"))
    out = out.withColumn("relevance_score", F.coalesce("r.relevance_score", "relevance_score")).withColumn("credibility_score", F.coalesce("r.credibility_score", "credibility_score")).withColumn("priority_score", F.coalesce("r.final_score", "priority_score"))
    out = out.withColumn("reason_codes", F.when(none, F.array_append("reason_codes", F.lit("missing_llm_decision"))).otherwise(F.coalesce("r.reason_codes", "reason_codes"))).withColumn("notes", F.col("r.notes"))
    return out.drop("r", "result_id")


def fail_closed(df: DataFrame) -> DataFrame:
    """Model rows where there is no model: none is kept."""
    return df.withColumn("keep", F.lit(False)).withColumn("stage", F.lit("llm_skipped")).withColumn("reason_codes", F.array_append("reason_codes", F.lit("no_llm_client_configured")))


# ---------------------------------------------------------------- order-dependent choices


def _fold(df: DataFrame, order: list[Column], row: Column, rejects, kept_type: str, group: str, id_col: str) -> DataFrame:
    """Walks the group's rows in order and keeps those that rejects(kept, row) does not hold for; (group, id, kept_ord)."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], row.alias("row"))))
    kept = F.aggregate(rows, F.array().cast(f"array<{kept_type}>"), lambda acc, x: F.when(rejects(acc, x["row"]), acc).otherwise(F.array_append(acc, x["row"])))
    return df.groupBy(group).agg(kept.alias("kept")).select(group, F.posexplode("kept").alias("kept_ord", "x")).select(group, F.col("x.id").alias(id_col), "kept_ord")


#: Rows of a group up to which it is folded within one row; larger groups are decided in blocks of so many rows.
FOLD_ROWS, BLOCK_ROWS = 256, 2048


def drop_near_copies(df: DataFrame, threshold: float = CFG.near_duplicate, group: str = "question_id", id_col: str = "id", fold_rows: int = FOLD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy, by score, then ord, then id: a row goes if one kept before has its canonical url (not null), or its domain and a Jaccard
    similarity of title and snippet of threshold or more. Not transitive. Ids must be unique in a group.

    Groups of up to fold_rows rows, like the results of a question, are walked within one row, of ids and hashed tokens, never texts. Larger ones are decided in
    blocks: see decided_in_blocks()."""
    tokens = F.array_sort(F.array_distinct(F.transform(text.tokenize(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))), lambda t: F.xxhash64(t))))
    slim = df.select(group, F.col(id_col).cast("string").alias("id"), (-F.col("final_score")).alias("o0"), F.col("ord").alias("o1"), F.coalesce("canonical_url", F.lit("")).alias("url"), F.coalesce("domain", F.lit("")).alias("domain"), tokens.alias("t"))
    slim = stored(slim, "near-copies")
    large = slim.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > fold_rows).select(group)
    row = F.struct("id", "url", "domain", "t")
    same = lambda k, x: _conflict(k, x, threshold)
    fold = lambda rows: _fold(rows, [F.col("o0"), F.col("o1")], row, lambda acc, x: F.exists(acc, lambda k: same(k, x)), "struct<id:string,url:string,domain:string,t:array<bigint>>", group, "__id")
    if large.isEmpty() or threshold <= 0:
        kept = fold(slim)
    else:
        large = stored(large, "large-groups")
        kept = fold(slim.join(large, group, "left_anti")).unionByName(decided_in_blocks(slim.join(large, group, "left_semi"), threshold, group, block_rows))
    return df.withColumn("__id", F.col(id_col).cast("string")).join(kept, [group, "__id"]).drop("__id")


def _conflict(k: Column, x: Column, threshold: float) -> Column:
    return ((k["url"] == x["url"]) & (x["url"] != "")) | ((k["domain"] == x["domain"]) & (text.jaccard(k["t"], x["t"]) >= threshold))


class _Overlaps:
    """Token lists by token: which of them a set of tokens is like."""

    def __init__(self, lists: pa.ListArray):
        values, self.ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
        self.size = np.diff(self.ends, prepend=0)
        self.token, which = np.unique(values, return_inverse=True)
        self.rows = np.repeat(np.arange(len(self.size)), self.size)[np.argsort(which, kind="stable")]
        self.at = np.append(0, np.cumsum(np.bincount(which, minlength=len(self.token))))

    def like(self, tokens: np.ndarray, threshold: float) -> np.ndarray:
        """Whether each list has a Jaccard similarity of threshold or more with tokens; none is empty."""
        c = np.searchsorted(self.token, tokens)
        c = c[self.token[np.minimum(c, len(self.token) - 1)] == tokens]
        n = self.at[c + 1] - self.at[c]
        shared = np.bincount(self.rows[np.arange(n.sum()) + np.repeat(self.at[c] - np.cumsum(n) + n, n)], minlength=len(self.size))
        return shared / (self.size + len(tokens) - shared) >= threshold


def _walk(rows: pa.Table, threshold: float) -> pa.Table:
    """The rows (at, url, t) that a walk in the order of at keeps."""
    rows = rows.take(pc.sort_indices(rows["at"]))
    lists, urls = rows["t"].combine_chunks(), rows["url"].to_pylist()
    index = _Overlaps(lists)
    tokens, kept, seen = lists.flatten().to_numpy(), np.zeros(len(urls), bool), set()
    for i, url in enumerate(urls):
        if url in seen or (index.like(tokens[index.ends[i] - index.size[i] : index.ends[i]], threshold) & kept).any():
            continue
        kept[i] = True
        if url:
            seen.add(url)
    return rows.filter(pa.array(kept))


def decided_in_blocks(slim: DataFrame, threshold: float, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, __id, kept_ord) as the walk in order would keep them.

    Rows that agree in url, domain and tokens are one, the first of them: the others conflict with whatever keeps it out, or with it. What remains is cut, in order, into blocks of
    block_rows rows of a group. Block after block, the rows meet those kept of each earlier block, a task for each such block of a group, and those without a conflict are walked in one task.
    Rounds are as many as the largest group has blocks, whatever its texts; no pair becomes a row, and no task holds more than two blocks.
    """
    # a domain's tokens are its own; a row without any has one that stands for that
    own = F.when(F.size("t") == 0, F.array(F.xxhash64("domain", F.lit("none")))).otherwise(F.array_distinct(F.transform("t", lambda x: F.xxhash64(F.col("domain"), F.lit("token"), x))))
    rows = slim.select(group, "url", F.struct("o0", "o1", "id").alias("o"), own.alias("t"))
    if threshold <= 1:
        rows = rows.groupBy(group, "url", "t").agg(F.min("o").alias("o"))
    order = Window.partitionBy(group).orderBy("o")
    block = lambda n: F.floor((n - 1) / block_rows).cast("int")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("last", block(F.count("*").over(Window.partitionBy(group)))).withColumn("block", block(F.col("at")))
    rows = stored(rows, "blocks")
    columns = [group, "o", "at", "url", "t", "last", "block"]
    schema, at_schema = rows.select(columns).schema, rows.select(group, "at").schema

    def walk(part: pa.Table) -> pa.Table:
        return _walk(part, threshold)

    def meet(kept: pa.Table, new: pa.Table) -> pa.Table:
        if not len(kept) or not len(new):
            return new.select([group, "at"]).slice(0, 0)
        index, urls = _Overlaps(kept["t"].combine_chunks()), set(kept["url"].to_pylist()) - {""}
        lists = new["t"].combine_chunks()
        tokens, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
        gone = [url in urls or index.like(x, threshold).any() for url, x in zip(new["url"].to_pylist(), np.split(tokens, ends[:-1]), strict=True)]
        return new.filter(pa.array(gone)).select([group, "at"])

    kept: list[DataFrame] = []
    for r in range((rows.agg(F.max("last")).first()[0] or 0) + 1):
        new = rows.filter(F.col("block") == r).select(columns)
        if r:
            before = _union(kept).filter(F.col("last") >= r)
            each = new.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
            gone = before.groupBy(group, "block").cogroup(each.groupBy(group, "block")).applyInArrow(meet, at_schema)
            new = new.join(gone.distinct(), [group, "at"], "left_anti").select(columns)
        kept.append(stored(new.groupBy(group).applyInArrow(walk, schema), "kept"))
    return _union(kept).select(group, F.col("o.id").alias("__id"), (F.row_number().over(order) - 1).alias("kept_ord"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joint_caps(df: DataFrame, per_domain: int = CFG.per_domain, per_type: int = CFG.per_type, group: str = "question_id", id_col: str = "id") -> DataFrame:
    """In order of ord, at most so many rows of a domain and of a file type (`unknown` if null); a row that one cap turns away does
    not count against the other."""
    row = F.struct(F.col(id_col).cast("string").alias("id"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("file_type", F.lit("unknown")).alias("type"))
    full = lambda acc, x: (F.size(F.filter(acc, lambda k: k["domain"] == x["domain"])) >= per_domain) | (F.size(F.filter(acc, lambda k: k["type"] == x["type"])) >= per_type)
    kept = _fold(df, [F.col("ord")], row, full, "struct<id:string,domain:string,type:string>", group, "__id")
    return df.withColumn("__id", F.col(id_col).cast("string")).join(kept, [group, "__id"]).drop("__id")


def extraction_hints(df: DataFrame) -> DataFrame:
    """Adds extraction_priority (1 is the first), extraction_mode and expected_value."""
    out = df.withColumn("extraction_priority", F.row_number().over(Window.partitionBy("question_id").orderBy("ord")))
    url = F.lower(F.coalesce("url", F.lit("")))
    mode = F.when((F.col("file_type") == "pdf") | url.endswith(".pdf"), "pdf").when(url.startswith("http"), "html").otherwise("unknown")
    value = F.when(F.col("is_official_domain") & (F.col("final_score") >= 0.85), "high").when(F.col("source_tier").isin("official", "academic"), "medium").otherwise("low")
    return out.withColumn("extraction_mode", mode).withColumn("expected_value", value)


def filter_stage(results: DataFrame, questions: DataFrame, replies: DataFrame | None = None, cfg: FilterConfig = CFG, model=None) -> DataFrame:
    """From search results (with ord) to filtered documents. replies: a model's decisions; or model, a ModelClient that is asked for them.
    Without either, undecided rows are not kept."""
    q = questions.select(F.col("id").alias("question_id"), *[F.col(c).alias(f"q_{c}") for c in ("text", "pathogen", "region", "event_type", "resolution_criteria")])
    # one pass: all rows are reranked within their route, but only borderline rows take the new values
    renewed = ["priority_score", "relevance_score", "reason_codes"]
    routed = route(results.join(q, "question_id"), cfg).withColumn("__old", F.struct(*renewed)).withColumn("__cred", F.col("credibility_score"))
    by_route = ("question_id", "route")
    split = split_for_model(rerank(routed, cfg, by_route), cfg, by_route).withColumn("__new", F.struct(*renewed))
    if model is not None:
        replies = decisions(model.complete(model_prompts(split.filter("route = 'borderline'")).select(F.col("question_id").alias("key"), "prompt")))
    decided = merge_decisions(split, replies) if replies is not None else fail_closed(split)
    middle = F.col("route") == "borderline"
    part = F.when(F.col("route") == "keep", 0).when(middle & (F.col("branch") == "auto_keep"), 1).when(middle & (F.col("branch") == "model") & F.col("keep"), 2)
    kept = decided.withColumn("part", part).filter("part is not null")
    for c in renewed:
        kept = kept.withColumn(c, F.when(F.col("part") == 0, F.col(f"__old.{c}")).when(F.col("part") == 1, F.col(f"__new.{c}")).otherwise(F.col(c)))
    cols = ["question_id", "id", "url", "canonical_url", "domain", "title", "snippet", "published_date", "file_type", "source_tier", "is_official_domain", "relevance_score", "credibility_score", "priority_score", "reason_codes", "part"]
    credibility_now = F.when(F.col("part") == 2, F.col("credibility_score")).otherwise(F.col("__cred"))
    kept = kept.select(*[credibility_now.alias(c) if c == "credibility_score" else F.col(c) for c in cols], F.when(F.col("part") == 0, F.col("ord")).otherwise(F.col("rank_ord")).alias("within")).withColumnRenamed("priority_score", "final_score")
    kept = kept.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("final_score"), "part", "within")))
    unique = drop_near_copies(kept, cfg.near_duplicate).withColumn("ord", F.col("kept_ord")).drop("kept_ord")
    capped = joint_caps(unique, cfg.per_domain, cfg.per_type).withColumn("ord", F.col("kept_ord")).drop("kept_ord")
    return extraction_hints(capped).withColumnRenamed("reason_codes", "selection_reasons").drop("part", "within")
