"""Ranked lexical search: the best documents of each item by integer term scores, with blocks of variable length to skip by.

Texts are read once into shards of postings of the terms that items ask for. When all documents are counted, each shard scores its
postings, cuts each term's postings into blocks where dynamic programming finds the least loss between scores and block maxima, and
answers all items: the maxima of an item's terms add up to a bound for each stretch of documents between two block ends, stretches are
searched from the highest bound on, and those whose bound is below the tenth best score so far are skipped, which loses nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_TERM, Scratch, chunks, release, small, utf8, word_hashes
from .lm_score import pack, unpack

#: Bytes of text of a shard, or one text if it is longer; a task holds some four times as much of postings.
SHARD_BYTES = 16 << 20
#: Bytes of items' texts that are asked at once and broadcast; more items are asked in further rounds over the index.
ITEM_BYTES = 16 << 20
#: Postings between which a block may end, and how many such steps a block has at most.
STEP, LONGEST = 8, 16
#: What another block costs: so many postings' mean score of its term.
BLOCK_COST = 8.0
#: Documents that are scored first, to have a good tenth score.
FIRST = 512


# ---------------------------------------------------------------- blocks


def block_starts(score: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where blocks of postings begin, of several terms whose postings are off[t]:off[t + 1].

    For each term the cuts that minimise the sum over blocks of length times maximum, and BLOCK_COST for each: best[j] is the least cost of the
    first j steps, over all lengths of the last block. All terms take step j together.
    """
    count = np.diff(off)
    steps = -(-count // STEP)
    first = np.cumsum(steps) - steps
    within = np.arange(steps.sum()) - np.repeat(first, steps)
    start = np.repeat(off[:-1], steps) + STEP * within
    if not len(start):
        return start
    most = np.maximum.reduceat(score, start).astype(float)
    size = np.diff(np.append(start, off[-1]))
    cost = BLOCK_COST * np.add.reduceat(score, off[:-1]) / count
    order = np.argsort(-steps, kind="stable")
    steps, first, cost = steps[order], first[order], cost[order]
    base = first + order  # of a term's best, which has one more place than steps
    best, back = np.zeros(len(start) + len(order)), np.zeros(len(start) + len(order), np.int32)
    for j in range(1, int(steps[0]) + 1):
        k = int(np.searchsorted(-steps, -j, side="right"))
        f, at = first[:k], base[:k]
        top, n, least, length = np.zeros(k), np.zeros(k), np.full(k, np.inf), np.ones(k, np.int32)
        for l in range(1, min(j, LONGEST) + 1):
            top = np.maximum(top, most[f + j - l])
            n += size[f + j - l]
            c = best[at + j - l] + n * top + cost[:k]
            better = c < least
            least, length = np.where(better, c, least), np.where(better, l, length)
        best[at + j], back[at + j] = least, length
    cut = np.zeros(len(start), bool)
    j = steps.copy()
    while True:
        live = np.flatnonzero(j > 0)
        if not len(live):
            return start[cut]
        j[live] -= back[base[live] + j[live]]
        cut[first[live] + j[live]] = True


class Shard:
    """Some documents' postings (term, document, times) in this order, scored and cut into blocks."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, times: np.ndarray, length_part: np.ndarray, place: np.ndarray):
        """length_part: of each document what its length adds to a score's divisor; place: its place in the order of ids."""
        self.terms, begin = np.unique(term, return_index=True)
        self.off = np.append(begin, len(term))
        self.doc, self.place, self.n = doc, place, len(place)
        self.score = 1_000_000_000 * times // (1000 * times + length_part[doc])
        self.start = block_starts(self.score, self.off)
        self.end = np.append(self.start, len(doc))[1:].astype(np.int64)
        self.most = np.maximum.reduceat(self.score, self.start) if len(doc) else np.zeros(0, np.int64)
        self.low, self.high = doc[self.start], doc[self.end - 1] + 1
        self.of_term = np.searchsorted(self.start, self.off)
        self.scored = 0

    def _add(self, into: np.ndarray, blocks: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> None:
        """Scores of the wanted documents, from the blocks that have any."""
        some = np.concatenate([[0], np.cumsum(wanted)])
        hit = some[self.high[blocks]] > some[self.low[blocks]]
        blocks, weight = blocks[hit], weight[hit]
        n = self.end[blocks] - self.start[blocks]
        at = np.repeat(self.start[blocks] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.scored += len(at)
        doc = self.doc[at]
        ok = wanted[doc]
        into += np.bincount(doc[ok], weights=(np.repeat(weight, n) * self.score[at])[ok].astype(float), minlength=self.n).astype(np.int64)

    def best(self, asked: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best above 0, equal scores by the order of ids."""
        at = np.searchsorted(self.terms, asked)
        have = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == asked)) if len(self.terms) else []
        if not len(have):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.of_term[at[have]], self.of_term[at[have] + 1]
        blocks = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        weight = np.repeat(weight[have], hi - lo)
        edge = np.unique(np.concatenate([self.low[blocks], self.high[blocks]]))
        bound = np.zeros(len(edge), np.int64)
        np.add.at(bound, np.searchsorted(edge, self.low[blocks]), weight * self.most[blocks])
        np.subtract.at(bound, np.searchsorted(edge, self.high[blocks]), weight * self.most[blocks])
        bound, width = np.cumsum(bound)[:-1], np.diff(edge)

        def documents(stretches: np.ndarray) -> np.ndarray:
            out = np.zeros(self.n, bool)
            out[edge[0] : edge[-1]] = np.repeat(stretches, width)
            return out

        order = np.argsort(-bound, kind="stable")
        first = np.zeros(len(bound), bool)
        first[order[: int(np.searchsorted(np.cumsum(width[order]), FIRST)) + 1]] = True
        score = np.zeros(self.n, np.int64)
        self._add(score, blocks, weight, documents(first))
        least = max(1, int(np.partition(score, self.n - k)[self.n - k])) if self.n >= k else 1
        rest = ~first & (bound >= least)
        if rest.any():
            self._add(score, blocks, weight, documents(rest))
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((self.place[found], -score[found]))][:k]
        return found, score[found]


# ---------------------------------------------------------------- Spark


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms in order, how many each text has)."""
    data, off = utf8(texts)
    return word_hashes(data, off, lower=True, gaps=NO_TERM)[:2]


def write_index(s: Scratch, docs: DataFrame, asked) -> DataFrame:
    """(docs: ids, lengths, terms, dfs, and postings packed as place of the term, document, times) by shard. asked: the broadcast hashes, in order."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("dfs", T.ArrayType(T.IntegerType())), *[T.StructField(x, T.BinaryType()) for x in ("lengths", "doc", "times")]])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        wanted = asked.value
        held, bytes_held, n_docs = [], 0, 0

        def out() -> pa.RecordBatch:
            term, doc, times, lengths = (np.concatenate([h[k] for h in held]) for k in range(4))
            order = np.lexsort((doc, term))
            term, doc, times = term[order], doc[order], times[order]
            terms, begin, df = np.unique(term, return_index=True, return_counts=True)
            step = np.diff(doc, prepend=0)
            step[begin] = doc[begin]
            ids = pa.concat_arrays([h[4] for h in held])
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, pa.int32()), type=kind)
            row = [one(ids, made.field("ids").type), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), one(terms.astype(np.int32), made.field("terms").type), one(df.astype(np.int32), made.field("dfs").type), *[pa.array([pack(x)], pa.binary()) for x in (lengths.astype(np.uint32), step.astype(np.uint32), times.astype(np.uint32))]]
            return pa.RecordBatch.from_arrays(row, schema=made)

        for b in small(batches):
            data, off = utf8(b.column(1))
            for i, j in chunks(off):
                if held and bytes_held + off[j] - off[i] > SHARD_BYTES:
                    yield out()
                    held, bytes_held, n_docs = [], 0, 0
                h, count, _ = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True, gaps=NO_TERM)
                at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1)) if len(wanted) else np.zeros(len(h), np.int64)
                ok = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
                key, times = np.unique(np.repeat(np.arange(j - i), count)[ok] * max(1, len(wanted)) + at[ok], return_counts=True)
                doc, term = np.divmod(key, max(1, len(wanted)))
                held.append((term, doc + n_docs, times, count, b.column(0).slice(i, j - i)))
                bytes_held, n_docs = bytes_held + off[j] - off[i], n_docs + j - i
        if held:
            yield out()
        held.clear()
        release()

    return s.table(docs.mapInArrow(work, schema), "postings")


def search(spark: SparkSession, df: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of df with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A null text has none, and neither has an item without
    one: it finds nothing. Items that repeat an id and a text are one. Rows of df that repeat an id are documents of their own; those without an id come last among equals.
    Other columns are not looked at; an empty table on either side gives an empty result. Postings have
    place for the terms that items ask for; items are asked in rounds of ITEM_BYTES, so what is broadcast is bounded. A shard sends k rows for each item.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    q = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null").distinct()
    rounds = -(-(q.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 1) // ITEM_BYTES)
    with Scratch(spark, "lexical") as s:
        q = q.withColumn("round", F.pmod(F.xxhash64("item", "text"), F.lit(rounds)))
        found = None
        for r in range(rounds):
            more = s.table(_one_round(spark, s, docs, q.filter(F.col("round") == r).drop("round"), k), "found")
            found = more if found is None else found.unionByName(more)
        place = F.row_number().over(Window.partitionBy("item", "of").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
        best = found.withColumn("rank", place).filter(F.col("rank") <= k)
        return s.result(best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))


def _one_round(spark: SparkSession, s: Scratch, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item, of, id, score) of each shard's best; of tells items of one id apart."""
    rows = items.toArrow()
    h, count = term_hashes(rows["text"])
    wanted = np.unique(h)
    of = np.unique(np.repeat(np.arange(len(count)), count) * max(1, len(wanted)) + np.searchsorted(wanted, h))
    item, term = np.divmod(of, max(1, len(wanted)))
    index = write_index(s, docs, spark.sparkContext.broadcast(wanted))
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(wanted), np.int64)
    counted = index.select(F.inline(F.arrays_zip("terms", "dfs"))).groupBy("terms").agg(F.sum("dfs").alias("df")).toArrow()
    df[counted["terms"].to_numpy()] = counted["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = spark.sparkContext.broadcast((term, np.searchsorted(item, np.arange(len(count) + 1)), weight, rows["item"].combine_chunks()))
    schema = T.StructType([T.StructField("item", items.schema["item"].dataType), T.StructField("of", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.LongType())])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        term, begin, weight, names = shared.value
        for b in small(batches, 1):
            ids = b.column(0).flatten()
            terms, dfs = (b.column(n).flatten().to_numpy() for n in (3, 4))
            lengths, step, times = (unpack(b.column(n)[0].as_py(), np.uint32).astype(np.int64) for n in (5, 6, 7))
            doc = np.cumsum(step)
            first = np.cumsum(dfs) - dfs
            doc -= np.repeat((doc - step)[first], dfs)
            share = 90 * lengths * n_docs // max(1, n_terms) if 90 * int(lengths.max(initial=0)) * n_docs < 1 << 63 else np.array([90 * int(x) * n_docs // n_terms for x in lengths])
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            shard = Shard(np.repeat(terms, dfs), doc, times, 8 * (100 - 90 + share), place)
            got = [[], [], []]
            for i, (lo, hi) in enumerate(zip(begin, begin[1:], strict=False)):
                d, score = shard.best(term[lo:hi], weight[term[lo:hi]], k)
                for x, v in zip(got, (np.full(len(d), i), d, score), strict=True):
                    x.append(v)
            i, d, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in got)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(i), ids.take(pa.array(d)), pa.array(score)], schema=made)
        release()

    return index.select("ids", "n_docs", "n_terms", "terms", "dfs", "lengths", "doc", "times").mapInArrow(work, schema)


def oracle() -> str:
    """The same in SQL, over documents and benchmark."""
    terms = r"regexp_extract_all(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '([A-Z])', '\1', 'g'), '[^ ]+')"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    d, q = terms.format(lower.format("text")), terms.format(lower.format("text"))
    return f"""with t as (select doc_id, {d} w from documents), s as (select count(*) filter (len(w) > 0)::bigint n_docs, sum(len(w))::bigint n_all from t),
    q as (select item_id, unnest(list_distinct({q})) w from benchmark),
    p as (select doc_id, n, w, count(*) tf from (select doc_id, len(w) n, unnest(w) w from t) where w in (select w from q) group by all),
    f as (select w, count(*) df from p group by w),
    g as (select item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_all))))::bigint score
      from q join p using (w) join f using (w) cross join s group by all having score > 0),
    r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int "rank" from g)
    select item_id, "rank", doc_id, score from r where "rank" <= 10"""
