"""Line dedup by a deletion-neighbourhood join on words."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, Scratch, chunks, discard, fits, free, materialize, mix, null_row, only_shared, release, small, unused, utf8, word_hashes

#: Lines of fewer words must be equal; longer ones may differ by one word put in, left out or replaced.
MIN_WORDS = 8
#: Lines of so many words and more pass the group filter before their neighbourhood is made.
LONG = 12
GROUPS = 4
#: A filter key over fewer words than this says too little; the line is taken without it.
LEAST_KEY = 3
R1, R2 = 0xD6E8FEB86659FD93 & ~7 | 5, 0xA0761D6478BD642F & ~7 | 5
_INV1, _INV2 = (np.uint64(pow(r, -1, 1 << 64)) for r in (R1, R2))
_SALT = np.uint64(0x8EBC6AF09C88C6E3)
PAIRS = list(itertools.combinations(range(GROUPS), 2))


class Lines:
    """The lines with a word of a chunk of rows: row, number within the row, words, first word, and prefix sums of two hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        h, count, line = word_hashes(data, off, lower=True, breaks=10)
        row = np.repeat(np.arange(len(off) - 1), count)
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        self.at = np.flatnonzero(new)
        self.words = np.diff(np.append(self.at, len(h)))
        self.row = row[self.at]
        before = np.concatenate([[0], np.cumsum(data == 10)])
        self.number = line[self.at] - before[off[self.row]]
        place = np.arange(len(h)) - np.repeat(self.at, self.words)
        self.h, self.place = h, place
        longest = int(self.words.max()) + 1 if len(h) else 1
        self.power = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest, r, np.uint64)])) for r in (R1, R2)]
        self.sum = []
        for x, p in ((h, self.power[0]), (mix(h ^ _SALT), self.power[1])):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(x * p[place], out=total[1:])
            self.sum.append(total)
        self.end = self.at + self.words
        self.key = [mix(s[self.end] - s[self.at] + self.words.astype(np.uint64)) for s in self.sum]

    def firsts(self) -> np.ndarray:
        """The first of equal lines of a row."""
        order = np.lexsort((self.number, self.key[1], self.key[0], self.row))
        same = np.zeros(len(order), bool)
        if len(order):
            o, p = order[1:], order[:-1]
            same[1:] = (self.row[o] == self.row[p]) & (self.key[0][o] == self.key[0][p]) & (self.key[1][o] == self.key[1][p])
        return np.sort(order[~same])

    def filter_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For LONG lines six keys, each of the words of two of the four groups that words are hashed into, and which of them have too
        few words. One word put in or left out changes one group, one replaced changes two: some key stays as it was. A line with a key
        of too few words is expanded anyway; a neighbour of it without such keys shares one of its other keys."""
        group = self.h >> np.uint64(5) & np.uint64(GROUPS - 1)
        spread = mix(self.h)
        n, content = np.zeros((len(which), GROUPS), np.int64), np.zeros((len(which), GROUPS), np.uint64)
        for g in range(GROUPS):
            inside = group == np.uint64(g)
            for out, x in ((n, inside.astype(np.int64)), (content, np.where(inside, spread, np.uint64(0)))):
                total = np.zeros(len(x) + 1, x.dtype)
                np.cumsum(x, out=total[1:])
                out[:, g] = total[self.end[which]] - total[self.at[which]]
        keys = np.stack([mix(content[:, a] + mix(content[:, b]) + np.uint64(k + 1)) for k, (a, b) in enumerate(PAIRS)], 1)
        return keys, np.stack([n[:, a] + n[:, b] for a, b in PAIRS], 1) < LEAST_KEY

    def neighbourhood(self, which: np.ndarray):
        """(line, position left out or -1, two hashes) of every line of which: itself and without each of its words."""
        n = self.words[which]
        line = np.repeat(which, n)
        i = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        at = self.at[line] + i
        keys = []
        for s, inv, full in zip(self.sum, (_INV1, _INV2), self.key, strict=True):
            without = (s[at] - s[self.at[line]]) + (s[self.end[line]] - s[at + 1]) * inv
            keys.append(np.concatenate([full[which], mix(without + (self.words[line] - 1).astype(np.uint64))]))
        return np.concatenate([which, line]), np.concatenate([np.full(len(which), -1), i]), keys


def _array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


#: Short lines that a task remembers to have expanded.
SEEN_LINES = 500_000
#: Kinds of rows of _scan(), in the column i of those that are no neighbourhood: a line, and one that skips the filter.
LINE, PLAIN = -2, -3


def _scan(docs: DataFrame) -> DataFrame:
    """One reading of (id, text). For the first of each document's equal lines a row (doc, line, h1, h2, i = LINE or PLAIN,
    k0..k5, row), and for the short of them their neighbourhoods, rows (doc, line, h1, h2, a, b, i, row).

    A task expands a short line again only where it comes in an earlier place than before, so that a line of very many documents
    makes a few rows for each task.
    """
    schema = docs.select(F.col("id").alias("doc")).schema
    for c in ("line", "h1", "h2", "a", "b", "i", *[f"k{k}" for k in range(len(PAIRS))], "row"):
        schema = schema.add(c, "long")
    none = lambda n: [pa.nulls(n, pa.int64())] * len(PAIRS)

    def work(batches):
        seen: dict[int, tuple] = {}
        for b in small(batches):
            data, off = utf8(b.column(1))
            for i, j in chunks(off):
                x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
                f = x.firsts()
                keys, few = x.filter_keys(f)
                weak = few.any(1)
                long_ = x.words[f] >= LONG
                ids, rows = b.column(0).slice(i, j - i), b.column(2).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.row[f])), *map(_array, (x.number[f], x.key[0][f], x.key[1][f])), pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.int64()), _array(np.where(long_ & weak, PLAIN, LINE)), *[pa.array(keys[:, k].view(np.int64), mask=~long_ | few[:, k]) for k in range(len(PAIRS))], rows.take(pa.array(x.row[f]))], names=schema.names)
                # lines of LONG words too: they may pair with a shorter one, which has no filter keys
                short = f[(x.words[f] >= MIN_WORDS) & (x.words[f] <= LONG)]
                names, kinds = ids.to_pylist(), rows.to_pylist()
                earlier = np.zeros(len(short), bool)
                for at, (h, r, line) in enumerate(zip(x.key[0][short].tolist(), x.row[short].tolist(), x.number[short].tolist(), strict=True)):
                    place = (names[r] is not None, kinds[r] if names[r] is None else names[r], line)
                    if h not in seen or place < seen[h]:
                        if len(seen) >= SEEN_LINES:
                            seen.clear()  # lines that come again are expanded again
                        seen[h], earlier[at] = place, True
                short = short[earlier]
                line, gone, keys = x.neighbourhood(short)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.row[line])), *map(_array, (x.number[line], x.key[0][line], x.key[1][line], keys[0], keys[1], gone)), *none(len(line)), rows.take(pa.array(x.row[line]))], names=schema.names)
        seen.clear()
        release()

    return docs.select("id", "text", "row").mapInArrow(work, schema)


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """Rows (doc, line, h1, h2, a, b, i, row) of the lines `wanted` of (id, text, wanted, row)."""
    schema = texts.select(F.col("id").alias("doc")).schema
    for c in ("line", "h1", "h2", "a", "b", "i", "row"):
        schema = schema.add(c, "long")

    def work(batches):
        for b in small(batches):
            data, off = utf8(b.column(1))
            for i, j in chunks(off):
                x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
                f = x.firsts()
                lists = b.column(2).slice(i, j - i).to_pylist()
                ask = {(r, n) for r, ns in enumerate(lists) for n in ns}
                f = f[[(r, n) in ask for r, n in zip(x.row[f].tolist(), x.number[f].tolist(), strict=True)]] if len(f) else f
                for lo in range(0, len(f), 4096):
                    line, gone, keys = x.neighbourhood(f[lo : lo + 4096])
                    ids, rows = (b.column(c).slice(i, j - i).take(pa.array(x.row[line])) for c in (0, 3))
                    yield pa.RecordBatch.from_arrays([ids, *map(_array, (x.number[line], x.key[0][line], x.key[1][line], keys[0], keys[1], gone)), rows], names=schema.names)
        release()

    return texts.mapInArrow(work, schema)


def _order(lines: DataFrame):
    """A column that orders lines as (doc, row, line) does, rows without a doc first: one number where the ids allow it, so that minimums
    need no sorting, else the three."""
    if lines.schema["doc"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        lo, hi, most = lines.agg(F.min("doc"), F.max("doc"), F.max("line")).first()
        if lo is not None and (hi - lo + 2) * (most + 1) < 1 << 62 and most < 1 << 22:
            # below zero for rows without an id, by 40 bits of what tells them apart
            return F.coalesce((F.col("doc") - lo + 1) * (most + 1), (F.col("row").bitwiseAND((1 << 40) - 1) - (1 << 40)) * (most + 1)) + F.col("line")
    return F.struct("doc", "row", "line")


def _later_lines(rows: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that an earlier line is within one word of; rows (h1, h2, a, b, i, place).

    Lines that agree without their i-th word differ by one replaced word, whichever pair of them is taken; a line that equals
    another without a word differs by that word. So the earliest line of such a group is enough for all the others, and minimums, partly
    taken before the shuffle, replace the pairs. Both hashes of the rest, 128 bits, must agree, which verifies the distance.
    """
    keys = ["a", "b", "i"]
    group = rows.groupBy(*keys).agg(F.min("place").alias("p"), F.min_by("h1", "place").alias("w1"), F.min_by("h2", "place").alias("w2"), (F.min("h1") != F.max("h1")).alias("differ"))
    group = materialize(group, "line-groups")
    replaced = rows.filter("i >= 0").join(group.filter("i >= 0 and differ").select(*keys, "w1"), keys).filter("h1 != w1").select("h1", "h2")
    whole = group.filter("i = -1").select("a", "b", F.col("p").alias("wp"), "w1", "w2")
    less = group.filter("i >= 0").groupBy("a", "b").agg(F.min("p").alias("p"))
    met = materialize(whole.join(less, ["a", "b"]), "line-meets")
    shorter = met.filter("p < wp").select(F.col("w1").alias("h1"), F.col("w2").alias("h2"))
    longer = rows.filter("i >= 0").join(met.select("a", "b", "wp"), ["a", "b"]).groupBy("h1", "h2").agg(F.min("wp").alias("wp"))
    # copies of a line have places of their own: compare with the first
    own = rows.filter("i = -1").groupBy("h1", "h2").agg(F.min("place").alias("own"))
    longer = longer.join(own, ["h1", "h2"]).filter("wp < own").select("h1", "h2")
    near = materialize(replaced.unionByName(shorter).unionByName(longer).distinct(), "later-lines")
    discard(group, met)
    return near


def drop_lines(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "__") -> DataFrame:
    """(id, n_lines, n_exact, n_near, text) for every row of df: the text without the lines that came before.
    With keep, these columns of df instead of the id, and the results' names after prefix, which should make them differ from the kept ones'. The result
    reads a table of dropped lines, in the folder of the run around it or else left in the shared one.

    A text is cut at line feeds; a line counts if it has a word (runs other than white space, A-Z in lower case). Earlier means a smaller id,
    then a smaller place. Lines with equal words stay once; of lines with MIN_WORDS words or more, one also goes if any earlier line is
    within one word of it, whether that one stays or not. Lines without words always stay. Null texts give an empty text without lines; a
    row with a null id is a document of its own (copies are one), earlier than all with an id; rows that repeat an id share its decisions, so repeated rows give equal results.

    All lines of LONG words or more pass a filter of six keys first, so that only lines with a likely neighbour are expanded. An
    expanded line is words + 1 rows of two hashes. Only a document's kept text is joined back, by id.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), null_row(F.col(id_col), F.col(text_col)))
    with Scratch(spark, "dropped-lines") as s:
        gone = s.result(_dropped(docs))
    gone = fits(gone)
    free(spark)  # before the texts are dealt
    if keep is None:
        here = F.col("id").eqNullSafe(F.col("__doc")) & F.col("row").eqNullSafe(F.col("__row"))
        return _rewrite(docs.join(gone, here, "left").select(F.col("id").alias(id_col), "text", "gone"), 1, "")
    id_, text, row, doc, doc_row, lines = unused(df, "__id", "__t", "__r", "__doc", "__row", "__gone")
    full = df.select(*keep, F.col(id_col).alias(id_), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text), null_row(F.col(id_col), F.col(text_col)).alias(row))
    full = full.join(gone.toDF(doc, doc_row, lines), F.col(id_).eqNullSafe(F.col(doc)) & F.col(row).eqNullSafe(F.col(doc_row)), "left")
    return _rewrite(full.select(*[F.lit(None).cast("string").alias(c) if c == text_col else F.col(c) for c in keep], text, lines), len(keep), prefix)


def _dropped(docs: DataFrame) -> DataFrame:
    """(__doc, __row, gone): the lines of documents (id, text, row) that others have before them, and whether these only come near."""
    scan = materialize(_scan(docs), "lines")
    lines = scan.filter(F.col("i") <= LINE)
    place = _order(lines)
    keys = [f"k{k}" for k in range(len(PAIRS))]
    lines = lines.withColumn("place", place)
    distinct = lines.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min_by("doc", "place").alias("doc"), F.min_by("row", "place").alias("row"), F.min_by("line", "place").alias("line"), *[F.first(k).alias(k) for k in (*keys, "i")])
    distinct = materialize(distinct, "distinct-lines")
    filtered = distinct.filter(F.col("i") == LINE)
    suspects = only_shared(distinct.select(F.explode(F.array(*keys)).alias("key"), F.col("h1").alias("sig")).filter("key is not null")).select(F.col("sig").alias("h1")).distinct()
    wanted = distinct.filter(F.col("i") == PLAIN).select("doc", "row", "line").unionByName(filtered.join(suspects, "h1", "left_semi").select("doc", "row", "line"))
    wanted = materialize(wanted.groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_set("line").alias("wanted")), "suspects")
    few = fits(wanted.select("__doc", "__row"))
    here = F.col("id").eqNullSafe(F.col("__doc")) & F.col("row").eqNullSafe(F.col("__row"))
    texts = docs.join(few, here, "left_semi").join(wanted, here).select("id", "text", "wanted", "row")
    columns = ["doc", "line", "h1", "h2", "a", "b", "i", "row"]
    expanded = materialize(_neighbourhoods(texts), "neighbourhoods")
    rows = expanded.select(*columns).unionByName(scan.filter(F.col("i") > LINE).select(*columns))
    near = _later_lines(rows.select("h1", "h2", "a", "b", "i", place.alias("place")))
    verdict = distinct.select("h1", "h2", F.col("doc").alias("first"), F.col("row").alias("first_row")).join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    gone = lines.select("doc", "row", "line", "h1", "h2").join(verdict, ["h1", "h2"]).filter("near or not (doc <=> first and row <=> first_row)")
    return gone.groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("line", F.coalesce("near", F.lit(False)).alias("near"))).alias("gone"))


def _rewrite(rows: DataFrame, kept: int, prefix: str) -> DataFrame:
    """Takes out the lines of `gone`, and within a document all repeats of an earlier line; the first columns are kept."""
    schema = rows.select(*rows.columns[:kept]).schema
    for name, kind in (("n_lines", "long"), ("n_exact", "long"), ("n_near", "long"), ("text", "string")):
        schema = schema.add(prefix + name, kind)

    def work(batches):
        for b in small(batches):
            data, off = utf8(b.column(kept))
            texts, gone = b.column(kept).to_pylist(), b.column(kept + 1).to_pylist()
            for i, j in chunks(off):
                x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
                first = np.zeros(len(x.at), bool)
                first[x.firsts()] = True
                bounds = np.searchsorted(x.row, np.arange(j - i + 1))
                out = []
                for r in range(j - i):
                    near = {g["line"] for g in gone[i + r] or () if g["near"]}
                    exact = {g["line"] for g in gone[i + r] or () if not g["near"]}
                    s = slice(bounds[r], bounds[r + 1])
                    numbers = x.number[s].tolist()
                    again = {n for n, f in zip(numbers, first[s].tolist(), strict=True) if not f}
                    drop = near | exact | again
                    text = "\n".join(l for n, l in enumerate(texts[i + r].split("\n")) if n not in drop) if drop else texts[i + r]
                    out.append((len(numbers), len(exact | again), len(near), text))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:kept]], *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=schema.names)
        release()

    return rows.mapInArrow(work, schema)


def oracle() -> str:
    """The same in DuckDB over the view documents, by joining the words left after taking one out."""
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) s, generate_subscripts(string_split(t, chr(10)), 1) n from d),
k as (select *, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{WS_CLASS}]+') w from l),
f as (select w, min(row(doc_id, n)) p from k where len(w) > 0 group by w),
g as (select w, p, unnest(generate_series(1, len(w))) i from f where len(w) >= {MIN_WORDS}),
v as (select w, p, i, list_concat(w[:i-1], w[i+1:]) v from g),
m as (select i, v, min(p) p from v group by i, v),
near as (select v.w from v join m using (i, v) where m.p < v.p
 union select v.w from v join f on f.w = v.v where len(f.w) >= {MIN_WORDS} and f.p < v.p
 union select f.w from v join f on f.w = v.v where len(f.w) >= {MIN_WORDS} and v.p < f.p),
j as (select k.*, f.p, near.w is not null and row_number() over (partition by k.doc_id, k.w order by n) = 1 as is_near, near.w is not null as gone_near from k left join f on k.w = f.w left join near on near.w = k.w),
r as (select doc_id, count(*) filter (len(w) > 0) n_lines, count(*) filter (len(w) > 0 and not is_near and p != row(doc_id, n)) n_exact, count(*) filter (is_near) n_near,
 coalesce(string_agg(s, chr(10) order by n) filter (len(w) = 0 or (not gone_near and p = row(doc_id, n))), '') t from j group by doc_id)
select doc_id, n_lines, n_exact, n_near, sha256(t) text_sha256 from r"""
