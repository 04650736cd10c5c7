"""The trie of conversations' turns: succinct tries of prefix shards, whose heavy upper levels are merged apart.

A turn is two 64-bit hashes of role and text, a prefix the sums of its turns' hashes mixed with their places: texts are read once and
never travel. Conversations with the same turns are one path. A prefix below which more turns stand than a shard may have is heavy; paths
are dealt by their first prefix that is not. Each shard's paths become a trie in level order whose shape is a LOUDS bit vector; sums over
subtrees go up its levels from the last to the first. The heavy prefixes, few by construction, are a trie of the same kind, to which shards
send one row for each heavy prefix that they hang from.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, mix, release, shuffle_partitions

#: Turns of distinct conversations that a shard has at most; a task holds some 100 bytes for each.
SHARD_TURNS = 1 << 19
#: Heavy prefixes there are at most; shards are larger where there would be more. They are broadcast, 30 bytes each.
HEAVY = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- succinct tries


class Louds:
    """A forest in level order: a bit vector with as many ones as a node has children and a zero, for the node above all and then each node."""

    def __init__(self, parents: list[np.ndarray]):
        """parents: for each level the numbers, within the level before, of its nodes' parents, in order; for the first level zeros."""
        self.ends = np.cumsum([0, *[len(p) for p in parents]])
        self.n = int(self.ends[-1])
        first = np.concatenate([[-1], self.ends[:-1]])[: len(parents)]  # where the parents' level begins; the node above all is -1
        degree = np.bincount(np.concatenate([p + b for p, b in zip(parents, first, strict=True)]) + 1, minlength=self.n + 1) if self.n else np.zeros(1, np.int64)
        self.bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
        self.bits[np.cumsum(degree) + np.arange(len(degree))] = 0

    def children(self) -> np.ndarray:
        """How many each node has: the ones between two zeros."""
        return np.diff(np.flatnonzero(self.bits == 0)) - 1

    def parent(self) -> np.ndarray:
        """Each node's, -1 in the first level: the zeros before the node's own one, less that of the node above all."""
        return np.flatnonzero(self.bits) - np.arange(self.n) - 1

    def rollup(self, *values: np.ndarray) -> None:
        """Adds to each node what is below it, in place, the last level first."""
        parent = self.parent()
        for lo, hi in zip(self.ends[-2:0:-1], self.ends[:1:-1], strict=True):
            for v in values:
                np.add.at(v, parent[lo:hi], v[lo:hi])


class Paths:
    """A forest of label sequences below some tops: what a shard is."""

    def __init__(self, top: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray, n: np.ndarray, least: np.ndarray):
        """Of each path its top, how many labels (a, b) with their words it has, how many conversations it stands for, and the smallest."""
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        size, n, least = size[order], n[order], least[order]
        self.tops, at = np.unique(top[order], return_inverse=True)
        parents, self.least, self.n, self.words, self.path = [np.zeros(len(self.tops), np.int64)], [np.zeros(len(self.tops), np.int64)], [np.zeros(len(self.tops), np.int64)], [np.zeros(len(self.tops), np.int64)], [np.full(len(self.tops), -1)]
        for level in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -level, side="left"))  # paths that go on
            x, y = a[begin[:k] + level], b[begin[:k] + level]
            o = np.lexsort((y, x, at[:k]))
            new = np.ones(k, bool)
            new[1:] = (at[o][1:] != at[o][:-1]) | (x[o][1:] != x[o][:-1]) | (y[o][1:] != y[o][:-1])
            starts = np.flatnonzero(new)
            parents.append(at[:k][o][starts])
            self.n.append(np.add.reduceat(n[:k][o], starts))
            self.least.append(np.minimum.reduceat(least[:k][o], starts))
            self.words.append(words[begin[:k][o][starts] + level])
            at = at.copy()
            at[:k][o] = np.cumsum(new) - 1
            path = np.full(len(starts), -1)
            ends = np.flatnonzero(size[:k] == level + 1)
            path[at[ends]] = order[ends]
            self.path.append(path)
        self.shape = Louds(parents)
        self.level = np.repeat(np.arange(len(parents)), [len(p) for p in parents])
        self.least, self.n, self.words, self.path = (np.concatenate(x) for x in (self.least, self.n, self.words, self.path))


# ---------------------------------------------------------------- Spark


def _prefixes(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keys of the prefixes that end at each label: sums of labels mixed with their places."""
    begin = np.cumsum(size) - size
    place = np.arange(len(a)) - np.repeat(begin, size)
    total = np.cumsum(mix(a + mix((place + 1).astype(np.uint64) * _STEP)), dtype=np.uint64)
    before = np.append(np.uint64(0), total)[begin]
    return total - np.repeat(before, size)


def _lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(kind), np.diff(off)


class Heavy:
    """The heavy prefixes by key, as workers know them."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["p"].to_numpy().view(np.uint64))
        self.p, self.q, self.above_p = (rows[x].to_numpy().view(np.uint64)[order] for x in ("p", "q", "above"))
        self.depth, self.least, self.n, self.words = (rows[x].to_numpy()[order] for x in ("depth", "least", "n", "words"))

    def find(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places, -1 for prefixes that aren't heavy."""
        if not len(self.p):
            return np.full(len(p), -1)
        at = np.minimum(np.searchsorted(self.p, p), len(self.p) - 1)
        return np.where((self.p[at] == p) & (self.q[at] == q), at, -1)


def shared_heads(s: Scratch, own: DataFrame, base: Column, head: Column, most_head: int) -> DataFrame:
    """Of conversations (c, s array of turns) those whose first `head` turns are those of conversation `base`, or all it has; none if it is
    absent. most_head: the largest value of head; bases send so many turns."""
    empty = F.array().cast(own.schema["s"].dataType)
    named = own.withColumn("base", base).withColumn("head", head.cast("int"))
    heads = own.select(F.col("c").alias("base"), F.slice("s", 1, most_head).alias("first"))
    heads = heads.join(named.select("base").distinct(), "base", "left_semi")
    joined = named.join(heads, "base", "left")
    rest = F.slice("s", F.col("head") + 1, F.greatest(F.size("s") - F.col("head"), F.lit(0)))
    return joined.select("c", F.concat(F.slice(F.coalesce("first", empty), F.lit(1), F.col("head")), rest).alias("s"))


def prefix_trie(spark: SparkSession, df: DataFrame, base: Column | None = None, head: Column | None = None, most_head: int = 3, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS, heavy: int = HEAVY) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each distinct prefix of df's conversations.

    Turns are ordered by turn, null first, and turns of equal number by a hash of role and text. Null roles and texts are empty ones. base and head, over the column c (the
    conversation's id, long): the first head turns of conversation base stand in place of as many of its own. Rows without a conversation's id belong to
    none and are left out; repeated rows are turns of their own; other columns are not looked at; without conversations there is no node.
    A conversation's hashes, 20 bytes a turn, are one row, as a document's text is elsewhere; a prefix that any share of all conversations has is
    counted by partial sums, and one that any share of them ends with sends its ids in order, in pieces.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).alias("w"))
    with Scratch(spark, "trie") as s:
        own = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("t", "a", "b", "w"))).alias("s"))
        if base is not None:
            own = s.table(own, "turns")
            own = shared_heads(s, own, base, head, most_head)
        own = own.select("c", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.w").alias("w"))
        own = s.table(own.withColumns({"k": F.xxhash64("a"), "l": F.xxhash64(F.lit(1), "b")}), "conversations")
        same = _ends(own)
        paths = s.table(own.drop("k", "l").join(same, "c"), "paths")
        turns_below, mass, n_all, least = paths.agg(F.sum(F.size("a")), F.sum(F.size("a") * (F.size("a") + 1) / 2), F.sum("n"), F.min("c")).first()
        # so that the turns below a common beginning are dealt over all tasks, as far as there may be heavy prefixes
        share = int(turns_below or 0) // (4 * shuffle_partitions(spark)) + 1
        limit = max(1, min(shard_turns, share), int(mass or 0) // heavy)
        upper = Heavy(_heavy(paths, limit).toArrow())
        shared = spark.sparkContext.broadcast(upper)
        buckets = max(shuffle_partitions(spark), 2 * int(turns_below or 0) // limit)
        nodes = s.table(_shards(paths, shared, buckets, least), "nodes")
        sums = nodes.filter("top is not null").groupBy("top").agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
        return s.result(nodes.filter("top is null").drop("top").unionByName(_merged(sums, shared, n_all or 0, least)))


def _ends(own: DataFrame) -> DataFrame:
    """(c, n, ends): the smallest conversation of those with the same turns, their number, and the digest of their ids.

    A digest runs through its ids in order, so it is one task's; what reaches that task are pieces of ids that other tasks ordered and wrote.
    """

    def write(batches):
        for b in batches:
            k, l, c = (x.to_numpy() for x in b.columns)
            if not len(k):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (l[1:] != l[:-1])]))
            ids = [",".join(map(str, x.tolist())) for x in np.split(c, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array(l[cut]), pa.array(c[cut]), pa.array(np.diff(np.append(cut, len(k)))), pa.array(ids, pa.string())], names=["k", "l", "c", "n", "ids"])

    def digest(batches):
        key, out = None, [[], [], []]

        def close():
            if key is not None:
                for x, v in zip(out, (first, n, sha.hexdigest()), strict=True):
                    x.append(v)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["c", "n", "ends"])

        for b in batches:
            for k, l, c, m, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (k, l) != key:
                    close()
                    key, first, n, sha = (k, l), c, m, hashlib.sha256(ids.encode())
                else:
                    n += m
                    sha.update(f",{ids}".encode())
            yield rows()
            out = [[], [], []]
        close()
        yield rows()

    n = shuffle_partitions(own.sparkSession)
    pieces = own.select("k", "l", "c").repartitionByRange(n, "k", "l", "c").sortWithinPartitions("k", "l", "c").mapInArrow(write, "k long, l long, c long, n long, ids string")
    return pieces.repartition(n, "k", "l").sortWithinPartitions("k", "l", "c").mapInArrow(digest, "c long, n long, ends string")


def _heavy(paths: DataFrame, limit: int) -> DataFrame:
    """Prefixes below which paths have more than so many turns: no more of them than the sum of all prefixes' turns over the limit."""

    def work(batches):
        for b in batches:
            a, size = _lists(b.column(1), np.uint64)
            q, w = _lists(b.column(2), np.uint64)[0], _lists(b.column(3), np.int64)[0]
            p, q = _prefixes(a, size), _prefixes(q, size)
            depth = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + 1
            above = np.where(depth == 1, np.uint64(0), np.append(np.uint64(0), p)[:-1])
            names = ("p", "q", "above", "depth", "least", "n", "words", "below")
            values = (p.view(np.int64), q.view(np.int64), above.view(np.int64), depth, np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(4).to_numpy(), size), w, np.repeat(size, size) - depth)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=list(names))

    rows = paths.select("c", "a", "b", "w", "n").mapInArrow(work, "p long, q long, above long, depth long, least long, n long, words long, below long")
    sums = rows.groupBy("p", "q").agg(F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("least").alias("least"), F.sum("n").alias("n"), F.min("words").alias("words"), F.sum("below").alias("below"))
    return sums.filter(F.col("below") > limit).drop("below")


_NODE = "top long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _shards(paths: DataFrame, shared, buckets: int, root: int) -> DataFrame:
    """Nodes of all shards, and rows with the heavy prefix `top` (-1: the root) that have what it gets from below, or the digest of those that end there."""

    def deal(batches):
        heavy = shared.value
        for b in batches:
            a, size = _lists(b.column(1), np.uint64)
            c2, w = _lists(b.column(2), np.uint64)[0], _lists(b.column(3), np.int64)[0]
            if not len(size):
                continue
            p, q = _prefixes(a, size), _prefixes(c2, size)
            at = heavy.find(p, q)
            row = np.repeat(np.arange(len(size)), size)
            above = np.bincount(row[at >= 0], minlength=len(size))  # heavy prefixes are the first of a path
            begin = np.cumsum(size) - size
            top = np.where(above > 0, np.append(at, -1)[np.maximum(begin + above - 1, 0)], -1)
            left = size - above
            key = np.append(p, np.uint64(0))[np.where(left > 0, begin + above, len(p))]
            keep = np.arange(len(a)) - begin[row] >= above[row]
            off = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x[keep].view(np.int64))) for x in (a, c2, w)]
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(top.astype(np.int64)), b.column(0), *lists, b.column(4), b.column(5)], names=["bucket", "top", "c", "a", "b", "w", "n", "ends"])

    def build(key, rows):
        heavy = shared.value
        top, least, n = (rows[x].to_numpy() for x in ("top", "c", "n"))
        a, size = _lists(rows["a"], np.uint64)
        t = Paths(top, size, a, _lists(rows["b"], np.uint64)[0], _lists(rows["w"], np.int64)[0], n, least)
        n_tops = len(t.tops)
        children, parent = t.shape.children(), t.shape.parent()
        leaves, saved = (children == 0).astype(np.int64), (t.n - 1) * t.words
        leaves[:n_tops] = saved[:n_tops] = 0
        t.shape.rollup(leaves, saved)
        whose = parent.copy()  # each node's top
        for lo, hi in zip(t.shape.ends[2:-1], t.shape.ends[3:], strict=True):
            whose[lo:hi] = whose[parent[lo:hi]]
        whose[:n_tops] = np.arange(n_tops)
        depth = np.append(heavy.depth, 0)[t.tops][whose] + t.level
        t.least[:n_tops] = np.append(heavy.least, root)[t.tops]
        up = np.where(np.arange(t.shape.n) < n_tops, -1, t.least[np.maximum(parent, 0)])
        empty = hashlib.sha256(b"").hexdigest()
        digest = rows["ends"].combine_chunks().take(pa.array(np.maximum(t.path, 0)))
        is_top = np.arange(t.shape.n) < n_tops
        ends = np.where(t.path >= 0, digest.to_numpy(zero_copy_only=False), empty) if t.shape.n else np.zeros(0, object)
        ends[is_top] = None
        over = np.flatnonzero(size == 0)  # conversations that end at a top
        ends[np.searchsorted(t.tops, top[over])] = rows["ends"].combine_chunks().to_numpy(zero_copy_only=False)[over]
        release()
        values = [pa.array(np.concatenate([t.tops, np.zeros(t.shape.n - n_tops, np.int64)]), mask=~is_top), *[pa.array(x.astype(np.int64)) for x in (t.least, depth, up, t.n, children, leaves, saved)], pa.array(ends, pa.string())]
        return pa.table(values, names=[f.split()[0] for f in _NODE.split(", ")])

    dealt = paths.select("c", "a", "b", "w", "n", "ends").mapInArrow(deal, "bucket long, top long, c long, a array<long>, b array<long>, w array<long>, n long, ends string")
    return dealt.groupBy("bucket").applyInArrow(build, _NODE)


def _merged(sums: DataFrame, shared, n_all: int, least: int | None) -> DataFrame:
    """The root and the heavy prefixes: the trie above the shards, of HEAVY nodes and one at most, in one task."""

    def work(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("top", pa.int64()), *[(x, pa.int64()) for x in ("n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())]))
        if not n_all:
            return
        h = shared.value
        size = len(h.p)
        order = np.argsort(h.depth, kind="stable")
        place = np.empty(size + 1, np.int64)  # in level order; the root is the first
        parents, before, levels = [np.zeros(1, np.int64)], np.array([size]), [np.array([size])]
        up = np.where(h.depth == 1, size, np.minimum(np.searchsorted(h.p, h.above_p), max(0, size - 1))) if size else np.zeros(0, np.int64)
        for d in range(1, int(h.depth.max()) + 1 if size else 0):
            here = order[h.depth[order] == d]
            of = np.argsort(before)
            rank = of[np.searchsorted(before[of], up[here])]
            here, rank = here[np.argsort(rank, kind="stable")], np.sort(rank, kind="stable")
            parents.append(rank)
            levels.append(here)
            before = here
        which = np.concatenate(levels)
        place[which] = np.arange(len(which))
        shape = Louds(parents)
        n, words, own = np.append(h.n, n_all)[which], np.append(h.words, 0)[which], np.append(h.least, least)[which]
        at = place[np.where(got["top"].to_numpy() < 0, size, got["top"].to_numpy())]
        children, leaves, saved = shape.children(), np.zeros(shape.n, np.int64), (n - 1) * words
        ends = np.full(shape.n, hashlib.sha256(b"").hexdigest(), object)
        for column, into in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
            into[at] += got[column].to_numpy()
        said = got["ends_sha256"].to_numpy()
        ends[at] = np.where(said == None, ends[at], said)  # noqa: E711
        leaves += children == 0
        shape.rollup(leaves, saved)
        parent = shape.parent()
        values = [own, np.append(h.depth, 0)[which], np.append(own, 0)[parent], n, children, leaves, saved]
        columns = [pa.array(x.astype(np.int64), mask=(parent < 0) if k == 2 else None) for k, x in enumerate(values)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.string())], names=[f.split()[0] for f in _NODE.split(", ")][1:])

    return sums.coalesce(1).mapInArrow(work, _NODE.split(", ", 1)[1])


def oracle() -> str:
    """op11's rows in SQL: a node is the digests of its turns, one after another, so its ancestors are its beginnings."""
    crc = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda x, y: list_reduce(list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
    return f"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) p, md5(coalesce(role, '')) || md5(coalesce(text, '')) k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w from conversations where conv_id is not null),
    c as (select conv_id, conv_id - conv_id % 20 base, ({crc} % 4)::bigint h from (select distinct conv_id from t)),
    m as (select c.conv_id, c.h, t.p, t.k, t.w, 0 part from c join t on t.conv_id = c.base and t.p <= c.h union all select c.conv_id, c.h, t.p, t.k, t.w, 1 from c join t using (conv_id) where t.p > c.h),
    r as (select conv_id, row_number() over (partition by conv_id order by part, p) d, k, w from m),
    x as (select conv_id, d, string_agg(k, '') over (partition by conv_id order by d) path, w from r union all select conv_id, 0, '', 0 from c),
    l as (select conv_id, max(d) d from x group by conv_id),
    n as (select path, d depth, min(conv_id) conv_id, count(*) n_convs, min(w) w from x group by path, d),
    e as (select path, string_agg(conv_id::varchar, ',' order by conv_id) ends from x join l using (conv_id, d) group by path),
    ch as (select left(path, 64 * (depth - 1)::bigint) path, count(*) n_children from n where depth > 0 group by 1),
    a as (select left(path, 64 * unnest(generate_series(0, depth))) path, n_children is null leaf, (n_convs - 1) * w saved from n left join ch using (path)),
    s as (select path, count(*) filter (leaf) n_leaves, sum(saved)::bigint saved_tokens from a group by path)
    select n.conv_id, n.depth, case when n.depth > 0 then u.conv_id end parent_conv_id, n.n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) ends_sha256
    from n join s using (path) left join ch using (path) left join e using (path) left join n u on u.path = left(n.path, 64 * (n.depth - 1)::bigint) and u.depth = n.depth - 1"""
