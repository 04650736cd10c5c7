"""N-gram Jaccard join: count vectors of hashed shingles, bounded by summed coordinate minima in an R-tree.

A count-vector R-tree alone prunes little: in so many dimensions every window of 20 % meets nearly every leaf, so a search
of all documents would compare all pairs. So the documents are first dealt into blocks in which every linked pair meets at least
once: the rarest fifth of each set, by one order of all shingles, must share a shingle. Blocks of more than BLOCK sets have
an R-tree in each of their tiles; of smaller ones the pairs that sizes and places allow meet the same bound directly.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, components, discard, fits, free, materialize, mix, owned, release, small, text_key, utf8, word_hashes

N = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Groups of a set of up to FEW shingles; four times as many for each four times the size, so that chance overlap stays small.
GROUPS, FEW = 128, 2048
#: A shingle in more than this share of all documents comes last in the order; there are at most
#: (mean shingles of a document) / HEAVY such shingles, whatever the input.
HEAVY = 1 / 4000
#: Shingles that are counted together for it.
HEAVY_CHUNK = 1 << 21
#: Blocks in which a set is first held against the hub.
FIRST_BLOCKS = 3
#: Sets of a block whose pairs are tried one by one; sets of a tile of the larger blocks.
BLOCK, TILE = 64, 256
NODE_SIZE = 32
_C = mix(np.arange(11, 11 + N, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW63 = np.uint64((1 << 63) - 1)
_TOP = np.uint64(1 << 63)


def shingles(data: np.ndarray, off: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each row's distinct shingles as 63-bit ids in the join's order; heavy ones, with the top bit set, come last."""
    h, count, _ = word_hashes(data, off, lower=True)
    n_docs = len(off) - 1
    doc = np.repeat(np.arange(n_docs), count)
    if len(h) >= N:
        s = h[: len(h) - N + 1] * _C[0]
        for k in range(1, N):
            s += h[k : len(h) - N + 1 + k] * _C[k]
        whole = doc[: len(s)] == doc[N - 1 :]
        s, d = mix(s[whole]), doc[: len(whole)][whole]
    else:
        s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < N))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        own = np.array([mix(np.array([(h[f : f + c] * _C[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64))[0] for f, c in zip(first, count[short], strict=True)], np.uint64)
        s, d = np.concatenate([s, own]), np.concatenate([d, short])
    s &= _LOW63
    if heavy is not None and len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        s = np.where(heavy[at] == s, s | _TOP, s)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[keep], d[keep]
    return s, np.searchsorted(d, np.arange(n_docs + 1))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def level(n) -> np.ndarray:
    """0 for sets of up to FEW shingles, 1 up to four times that, and so on; the groups of a level split those of the one below."""
    return np.ceil(np.log2(np.maximum(n, FEW) / FEW) / 2).astype(np.int64)


def count_vectors(s: np.ndarray, at: np.ndarray, which: np.ndarray | None = None) -> list[bytes]:
    """For each set, or each of which, a scale and the counts over it, rounded up, as bytes. So count <= scale * stored, and bounds stay bounds."""
    out = []
    for i, k in enumerate(level(np.diff(at)).tolist()):
        if which is not None and not which[i]:
            continue
        groups = GROUPS << 2 * k
        grid = np.bincount((s[at[i] : at[i + 1]] & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        scale = min(255, max(1, -(-int(grid.max()) // 255)))
        out.append(bytes([scale]) + np.minimum(255, -(-grid // scale)).astype(np.uint8).tobytes())
    return out


def unpack(raw: bytes) -> np.ndarray:
    """The counts' upper bounds. A count beyond 255 times 255 is taken as unbounded."""
    q = np.frombuffer(raw, np.uint8)
    out = q[1:].astype(np.int32) * int(q[0])
    if q[0] == 255:
        out[q[1:] == 255] = np.iinfo(np.int32).max // len(out)
    return out


def coarsen(vec: np.ndarray, k: int) -> np.ndarray:
    """The vector by the groups of level k."""
    return vec.reshape(-1, GROUPS << 2 * k).sum(0)


def may_link(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that share no more than overlap can link."""
    overlap = np.minimum(overlap, np.minimum(a, b))
    return (100 + percent) * overlap >= percent * (a + b)


class RTree:
    """A packed two-level R-tree of count vectors that takes further points: nodes of NODE_SIZE points with their greatest coordinates."""

    def __init__(self, groups: int):
        self.points = np.zeros((NODE_SIZE, groups), np.int32)
        self.size = np.zeros(NODE_SIZE, np.int64)
        self.top = np.zeros((1, groups), np.int32)
        self.label: list[int] = []
        self.n = 0

    def add(self, vector: np.ndarray, size: int, label: int) -> None:
        self.label.append(label)
        if self.n == len(self.points):
            self.points = np.concatenate([self.points, np.zeros_like(self.points)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.top = np.concatenate([self.top, np.zeros_like(self.top)])
        self.points[self.n], self.size[self.n] = vector, size
        node = self.n // NODE_SIZE
        self.top[node] = np.maximum(self.top[node], vector)
        self.n += 1

    def search(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose overlap with vector can suffice. A node is entered if even its greatest coordinates could: a partner has
        percent / 100 of the size at least."""
        if self.n > NODE_SIZE:
            nodes = np.flatnonzero(100 * np.minimum(self.top[: -(-self.n // NODE_SIZE)], vector).sum(1) >= percent * size)
            at = (nodes[:, None] * NODE_SIZE + np.arange(NODE_SIZE)).ravel()
            at = at[at < self.n]
        else:
            at = np.arange(self.n)
        ok = may_link(np.minimum(self.points[at], vector).sum(1), self.size[at], np.full(len(at), size), percent)
        return at[ok]


def _heavy(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles of more than HEAVY of the documents. Such a shingle has that share of some chunk's documents."""

    def often(held: list[np.ndarray], docs: int):
        ids, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= max(3, HEAVY * docs)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), pa.array(n[keep])], ["s", "n"])

    def work(batches):
        held, docs = [], 0
        for b in small(batches):
            data, off = utf8(b.column(0))
            for i, j in chunks(off):
                held.append(shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])[0])
                docs += j - i
                if sum(map(len, held)) > HEAVY_CHUNK:
                    yield often(held, docs)
                    held, docs = [], 0
        if held:
            yield often(held, docs)
        held.clear()
        release()

    rows = docs.select("text").mapInArrow(work, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(16, int(HEAVY * n_docs))).select("s").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _features(docs: DataFrame, heavy, percent: int) -> DataFrame:
    """(id, n, sig, sig2, vec, keys, row): keys is the prefix of the set in which a linked set must share a shingle, in the join's order.

    vec and keys are there for the first of equal sets in a task only, so a group of copies has as many as there are tasks at most.
    """
    schema = docs.select("id").schema.add("n", "long").add("sig", "long").add("sig2", "long").add("vec", "binary").add("keys", T.ArrayType(T.LongType())).add("row", "long")

    def work(batches):
        seen: set[int] = set()
        for b in small(batches):
            data, off = utf8(b.column(1))
            for i, j in chunks(off):
                s, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], heavy.value)
                n = np.diff(at)
                m = s & _LOW63
                sig, sig2 = mix(_sums(mix(m), at) + n.astype(np.uint64)), mix(_sums(mix(m ^ _C[0]), at))
                new = np.zeros(len(n), bool)
                for k, g in enumerate(sig.tolist()):
                    if n[k] and g not in seen:
                        seen.add(g)
                        new[k] = True
                vec = iter(count_vectors(s, at, new))
                prefix = np.where(new, n - (percent * n + 99) // 100 + 1, 0)
                to = np.concatenate([[0], np.cumsum(prefix)])
                take = np.repeat(at[:-1] - to[:-1], prefix) + np.arange(to[-1])
                keys = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(m[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(sig.view(np.int64)), pa.array(sig2.view(np.int64)), pa.array([next(vec) if x else None for x in new], pa.binary()), keys, b.column(2).slice(i, j - i)], names=schema.names)
        release()

    return docs.select("id", "text", "row").mapInArrow(work, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (key, sig, n, pos), with repeats, the distinct ones whose key two or more sigs have, with the number m of them."""

    def work(batches):
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if held:
            key, sig, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((sig, key))
            key, sig = key[order], sig[order]
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], sig[1:] != sig[:-1]])
            order, key, sig = order[new], key[new], sig[new]
            first = np.flatnonzero(new_key[new])
            size = np.diff(np.append(first, len(key)))
            m = np.repeat(size, size)
            keep = m > 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep], sig[keep], n[order[keep]], pos[order[keep]], m[keep])], ["key", "sig", "n", "pos", "m"])
        release()

    return rows.repartition("key").mapInArrow(work, "key long, sig long, n long, pos int, m long")


def _least_overlap(a, b, percent: int):
    """The least number of shingles that linked sets of sizes a and b share."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _small_blocks(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sigs of different components that share a block of BLOCK sets at most, from rows (key, sig, n, pos, component).

    At the first shingle that two sets share, in the join's order, no more than the rest of each can be shared; a pair that links
    passes this at that shingle. Every pair comes once from a task.
    """

    def pairs_of(key, sig, n, pos, component):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        for m in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            for at in np.array_split(start[size == m], max(1, (size == m).sum() * len(i) >> 20)):
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = component[x] != component[y]
                x, y = x[ok], y[ok]
                ok = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= _least_overlap(n[x], n[y], percent)
                x, y = sig[x[ok]], sig[y[ok]]
                yield np.stack([np.minimum(x, y), np.maximum(x, y)], 1)

    def work(batches):
        held, rest, found = 0, None, []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                new = [c.to_numpy() for c in b.columns]
                rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            # the last key may go on in the next batch
            cut = len(rest[0]) if b is None else int(np.searchsorted(rest[0], rest[0][-1]))
            for pairs in pairs_of(*(x[:cut] for x in rest)):
                found.append(pairs)
                held += len(pairs)
                if held > 1 << 20:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    held = len(found[0])
                    if held > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(found[0][:, 0]), pa.array(found[0][:, 1])], ["a", "b"])
                        found, held = [], 0
            rest = [x[cut:] for x in rest]
        if found:
            every = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["a", "b"])
        release()

    return known.select("key", "sig", "n", "pos", "component").repartition("key").sortWithinPartitions("key").mapInArrow(work, "a long, b long").distinct()


def _tiles(known: DataFrame) -> DataFrame:
    """Rows (cell, side, sig, n, component) of the blocks of more than BLOCK sets, so that two sets of different components of a block meet in
    one cell.

    The sets of a block's largest component meet the others only; these meet each other too. Both are dealt into tiles of TILE sets, and a
    cell holds two tiles, or one. A group of near copies shares dozens of blocks; so blocks of which one component has half the sets
    or more are one group, in which a set is once. A block of one component has no cell: its rows are added up by component before they
    are dealt by key.
    """
    parts = known.groupBy("key", "component").agg(F.count("*").alias("n_sets"))
    block = parts.groupBy("key").agg(F.max_by("component", F.struct("n_sets", "component")).alias("main"), F.max("n_sets").alias("n_main"), F.sum("n_sets").alias("n_all")).filter("n_all > n_main")
    group = F.when(F.col("n_main") * 2 >= F.col("n_all"), F.concat(F.lit("c/"), "main")).otherwise(F.concat(F.lit("k/"), "key"))
    block = materialize(block.select("key", "main", group.alias("group")), "large-blocks")
    rows = known.join(fits(block), "key").select("group", "sig", "n", "component", (F.col("component") != F.col("main")).alias("other")).distinct()
    rows = materialize(rows, "large-groups")
    size = rows.groupBy("group").agg(F.count_if(~F.col("other")).alias("n_main"), F.count_if("other").alias("n_other"))
    size = size.select("group", F.ceil(F.col("n_main") / TILE).cast("int").alias("k"), F.ceil(F.col("n_other") / TILE).cast("int").alias("g"))
    # a set lies in the main component, in tile x of k, or among the others, in tile x of g
    x = F.pmod(F.xxhash64("sig"), F.when(F.col("other"), F.col("g")).otherwise(F.col("k"))).cast("int")
    rows = rows.join(fits(size), "group").withColumn("x", x)
    cell = lambda kind, i, j: F.concat_ws("/", F.col("group"), F.lit(kind), i, j)
    with_main = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda d: F.struct(cell("m", F.col("x"), d).alias("cell"), F.lit(1).alias("side")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda y: F.struct(cell("m", y, F.col("x")).alias("cell"), F.lit(0).alias("side"))))
    among = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda y: F.struct(cell("o", F.least(y, F.col("x")), F.greatest(y, F.col("x"))).alias("cell"), F.when(y == F.col("x"), 2).when(F.col("x") < y, 0).otherwise(1).alias("side")))).otherwise(F.array().cast("array<struct<cell:string,side:int>>"))
    return rows.select(F.explode(F.concat(with_main, among)).alias("c"), "sig", "n", "component").select("c.cell", "c.side", "sig", "n", "component")


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sigs of different components whose vectors allow a link, from rows (cell, side, sig, n, component, vec): of a
    cell's sides 0 and 1, or all of side 2. Side 0 is indexed by R-trees, and side 1 searches them."""

    def compare(key, cell):
        sig, n, component, side = (cell[c].to_numpy() for c in ("sig", "n", "component", "side"))
        vec, k = [unpack(v) for v in cell["vec"].to_pylist()], level(n).tolist()
        trees: dict[tuple[int, int], RTree] = {}
        out = [np.zeros((0, 2), np.int64)]
        for i in np.argsort(side, kind="stable").tolist():
            if side[i]:
                for own, at in list(trees):
                    if at == min(own, k[i]):
                        tree = trees[own, at]
                        j = np.array([tree.label[x] for x in tree.search(coarsen(vec[i], at), n[i], percent)], np.int64)
                        j = j[component[j] != component[i]]
                        out.append(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])], 1))
            if side[i] != 1:
                for at in range(k[i] + 1):
                    trees.setdefault((k[i], at), RTree(GROUPS << 2 * at)).add(coarsen(vec[i], at), n[i], i)
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("cell").applyInArrow(compare, "a long, b long").distinct()


def _allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose count vectors allow a link; sets: (sig, n, vec) of all."""
    end = lambda x: sets.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("vec").alias(f"vec_{x}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "n_b", "vec_a", "vec_b")

    def work(batches):
        for batch in batches:
            a, b, n_a, n_b = (c.to_numpy() for c in batch.columns[:4])
            overlap = np.zeros(len(a), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = unpack(x), unpack(y)
                groups = min(len(p), len(q))
                overlap[i] = np.minimum(p.reshape(-1, groups).sum(0), q.reshape(-1, groups).sum(0)).sum()
            ok = may_link(overlap, n_a, n_b, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def _verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets; sets: (sig, id, row) of all. The partners of a are dealt into jobs of about 64 texts."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("k"))
    jobs = pairs.join(many, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("k"))).alias("job"), "a", "b")
    both = jobs.select("job", F.col("a").alias("sig"), F.lit(True).alias("leads")).unionByName(jobs.select("job", F.col("b").alias("sig"), F.lit(False).alias("leads"))).distinct()
    need = materialize(both.join(sets.select("sig", F.col("id").alias("__id"), F.col("row").alias("__row")), "sig"), "verify-jobs")
    texts = docs.join(fits(need), F.col("id").eqNullSafe(F.col("__id")) & F.col("row").eqNullSafe(F.col("__row")))

    def work(key, job):
        sig, leads = job["sig"].to_pylist(), job["leads"].to_pylist()
        data, off = utf8(job["text"])
        s, at = shingles(data, off)
        own = mix(_sums(mix(s), at) + np.diff(at).astype(np.uint64)).view(np.int64)
        # rows that repeat an id may have other texts
        found = {(g, x): s[at[i] : at[i + 1]] for i, (g, x) in enumerate(zip(sig, leads, strict=True)) if own[i] == g}
        out = []
        for a in [g for g, x in found if x]:
            lead = found[a, True]
            for b in [g for g, x in found if not x]:
                i = len(np.intersect1d(lead, found[b, False], assume_unique=True))
                if 100 * i >= percent * (len(lead) + len(found[b, False]) - i):
                    out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    links = materialize(texts.select("job", "sig", "leads", "text").groupBy("job").applyInArrow(work, "a long, b long"), "links")
    discard(need)
    return links


@owned("shingle-components")
def jaccard_components(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, one_of_each: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row of df; component_id is the smallest id that links reach.
    With one_of_each also text_key, the hash of the text, and first: whether (id, text_key) is the smallest of its component.

    Null texts and texts without words have an empty set, link with nothing and are their own component; so are
    they where their id is null. Equal sets are one node from the start; a task sends the keys of such a set once, so exact copies cost
    little. Every other linked pair shares a shingle of its two prefixes. Blocks are searched in two steps: first each set meets the hubs
    of its FIRST_BLOCKS largest blocks, the sets of which most shingles are shared, which joins groups of near copies to their originals;
    then, with the components known, sets of different components meet in all blocks. Any two sets of one block that could link are
    verified or already joined; so no link is lost, and a group of near copies never becomes all its pairs. Sets are of 63-bit
    hashes: two shingles of a pair of texts agree by chance with a probability of about 1e-13. Repeated rows are copies of each
    other; rows that repeat an id with other texts are told apart. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("row"))
    heavy = spark.sparkContext.broadcast(_heavy(docs, docs.count()))
    feats = materialize(_features(docs, heavy, percent), "shingle-features")
    one = feats.filter("vec is not null")
    shared = materialize(_shared(one.select("sig", "n", F.posexplode("keys").alias("pos", "key")).select("key", "sig", "n", "pos")), "shared-keys")
    free(spark)
    # of a set that several tasks sent, any row will do
    needed = shared.select("sig").distinct()
    sets = materialize(one.select("sig", "n", "vec", "id", "row").join(needed, "sig", "left_semi").dropDuplicates(["sig"]), "shingle-sets")
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    largest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "key"))), 1, FIRST_BLOCKS)
    first = shared.groupBy("sig", "n").agg(F.count("*").alias("c"), largest.alias("b")).select(F.explode("b.key").alias("key"), "sig", "n", (F.col("c") / prefix).alias("hub"))
    first = materialize(first, "first-blocks")
    hubs = first.groupBy("key").agg(F.max(F.struct("hub", "n", "sig")).alias("h"))
    fit = F.least(F.col("n"), F.col("h.n")) * 100 >= F.greatest(F.col("n"), F.col("h.n")) * percent
    pairs = first.join(fits(materialize(hubs, "hubs")), "key").filter((F.col("sig") != F.col("h.sig")) & fit).select(F.col("h.sig").alias("a"), F.col("sig").alias("b")).distinct()
    pairs = materialize(_allowed(pairs, sets, percent), "pairs")
    links = _verify(docs, sets, pairs, percent)
    discard(pairs)
    component = materialize(components(links), "components")
    known = shared.join(component, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "pos", "m", F.coalesce("component", "sig").alias("component"))
    known = materialize(known, "known-keys")
    discard(shared)
    free(spark)
    found = _allowed(_small_blocks(known.filter(F.col("m") <= BLOCK), percent), sets, percent)
    cells = _tiles(known.filter(F.col("m") > BLOCK).select("key", "sig", "n", "component")).join(sets.select("sig", "vec"), "sig")
    found = materialize(found.unionByName(_cells(cells, percent)).distinct(), "pairs")
    discard(known, first)
    if not found.isEmpty():
        more = _verify(docs, sets, found, percent)
        discard(component)
        component = materialize(components(links.unionByName(more)), "components")
        discard(more)
    members = feats.select("id", "n", "sig", "sig2", "row")
    named = F.when(F.col("id").isNotNull(), F.struct("id", "row"))
    node = members.filter("n > 0").groupBy("sig", "sig2").agg(F.min(named).alias("low")).join(component, F.col("sig") == F.col("node"), "left").withColumn("component", F.coalesce("component", "sig"))
    node = materialize(node.select("sig", "sig2", "low", "component"), "nodes")
    low = node.groupBy("component").agg(F.min("low").alias("first"))
    out = members.join(node.join(low, "component").select("sig", "sig2", "first"), ["sig", "sig2"], "left")
    alone = F.col("n") == 0
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.coalesce("first.id", "id")).alias("component_id")]
    if one_of_each:
        columns += [F.col("row").alias("text_key"), F.coalesce(alone | ((F.col("id") == F.col("first.id")) & (F.col("row") == F.col("first.row"))), F.lit(False)).alias("first")]
    return out.select(*columns)


def oracle(percent: int = PERCENT) -> str:
    """Brute force in DuckDB over the view documents."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, x from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')]
 else list_transform(generate_series(1, len(w) - {N - 1}), lambda i: array_to_string(w[i:i+{N - 1}], ' ')) end) x from w)),
n as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b using (x) where a.doc_id != b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= {percent} * (x.n + y.n - i)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) b from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id"""
