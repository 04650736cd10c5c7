"""Embedding near-duplicates by a random-projection tree forest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fits, materialize, owned, release

THRESHOLD = 0.98
TREES = 4
#: The forest is fitted on at most so many vectors; every vector is then indexed.
FIT_ROWS = 16384
#: Vectors wished for in a leaf, the fewest of the sample that may fix a split, and rows of a compared tile.
LEAF, SPLIT_SAMPLE, TILE = 500, 16, 2000
#: Splits of a leaf after the sample's are used up.
FURTHER = 40
#: A split that sends more than this share of the sample both ways makes more rows than it saves pairs.
MOST_SPILL = 0.3


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def depth_for(n: int) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / LEAF)))


class Tree:
    """Random splits at the sample's median. A vector within `spill` of a split goes both ways, so that two linked
    vectors part only if a random direction tells them apart by more than twice that.

    Where the sample is used up, splits go on along one direction for each level, at the mean of what the leaf has of the
    sample; so leaves stay small whatever the number of vectors, and the tree as large as its sample.
    """

    def __init__(self, sample: np.ndarray, spill: float, rng: np.random.Generator):
        self.spill = spill
        self.nodes: list[tuple[np.ndarray, float, int, int] | None] = []
        self.directions = rng.standard_normal((FURTHER, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.cuts: dict[int, np.ndarray] = {}
        self._grow(sample, rng)

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(x) >= 2 * SPLIT_SAMPLE:
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            p = x @ direction
            cut = float(np.median(p))
            left, right = p <= cut + self.spill, p >= cut - self.spill
            if (left & right).mean() < MOST_SPILL and max(left.sum(), right.sum()) < len(x):
                self.nodes[at] = (direction, cut, self._grow(x[left], rng), self._grow(x[right], rng))
                return at
        p = x @ self.directions.T
        cuts = p.mean(0) if len(x) else np.zeros(FURTHER)
        # splits that would send nearly all both ways are left out
        useful = (np.abs(p - cuts) <= self.spill).mean(0) < MOST_SPILL if len(x) else np.zeros(FURTHER, bool)
        self.cuts[at] = np.where(useful, cuts, np.nan)
        return at

    def leaves(self, x: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x in it) after so many splits, or all that help."""
        out, todo = [], [(0, np.arange(len(x)), 0)]
        while todo:
            at, rows, d = todo.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if node is None or d == depth:
                out += self._further(at, x, rows, depth - d)
                continue
            p = x[rows] @ node[0]
            todo += [(node[2], rows[p <= node[1] + self.spill], d + 1), (node[3], rows[p >= node[1] - self.spill], d + 1)]
        return out

    def _further(self, at: int, x: np.ndarray, rows: np.ndarray, splits: int) -> list[tuple[int, np.ndarray]]:
        done = [(at << FURTHER, rows)]
        levels = np.flatnonzero(~np.isnan(self.cuts[at]))[:splits] if splits > 0 and at in self.cuts else []
        for bit, level in enumerate(levels):
            new = []
            for leaf, inside in done:
                p = x[inside] @ self.directions[level] - self.cuts[at][level]
                new += [(leaf, inside[p <= self.spill]), (leaf | 1 << bit, inside[p >= -self.spill])]
            done = [(leaf, inside) for leaf, inside in new if len(inside)]
        return done


def fit_forest(labels: np.ndarray, x: np.ndarray, trees: int, threshold: float, seed: int = 7) -> dict:
    """label: [Tree] for every label with enough of the sample for a split; None: [Tree] for all others, of the whole sample."""
    rng = np.random.default_rng(seed)
    spill = math.sqrt(2 - 2 * threshold) / math.sqrt(x.shape[1])
    names, n = np.unique(labels, return_counts=True)
    forest: dict = {str(k): [Tree(x[labels == k], spill, rng) for _ in range(trees)] for k in names[n >= 2 * SPLIT_SAMPLE]}
    return forest | {None: [Tree(x, spill, rng) for _ in range(trees)]}


@owned("near-vectors")
def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df.

    Rows link if their labels are equal and not null and the cosine, in doubles, is at least threshold. A vector that is null,
    empty, zero, or has null or non-finite components links with nothing and is its own component; so does one whose label
    is null, and vectors of different labels or lengths never link. Equal vectors are one class from the start: its
    rows link with each other, and only the class enters the forest. Every class goes to one or more leaves of each tree;
    all pairs within a leaf are compared, those of a large leaf tile by tile, and a pair that meets in several leaves counts in the
    first of them. Leaves send back sums and one edge for each class, never pairs. Rows with a null id count as links, have the
    smallest id of their component, if any has one, and are not kept; rows that repeat an id are judged each by its own vector.
    An empty table gives an empty result.
    """
    narrow = df.schema[vec_col].dataType.simpleString() == "array<float>"  # these are doubles of four bytes
    like, keep = ("<f4" if narrow else "<f8"), materialize
    vec = F.col(vec_col).cast("array<double>")
    good = F.coalesce(F.col(label_col).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    # minus zero is zero
    base = df.select(F.col(id_col).alias("id"), F.when(good, F.concat_ws("/", F.size(vec).cast("string"), F.col(label_col).cast("string"))).alias("label"), F.when(good, F.transform(vec, lambda v: v + 0.0)).alias("vec"))
    classes = base.filter("label is not null").groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = keep(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("of"))
    placed_in = classes.join(fits(sizes), "label").select("label", "of", "c", "n", "vec")
    n_classes = classes.count()
    share = min(1.0, fit_rows / max(1, n_classes))
    sample = classes.filter(F.pmod(F.xxhash64("c", F.lit("fit")), F.lit(1 << 40)) < int(share * 2**40)).select("label", "vec").limit(2 * fit_rows).collect() if n_classes else []
    forest: dict = {}
    for size in {r.label.split("/", 1)[0] for r in sample}:
        mine = [r for r in sample if r.label.split("/", 1)[0] == size]
        forest[size] = fit_forest(np.array([r.label for r in mine]), _unit(np.array([r.vec for r in mine], float)), trees, threshold)
    model = spark.sparkContext.broadcast(forest)

    def placed(batch):
        """(label, rank, rows); a rank is a tree and a leaf of it. Vectors of a length that the sample lacks are one leaf."""
        labels, x = batch.column("label").to_pylist(), batch.column("vec").to_numpy(zero_copy_only=False)
        of = batch.column("of").to_pylist()
        for label, rows in (pd.Series(np.arange(len(labels))).groupby(np.array(labels)).indices if labels else {}).items():
            unit = _unit(np.array([x[i] for i in rows]))
            forest = model.value.get(label.split("/", 1)[0], {})
            for t, tree in enumerate(forest.get(label) or forest.get(None) or [None]):
                for leaf, inside in tree.leaves(unit, depth_for(of[rows[0]])) if tree else [(0, np.arange(len(rows)))]:
                    yield label, t << 58 | leaf, rows[inside]

    def count_leaves(batches):
        total: dict = {}
        for b in batches:
            for label, rank, rows in placed(b):
                total[label, rank] = total.get((label, rank), 0) + len(rows)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["label", "rank", "leaf_n"])
        release()

    large = placed_in.mapInArrow(count_leaves, "label string, rank long, leaf_n long").groupBy("label", "rank").agg(F.sum("leaf_n").alias("leaf_n"))
    large = keep(large.filter(F.col("leaf_n") > TILE).select("label", "rank", F.ceil(F.col("leaf_n") / TILE).cast("int").alias("parts")), "large-leaves")

    def route(batches):
        for b in batches:
            c, n, x = b.column("c").to_numpy(), b.column("n").to_numpy(), b.column("vec").to_numpy(zero_copy_only=False)
            where = list(placed(b))
            member: list[list[int]] = [[] for _ in range(len(c))]
            for _, rank, rows in where:
                for i in rows:
                    member[i].append(rank)
            member_b = [np.array(sorted(m), "<i8").tobytes() for m in member]
            raw = [np.asarray(v, like).tobytes() for v in x]
            for label, rank, rows in where:
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(rows), pa.string()), pa.array([rank] * len(rows), pa.int64()), pa.array(c[rows]), pa.array(n[rows]), pa.array([raw[i] for i in rows], pa.binary()), pa.array([member_b[i] for i in rows], pa.binary())], ["label", "rank", "c", "n", "vec", "member"])
        release()

    routed = placed_in.mapInArrow(route, "label string, rank long, c long, n long, vec binary, member binary")
    # a large leaf's vectors lie in one of `parts` tiles, and every two tiles meet
    routed = routed.join(fits(large), ["label", "rank"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("c"), "parts").cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    routed = routed.withColumn("tile", F.explode(tiles)).select("label", "rank", "tile.i", "tile.j", "part", "c", "n", "vec", "member")

    def compare(key, leaf):
        c, n, rank, cross = leaf["c"].to_numpy(), leaf["n"].to_numpy(), key[1].as_py(), key[2].as_py() != key[3].as_py()
        x = _unit(np.array([np.frombuffer(v, like) for v in leaf["vec"].to_pylist()], dtype=float))
        part = leaf["part"].to_numpy()
        m = [np.frombuffer(v, "<i8") for v in leaf["member"].to_pylist()]
        wide = max(map(len, m))
        member = np.full((len(m), wide), -1, np.int64)
        for i, v in enumerate(m):
            member[i, : len(v)] = np.where(v < rank, v, -1)  # only earlier leaves matter
        links = np.zeros(len(c), np.int64)
        root = np.arange(len(c))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in range(0, len(c), 512):
            a, b = np.nonzero(x[at : at + 512] @ x.T >= threshold)
            a = a + at
            ok = (a < b) & ((part[a] != part[b]) if cross else True)
            a, b = a[ok], b[ok]
            for i, j in zip(a[_firsts(a, b, root)], b[_firsts(a, b, root)], strict=True) if len(a) else ():
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            for lo in range(0, len(a), 1 << 20):
                i, j = a[lo : lo + (1 << 20)], b[lo : lo + (1 << 20)]
                before = np.zeros(len(i), bool)
                for u in range(wide):
                    for v in range(wide):
                        before |= (member[i, u] == member[j, v]) & (member[i, u] >= 0)
                i, j = i[~before], j[~before]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
        some = np.flatnonzero((links > 0) | (root != np.arange(len(c))))
        return pa.table({"c": c[some], "links": links[some], "root": c[[find(i) for i in some]] if len(some) else c[:0]})

    found = keep(routed.groupBy("label", "rank", "i", "j").applyInArrow(compare, "c long, links long, root long"), "vector-links")
    component = components(found.filter("c != root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("c").agg(F.sum("links").alias("links"))
    per_class = keep(classes.select("label", "vec", "id", "n", "c").join(sums, "c", "left").join(component, F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c")), "class-links")
    low = per_class.groupBy("component").agg(F.min("id").alias("component_id"))
    per_class = per_class.join(low, "component").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    done = base.join(per_class, ["label", "vec"], "left")
    component_id = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))


def _firsts(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which pairs to unite: for a row all its pairs, but each pair of roots only once, since the others change nothing."""
    pair = np.stack([root[a], root[b]])
    _, first = np.unique(pair, axis=1, return_index=True)
    return first


def oracle(threshold: float = THRESHOLD) -> str:
    """Brute force in DuckDB over the view embeddings."""
    return f"""
with recursive v as (select vec_id, label, embedding::double[] e from embeddings
 where label is not null and embedding is not null and len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x != 0))),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id != b.vec_id where list_cosine_similarity(a.e, b.e) >= {threshold}),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) b from r group by a), n as (select a, count(*) n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint n_links, least(vec_id, coalesce(c.b, vec_id)) component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id"""
