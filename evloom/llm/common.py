"""Shared-folder tables, numpy word hashing and connected components for the corpus operators.

Word hashes are 64-bit: two different words agree with probability of about 2**-55, which the
operators accept in place of a dictionary of all words.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts, as a character class of Java, RE2 and Python.
WS_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{WS_CLASS}]+"


#: The temporary folder of this process, once there is one.
_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary one if driver and executors are one process. On a cluster the setting must be there: a folder of
    each machine's own would lose results. The session is left as it is.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _SCRATCH:
        _SCRATCH["own"] = tempfile.mkdtemp(prefix="evloom-scratch-")
        atexit.register(shutil.rmtree, _SCRATCH["own"], ignore_errors=True)
    return _SCRATCH["own"]


class Scratch:
    """A run's folder in the shared one. All tables that are written while it is open go when the run is over, also if it fails; result() is what
    stays, in the folder of the run around it if there is one.

        with Scratch(spark, "mix") as s:
            sizes = s.table(df, "sizes")
            return s.result(sizes.groupBy("source").count())
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.dealt = spark, name, []
        self.path = f"{scratch_dir(spark)}/evloom/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag, self.path)

    def result(self, df: DataFrame) -> DataFrame:
        outer = Scratch.open[: Scratch.open.index(self)]
        return materialize(df, f"result-{self.name}", outer[-1].path if outer else f"{scratch_dir(self.spark)}/evloom")

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scratch.open.remove(self)
        discard(*self.dealt)
        delete(self.spark, self.path)


def owned(name: str):
    """For a function whose result is to be a table, and whose other tables go."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **more):
            frame = next(a for a in args if isinstance(a, DataFrame))
            with Scratch(frame.sparkSession, name) as s:
                return s.result(f(*args, **more))

        return run

    return wrap


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = f"{folder or _folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._evloom_path = path
    return out


def materialize_dealt(df: DataFrame, tag: str, key: str, parts: int) -> DataFrame:
    """Like materialize(), but dealt by key into so many buckets: what groups or joins it by the key later moves the other side only.
    df should be dealt so already."""
    name = f"evloom_{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{_folder(df.sparkSession)}/{name}"
    if Scratch.open:  # before the table is there: so it goes even if writing it fails
        Scratch.open[-1].dealt.append(_Dealt(df.sparkSession, path, name))
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
    out = df.sparkSession.table(name)
    out._evloom_path, out._evloom_table = path, name
    return out


class _Dealt:
    """A table to be discarded that may not be there yet."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.sparkSession, self._evloom_path, self._evloom_table = spark, path, name


def _folder(spark: SparkSession) -> str:
    return Scratch.open[-1].path if Scratch.open else f"{scratch_dir(spark)}/evloom"


def discard(*tables: DataFrame | _Dealt) -> None:
    """Deletes tables that materialize() or materialize_dealt() wrote, once nothing will read them again."""
    for t in tables:
        if hasattr(t, "_evloom_table"):
            t.sparkSession.sql(f"drop table if exists {t._evloom_table}")
        delete(t.sparkSession, t._evloom_path)


#: Bytes that a table may have in memory to be broadcast.
BROADCAST_BYTES = 48 << 20


def fits(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if all its rows take no more than so many bytes: 8 for a number, and 40 a row that a hash table adds."""
    row = F.lit(40)
    for f in table.schema:
        text = f.dataType.simpleString() in ("string", "binary")
        row += F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if text else F.coalesce(F.size(f.name), F.lit(0)) * 24 + 16 if f.dataType.simpleString().startswith("array") else F.lit(8)
    size = table.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no columns of theirs."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_key(text: Column) -> Column:
    """The hash of a text, null taken as a text of its own."""
    return F.xxhash64(text.cast("string"))


def null_row(id_: Column, text: Column) -> Column:
    """What tells rows without an id apart, null where there is an id: beside the id a key of all rows but copies."""
    return F.when(id_.isNull(), text_key(text)).alias("row")


def free(spark: SparkSession) -> None:
    """Lets Spark drop the files of shuffles that are over."""
    gc.collect()
    spark._jvm.System.gc()


#: What operators keep in a worker for their next task: each is emptied by the first other operator's task there that releases its memory.
KEPT: list[dict] = []


def release() -> None:
    """Gives memory that a task is done with back to the system; a Python worker lives on for the next task."""
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        gc.unfreeze()
        gc.collect()
    trim()


def trim() -> None:
    """release() without what operators keep for their next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- Arrow and numpy

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # odd, 5 modulo 8: powers differ for as long as possible
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[65:91] = BYTE[97:123]
IS_WS = np.zeros(256, bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a term of letters and digits: of ASCII all others, of the rest none.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, (1 << 19) + 1)
        for name, b in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is taken as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    _, offsets, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def small(batches, rows: int = 1024):
    """The batches, cut into pieces of so many rows; what a task copies of them at once is bounded by these."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def chunks(off: np.ndarray, most: int = 1 << 19):
    """Ranges of rows of at most so many bytes, a longer row alone; bounds what numpy holds at once."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool, breaks: int | None = None, gaps: np.ndarray = IS_WS):
    """Hashes of all words in order, and for each row how many it has. gaps: for each byte whether it lies between words.

    breaks: a byte at which rows are cut into lines; then a third array has each word's line in its row's order.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64), np.zeros(0, np.int64)
    up, down = _powers(n + 1)
    ws = gaps[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    prev_ws = np.empty(n, bool)
    prev_ws[0] = True
    prev_ws[1:] = ws[:-1]
    start = np.flatnonzero(~ws & (prev_ws | first[:-1]))
    next_ws = np.empty(n, bool)
    next_ws[-1] = True
    next_ws[:-1] = ws[1:]
    end = np.flatnonzero(~ws & (next_ws | first[1:])) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER_BYTE if lower else BYTE)[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    count = np.diff(np.searchsorted(start, off))
    line = np.cumsum(data == breaks)[start] if breaks is not None else np.zeros(0, np.int64)
    return h, count, line


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def only_shared(rows: DataFrame) -> DataFrame:
    """Of distinct rows (key, sig) those whose key has two or more, with that number m; dealt by key once, since only pairs of
    numbers travel. Neither may be null. A task holds its partition's numbers, 16 bytes a row."""

    def work(batches):
        keys, sigs = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy())
            sigs.append(b.column(1).to_numpy())
        if keys:
            key, sig = np.concatenate(keys), np.concatenate(sigs)
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            size = np.diff(np.append(first, len(key)))
            m = np.repeat(size, size)
            keep = order[m > 1]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(sig[keep]), pa.array(m[m > 1])], ["key", "sig", "m"])
        release()

    return rows.repartition("key").mapInArrow(work, "key long, sig long, m long")


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of edges (a, b), a != b.

    Alternating large-star and small-star steps: each joins and groups by node, with partial minimums
    before each shuffle, so that no component is ever gathered; the number of rounds grows with the
    logarithm of the longest path. Every round is a table in the shared folder. Edges with a null end are no
    links; repeated ones and loops change nothing; without edges the result is empty.
    """
    e = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
