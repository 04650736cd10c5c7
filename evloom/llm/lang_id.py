"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, unused

BITS = 16
ORDERS = (1, 2, 3)
#: The model is fitted on about so many labelled rows, chosen by the hash of their id.
FIT_ROWS = 8192
#: Characters that numpy works on at once.
WINDOW = 1 << 18
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNDETERMINED = "und"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of all n-grams that lie within codes, by order."""
    out = []
    m = codes * _MULT[0]
    for n in ORDERS:
        if len(codes) < n:
            break
        h = m[n - 1 :].copy()
        for k in range(1, n):
            h ^= np.left_shift(m[n - 1 - k : len(m) - k] * _MULT[k % 3], k) + np.uint32(n)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) arrays of all n-grams of the texts, a bounded number of characters at once.

    A text is cut at WINDOW characters with an overlap of the longest n-gram less one; orders that lie wholly in
    the overlap are counted by the earlier window only.
    """
    rows: list[np.ndarray] = []
    at: list[np.ndarray] = []
    held = 0
    longest = max(ORDERS)
    for r, t in enumerate(texts):
        c = _codes(" " + t + " ")
        for i in range(0, max(1, len(c) - longest + 1), WINDOW):
            piece = c[i : i + WINDOW + longest - 1]
            last = i + WINDOW + longest - 1 >= len(c)
            for n, b in zip(ORDERS, _buckets(piece), strict=False):
                b = b if last else b[:WINDOW]
                at.append(b)
                rows.append(np.full(len(b), r, np.int32))
            held += len(piece)
            if held >= WINDOW:
                yield np.concatenate(at), np.concatenate(rows)
                at, rows, held = [], [], 0
    if at:
        yield np.concatenate(at), np.concatenate(rows)


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column | None = None, fit_rows: int = FIT_ROWS, alpha: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities by bucket and language, log-priors) from a bounded, hashed sample of labelled rows.

    Counts are added up on the executors: each task sends one row for each language, of 2**BITS numbers.
    """
    labelled = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    labelled = labelled.filter(usable) if usable is not None else labelled
    n = labelled.count()
    share = F.lit(int(min(1.0, fit_rows / max(n, 1)) * (2**62)))
    sample = labelled.filter(F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 2) <= share).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            index = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            code = np.array([index[x] for x in langs])
            grid = np.zeros((len(index), 1 << BITS), np.int64)
            for buckets, rows in _windows(texts):
                grid += np.bincount(code[rows] << BITS | buckets, minlength=grid.size).reshape(grid.shape)
            docs = np.bincount(code, minlength=len(index))
            for x, i in index.items():
                total[x] = total.get(x, 0) + np.append(grid[i], docs[i])
        release()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype(np.int64).tobytes() for x in total.values()])], ["l", "c"])

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for x, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[x] = total.get(x, 0) + np.frombuffer(c, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()])], ["l", "c"])

    rows = sorted(sample.mapInArrow(count, "l string, c binary").repartition("l").mapInArrow(add, "l string, c binary").collect())
    if not rows:
        return [], np.zeros((1 << BITS, 0)), np.zeros(0)
    counts = np.array([np.frombuffer(r.c, np.int64) for r in rows], float)
    grams, docs = counts[:, :-1] + alpha, counts[:, -1]
    return [r.l for r in rows], np.log(grams / grams.sum(1, keepdims=True)).T.copy(), np.log(docs / docs.sum())


def predict(spark: SparkSession, df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """df's id (or the columns keep) with lang_pred and score, the posterior probability of lang_pred; their names after prefix, which should make
    them differ from the kept ones'.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text where nothing could be
    learned. Equal posteriors go to the language that is first by code point. Whole texts are scored, in windows, so
    memory does not grow with the longest text's n-grams.
    """
    langs, weights, prior = model
    shared = spark.sparkContext.broadcast((langs, weights.astype(np.float32), prior))
    keep = [id_col] if keep is None else keep

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def score(column: pa.Array, letters: pa.Array) -> pa.Array:
        langs, w, prior = shared.value
        pred, sure = [], []
        for at in range(0, len(column), 512):  # few texts at once as Python strings
            texts = [t or "" for t in column.slice(at, 512).to_pylist()]
            total = np.tile(prior, (len(texts), 1))
            for buckets, rows in _windows(texts) if langs else ():
                for j in range(len(langs)):
                    total[:, j] += np.bincount(rows, weights=w[buckets, j], minlength=len(texts))
            ok = np.array([bool(x) for x in letters.slice(at, 512).to_pylist()], bool) & bool(langs)
            best = total.argmax(1) if langs else np.zeros(len(texts), int)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if langs else np.zeros(len(texts))
            pred += [langs[k] if x else UNDETERMINED for k, x in zip(best, ok, strict=True)]
            sure += np.where(ok, p, 0.0).tolist()
        release()
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    # only the text goes to Python; the other columns wait in the JVM
    text = F.col(text_col).cast("string")
    (name,) = unused(df, "__lang")
    found = df.withColumn(name, score(text, text.rlike(r"\p{L}")))
    return found.select(*keep, *[F.col(name)[c].alias(prefix + c) for c in ("lang_pred", "score")])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row, learned from the rows that are not held out."""
    model = fit(df, id_col, text_col, lang_col, ~held_out(id_col), fit_rows)
    return predict(spark, df, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
