"""Text, token and score expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it: Unicode, wider than Java's \s.
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(x: Column | str) -> Column:
    return F.regexp_replace(x, EDGE, "")


def normalize_text(x: Column) -> Column:
    """Lower case, no white space at the ends, runs of it as one space."""
    return F.regexp_replace(strip(F.lower(x)), SPACE, " ")


def tokenize(x: Column) -> Column:
    return F.regexp_extract_all(normalize_text(F.coalesce(x, F.lit(""))), F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0))


def words(x: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), SPACE), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays taken as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_sum(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the keys that have a weight; 0 if these weights add up to 0."""
    used = [(v, weights[k]) for k, v in values.items() if k in weights]
    total = sum(w for _, w in used)
    if not total:
        return F.lit(0.0)
    out = F.lit(0.0)
    for v, w in used:
        out = out + v * F.lit(w)
    return out / F.lit(total)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def keyword_overlap(text: Column, query: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for a query without tokens."""
    q = F.array_distinct(tokenize(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokenize(text))) / F.size(q))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends; case stays."""
    return strip(F.regexp_replace(x, SPACE, " "))


def quote_in_text(quote: Column, text: Column) -> Column:
    """Whether a quote is found in a text, but for white space; an empty one never is."""
    q = collapse(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(collapse(F.coalesce(text, F.lit(""))), q)


def date_strings(x: Column, patterns: list[str]) -> Column:
    """All matches, by pattern and then by place, each string once."""
    found = [F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?i)" + p), F.lit(0)) for p in patterns]
    return F.array_distinct(F.concat(*found))


def mime_type(header: Column) -> Column:
    """Type without parameters, in lower case; null for null and empty."""
    return F.nullif(strip(F.lower(F.substring_index(header, ";", 1))), F.lit(""))


def sniff_type(header: Column, head: Column) -> Column:
    """The header's type, or where it says nothing, what the first 64 characters look like."""
    first = F.substring(head, 1, 64)
    opening = F.lower(F.regexp_replace(first, r"^\s+", ""))
    guess = F.when(first.startswith("%PDF-"), "application/pdf").when(opening.startswith("<!doctype") | opening.startswith("<html"), "text/html")
    mime = mime_type(header)
    return F.when(mime.isNull() | (mime == "application/octet-stream"), F.coalesce(guess, mime)).otherwise(mime)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; a vector of norm 0 counts as one of norm 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """A deterministic unit vector of a text: bytes of sha-256 over 255, more of them from the digest of the text and the
    length so far as four big-endian bytes, divided by the norm (1 where that is 0)."""

    @F.arrow_udf("array<double>")
    def embed(x: pa.Array) -> pa.Array:
        return _hash_vectors(x, dim)

    return embed(F.coalesce(text, F.lit("")))


def _hash_vectors(texts: pa.Array, dim: int) -> pa.Array:
    data = b"".join(b"".join(hashlib.sha256(x + n.to_bytes(4, "big") if n else x).digest() for n in range(0, dim, 32))[:dim] for x in texts.cast(pa.binary()).to_pylist())
    v = np.frombuffer(data, np.uint8).reshape(len(texts), dim) / 255.0
    total = np.zeros(len(v))
    for column in v.T:  # in order, as a sum over each vector has it
        total += column * column
    norm = np.sqrt(total)
    v = v / np.where(norm == 0, 1, norm)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))


def token_count(x: Column) -> Column:
    """Default estimate of a text's tokens: a quarter of its characters, rounded up."""
    return F.ceil(F.length(F.coalesce(x, F.lit(""))) / 4).cast("int")
