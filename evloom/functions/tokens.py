"""Exact token counts by a vocabulary file, as column functions; the path is a parameter and the file is read on the driver."""

from __future__ import annotations

import base64
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies cut a text into words before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a worker remembers; when they are so many they are forgotten.
CACHE_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each merged byte string, from a file of base64 strings and ranks or from a tokenizer's JSON with byte-level merges."""
    with open(path, "rb") as f:
        raw = f.read()
    if not raw.lstrip().startswith(b"{"):
        return {base64.b64decode(a): int(r) for a, r in (line.split() for line in raw.splitlines() if line)}
    model = json.loads(raw)["model"]
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    spelled = lambda s: bytes(value[c] for c in s)
    single = {spelled(s): i for s, i in model["vocab"].items() if len(s) == 1 and s in value}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return single | {spelled(a + b): 256 + k for k, (a, b) in enumerate(pairs)}


def count_word(word: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one word. The neighbours with the lowest rank are merged, the first of equal ones first, until none has a rank: a heap of pairs, so that a long word
    takes n log n steps. A pair in the heap is stale if one of its parts has been merged since, which its end tells."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i: where it ends, and where the part before begins
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            until = end[end[i]]
            rank = ranks.get(word[i:until])
            if rank is not None:
                heapq.heappush(heap, (rank, i, until))

    for i in range(n - 1):
        offer(i)
    parts = n
    while heap:
        _, i, until = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[i] == until or end[end[i]] != until:
            continue
        alive[end[i]] = False
        end[i] = until
        if until < n:
            before[until] = i
        parts -= 1
        offer(i)
        offer(before[i])
    return parts


class TokenCounter:
    """A chunking.Counter: counts of a column's texts, 0 for null; split() cuts texts by them. Special tokens' strings count as text.

    The vocabulary is broadcast; it has the file's size. A worker keeps CACHE_WORDS words' counts."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = PATTERN):
        self.shared = spark.sparkContext.broadcast((read_ranks(path), pattern))

    def __call__(self, x: Column) -> Column:
        shared = self.shared

        @F.arrow_udf("int")
        def count(texts: pa.Array) -> pa.Array:
            tokens = _counter(shared)
            return pa.array([tokens(t) if t else 0 for t in texts.to_pylist()], pa.int32())

        return count(F.coalesce(x, F.lit("")))

    def split(self, x: Column, target: int) -> Column:
        """As chunking.split_text(): by paragraphs if there are several, else by sentences, else by words; neighbours are joined while the whole stays within target."""
        shared = self.shared

        @F.arrow_udf("array<string>")
        def cut(texts: pa.Array) -> pa.Array:
            tokens = _counter(shared)
            return pa.array([pieces(t or "", target, tokens) for t in texts.to_pylist()], pa.list_(pa.string()))

        return cut(x)


def pieces(text: str, target: int, tokens) -> list[str]:
    paragraphs = [p for p in (x.strip() for x in regex.split(r"\n\s*\n", text)) if p]
    sentences = [s for s in regex.split(r"(?<=[.!?])\s+", text.strip()) if s]
    parts, joint = (paragraphs, "\n\n") if len(paragraphs) > 1 else (sentences, "\n\n") if len(sentences) > 1 else (text.split(), " ")
    out: list[str] = []
    for p in parts:
        both = joint.join([out[-1], p]) if out else p
        if out and tokens(both) <= target:
            out[-1] = both
        else:
            out.append(p)
    return out


_COUNTERS: dict = {}


def _counter(shared):
    """One for each worker and vocabulary."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else getattr(shared, "_path", id(shared))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        ranks, pattern = shared.value
        words, known = regex.compile(pattern), {}

        def tokens(text: str) -> int:
            total = 0
            for w in words.findall(text):
                n = known.get(w)
                if n is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    raw = w.encode("utf-8", "replace")
                    n = 1 if raw in ranks else count_word(raw, ranks)
                    if len(w) <= 64:
                        known[w] = n
                total += n
            return total

        _COUNTERS[key] = tokens
    return _COUNTERS[key]
