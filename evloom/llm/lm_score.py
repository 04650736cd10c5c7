"""Language-model scores: a hierarchical Pitman-Yor model of order three whose seating is sampled by Gibbs sweeps.

Every two words in a row have a restaurant for the word after them; its parent is the restaurant of the second word alone, whose
parent is the root, whose parent is uniform. All contexts of training have restaurants, whatever the input.

Text meets model in blocks of documents. A block sends each of its distinct triples of words once, to the part of the middle word,
so that a context and its parent lie in one part; a middle word with much text is dealt over several parts by the word after it. What
parts share - customers of the root, tables of the contexts of dealt words - is added up by key between the rounds. Parts answer each
block's triples; a block kept which document has which triple. So a text is read once, and no model of the corpus is
broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free, materialize, materialize_dealt, mix, owned, release, small, utf8, word_hashes

#: Sweeps of all seating, and how many of them come before the averaged ones. Parts share what they have after BURN_IN.
SWEEPS, BURN_IN = 5, 2
#: Discount and concentration of the restaurants of two words, of one, and of the root.
PAIR, WORD, ROOT = (0.8, 1.0), (0.75, 4.0), (0.7, 10.0)
END = np.uint64(0x5851F42D4C957)
#: The words before a text's first word.
START = np.uint64(0x14057B7EF7678)
#: Tokens of a block; a longer text is a block of its own.
BLOCK_TOKENS = 1 << 21
#: Bytes of text for each part, and how many parts there are at least. They depend on the texts alone, and so do seeds and the order of all draws:
#: scores are the same on any cluster and however the table is split.
PART_BYTES, LEAST_PARTS = 8 << 20, 16
#: Words, the most frequent of those read beforehand, that have short numbers known to all tasks; a few MB. So messages are shorter.
BOOK_WORDS = 1 << 18
#: Bits of a word's hash: two of a hundred million words agree with a probability of about one. Words of the book have their place in it
#: instead, below these bits; others the next bit set.
WORD_BITS = 52
#: One text of so many, by its hash, is read beforehand to find the words that need several parts and those of the book. Sampling from it changes
#: results slightly: parts that share a word learn of each other's seating between the rounds only.
PEEK = 16
#: Customers of a dish up to which its tables are drawn from their exact distribution.
EXACT = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CUT, _RARE = np.uint64(64 - WORD_BITS), np.uint64(1 << WORD_BITS)


# ---------------------------------------------------------------- packing


def pack(x: np.ndarray) -> bytes:
    """A compressed array of numbers, byte planes apart."""
    x = np.ascontiguousarray(x)
    size = x.dtype.itemsize
    return len(x).to_bytes(7, "little") + bytes([size]) + (pa.compress(x.view(np.uint8).reshape(-1, size).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack(raw: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(raw[:7], "little"), raw[7]
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(w: np.ndarray) -> bytes:
    return pack(np.diff(w, prepend=w.dtype.type(0)))


def unpack_sorted(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def order_of(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The order of triples of numbers below n."""
    bits = max(1, int(n - 1).bit_length())
    if 3 * bits > 63:
        return np.lexsort((c, b, a))
    key = a.astype(np.int64)
    for x in (b, c):
        key <<= bits
        key |= x
    return np.argsort(key)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def ranges(x: np.ndarray, parts: int) -> np.ndarray:
    """Numbers below parts, evenly for any x."""
    return ((mix(x) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pack_within(x: np.ndarray, first: np.ndarray) -> bytes:
    """Numbers that are in order but where `first` is set."""
    return pack(np.where(first, x, np.diff(x, prepend=x.dtype.type(0))))


def unpack_within(raw: bytes, first: np.ndarray) -> np.ndarray:
    d = unpack(raw, np.uint32).astype(np.int64)
    total = np.cumsum(d)
    at = np.flatnonzero(first)
    return (total - np.repeat((total - d)[at], np.diff(np.append(at, len(d))))).astype(np.uint32)


# ---------------------------------------------------------------- the model


def stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t): how c customers can sit at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - discount * t, 0)) + out[c, t])
    return out


_STIRLING = {d: stirling(EXACT, d) for d in (PAIR[0], WORD[0], ROOT[0])}


def seat(rng: np.random.Generator, c: np.ndarray, a: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """Tables that c customers of one dish take, seated one after another; a is the concentration with the other dishes' tables.

    From the 32nd customer on they come in groups of a sixteenth of those seated, who see the same tables: so
    the steps grow with the logarithm of c, for a count of any size.
    """
    order = np.argsort(-c, kind="stable")
    c, a, parent = c[order], a[order], parent[order]
    t = np.ones(len(c), np.int64)
    n = 1
    while len(c) and c[0] > n:
        active = int(np.searchsorted(-c, -n, side="left"))
        step = np.minimum(max(1, n // 16), c[:active] - n)
        new = (a[:active] + discount * t[:active]) * parent[:active]
        p = new / (new + n - discount * t[:active])
        t[:active] += rng.binomial(step, np.clip(p, 0, 1))
        n += max(1, n // 16)
    out = np.empty_like(t)
    out[order] = t
    return out


def reseat(rng: np.random.Generator, c: np.ndarray, a: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes all of whose c customers left and come back, given everyone else.

    A blocked Gibbs step: the tables t have weights S(c, t) * a (a + d) .. (a + (t - 1) d) * parent^t. They are drawn exactly for up
    to EXACT customers; of dishes with more, customers sit down one after another, as seat() does.
    """
    out = np.ones(len(c), np.int64)
    many = c > EXACT
    if many.any():
        out[many] = seat(rng, c[many], a[many], parent[many], discount)
    few = np.flatnonzero((c > 1) & ~many)
    few = few[np.argsort(-c[few], kind="stable")]
    n, a, log_parent = c[few], a[few], np.log(parent[few])
    table, chosen = _STIRLING[discount], np.ones(len(few), np.int64)
    rising = np.log(a)
    total = table[n, 1] + log_parent + rising
    for t in range(2, EXACT + 1):
        k = int(np.searchsorted(-n, -t, side="right"))
        if not k:
            break
        rising[:k] += np.log(a[:k] + (t - 1) * discount)
        weight = table[n[:k], t] + t * log_parent[:k] + rising[:k]
        total[:k] = np.logaddexp(total[:k], weight)
        chosen[:k] = np.where(np.log(rng.random(k)) < weight - total[:k], t, chosen[:k])
    out[few] = chosen
    return out


#: Numbers of customers at which the root's tables are computed; between them they are interpolated.
GRID = np.concatenate([np.arange(EXACT + 1), np.unique((EXACT * 1.05 ** np.arange(1, 600)).astype(np.int64))])


def expected_tables(all_tables: float, known: int, before: np.ndarray) -> np.ndarray:
    """The mean number of tables of a word at the root with so many customers as GRID says.

    All words have the same parent, uniform over the known and one unknown word; so the seating of a word depends on its
    customers and on all other tables alone, and its mean is exact for up to EXACT customers.
    """
    d, theta = ROOT
    out = np.zeros(len(GRID))
    t = np.arange(1, EXACT + 1)
    a = theta + d * (all_tables - before[1 : EXACT + 1, None])
    weight = _STIRLING[d][1:, 1:] - t * np.log(known + 1) + np.cumsum(np.log(a + d * (t - 1)), 1)
    weight = np.exp(weight - weight.max(1, keepdims=True))
    out[1 : EXACT + 1] = (weight * t).sum(1) / weight.sum(1)
    for k in range(EXACT + 1, len(GRID)):
        n, x = GRID[k - 1], out[k - 1]
        new = (theta + d * all_tables) / (known + 1)
        out[k] = x + (GRID[k] - n) * new / (new + n - d * x)
    return out


def seat_root(customers: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, float]:
    """(tables of a word by GRID, all tables) where so many words have so many customers."""
    known = int(words.sum())
    tables, total = np.minimum(GRID, 1).astype(float), float(known)
    for _ in range(200):
        tables = expected_tables(total, known, tables)
        new = float((words * np.interp(customers, GRID, tables)).sum())
        if abs(new - total) <= 1e-9 * total:
            break
        total = new
    return tables, total


class Root:
    """What a part knows of the root: customers of its words; customers, tables and number of all words; tables by customers."""

    def __init__(self, c: np.ndarray, customers: float, known: int, tables: np.ndarray, all_tables: float):
        self.c, self.customers, self.base, self.tables, self.all = c, customers, 1 / (known + 1), tables, all_tables

    def probability(self, word: np.ndarray, without: np.ndarray | int = 0) -> np.ndarray:
        """Of words, with `without` of their customers gone, or all that the root knew of when it was told."""
        d, theta = ROOT
        c = np.maximum(self.c[word] - without, 0)
        t = np.interp(c, GRID, self.tables)
        gone = np.interp(self.c[word], GRID, self.tables) - t if np.any(without) else 0
        return (c - d * t + (theta + d * (self.all - gone)) * self.base) / (theta + self.customers - without)


class Part:
    """The triples (u, v, w) of some middle words v, all that training has of them, in the order of v, u, w."""

    def __init__(self, vocabulary: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, dealt: np.ndarray, seed: int):
        self.rng = np.random.default_rng(seed)
        self.c, size = c, max(1, len(vocabulary))
        new = changes(v, u)
        self.context = (np.cumsum(new) - 1).astype(np.int32)
        pairs, pair = np.unique(v.astype(np.int64) * size + w, return_inverse=True)
        self.pair, self.n_pairs = pair.astype(np.int32), len(pairs)
        middle, last = pairs // size, pairs % size
        first = changes(middle)
        self.middle = (np.cumsum(first) - 1).astype(np.int32)
        last, self.word = np.unique(last, return_inverse=True)
        self.words = vocabulary[last]
        self.count = np.bincount(self.word[self.pair], weights=c, minlength=len(self.words)).astype(np.int64)
        #: keys of the contexts that other parts have too, and which of all contexts these are
        both, one = np.flatnonzero(new), vocabulary[middle[first]]
        self.shared = [np.flatnonzero(np.isin(vocabulary[v[both]], dealt)), np.flatnonzero(np.isin(one, dealt))]
        self.keys = np.concatenate([mix(vocabulary[u[both]] + mix(vocabulary[v[both]] + _GOLD))[self.shared[0]], mix(one ^ _GOLD)[self.shared[1]]])
        self.by_key = np.argsort(self.keys)
        self.t = (c > 0).astype(np.int64)
        self.customers = [np.bincount(self.context, weights=c, minlength=len(both)), None]
        self.other_tables = [np.zeros(len(both)), np.zeros(len(one))]
        self.other_customers = [np.zeros(len(both)), np.zeros(len(one))]
        self._to_parents()
        self.t2 = (self.c2 > 0).astype(np.int64)

    def _to_parents(self) -> None:
        """A table of two words is a customer of the second alone."""
        self.c2 = np.bincount(self.pair, weights=self.t, minlength=self.n_pairs).astype(np.int64)
        self.customers[1] = np.bincount(self.middle, weights=self.c2, minlength=len(self.other_tables[1]))

    def own(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tables and customers of the contexts, here."""
        return [(np.bincount(self.context, weights=self.t, minlength=len(self.other_tables[0])), self.customers[0]), (np.bincount(self.middle, weights=self.t2, minlength=len(self.other_tables[1])), self.customers[1])]

    def told(self) -> tuple[np.ndarray, ...]:
        """Words in order with their customers at the root and their counts; shared contexts in order with tables and customers."""
        served = np.bincount(self.word, weights=self.t2, minlength=len(self.words)).astype(np.int64)
        tables, customers = (np.concatenate([x[i][s] for x, s in zip(self.own(), self.shared, strict=True)]).astype(np.int64)[self.by_key] for i in (0, 1))
        return self.words, served, self.count, self.keys[self.by_key], tables, customers

    def hear(self, tables: np.ndarray, customers: np.ndarray) -> None:
        """Totals over all parts of the shared contexts, in the order of told()."""
        back = np.empty(len(self.keys), np.int64)
        back[self.by_key] = np.arange(len(back))
        n = len(self.shared[0])
        for i, (at, mine) in enumerate(zip(self.shared, self.own(), strict=True)):
            which = back[:n] if i == 0 else back[n:]
            self.other_tables[i][at] = tables[which] - mine[0][at]
            self.other_customers[i][at] = customers[which] - mine[1][at]

    def sweep(self, root: Root) -> None:
        """Every dish of every restaurant: all its customers leave and are seated again, given the rest."""
        (tables, _), (tables2, customers2) = self.own()
        tables, tables2, customers2 = tables + self.other_tables[0], tables2 + self.other_tables[1], customers2 + self.other_customers[1]
        d, theta = WORD
        many = np.flatnonzero(self.c > 1)
        pair, t = self.pair[many], self.t[many]
        left = self.c2[pair] - t
        served = np.minimum(self.t2[pair], left)
        m = self.middle[pair]
        parent = (np.maximum(0, left - d * served) + (theta + d * (tables2[m] - self.t2[pair] + served)) * root.probability(self.word[pair])) / (theta + customers2[m] - t)
        self.t[many] = reseat(self.rng, self.c[many], PAIR[1] + PAIR[0] * (tables[self.context[many]] - t), parent, PAIR[0])
        self._to_parents()
        many = np.flatnonzero(self.c2 > 1)
        t2 = self.t2[many]
        self.t2 = (self.c2 > 0).astype(np.int64)
        self.t2[many] = reseat(self.rng, self.c2[many], theta + d * np.maximum(0, tables2[self.middle[many]] - t2), root.probability(self.word[many], t2), d)

    def probability(self, root: Root) -> np.ndarray:
        """Of each triple, the predictive probability of its last word after the others."""
        (tables, customers), (tables2, customers2) = self.own()
        d, theta = WORD
        p = (self.c2 - d * self.t2 + (theta + d * (tables2 + self.other_tables[1])[self.middle]) * root.probability(self.word)) / (theta + (customers2 + self.other_customers[1])[self.middle])
        d, theta = PAIR
        return (self.c - d * self.t + (theta + d * (tables + self.other_tables[0])[self.context]) * p[self.pair]) / (theta + (customers + self.other_customers[0])[self.context])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


# ---------------------------------------------------------------- texts to triples


def _look_ahead(docs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the book's words in order; their places by frequency; words with more than a quarter of a part's text, in order;
    parts to deal each of these over).

    The counts are those of all words of the texts that are read, however they are dealt; the driver gets BOOK_WORDS rows and one.
    """

    def count(batches):
        held, n = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(-1, h.astype(np.int64))), pa.array(np.append(n, c))], ["h", "n"])

        for b in small(batches):
            data, off = utf8(b.column(0))
            for i, j in chunks(off):
                held.append(word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)[0] >> _CUT)
                n += len(held[-1])
                if n > BLOCK_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    seen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(PEEK)) == 0).select("text").mapInArrow(count, "h long, n long")
    often = seen.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(BOOK_WORDS + 1).toArrow()
    h, n = np.asarray(often["h"].to_numpy()), np.asarray(often["n"].to_numpy())
    total = int(n[h == -1].sum())
    h, n = h[h >= 0].astype(np.uint64), n[h >= 0]
    much = n * (4 * parts) > total  # the first of the book
    order = np.argsort(h)
    return h[order], order.astype(np.uint64), np.flatnonzero(much).astype(np.uint64), -(-n[much] * (4 * parts) // max(1, total)).astype(np.uint64)


def numbered(h: np.ndarray, book: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The numbers that stand for hashes of words from here on."""
    if not len(book):
        return h | _RARE
    at = np.minimum(np.searchsorted(book, h), len(book) - 1)
    return np.where(book[at] == h, place[at], h | _RARE)


def pack_triples(words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Triples of places in words, in order."""
    some, local = np.unique(np.concatenate([v, u, w]), return_inverse=True)
    v, u, w = np.split(local.astype(np.uint32), 3)
    return pack_sorted(words[some]), pack_sorted(v), pack_within(u, changes(v)), pack(w)


def unpack_triples(x: bytes, v: bytes, u: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words in order, v, u, w)."""
    v = unpack_sorted(v, np.uint32)
    return unpack_sorted(x, np.uint64), v, unpack_within(u, changes(v)), unpack(w, np.uint32)


#: Tokens of a block that are looked up at once.
PIECE = 1 << 18


def _block(w: np.ndarray, row: np.ndarray, starts: np.ndarray, train: np.ndarray, parts: int, book: np.ndarray, place: np.ndarray, dealt: np.ndarray, over: np.ndarray):
    """(what the block keeps, the triples that it sends to each part).

    Places and rows are numbers of 32 bits, and each array goes as soon as the next one is there: some 45 bytes a token at once, if the caller
    keeps none of them.
    """
    seen = np.unique(np.append(np.unique(w), START))
    words = numbered(seen, book, place)
    order = np.argsort(words)
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order))
    words, start = words[order], back[np.searchsorted(seen, START)]
    w = np.concatenate([back[np.searchsorted(seen, w[i : i + PIECE])] for i in range(0, len(w), PIECE)])
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], v[starts] = w[:-1], start
    u[1:], u[starts] = v[:-1], start
    part = ranges(words, parts).astype(np.uint16 if parts < 1 << 16 else np.int64)[v]
    if len(dealt):
        at = np.minimum(np.searchsorted(dealt, words), len(dealt) - 1)
        hot = np.where(dealt[at] == words, over[at], np.uint64(1))
        for i in range(0, len(w), PIECE):
            some = np.flatnonzero(hot[v[i : i + PIECE]] > 1) + i
            part[some] = ranges(words[v[some]] + _GOLD * (mix(words[w[some]]) % hot[v[some]] + np.uint64(1)), parts)
    order = order_of(v, u, w, len(words))
    order = order[np.argsort(part[order], kind="stable")]
    v = v[order]
    u = u[order]
    w = w[order]
    part = part[order]
    row = row[order].astype(np.uint32)
    del order
    new = changes(v, u, w)
    at = np.flatnonzero(new)
    c = np.add.reduceat(train[row], at, dtype=np.uint32)
    v = v[at]
    u = u[at]
    w = w[at]
    part = part[at]
    del at
    yield None, pack(row), np.packbits(new).tobytes()
    del row, new
    cut = np.flatnonzero(changes(part))
    for lo, hi in zip(cut, [*cut[1:], len(part)], strict=True):
        s = slice(lo, hi)
        yield int(part[lo]), *pack_triples(words, v[s], u[s], w[s]), pack(c[s])


def _combine(messages: list[tuple]):
    """The distinct triples of messages (words, v, u, w, c), their counts, and of each message the numbers of its own. The list is emptied, so
    that its arrays go one after another."""
    words, v, u, w, c = (list(x) for x in zip(*messages, strict=True))
    messages.clear()
    ends = np.cumsum([len(x) for x in v])[:-1]
    vocabulary = np.unique(np.concatenate(words))
    to = [np.searchsorted(vocabulary, x).astype(np.uint32) for x in words]
    del words
    v = np.concatenate([t[x] for t, x in zip(to, v, strict=True)])
    u = np.concatenate([t[x] for t, x in zip(to, u, strict=True)])
    w = np.concatenate([t[x] for t, x in zip(to, w, strict=True)])
    order = order_of(v, u, w, len(vocabulary))
    new = changes(v[order], u[order], w[order])
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    at = order[new]
    del order, new
    c = np.bincount(number, weights=np.concatenate(c), minlength=len(at)).astype(np.int64)
    return vocabulary, v[at], u[at], w[at], c, np.split(number, ends)


# ---------------------------------------------------------------- the operator


@owned("lm-scores")
def score_texts(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of df.

    score is the log10 probability of the text's words and its end, each probability averaged over the sweeps after burn_in;
    perplexity is its inverse geometric mean. base_score adds 0.1 to each count instead. Null and empty texts are an end only; a row with a
    null id is learned from, and rows that repeat an id or a text are scored and learned from one by one. A word that training lacks has the
    root's share of the uniform base. If nothing can be learned, both scores are those of the uniform base over one
    unknown word. An empty table gives an empty result. A block takes some 45 bytes for each token; a text longer than
    BLOCK_TOKENS is a block.
    """
    held = held_out(id_col) if held is None else held
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, size // PART_BYTES)
    slots = max(1, parts // 4)
    book, place, dealt, over = (spark.sparkContext.broadcast(x) for x in _look_ahead(docs, parts))
    id_type = docs.schema["id"].dataType
    buckets = max(LEAST_PARTS // 2, parts // 2)
    columns = [T.StructField("part", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("held", T.BinaryType()), T.StructField("train", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in "xvuwc"]]
    sent = T.StructType([*columns, T.StructField("block", T.LongType())])
    counted = T.StructType([*columns, T.StructField("blocks", T.ArrayType(T.LongType())), T.StructField("numbers", T.ArrayType(T.BinaryType()))])

    def ask(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(sent)
        block = TaskContext.get().partitionId() << 32
        held: list = []

        def out():
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()

            def taken(k):
                x = np.concatenate(columns[k])
                columns[k].clear()
                return x

            flags, ids, starts = taken(3), pa.concat_arrays(columns[4]), taken(2)
            train = int(np.diff(np.append(starts, n))[~flags].sum())
            rows = []
            for part, *packed in _block(taken(0), taken(1), starts, ~flags, parts, book.value, place.value, dealt.value, over.value):
                if part is None:  # x: the row of each token, v: where triples begin
                    rows.append({"part": -1 - block, "ids": ids, "held": np.packbits(flags).tobytes(), "train": train, **dict(zip("xv", packed, strict=True))})
                else:
                    rows.append({"part": part, "block": block, **dict(zip("xvuwc", packed, strict=True))})
            columns = []
            for f in schema:
                if f.name == "ids":
                    lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids, type=f.type, mask=pa.array(["ids" not in r for r in rows]))
                    columns.append(lists)
                else:
                    columns.append(pa.array([r.get(f.name) for r in rows], f.type))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        n = docs_held = 0
        for b in small(batches):
            data, off = utf8(b.column(1))
            flags = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            for i, j in chunks(off):
                h, count, _ = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                w = np.insert(h >> _CUT, np.cumsum(count), END)
                if held and n + len(w) > BLOCK_TOKENS:
                    yield out()
                    n, docs_held, block = 0, 0, block + 1
                row = np.repeat(np.arange(docs_held, docs_held + j - i, dtype=np.int32), count + 1)
                held.append((w, row, n + np.cumsum(count + 1) - count - 1, flags[i:j], b.column(0).slice(i, j - i)))
                n, docs_held = n + len(w), docs_held + j - i
        if held:
            yield out()
        release()

    def merge(key, rows):
        """The triples of a part from all blocks; what a block keeps stays as it is."""
        if key[0].as_py() < 0:
            return rows.select(["part", "ids", "held", "train", *"xvuwc"]).append_column("blocks", pa.nulls(len(rows), pa.list_(pa.int64()))).append_column("numbers", pa.nulls(len(rows), pa.list_(pa.binary())))

        messages = [(*unpack_triples(*r), unpack(c, np.uint32)) for *r, c in zip(*(rows[n].to_pylist() for n in "xvuwc"), strict=True)]
        vocabulary, v, u, w, c, numbers = _combine(messages)
        packed = (*pack_triples(vocabulary, v, u, w), pack(c))
        blocks = pa.array([rows["block"].to_pylist()], pa.list_(pa.int64())), pa.array([[pack_sorted(x) for x in numbers]], pa.list_(pa.binary()))
        release()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.nulls(1, rows.schema.field(n).type) for n in ("ids", "held", "train")], *[pa.array([x], pa.binary()) for x in packed], *blocks], names=[f.name for f in counted])

    merged = docs.mapInArrow(ask, sent).repartition(buckets, "part").groupBy("part").applyInArrow(merge, counted)
    merged = materialize_dealt(merged, "lm-counts", "part", buckets)
    free(spark)
    kept, counts = merged.filter("part < 0"), merged.filter("part >= 0")
    n_train = kept.agg(F.sum("train")).first()[0] or 0

    def load(part: int, x: bytes, v: bytes, u: bytes, w: bytes, c: bytes) -> Part:
        return Part(*unpack_triples(x, v, u, w), unpack(c, np.int64), dealt.value, part)

    def tell(number: int, p: Part) -> pa.Table:
        """Words go to slots from 0 on, shared contexts to those from `slots` on."""
        out = []
        words, served, count, keys, tables, customers = p.told()
        for first, k, a, b in ((0, words, served, count), (slots, keys, tables, customers)):
            slot = ranges(k, slots)
            order = np.argsort(slot, kind="stable")
            cut = np.searchsorted(slot[order], np.arange(slots + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                piece = order[cut[s] : cut[s + 1]]
                out.append((number, first + s, pack_sorted(k[piece]), pack(a[piece]), pack(b[piece])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "slot", "x", "a", "b"])

    def hear(p: Part, rows: pa.Table, sums: tuple) -> Root:
        """The root for the part, which also hears of its shared contexts and of its words' counts in all training."""
        got = sorted(zip(*(rows[x].to_pylist() for x in ("slot", "a", "b")), strict=True))
        both = []
        for keys, mine in ((p.words, [g for g in got if g[0] < slots]), (p.keys[p.by_key], [g for g in got if g[0] >= slots])):
            order = np.argsort(ranges(keys, slots), kind="stable")
            for k in (1, 2):
                both.append(np.zeros(len(keys), np.int64))
                both[-1][order] = np.concatenate([np.zeros(0, np.int64), *[unpack(g[k], np.int64) for g in mine]])
        p.hear(both[2], both[3])
        p.counts = both[1]
        return Root(both[0], *sums)

    def first_telling(key, rows):
        out = tell(key[0].as_py(), load(key[0].as_py(), *(rows[x][0].as_py() for x in "xvuwc")))
        release()
        return out

    def add(key, rows):
        """Totals of a slot's keys, for every part that told of them; of words also how many have so many customers at the root."""
        slot, told = key[0].as_py(), rows["part"].to_pylist()
        x = [unpack_sorted(v, np.uint64) for v in rows["x"].to_pylist()]
        keys, at = np.unique(np.concatenate(x), return_inverse=True)
        a, b = (np.bincount(at, weights=np.concatenate([unpack(v, np.int64) for v in rows[n].to_pylist()]), minlength=len(keys)).astype(np.int64) for n in "ab")
        ends = np.cumsum([len(v) for v in x])[:-1]
        back = [[pack(v) for v in np.split(y[at], ends)] for y in (a, b)]
        at = np.searchsorted(GRID, a, side="right") - 1
        n, c = (np.bincount(at, weights=w, minlength=len(GRID)) if slot < slots else np.zeros(len(GRID)) for w in (a > 0, a))
        release()
        rest = [None] * (len(told) - 1)
        return pa.table([pa.array(told, pa.int64()), pa.array([slot] * len(told), pa.int32()), *[pa.array(v, pa.binary()) for v in back], *[pa.array([x.astype(np.int64).tolist(), *rest], pa.list_(pa.int64())) for x in (n, c)]], names=["part", "slot", "a", "b", "words", "customers"])

    heard = "part long, slot int, a binary, b binary, words array<long>, customers array<long>"

    def sums_of(totals: DataFrame) -> tuple:
        """(customers, known words, tables by customers, all tables) of the root; GRID has a few hundred numbers at any size."""
        rows = totals.select(F.posexplode(F.arrays_zip("words", "customers"))).groupBy("pos").agg(F.sum("col.words").alias("n"), F.sum("col.customers").alias("c")).filter("n > 0").collect()
        n, c = np.array([r.n for r in rows], float), np.array([r.c for r in rows], float)
        return (int(c.sum()), int(n.sum()), *(seat_root(c / n, n) if len(n) else (np.zeros(len(GRID)), 0.0)))

    message = "part long, slot int, x binary, a binary, b binary"
    first = materialize(counts.select("part", *"xvuwc").groupBy("part").applyInArrow(first_telling, message).groupBy("slot").applyInArrow(add, heard), "lm-totals")
    sums = sums_of(first)

    def state(key, rows, history, sums) -> Part:
        """The part after its first sweeps; the same whenever it is computed."""
        p = load(key[0].as_py(), *(rows[x][0].as_py() for x in "xvuwc"))
        root = hear(p, history, sums)
        for _ in range(burn_in):
            p.sweep(root)
        return p

    def second_telling(key, rows, history):
        out = tell(key[0].as_py(), state(key, rows, history, sums))
        release()
        return out

    told = counts.select("part", *"xvuwc").groupBy("part").cogroup(first.groupBy("part")).applyInArrow(second_telling, message)
    second = materialize(told.groupBy("slot").applyInArrow(add, heard), "lm-totals")
    last = sums_of(second)
    free(spark)

    def answer(key, rows, history):
        n = np.asarray(history["round"].to_numpy())
        p = state(key, rows, history.filter(pa.array(n == 1)), sums)
        root = hear(p, history.filter(pa.array(n == 2)), last)
        mean = np.zeros(len(p.c))
        for _ in range(burn_in, sweeps):
            p.sweep(root)
            mean += p.probability(root)
        logs, count = np.log10(mean / (sweeps - burn_in)).astype(np.float32), p.counts[p.word[p.pair]]
        blocks, out = rows["blocks"][0].as_py(), [[], []]
        for number in rows["numbers"][0].as_py():
            i = unpack_sorted(number, np.uint32)
            out[0].append(pack(logs[i]))
            out[1].append(pack(count[i]))
        release()
        return pa.table([pa.array([-1 - b for b in blocks], pa.int64()), pa.array([key[0].as_py()] * len(blocks), pa.int64()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["part", "from", "p", "n"])

    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))).select("part", "slot", "a", "b", "round")
    answers = counts.drop("ids", "held", "train").groupBy("part").cogroup(both.groupBy("part")).applyInArrow(answer, "part long, from long, p binary, n binary")
    known = last[1]
    schema = docs.select(F.col("id").alias(id_col), F.col("held").alias("held_out")).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("perplexity", "double")):
        schema = schema.add(name, kind)
    names = schema.names

    def score(key, block, rows):
        rows = rows.sort_by("from")
        ids = block["ids"].combine_chunks().flatten()
        row = unpack(block["x"][0].as_py(), np.uint32)
        new = np.unpackbits(np.frombuffer(block["v"][0].as_py(), np.uint8), count=len(row))
        flags = np.unpackbits(np.frombuffer(block["held"][0].as_py(), np.uint8), count=len(ids)).astype(bool)
        triple = np.cumsum(new, dtype=np.int64) - 1
        p = np.concatenate([unpack(x, np.float32) for x in rows["p"].to_pylist()]).astype(float)
        count = np.concatenate([unpack(x, np.int64) for x in rows["n"].to_pylist()])
        base = np.log10((count + 0.1) / (n_train + 0.1 * (known + 1)))
        total = [np.bincount(row, weights=None if x is None else x[triple], minlength=len(ids)) for x in (None, (count > 0).astype(float), base, p)]
        whole = [x.astype(np.int64) for x in total[:2]]
        release()
        return pa.table([ids, pa.array(flags), pa.array(whole[0]), pa.array(whole[1]), pa.array(np.full(len(ids), n_train)), pa.array(total[2]), pa.array(total[3]), pa.array(10 ** (-total[3] / total[0]))], names=names)

    return kept.select("part", "ids", "held", "x", "v").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, schema)
