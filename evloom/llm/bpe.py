"""BPE encoding and decoding by dynamic programming over prefixes.

Byte-pair encoding gives every prefix of a word exactly one last token: the token t at whose start the shorter prefix
ends in a token p such that (p, t), encoded by itself, stays (p, t). A suffix automaton of the vocabulary lists the
tokens that end at a position; a test of the pair picks the one; back-pointers then give the ids.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, trim, unused

#: Lower-case ASCII words, other words, and other pieces of words, whose ids a Python worker remembers, in two generations: when the younger is
#: full, the older is forgotten. A plain word is its own and only piece, so it is held once.
CACHE_PLAIN, CACHE_WORDS, CACHE_PIECES = 60_000, 60_000, 40_000
#: Pairs of tokens whose test a worker remembers.
CACHE_PAIRS = 250_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: bytes that print stand for
    themselves, the others take the code points from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    """What a tokenizer file says, as flat data that can be broadcast; its size is the file's, not the corpus's.

    Reads byte-level BPE files with an end-of-word suffix, the normalizer NFC, white space to one space, lower case,
    and a pre-tokenizer that keeps the matches of one pattern.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model = raw["model"]
        known = [x.get("type") for x in (raw["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in (raw["pre_tokenizer"] or {}).get("pretokenizers", [])][:1] == ["Split"]
        if not known:
            raise ValueError(f"{path} normalizes or splits texts in another way than this encoder does")
        self.suffix = model["end_of_word_suffix"] or ""
        self.pattern = raw["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in raw["added_tokens"]}
        self.token = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        vocab = model["vocab"]
        # Ranks by the two tokens, as one number; by token the rank of its merge, -1 for none, and its parts: flat, as each worker has a copy
        self.merges: dict[int, int] = {}
        self.rank, self.left, self.right = (array("i", [-1]) * (1 + max(self.token)) for _ in range(3))
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x << 32 | y] = rank
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        letters = byte_letters()
        self.symbol = [vocab[c] for c in letters]
        self.last_symbol = [vocab[c + self.suffix] for c in letters]

    def spelled(self, token: int) -> list[int]:
        """The symbols that a token is merged from."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if self.rank[t] >= 0:
                todo += self.right[t], self.left[t]
            else:
                out.append(t)
        return out


class SuffixAutomaton:
    """Of all tokens' symbol strings. state -> {symbol: state}; the tokens that are suffixes of a state's strings, longest first."""

    def __init__(self, words: dict[int, list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, int] = {}
        for token, w in words.items():
            last = 0
            for c in w:
                last = self._extend(last, c)
            own[last] = token
        # A state made by cloning later may be the one that holds a whole token: walk again
        own.clear()
        for token, w in words.items():
            s = 0
            for c in w:
                s = self.next[s][c]
            own[s] = token
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.own = own
        self.tokens: list[tuple] = [()] * len(order)
        for s in order[1:]:
            below = self.tokens[self.link[s]]
            self.tokens[s] = ((own[s], self.length[s]), *below) if s in own else below

    def _new(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        k = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        s = self._new(self.length[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = s
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[s] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return s


_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        symbols = {*vocab.symbol, *vocab.last_symbol}
        self.automaton = SuffixAutomaton({t: vocab.spelled(t) for t in [*symbols, *(t for t, rank in enumerate(vocab.rank) if rank >= 0)]})
        self.split = regex.compile(vocab.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None
        self.space = regex.compile(r"\s+")
        self.plain: dict[str, bytes] = {}
        self.old_plain: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: array) -> list[tuple[int, int]]:
        """(part, rank of the merge that swallows it) for the parts at one edge of a token, the whole token first."""
        out, until, rank = [], 1 << 60, self.v.rank
        while True:
            out.append((token, until))
            if rank[token] < 0:
                return out
            until = rank[token]
            token = side[token]

    def stays(self, p: int, t: int) -> bool:
        """Whether no merge across the boundary comes before the merges that build p and t.

        Merges go by rank, and of equal ranks the left one first: so at the left token's edge a merge must come
        strictly earlier to happen, at the right token's edge no later.
        """
        merges = self.v.merges
        right = self._edge(t, self.v.left)
        for a, a_until in self._edge(p, self.v.right):
            for b, b_until in right:
                m = merges.get(a << 32 | b)
                if m is not None and m < a_until and m <= b_until:
                    return False
        return True

    def piece(self, s: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit numbers."""
        data = s.encode("utf-8", "replace")
        symbol = self.v.symbol
        symbols = [symbol[b] for b in data]
        symbols[-1] = self.v.last_symbol[data[-1]]
        auto, pairs = self.automaton, self.pairs
        nxt, link, length, own, tokens = auto.next, auto.link, auto.length, auto.own, auto.tokens
        token, start = [0], [0]  # by prefix: its last token, and where that begins
        state = matched = i = 0
        for c in symbols:
            i += 1
            to = nxt[state].get(c)
            while to is None:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            state = to
            matched += 1
            found = tokens[state]
            if matched < length[state] and state in own:
                found = found[1:]
            for t, n in found:
                if n == i:
                    token.append(t)
                    start.append(0)
                    break
                key = token[i - n] << 32 | t
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.stays(token[i - n], t)
                if ok:
                    token.append(t)
                    start.append(i - n)
                    break
        out = []
        while i:
            out.append(token[i])
            i = start[i]
        return _PACK[len(out)](*out[::-1]) if len(out) < len(_PACK) else np.array(out[::-1], "<u4").tobytes()

    def _letters(self, x: str) -> bytes:
        """Ids of a pre-token of lower-case ASCII letters."""
        ids = self.plain.get(x)
        if ids is None:
            if len(self.plain) >= CACHE_PLAIN:
                self.old_plain, self.plain = self.plain, {}
            ids = self.old_plain.get(x)
            if ids is None:
                ids = self.piece(x)
            if len(x) <= 64:
                self.plain[x] = ids
        return ids

    def _plain(self, s: str) -> bytes:
        s = "".join(c.lower() for c in unicodedata.normalize("NFC", s)) if not s.isascii() else s.lower()
        if s.isalpha() and s.isascii():
            return self._letters(s)
        out: list[bytes] = []
        for x in self.split.findall(s):
            if x.isalpha() and x.isascii():
                out.append(self._letters(x))
                continue
            ids = self.pieces.get(x)
            if ids is None:
                if len(self.pieces) >= CACHE_PIECES:
                    self.old_pieces, self.pieces = self.pieces, {}
                ids = self.old_pieces.get(x)
                if ids is None:
                    ids = self.piece(x)
                if len(x) <= 64:
                    self.pieces[x] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _word(self, w: str) -> bytes:
        """Ids of a stretch without white space, as little-endian 32-bit numbers; special tokens stand for themselves."""
        if self.special and "<|" in w:
            return b"".join(_PACK[1](self.v.special[x]) if k % 2 else self._plain(x) for k, x in enumerate(self.special.split(w)) if x)
        return self._plain(w)

    def encode(self, text: str) -> bytes:
        plain, words, old, out = self.plain, self.words, self.old_words, []
        # str.split() also cuts at four control characters, which are no white space to the pattern
        cut = text.split() if text.isprintable() or not regex.search(r"[\x1c-\x1f]", text) else [x for x in self.space.split(text) if x]
        for w in cut:
            ids = plain.get(w)
            if ids is None:
                ids = words.get(w)
            if ids is None and w.isascii() and w.isalpha() and w.islower():
                ids = self._letters(w)
                plain = self.plain
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    self.old_words, self.words = old, words = words, {}
                ids = old.get(w)
                if ids is None:
                    ids = self._word(w)
                    plain = self.plain
                if len(w) <= 64:
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def forget_old(self) -> None:
        """Between tasks a worker keeps one generation: other operators may use it next."""
        self.old_plain, self.old_words, self.old_pieces = {}, {}, {}

    def decode(self, ids: bytes) -> str:
        """The library's decoding where the file names no decoder: the tokens, joined by spaces."""
        token = self.v.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ENCODERS: dict[int, Encoder] = {}
KEPT.append(_ENCODERS)


def _encoder(shared) -> Encoder:
    """One for each worker process; kept between tasks, until another operator's."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        trim()  # of what other operators' tasks left
        _ENCODERS[shared.id] = Encoder(shared.value)
        gc.freeze()  # the automaton's many small objects never go: no need to look at them again
    return _ENCODERS[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else id(broadcast)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def encode(spark: SparkSession, df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df's id (or the columns keep) with ids (array of int, if wanted), n_tokens, ids_sha256 and decoded_sha256.

    Null texts are taken as empty and have no ids. Whole texts are encoded, row by row, without a shuffle; what a worker
    remembers is bounded by CACHE_PLAIN, CACHE_WORDS, CACHE_PIECES and CACHE_PAIRS. The path is read on the driver only; the vocabulary, of the
    file's size, is broadcast.
    """
    shared = _Shared(spark.sparkContext.broadcast(Vocabulary(tokenizer_path)))
    keep = [id_col] if keep is None else keep
    rows = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias(unused(df, "__text")[0]))
    schema = rows.select(*keep).schema
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if ids else schema
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def work(batches):
        enc = _encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [enc.encode(t or "") for t in part.column(len(keep)).to_pylist()]
                out = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in got], pa.list_(pa.int32()))] if ids else []
                out += [pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()), pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], names=schema.names)
        enc.forget_old()
        trim()

    return rows.mapInArrow(work, schema)


def decode(spark: SparkSession, df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with the text of its ids; null ids give null."""
    token = spark.sparkContext.broadcast(Vocabulary(tokenizer_path).token)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        t = token.value
        return pa.array([None if x is None else " ".join([t[i] for i in x]) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out_col, text(ids_col))
