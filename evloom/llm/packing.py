"""Packing of documents' tokens into sequences: minimum bin slack by a bitset subset-sum.

Whole stretches of a sequence's width are sequences of their own. What remains of each document waits in a window; each sequence takes
the longest remainder and, of the multiset of the others, the lengths whose sum comes closest to the room that is left. Only what no
sum can fill is cut from a further remainder, so nothing is padded and few documents are cut.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _Shared, byte_letters
from .common import chunks

#: Remainders that wait for partners in a task; the longer they wait, the fewer are cut. Each has fewer ids than a sequence.
WINDOW = 4096
#: Stretches between blanks whose ids a worker remembers, in two generations.
CACHE_PIECES = 400_000
# The pre-tokenizer of byte-level files, and the pattern that it stands for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded at once, or one text if it is longer: each distinct piece of them is looked up once.
ENCODE_BYTES = 4 << 20
#: Marks the key of a piece that has no blank before it.
FIRST = "\0"
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


# ---------------------------------------------------------------- ids


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them for a byte-level file, remembered by piece.

    The pattern of such files takes white space only at the start of a match, so nothing joins what lies before a blank with the blank:
    texts are cut before each run of blanks and newlines, and each piece is encoded once, by the faster tiktoken from the same file's
    vocabulary where its letters are old ones that both libraries know alike. Texts with other white space or with a special token's string
    are encoded whole by tokenizers.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        raw = json.loads(file)
        special = [x["content"] for x in raw["added_tokens"]]
        self.odd = re.compile("|".join([r"[^\S \n]", *map(re.escape, special)])).search
        vocab = raw["model"]["vocab"]
        value = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(value[c] for c in s): i for s, i in vocab.items() if s not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in raw["model"]["merges"]]
        ordered = made == sorted(made) and raw["pre_tokenizer"] == BYTE_LEVEL and not raw["normalizer"]  # ids stand for the order of merges
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary if ordered else None
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes by id
        for x, i in ranks.items():
            self.size[i] = len(x)
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, x: str) -> bytes | None:
        """None where a text that has the piece must be encoded whole."""
        if self.odd(x):
            return None
        return array("I", self.fast(x)).tobytes() if x.isascii() or max(x) < "\u0250" else self._whole(x)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that end in no blank are encoded in one call, one after another, and told apart by their bytes."""
        text = [p[1:] if p[:1] == FIRST else p if p[:1] == "\n" else " " + p for p in pieces]
        joined = [(p, x) for p, x in zip(pieces, text, strict=True) if p[:1] != FIRST and len(x) > 1]
        every = "".join([x for _, x in joined])
        if joined and not self.odd(every) and (every.isascii() or max(every) < "\u0250"):
            ids = np.array(self.fast(every), np.uint32)
            ends = np.cumsum([len(x.encode()) for _, x in joined])
            at = [0, *(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()]
            raw = ids.astype("<u4").tobytes()
            self.known.update((p, raw[4 * i : 4 * j]) for (p, _), i, j in zip(joined, at, at[1:], strict=False))
        for p, x in zip(pieces, text, strict=True):
            if p not in self.known:
                self.known[p] = self._piece(x)

    def _of(self, pieces: list[str]) -> list[bytes | None]:
        if len(self.known) > CACHE_PIECES:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = [p for p in pieces if p not in known]
        if old:
            known.update((p, old[p]) for p in new if p in old)
            new = [p for p in new if p not in known]
        for at in range(0, len(new), 1000):
            self._learn(new[at : at + 1000])
        return [known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each of some texts, of which none is null."""
        if self.fast is None:
            yield from map(self._whole, texts.to_pylist())
            return
        # without runs of blanks a text is cut in one go, and the blank before a piece is no part of its key
        runs = pc.match_substring_regex(texts, r"  |\n\n| \n|\n |\x00")
        cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), ""), " ")
        pieces = cut.flatten().dictionary_encode()
        ids = pa.array(self._of(pieces.dictionary.to_pylist()), pa.binary()).take(pieces.indices)
        off = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        whole = np.asarray(runs)
        if ids.null_count:
            whole = whole | (np.add.reduceat(np.asarray(ids.is_null()).astype(np.int64), off[:-1]) > 0)
        at = np.frombuffer(ids.buffers()[1], np.int32)[off].tolist()
        flat = ids.buffers()[2].to_pybytes()
        for i, w in enumerate(whole.tolist()):
            yield self._runs(texts[i].as_py()) if w else flat[at[i] : at[i + 1]]

    def _runs(self, text: str) -> bytes:
        """Of a text with longer runs of white space."""
        pieces = [] if FIRST in text else self._of([FIRST + p for p in _PIECE.findall(text)])
        return b"".join(pieces) if pieces and None not in pieces else self._whole(text)


# ---------------------------------------------------------------- filling


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """Of a multiset of lengths (counts by length) one whose sum is as near to room as possible from below: {length: how many}.

    One bit for each sum that can be reached. Lengths come in longest first, each up to as many times as it is there; once room itself is
    reached no further ones are looked at. Going back, a length is taken until the sum was reachable without it.
    """
    full = (1 << room + 1) - 1
    reach, used = [1], []
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        now, left, step = reach[-1], min(int(counts[n]), room // n), 1
        while left:
            take = min(step, left)
            now |= now << take * n & full
            left, step = left - take, step * 2
        reach.append(now)
        used.append(n)
        if now >> room & 1:
            break
    at, out = reach[-1].bit_length() - 1, {}
    for n, before in zip(reversed(used), reversed(reach[:-1]), strict=True):
        k = 0
        while not before >> at & 1:
            at, k = at - n, k + 1
        if k:
            out[n] = k
    return out


class Packer:
    """Remainders that wait, by length, and the sequences made of them; a remainder is (document, its tokens, start, ids)."""

    def __init__(self, width: int, first: int):
        self.width, self.next = width, first
        self.waiting: list[list[tuple]] = [[] for _ in range(width)]
        self.counts = np.zeros(width, np.int64)
        self.n = self.total = 0

    def add(self, doc, tokens: int, ids: bytes) -> Iterator[tuple]:
        """Pieces of the document's own sequences; the rest waits."""
        whole = len(ids) // 4 // self.width * self.width
        for start in range(0, whole, self.width):
            yield self._piece((doc, tokens, start, ids[4 * start : 4 * (start + self.width)]), 0)
            self.next += 1
        if len(ids) > 4 * whole:
            self._wait((doc, tokens, whole, ids[4 * whole :]))

    def _wait(self, item: tuple) -> None:
        n = len(item[3]) // 4
        self.waiting[n].append(item)
        self.counts[n] += 1
        self.n, self.total = self.n + 1, self.total + n

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.n, self.total = self.n - 1, self.total - n
        return self.waiting[n].pop()

    def _piece(self, item: tuple, offset: int) -> tuple:
        doc, tokens, start, ids = item
        return doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, offset, ids

    def _longest(self) -> int:
        return int(np.flatnonzero(self.counts)[-1])

    def sequence(self, width: int) -> Iterator[tuple]:
        """Pieces of one full sequence; at least so many tokens must wait."""
        n, at = self._longest(), 0
        if n <= width:
            items = [self._take(n)]
            for k, times in fill(self.counts, width - n).items():
                items += [self._take(k) for _ in range(times)]
            for item in items:
                yield self._piece(item, at)
                at += len(item[3]) // 4
        if at < width:  # every other remainder is longer than what is missing
            doc, tokens, start, ids = self._take(self._longest())
            cut = width - at
            yield self._piece((doc, tokens, start, ids[: 4 * cut]), at)
            self._wait((doc, tokens, start + cut, ids[4 * cut :]))
        self.next += 1

    def pack(self, most: int) -> Iterator[tuple]:
        """Full sequences until no more than so many remainders wait."""
        while self.n > most and self.total >= self.width:
            yield from self.sequence(self.width)

    def end(self) -> Iterator[tuple]:
        """All that waits; what is less than a sequence becomes sequences of powers of two, which need no padding."""
        yield from self.pack(0)
        while self.total:
            yield from self.sequence(1 << self.total.bit_length() - 1)


def pack(spark: SparkSession, df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1, ids: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids array<int>) for each piece of df's documents.

    A document's tokens are its text's ids and end_id; doc_tokens counts them. Every token lies in one piece: tokens start to start + length
    of the document are those from offset on of the sequence. Sequences are full but for the last few of a task, whose lengths are powers of two.
    Null and empty texts are end_id alone; rows that repeat an id or a text, and rows without an id, are packed one by one; other columns
    are not looked at; an empty table gives an empty result. A task reads its rows once, without a shuffle, and holds WINDOW remainders and
    one document's ids. Sequence ids come from the number of the partition: a task that runs again makes the same ones.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = _Shared(spark.sparkContext.broadcast(f.read()))
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema[0]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    last = np.array([end_id], "<u4").tobytes()

    def work(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        encoder = _encoder(shared)
        packer = Packer(width, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*held, strict=True)]
            if ids:
                columns[7] = [np.frombuffer(x, "<i4") for x in columns[7]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns[: len(made)], made, strict=True)], schema=made)

        for b in batches:
            texts = b.column(1).fill_null("")
            for at, to in chunks(np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]), ENCODE_BYTES):
                docs = b.column(0).slice(at, to - at).to_pylist()
                for doc, x in zip(docs, encoder.encode(texts.slice(at, to - at)), strict=True):
                    held.extend(packer.add(doc, len(x) // 4 + 1, x + last))
                    if len(held) >= 2048:
                        yield out()
                if packer.n > WINDOW:
                    held.extend(packer.pack(WINDOW // 2))
        held.extend(packer.end())
        if held:
            yield out()

    return rows.mapInArrow(work, schema)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: _Shared) -> Encoder:
    """One for each worker process; kept between tasks."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]
