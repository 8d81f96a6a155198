"""Pack token sequences by harmonic classes, each worker for itself.

A document is its ids and an end mark. It is cut into pieces whose lengths belong to reciprocal classes of
the capacity C: class k holds lengths above C/(k+1) and up to C/k, and a bin of class k is full with k pieces.
While a piece of ``WHOLE`` ids or more is left, the largest C, C/2, C/4, ... that fits is cut off, so these bins
are full to the last id. What is left below ``WHOLE`` stays whole in its class; its bins are padded by less than
C mod k pieces' length (about 1 % of such bins, which hold the short ends alone).

A worker packs the rows of its partition alone and nothing is shuffled. Open bins at its end (at most k - 1
pieces a class) are laid one after the other, longest pieces first, and cut at C; the last sequence is cut into
sequences of powers of two, which need no padding. So a partition, a table of one document or a hot source
never leaves a sequence that is nearly empty.

Defined results: a null or empty text is its end mark alone; strings of special tokens are ordinary text;
repeated rows and rows without a doc_id are documents of their own; an empty table gives no rows; only
doc_id and text are read. Sequence ids hold the number of the partition in the upper bits.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END, WHOLE = 2048, 1, 64
KNOWN = 1 << 18  # words held with their ids
LONG = 48  # bytes; longer words are not held
PART = 1 << 20  # characters split into words at a time
ROWS = 1 << 14  # pieces of a result batch
_PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# Words of these characters alone have a simple lower case, need no normal form and are cut by one pattern.
_ODD = re.compile("[^!-~À-ÖØ-öø-įı-ſ\n]")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\n|[^a-z0-9ß-öø-ſ\n]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it can be seen, else the next one above U+00FF."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer never joins characters over white space, so a text's ids are those of its words one after
    the other, and each different word is encoded once. Words of common characters are cut into pieces here, and
    only pieces that are new go to the tokenizer's merges; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.merges = models.BPE(
            vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes | None] = {"\n": None}

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        made = [token.id for token in self.merges.tokenize(shown)]
        ids = struct.pack(f"<{len(made)}I", *made)
        if len(piece) <= LONG:
            self.pieces[piece] = ids
        return ids

    def _simple(self, words: list[bytes], text: str) -> dict[bytes, bytes]:
        """Ids of words that ``text`` holds, each ended by a line feed."""
        if len(self.pieces) > KNOWN:
            self.pieces = {"\n": None}
        found, own, nth, known = {}, [], 0, self.pieces
        for piece in _PIECES.findall(text.lower()):
            ids = known[piece] if piece in known else self._piece(piece)
            if ids is None:
                found[words[nth]] = b"".join(own)
                own, nth = [], nth + 1
            else:
                own.append(ids)
        return found

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        asked = list(words)
        text = b"\n".join([*asked, b""]).decode()
        odd = []
        if _ODD.search(text):
            odd = [w for w in asked if _ODD.search(w.decode())]
            asked = list(words.difference(odd))
            text = b"\n".join([*asked, b""]).decode()
        found = self._simple(asked, text) if asked else {}
        for lo in range(0, len(odd), 4096):
            part = odd[lo:lo + 4096]
            for word, made in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                found[word] = np.array(made.ids, "<u4").tobytes()
        return found

    def _words(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            new = set(words).difference(self.known)
        if len(self.known) > KNOWN:
            self.known = {}
            new = set(words)
        found = self._learn(new)
        self.known.update(found)
        made = b"".join(map(self.known.__getitem__, words))
        for word in found:
            if len(word) > LONG:
                del self.known[word]
        return made

    def encode(self, text: bytes) -> bytes:
        if len(text) <= PART:
            return self._words(text.split())
        made, lo = [], 0
        while lo < len(text):
            gap = _SPACE.search(text, min(lo + PART, len(text)))
            hi = gap.start() if gap else len(text)
            made.append(self._words(text[lo:hi].split()))
            lo = hi
        return b"".join(made)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def piece_lengths(tokens: int, capacity: int = CAPACITY, whole: int = WHOLE) -> list[int]:
    """How a document is cut: whole sequences, then halves, quarters, ..., then the rest below ``whole``."""
    cut = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity >> 1
    while rest >= whole and size:
        if size <= rest:
            cut.append(size)
            rest -= size
        size >>= 1
    if rest:
        cut.append(rest)
    return cut


class Bins:
    """The open bins of one worker, one a class, and the pieces that are finished."""

    def __init__(self, first: int, capacity: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) >> 2
            self.done.append((doc_id, start, n, ids, tokens, self.next, at))
            at += n
        self.next += 1

    def add(self, piece: tuple) -> None:
        """Put ``doc_id, start, ids, doc_tokens`` into its class; a bin of class k closes with k pieces."""
        k = self.capacity // (len(piece[2]) >> 2)
        if k == 1:
            self._close([piece])
            return
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            self._close(held)

    def finish(self) -> None:
        """Lay the open bins one after the other; the last sequence becomes sequences of powers of two."""
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p[2]))
        self.open = {}
        total = sum(len(p[2]) >> 2 for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        pieces = iter(left)
        piece = None
        for size in sizes:
            held = []
            while size:
                doc_id, start, ids, tokens = piece or next(pieces)
                n = min(size, len(ids) >> 2)
                held.append((doc_id, start, ids[:4 * n], tokens))
                piece = (doc_id, start + n, ids[4 * n:], tokens) if 4 * n < len(ids) else None
                size -= n
            self._close(held)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        while len(self.done) >= least:
            part, self.done = self.done[:ROWS], self.done[ROWS:]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, whole: int = WHOLE) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id"), texts, strict=True):
                ids = encoder.encode(text.as_py() or b"") + end
                tokens, start = len(ids) >> 2, 0
                for n in piece_lengths(tokens, capacity, whole):
                    bins.add((doc_id.as_py(), start, ids[4 * start:4 * (start + n)], tokens))
                    start += n
                yield from bins.batches(ROWS)
        bins.finish()
        yield from bins.batches()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)


def report(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece."""
    return pack(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
