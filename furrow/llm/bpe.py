"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded by itself. Its bytes are the leaves of a segment tree that holds
the leftmost smallest rank among neighbouring pairs; a merge changes at most three leaves, each in
logarithmic time, so a run of n bytes takes O(n log n) however long it is. The trees of short matches are rows
of numpy tables and are worked on together. Encodings of short matches are remembered by a worker, up to
about ``REMEMBERED`` of them at a time.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens' strings are
ordinary text; repeated rows give repeated results; other columns pass through ``encode`` unless they
are called ``ids``, ``n_tokens`` or ``decoded``, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.arrays import unused

RANKS = "byte_bpe_50k.tiktoken"
REMEMBERED, SHORT = 200_000, 64
# Texts of more characters are split and hashed this many matches at a time.
LONG, STEP = 1 << 20, 1 << 16
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the leftmost pair of smallest rank until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the part that starts here ends
    least = [_NONE] * width + [ranks.get(piece[i:i + 2], _NONE) for i in range(n - 1)] + [_NONE] * (width - n + 1)
    for i in range(width - 1, 0, -1):
        a, b = least[2 * i], least[2 * i + 1]
        least[i] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        i += width
        least[i] = rank
        while i > 1:
            i //= 2
            a, b = least[2 * i], least[2 * i + 1]
            low = a if a <= b else b
            if least[i] == low:
                break
            least[i] = low

    while least[1] < _NONE:
        low, i = least[1], 1
        while i < width:
            i *= 2
            if least[i] != low:
                i += 1
        i -= width
        gone = after[i]
        end[i] = end[gone]
        after[i] = after[gone]
        put(gone, _NONE)
        if after[i] < n:
            before[after[i]] = i
            put(i, ranks.get(piece[i:end[after[i]]], _NONE))
        else:
            put(i, _NONE)
        if before[i] >= 0:
            put(before[i], ranks.get(piece[before[i]:end[i]], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = after[i]
    return ids


class PairTable:
    """Rank of the token that two neighbouring tokens make, looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)


def merge_many(pieces: list[bytes], pair: PairTable) -> list[list[int]]:
    """``merge_pairs`` for many short matches: their segment trees are rows of one table and grow together."""
    lengths = np.array([len(p) for p in pieces])
    width = 1 << int(lengths.max() - 1).bit_length() if len(pieces) else 1
    rows, places = len(pieces), np.arange(width)
    held = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    alive = places < lengths[:, None]
    ids = np.where(alive, pair.bytes[held], -1)
    ids = np.hstack((ids, np.full((rows, 1), -1)))  # nothing stands behind the last part
    after = np.broadcast_to(places + 1, (rows, width)).copy()
    after[after >= lengths[:, None]] = width
    before = np.broadcast_to(np.arange(width + 1) - 1, (rows, width + 1)).copy()
    least = np.full((rows, 2 * width), _NONE)
    least[:, width:] = pair(ids[:, :width], np.take_along_axis(ids, after, 1))
    level = width
    while level > 1:
        below = least[:, level:2 * level]
        level //= 2
        least[:, level:2 * level] = np.minimum(below[:, 0::2], below[:, 1::2])
    open_ = np.flatnonzero(least[:, 1] < _NONE)
    while len(open_):
        low, at = least[open_, 1], np.ones(len(open_), np.int64)
        while at[0] < width:
            at *= 2
            at += least[open_, at] != low
        at -= width
        gone = after[open_, at]
        behind = after[open_, gone]
        ids[open_, at] = low
        alive[open_, gone] = False
        ids[open_, gone] = -1
        after[open_, at] = behind
        before[open_, behind] = at
        ahead = before[open_, at]
        least[open_, width + gone] = _NONE
        least[open_, width + at] = pair(low, ids[open_, behind])
        first = ahead >= 0
        least[open_[first], width + ahead[first]] = pair(ids[open_[first], ahead[first]], low[first])
        changed = [(open_, width + gone), (open_, width + at), (open_[first], width + ahead[first])]
        size = width
        while size > 1:
            changed = [(r, n >> 1) for r, n in changed]
            for r, n in changed:
                least[r, n] = np.minimum(least[r, 2 * n], least[r, 2 * n + 1])
            size //= 2
        open_ = open_[least[open_, 1] < _NONE]
    flat, ends = ids[:, :width][alive].tolist(), np.cumsum(alive.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec:
    """Encoder and decoder of one rank file, with the matches it remembers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pair = PairTable(self.ranks)
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def entry(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal each with a space after it, and their bytes decoded from the ids."""
        return len(ids), (" ".join(map(str, ids)) + " ").encode(), b"".join([self.tokens[i] for i in ids])

    def learn(self, matches: set[str]) -> None:
        """Encode matches that are not remembered yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        by_width: dict[int, list[str]] = {}
        for m in matches - self.known.keys():
            data = m.encode()
            if data in self.ranks or len(data) > SHORT:
                self.known[m] = self.entry(merge_pairs(data, self.ranks))
            else:
                by_width.setdefault((len(data) - 1).bit_length(), []).append(m)
        for same in by_width.values():
            for lo in range(0, len(same), 4096):
                part = same[lo:lo + 4096]
                for m, ids in zip(part, merge_many([m.encode() for m in part], self.pair), strict=True):
                    self.known[m] = self.entry(ids)

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, bytes, bytes]]]]:
        """Row and encodings of the matches of its text; a long text comes in several parts."""
        held: list[tuple[int, list[str]]] = []
        waiting = 0

        def done() -> Iterator[tuple[int, list[tuple[int, bytes, bytes]]]]:
            self.learn(set().union(*[found for _, found in held]))
            known = self.known
            for row, found in held:
                yield row, [known[m] for m in found]
            for m in [m for _, found in held for m in found if len(m) > SHORT]:
                known.pop(m, None)
            held.clear()

        for row, text in enumerate(texts):
            matches = iter(self.split.findall(text)) if len(text) <= LONG else (m[0] for m in self.split.finditer(text))
            while found := list(islice(matches, STEP)):
                held.append((row, found))
                waiting += len(found)
                if waiting >= STEP:
                    yield from done()
                    waiting = 0
        yield from done()


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """The codec of this worker process, with what earlier tasks left in its memory."""
    return Codec(path, pattern)


def _run(docs: DataFrame, path: str, pattern: str, added: T.StructType, rows_of) -> DataFrame:
    """Add columns computed by ``rows_of(codec, texts)`` to each document, in one pass."""
    names = added.fieldNames()
    kept = docs.drop(*names)
    hidden = unused(kept, "_text")
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType)
             else pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = rows_of(codec, [text or "" for text in part.column(hidden).to_pylist()])
                rest = part.drop_columns([hidden])
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=[*rest.schema.names, *names]
                )

    schema = T.StructType([*kept.schema.fields, *added.fields])
    return kept.withColumn(hidden, F.col("text").cast("string")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``n_tokens``, the ``ids`` of each whole text, and ``decoded``: the bytes they stand for."""
    def rows_of(codec: Codec, texts: list[str]) -> list[tuple[int, np.ndarray, bytes]]:
        ids: list[list[bytes]] = [[] for _ in texts]
        back: list[list[bytes]] = [[] for _ in texts]
        for row, found in codec.pieces(texts):
            ids[row] += [f[1] for f in found]
            back[row] += [f[2] for f in found]
        made = []
        for own, token_bytes in zip(ids, back, strict=True):
            numbers = np.array(b"".join(own).split(), np.int32)
            made.append((len(numbers), numbers, b"".join(token_bytes)))
        return made

    return _run(docs, path, pattern, T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()),
    ]), rows_of)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the same encodings, hashed as they are made."""
    def rows_of(codec: Codec, texts: list[str]) -> list[tuple[int, str, str]]:
        made = [[0, hashlib.sha256(), hashlib.sha256(), b""] for _ in texts]
        for row, found in codec.pieces(texts):
            own = made[row]
            written = own[3] + b"".join([f[1] for f in found])
            own[0] += sum([f[0] for f in found])
            own[1].update(written[:-1])
            own[2].update(b"".join([f[2] for f in found]))
            own[3] = written[-1:]
        return [(n, ids.hexdigest(), back.hexdigest()) for n, ids, back, _ in made]

    return _run(docs.select("doc_id", "text"), path, pattern, T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ]), rows_of).drop("text")
