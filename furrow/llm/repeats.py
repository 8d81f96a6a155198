"""Removal of byte strings that occur more than once, by suffix arrays over aligned passages.

Every string of ``SPAN`` bytes has an anchor: the leftmost of its ``CORE``-byte stretches with the smallest
hash. Equal strings have equal anchors at equal distances, so strings meet only others with their anchor. The
strings of one document around one anchor form a passage. A passage that occurs again as a whole is a repeat;
where passages with one anchor differ, they are written in the symbols of the columns in which they
differ, and the suffix array of all of them (``suffix_groups``) tells which of their strings they share.

Passages are compared by 64-bit hashes, and only one of each kind that needs sorting carries its bytes.
Anchors with more than ``LIMIT`` different passages are split by the place of the anchor in the string, so
that no group of bytes grows with the data and none is left out. Texts are shuffled only where a bit table of
fixed size says that a repeat may be in them.

Defined results: null is the empty text; a text shorter than ``SPAN`` bytes keeps all; rows with one doc_id,
null or not, are documents of their own; a document that repeats another is removed whole; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.suffix_groups import suffix_array
from furrow.llm.words import mix, power_tables, text_slices
from furrow.session import scratch_path

SPAN, CORE = 200, 64
SHIFTS = SPAN - CORE  # an anchor starts 0 to SHIFTS bytes behind the start of its string
LIMIT = 4096  # passages with one anchor that are sorted together
SYMBOLS = 1 << 17  # sorted together, about
BITS = 1 << 23  # of the table that tells which texts to shuffle

_PLACE = 20  # bits of a position in a slice
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _hashes(data: np.ndarray) -> np.ndarray:
    """Sums before each byte, from which the hash of any stretch follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power_tables(len(data))[0][:len(data)], out=sums[1:])
    return sums


def _stretch(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((sums[hi] - sums[lo]) * power_tables(len(sums))[1][lo] + (hi - lo).astype(np.uint64))


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, position, first and last string start, anchor hash and passage hash of each anchor."""
    sums = _hashes(data)
    at = np.arange(len(data) - CORE + 1)
    hashed = _stretch(sums, at, at + CORE)
    low = np.uint64((1 << _PLACE) - 1)
    least, width = (hashed & ~low) | at.astype(np.uint64), 1
    while 2 * width <= SHIFTS + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = SHIFTS + 1 - width
    least = np.minimum(least[:len(least) - rest], least[rest:])
    anchor = (least & low).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = np.flatnonzero(start + SPAN <= offsets[row + 1])
    anchor, row = anchor[inside], row[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    pos, lo, hi = anchor[first], inside[first], inside[last]
    return row[first], pos, lo, hi, hashed[pos], _stretch(sums, lo, hi + SPAN)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    room = (1 << _PLACE) - 1
    for batch in batches:
        ids = batch.column("text_id").to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in text_slices(batch.column("text"), room):
            # a text longer than a slice goes in pieces that share SPAN - 1 bytes
            pieces = [(0, data, offsets)] if len(data) <= room else [
                (c, data[c:c + room], np.array([0, min(room, len(data) - c)])) for c in range(0, len(data) - SPAN + 1, room - SPAN + 1)
            ]
            for shift, part, bounds in pieces:
                if len(part) < SPAN:
                    continue
                row, pos, first, last, anchor, passage = _anchors(part, bounds)
                placed = ((pos - bounds[row] + shift) << 16) | ((pos - first) << 8) | (pos - last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(passage.view(np.int64)), pa.array(ids[lo + row]), pa.array(placed)],
                    names=["anchor", "passage", "text_id", "placed"],
                )


# the anchor's position, and how far before it the first and the last string of its passage start
def _pos() -> Column:
    return F.shiftright("placed", 16)


def _before() -> Column:
    return F.shiftright("placed", 8).bitwiseAND(F.lit(255))


def _after() -> Column:
    return F.col("placed").bitwiseAND(F.lit(255))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted passages of each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for i, wanted in enumerate(batch.column("wanted")):
            data = texts[i].as_buffer()
            view, rows = memoryview(data), wanted.as_py()
            for lo in range(0, len(rows), 4096):
                part = rows[lo:lo + 4096]
                cut = [(w["placed"] >> 16, (w["placed"] >> 8) & 255, w["placed"] & 255) for w in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([w["anchor"] for w in part], pa.int64()), pa.array([w["anchor"] for w in part], pa.int64()),
                    pa.array([w["passage"] for w in part], pa.int64()),
                    pa.array([b for _, b, _ in cut], pa.int32()), pa.array([a for _, _, a in cut], pa.int32()),
                    pa.array([bytes(view[p - b:p - a + SPAN]) for p, b, a in cut], pa.binary()),
                ], names=["group", "anchor", "passage", "before", "after", "bytes"])


_PASSAGE = "group bigint, anchor bigint, passage bigint, before int, after int, bytes binary"
_SHARED = "anchor bigint, passage bigint, lo int, hi int"


def _symbols(before: np.ndarray, after: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Column bounds of the blocks of one group, and its symbols: passages x blocks, -1 outside a passage.

    Neighbouring columns that tell the same passages apart form one block; a symbol names the first passage
    with the same bytes there.
    """
    most = int(before.max())
    table = np.full((len(texts), most + SPAN - int(after.min())), 256, np.int16)
    for i, text in enumerate(texts):
        lo = most - before[i]
        table[i, lo:lo + len(text)] = np.frombuffer(text, np.uint8)
    order = np.argsort(table, axis=0, kind="stable")
    ranked = np.take_along_axis(table, order, 0)
    starts = np.vstack((np.ones((1, table.shape[1]), bool), ranked[1:] != ranked[:-1]))
    leaders = np.take_along_axis(order, np.maximum.accumulate(np.where(starts, np.arange(len(texts))[:, None], 0), axis=0), 0)
    classes = np.empty_like(leaders)
    np.put_along_axis(classes, order, leaders, 0)
    cuts = np.flatnonzero((classes[:, 1:] != classes[:, :-1]).any(0) | ((table[:, 1:] == 256) != (table[:, :-1] == 256)).any(0)) + 1
    bounds = np.concatenate(([0], cuts, [table.shape[1]]))
    symbols = np.where(table[:, bounds[:-1]] == 256, -1, classes[:, bounds[:-1]])
    return bounds - most, symbols


def shared_starts(groups: list[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> Iterator[tuple[int, int, int, int]]:
    """``group, passage, lo, hi``: starts, relative to the anchor, of strings that another passage has too."""
    parts, spots, names, separators, base = [], [], [], 0, 0
    for g, (before, after, texts) in enumerate(groups):
        bounds, symbols = _symbols(before, after, texts)
        blocks = symbols.shape[1]
        named = np.where(symbols < 0, -1, symbols * blocks + np.arange(blocks) + base)
        base += blocks * len(texts)
        for i in range(len(texts)):
            inside = np.flatnonzero(named[i] >= 0)
            parts.append(np.append(named[i, inside], -1 - separators))  # a separator occurs once
            spots.append(np.append(inside, -1))
            names.append((g, i, len(inside) + 1))
            separators += 1
        groups[g] = (before, after, bounds)
    text = np.concatenate(parts) + separators
    at = np.concatenate(spots)
    owner = np.repeat(np.arange(len(names)), [n for _, _, n in names])
    order = suffix_array(text)
    # common prefixes of neighbours, counted in blocks; separators end them
    common, open_ = np.zeros(len(order) + 1, np.int64), np.arange(1, len(order))
    while len(open_):
        a, b = order[open_ - 1] + common[open_], order[open_] + common[open_]
        fits = np.maximum(a, b) < len(text)
        open_, a, b = open_[fits], a[fits], b[fits]
        open_ = open_[text[a] == text[b]]
        common[open_] += 1
    longest = np.zeros(len(text), np.int64)
    longest[order] = np.maximum(common[:-1], common[1:])
    for spot in np.flatnonzero((longest > 0) & (at >= 0)).tolist():
        g, i, _ = names[owner[spot]]
        before, after, bounds = groups[g]
        block = at[spot]
        lo = max(int(bounds[block]), -int(before[i]))
        hi = min(int(bounds[block + 1]) - 1, -int(after[i]), int(bounds[block + longest[spot]]) - SPAN)
        if lo <= hi:
            yield g, i, lo, hi


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are sorted together, about ``SYMBOLS`` at a time."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        groups, rows, i = [], [], 0
        while i < len(held):
            j = i
            while j < len(held) and held[j][0] == held[i][0]:
                j += 1
            if j - i > 1:
                groups.append((np.array([r[3] for r in held[i:j]]), np.array([r[4] for r in held[i:j]]), [r[5] for r in held[i:j]]))
                rows.append(i)
            i = j
        found = [(held[rows[g] + i][1], held[rows[g] + i][2], lo, hi) for g, i, lo, hi in shared_starts(groups)] if groups else []
        return pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], pa.int64() if c < 2 else pa.int32()) for c in range(4)], names=["anchor", "passage", "lo", "hi"]
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if len(held) * 12 >= SYMBOLS and row[0] != held[-1][0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split passages by how far before the anchor a string starts: at most or more than the middle.

    The new group is named by all bytes that the strings of its range have in common.
    """
    for batch in batches:
        out = []
        for group, anchor, passage, before, after, text, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = (least + most) // 2
            for lo, hi in ((least, middle), (middle + 1, most)):
                b, a = min(before, hi), max(after, lo)
                if a <= b:
                    part = text[before - b:before - a + SPAN]
                    # from lo bytes before the anchor to the end of a string that starts hi before it
                    common = part[b - lo:b + SPAN - hi]
                    key = hashlib.blake2b(b"%d %d %d " % (group, lo, hi) + common, digest_size=8).digest()
                    out.append((int.from_bytes(key, "little", signed=True), anchor, passage, b, a, part, lo, hi))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[c] for o in out], f.type) for c, f in enumerate(batch.schema)], names=batch.schema.names
        )


def _shared(passages: DataFrame, limit: int) -> DataFrame:
    """Shared starts of all passages; groups beyond ``limit`` are halved until they are small or all alike."""
    rows = passages.withColumns({"least": F.lit(0), "most": F.lit(SHIFTS)})
    found = []
    while True:
        large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("group")
        done = large.isEmpty()
        small = rows if done else rows.join(large, "group", "left_anti")
        found.append(small.drop("least", "most").repartition("group").sortWithinPartitions("group").mapInArrow(_sort_groups, _SHARED))
        if done:
            break
        halves = _stored(rows.join(large, "group", "left_semi").select(*rows.columns).mapInArrow(_halve, rows.schema), "passages")
        # passages of one string each are alike within a group
        single = halves.filter("least = most")
        several = single.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
        found.append(single.join(several, "group").select("anchor", "passage", (-F.col("before")).alias("lo"), (-F.col("after")).alias("hi")))
        rows = halves.filter("least < most")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """A written copy in the shared folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``_maybe``: false where ``text_id`` is certainly not among the keys. The table has BITS bits."""
    bit = F.xxhash64("text_id").bitwiseAND(F.lit(BITS - 1))
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
    table = keys.select(F.shiftright(bit, 6).alias("_word"), own.alias("_set"))
    table = table.groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    # BITS / 64 rows at most
    marked = rows.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(table), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce("_set", F.lit(0)).bitwiseAND(own) != 0).drop("_word", "_set")


def repeated_ranges(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``text_id, ranges``: first and last starts of repeated strings of the texts that have any."""
    found = texts.filter(F.octet_length("text") >= SPAN).mapInArrow(_anchor_rows, "anchor bigint, passage bigint, text_id bigint, placed bigint")
    several = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    met = _stored(found.join(several, "anchor"), "anchors")
    kinds = _stored(met.groupBy("anchor", "passage").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "placed")).alias("one")
    ), "kinds")
    differing = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    wanted = kinds.join(differing.select("anchor"), "anchor").select("anchor", "passage", "one.*")
    wanted = wanted.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "passage", "placed")).alias("wanted"))
    sources = _maybe(texts, wanted).filter("_maybe").select("text_id", "text").dropDuplicates(["text_id"])
    passages = _stored(sources.join(wanted, "text_id").mapInArrow(_passages, _PASSAGE), "passages")
    marks = kinds.filter("n > 1").select("anchor", "passage", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    marks = marks.unionByName(_shared(passages, limit).join(kinds.filter("n = 1").select("anchor", "passage"), ["anchor", "passage"]))
    lo, hi = F.coalesce("lo", -_before()), F.coalesce("hi", -_after())
    return met.join(marks, ["anchor", "passage"]).select("text_id", F.struct((_pos() + lo).alias("lo"), (_pos() + hi).alias("hi")).alias("range")).groupBy(
        "text_id"
    ).agg(F.collect_set("range").alias("ranges"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column("text").cast(pa.large_binary()), []
        ranges = batch.column("ranges")
        for i in range(batch.num_rows):
            data = np.frombuffer(texts[i].as_buffer(), np.uint8) if len(texts[i].as_buffer()) else np.zeros(0, np.uint8)
            depth = np.zeros(len(data) + 1, np.int64)
            if ranges[i].is_valid:
                flat = ranges[i].values
                np.add.at(depth, flat.field("lo").to_numpy(), 1)
                np.add.at(depth, flat.field("hi").to_numpy() + SPAN, -1)
            gone = np.cumsum(depth[:-1]) > 0
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[:1].sum()))
            kept = data[~gone].tobytes()
            out.append((len(data), int(gone.sum()), spans, kept))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
            pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.binary()),
        ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: each text without its repeated bytes."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_id", F.xxhash64("text"))
    ranges = _stored(repeated_ranges(texts, limit), "ranges")
    marked = _maybe(texts, ranges.select("text_id"))
    whole = marked.filter(~F.col("_maybe")).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.col("text").cast("binary").alias("kept"),
    )
    cut = marked.filter("_maybe").join(ranges, "text_id", "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    return whole.unionByName(cut)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
