"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

The words of a text are numbered and its suffixes sorted by prefix doubling; the ranks of every doubling step
are kept, so that the common length of two suffixes is found by going down the steps. Suffixes that share
exactly q words form an interval of the suffix array, split into parts by their next word. Of each interval all
parts but the largest are gone through: a suffix i with i + q (or i - q) in the same interval but another part,
which the inverse suffix array tells, is the last square of period q of a run. No tree is built, and a suffix is in the
smaller part at most log2(n) times. The square is then rotated to the left to the start of its run, and squares
that lie in a run of a smaller period and end with it are multiples of that period.

Several documents are sorted together, each closed by a mark of its own, so no run crosses documents. Memory is
4 bytes a word and doubling step for ``SLICE`` words, or for the longest text where that is longer.

Defined results: null, empty and blank texts have no words and no runs; words are compared as bytes, with case;
repeated rows give repeated results; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 18  # words sorted together
LEAST, TIMES = 6, 4  # a run has at least 6 words and 4 periods
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ROW = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def doubled_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until they differ.

    The last symbol of each text must occur once. Equal ranks mean equal prefixes.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate(([True], symbols[order[1:]] != symbols[order[:-1]])) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    steps, width = [rank], 1
    single = np.append(new[1:], True) & new if n else new
    open_ = order[~single]
    while len(open_):
        old = steps[-1]
        key = old[open_].astype(np.int64) * n + old[open_ + width]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = old[open_]
        at = np.arange(len(open_))
        starts = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.concatenate(([True], group[1:] != group[:-1]))
        rank = old.copy()
        # a suffix stands as far into its old group as its new one begins there
        rank[open_] = group + np.maximum.accumulate(np.where(starts, at, 0)) - np.maximum.accumulate(np.where(heads, at, 0))
        steps.append(rank)
        width *= 2
        open_ = open_[~(starts & np.append(starts[1:], True))]
    return steps


def common_lengths(steps: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and at ``b`` (never the same) have in common at their starts."""
    a, b = a.copy(), b.copy()
    start = a.copy()
    for k in range(len(steps) - 1, -1, -1):
        same = np.flatnonzero(steps[k][a] == steps[k][b])
        a[same] += 1 << k
        b[same] += 1 << k
    return a - start


def _bounds(lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each entry the last smaller one before it and the next smaller one after it."""
    n = len(lcp)
    before, after = [0] * n, [n] * n
    stack: list[int] = []
    for r, v in enumerate(lcp):
        while stack and lcp[stack[-1]] > v:
            after[stack.pop()] = r
        # of equal entries all share the bounds; the last one stays on the stack for them
        if stack and lcp[stack[-1]] == v:
            before[r] = before[stack[-1]]
        elif stack:
            before[r] = stack[-1]
        stack.append(r)
    return before, after


def branching_squares(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares whose two halves share exactly the period with what follows."""
    place = steps[-1].astype(np.int64)
    n = len(place)
    none = np.zeros(0, np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[place] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = common_lengths(steps, suffixes[:-1], suffixes[1:])
    inner = np.flatnonzero(lcp)
    if not len(inner):
        return none, none
    before, after = (np.array(x, np.int64) for x in _bounds(lcp.tolist()))
    lo, hi, depth = before[inner], after[inner], lcp[inner]  # the interval is lo .. hi - 1
    # its parts: up to the first split, between splits, and from the last split on
    by = np.lexsort((inner, depth, lo))
    inner, lo, hi, depth = inner[by], lo[by], hi[by], depth[by]
    head = np.concatenate(([True], (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])))
    tail = np.append(head[1:], True)
    interval = np.cumsum(head) - 1
    part_lo = np.concatenate((lo[head], inner))
    part_hi = np.concatenate((inner[head], np.where(tail, hi, np.append(inner[1:], 0))))
    owner = np.concatenate((np.arange(interval[-1] + 1), interval))
    by = np.lexsort((part_lo, owner))
    part_lo, part_hi, owner = part_lo[by], part_hi[by], owner[by]
    size = part_hi - part_lo
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    largest = np.zeros(len(size), bool)
    most = np.repeat(np.maximum.reduceat(size, firsts), np.diff(np.append(firsts, len(size))))
    ties = np.flatnonzero(size == most)
    largest[ties[np.concatenate(([True], owner[ties][1:] != owner[ties][:-1]))]] = True
    own_lo, own_hi, own_depth = lo[head], hi[head], depth[head]
    small = np.flatnonzero(~largest)
    starts, periods = [none], [none]
    # the suffixes of the smaller parts, a bounded number of them at a time
    ends = np.cumsum(size[small])
    cuts = [0, *np.searchsorted(ends, np.arange(SLICE, int(ends[-1]) if len(ends) else 0, SLICE)).tolist(), len(small)]
    for c, d in zip(cuts[:-1], cuts[1:], strict=True):
        parts = small[c:d]
        count = size[parts]
        part = np.repeat(parts, count)
        rank = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + part_lo[part]
        q = own_depth[owner[part]]
        i = suffixes[rank]
        for shift in (q, -q):
            other = i + shift
            inside = np.flatnonzero((other >= 0) & (other < n))
            r = place[other[inside]]
            p = part[inside]
            met = (r >= own_lo[owner[p]]) & (r < own_hi[owner[p]]) & ((r < part_lo[p]) | (r >= part_hi[p]))
            inside = inside[met]
            starts.append(np.minimum(i[inside], other[inside]))
            periods.append(q[inside])
    return np.concatenate(starts), np.concatenate(periods)


def _first_of_run(symbols: np.ndarray, at: int, period: int, least: int) -> int:
    """The square at ``at`` rotated to the left as far as words a period apart are identical."""
    width = 64
    while at > least:
        lo = max(least, at - width)
        differ = np.flatnonzero(symbols[lo:at] != symbols[lo + period:at + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        at, width = lo, 2 * width
    return at


def find_runs(words: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each text, given as word numbers; by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    if not len(sizes):
        return found
    ends = np.cumsum(sizes)
    top = max((int(w.max()) for w in words if len(w)), default=0) + 1
    symbols = np.empty(int(ends[-1]), np.int64)
    for row, w in enumerate(words):
        # a text has symbols of its own, so that suffixes of different texts share nothing
        symbols[ends[row] - sizes[row]:ends[row] - 1] = w + row * (top + 1)
        symbols[ends[row] - 1] = row * (top + 1) + top
    steps = doubled_ranks(symbols)
    start, period = branching_squares(steps)
    row = np.searchsorted(ends, start, "right")
    end = start + 2 * period
    first = end - np.maximum(least, times * period)  # where a run that is long enough has begun
    able = np.flatnonzero(first >= ends[row] - sizes[row])
    start, period, row, end, first = start[able], period[able], row[able], end[able], first[able]
    long = np.flatnonzero((common_lengths(steps, first, first + period) >= end - first - period) & (end - first >= 2 * period))
    pairs = np.unique(np.stack((end[long], period[long]), 1), axis=0)
    last, begun = -1, []
    for e, q in pairs.tolist():
        if e != last:
            last, begun = e, []
        # a square inside a run of a smaller period that ends here has a multiple of that period
        if any(e - 2 * q >= s for s in begun):
            continue
        own = int(np.searchsorted(ends, e - 1, "right"))
        base = int(ends[own] - sizes[own])
        s = _first_of_run(symbols, e - 2 * q, q, base)
        begun.append(s)
        found[own].append((s - base, e - s, q))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = find_runs([numbers for _, _, numbers in rows])
        collapsed = []
        for (_, words, _), runs in zip(rows, found, strict=True):
            if runs:
                words = [w for w, keep in zip(words, _kept(len(words), runs).tolist(), strict=True) if keep]
            collapsed.append(b" ".join(words).decode())
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array(named, pa.list_(_RUN)), pa.array(collapsed, pa.string()),
        ], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        held, total = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            words = (text.as_py() or b"").split()
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            if held and total + len(words) > SLICE:
                yield flush(held)
                held, total = [], 0
            held.append((doc_id, words, ids))
            total += len(words) + 1
        if held:
            yield flush(held)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each text, and its words without their repetitions."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_collapse, _ROW)


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document by crc32 of its id goes on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    g = F.floor(h / 10).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("words", F.when(h % 10 == 0, words_of(F.col("text"))))
    n = F.size("words").cast("bigint")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("bigint"))
    place = F.when(F.col("a") > 0, F.slice("words", F.lit(1), F.col("a").cast("int"))).otherwise(F.slice("words", F.lit(1), F.lit(0)))
    again = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.col("words")[(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")])
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(place, again), " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of each document after ``planted``."""
    found = collapse_runs(planted(docs))

    def better(best: Column, run: Column) -> Column:
        # exponents as exact fractions; runs come by start, then period, so the first of equals stays
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    whole = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", F.aggregate("runs", none, better))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(whole, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
