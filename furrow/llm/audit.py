"""Audit of filters in every order: what each removes, repeats or removes alone, per source.

A document gets one bit per filter it fails. The duplicate filter looks at whole texts over the whole table:
texts are dealt out by adaptive prefixes (``PREFIXES`` bytes long; the first length that at most ``limit`` documents
share, else the whole text), each prefix being one range of texts. Within a range the whole texts go into a compressed
radix trie whose terminals hold the smallest id; a walk over the trie flags the rows above it. Copies within a
batch of input rows are decided there, so only one row of them travels with its text, and no group of copies
meets in one task. Masks are then reduced to counts per source, at most 32 of them, from which all 120 orders follow.

Bounds: ``limit`` is raised with the table so that at most ``HEAVY`` prefixes of each length are broadcast; a trie
holds one range, a task one trie at a time.

Defined results: a null text is empty; a null source is the part ''; a null doc_id is no smaller than any and
fails E never; rows that repeat the smallest doc_id of a text do not fail E; repeated rows count each; a label counts if any
row of ``labels`` for the doc_id has it; no document, no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import cut

LETTERS = "ABCDE"
PREFIXES = (8, 64, 512, 4096, 32768)
LIMIT = 512  # documents that may share a prefix
HEAVY = 1 << 17
MIN_WORDS, DISTINCT, UPPER = 50, 65, 5
SPECIAL = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SPREAD = 0x9E3779B97F4A7C15
_OPEN = "key bigint, has_id boolean, source string, mask int, n bigint, text binary, bucket bigint"
_DONE = "key bigint, has_id boolean, source string, mask int, n bigint"


def own_mask(text: bytes, chars: int) -> int:
    """Bits of the filters A to D, which look at one text alone."""
    words = text.split()
    mask = 1 if len(words) < MIN_WORDS else 0
    if 100 * len(set(words)) < DISTINCT * len(words):
        mask |= 2
    if 100 * (len(text) - len(text.translate(None, _UPPER))) > UPPER * chars:
        mask |= 4
    if any(c in text for c in SPECIAL):
        mask |= 8
    return mask


class Node:
    __slots__ = ("label", "children", "rows", "least")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.rows: list[tuple] | None = None
        self.least = 0


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` and ``b`` from ``at`` on have in common."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if a[lo:middle] == b[at + lo:at + middle]:
            lo = middle
        else:
            hi = middle - 1
    return lo


def insert(root: Node, text: bytes, row: tuple) -> None:
    """Put a row, whose first entry is its id, at the terminal of its text."""
    node, at = root, 0
    while at < len(text):
        child = node.children.get(text[at])
        if child is None:
            child = Node(text[at:])
            node.children[text[at]] = child
        elif not text.startswith(child.label, at):
            k = _shared(child.label, text, at)
            upper = Node(child.label[:k])
            child.label = child.label[k:]
            upper.children[child.label[0]] = child
            node.children[text[at]] = upper
            child = upper
        node = child
        at += len(child.label)
    if node.rows is None:
        node.rows, node.least = [row], row[0]
    else:
        node.rows.append(row)
        node.least = min(node.least, row[0])


def flagged(root: Node) -> Iterator[tuple]:
    """All rows of a trie; those above the smallest id of their text get the bit of E."""
    open_ = [root]
    while open_:
        node = open_.pop()
        for key, source, mask, n in node.rows or ():
            yield key, True, source, mask | 16 if key > node.least else mask, n
        open_.extend(node.children.values())


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own masks, and the copies within a batch; rows that are still open keep their text."""
    count = 0
    for batch in batches:
        ids, texts, sources, buckets = (batch.column(c).to_pylist() for c in ("doc_id", "text", "source", "bucket"))
        masks: dict[str, int] = {}
        least: dict[str, int] = {}
        for doc_id, text in zip(ids, texts, strict=True):
            if text not in masks:
                masks[text] = own_mask(text.encode(), len(text))
            if doc_id is not None and doc_id < least.get(text, doc_id + 1):
                least[text] = doc_id
        open_: dict[tuple, list] = {}
        out = []
        for i, (doc_id, text, source) in enumerate(zip(ids, texts, sources, strict=True)):
            if doc_id is None:
                count += 1
                out.append((count, False, source, masks[text], 1, None, (count * _SPREAD) % (1 << 63)))
            elif doc_id > least[text]:
                out.append((doc_id, True, source, masks[text] | 16, 1, None, (doc_id * _SPREAD) % (1 << 63)))
            elif (text, source) in open_:
                open_[text, source][4] += 1
            else:
                open_[text, source] = [doc_id, True, source, masks[text], 1, text.encode(), buckets[i]]
        out += open_.values()
        kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], names=["key", "has_id", "source", "mask", "n", "text", "bucket"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: a trie for each bucket; rows without a text pass."""
    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["key", "has_id", "source", "mask", "n"])

    root, current, out = Node(b""), None, []
    for batch in batches:
        for key, has_id, source, mask, n, text, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None:
                out.append((key, has_id, source, mask, n))
                continue
            if bucket != current:
                out += flagged(root)
                root, current = Node(b""), bucket
            insert(root, text, (key, source, mask, n))
        if len(out) >= 4096:
            yield made(out)
            out = []
    out += flagged(root)
    yield made(out)


def _with_bucket(rows: DataFrame, limit: int) -> DataFrame:
    """Add ``bucket``: a hash of the shortest prefix that few documents share, else of the whole text."""
    data = F.col("text").cast("binary")
    hashes = [F.xxhash64(F.lit(n), F.substring(data, 1, n)) for n in PREFIXES]
    limit = max(limit, -(-rows.count() // HEAVY))
    counted = rows.select(F.explode(F.array(*hashes)).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    # at most HEAVY prefixes of each length
    heavy = cut(counted.filter(F.col("n") > limit).select("prefix"))
    bucket = F.xxhash64(F.lit(0), data)
    placed = rows
    for i, h in reversed(list(enumerate(hashes))):
        found = F.broadcast(heavy.select(F.col("prefix").alias(f"_h{i}"), F.lit(True).alias(f"_heavy{i}")))
        placed = placed.withColumn(f"_h{i}", h).join(found, f"_h{i}", "left")
        bucket = F.when(F.col(f"_heavy{i}").isNull(), F.col(f"_h{i}")).otherwise(bucket)
    return placed.select(*rows.columns, bucket.alias("bucket"))


def failures(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``key, has_id, source, mask, n``: documents with the bits of the filters they fail (A is 1, E is 16).

    ``key`` is the doc_id where ``has_id``; ``n`` rows are alike.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    marked = _with_bucket(rows, limit).mapInArrow(_mark, _OPEN)
    return marked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_walk, _DONE)


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows a source."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    ).withColumn("has_id", F.lit(True))
    return failed.join(known, ["key", "has_id"], "left").groupBy(F.col("source").alias("part"), "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )


def interactions(counted: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its counts by mask."""
    orders = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")).withColumn("filter_order", F.lit(""))
    for _ in LETTERS:
        rest = F.filter(F.array(*map(F.lit, LETTERS)), lambda x: ~F.contains(F.col("filter_order"), x))
        orders = orders.withColumn("_letter", F.explode(rest)).withColumn("filter_order", F.concat("filter_order", "_letter"))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    place = {x: F.instr("filter_order", x) for x in LETTERS}
    earlier, own = F.lit(0), F.lit(0)
    for i, x in enumerate(LETTERS):
        earlier = earlier + F.when(place[x] < F.col("step"), 1 << i).otherwise(0)
        own = own + F.when(place[x] == F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumns({"_earlier": earlier, "_own": own})

    def total(what: str, keep) -> Column:
        rows = F.filter("masks", lambda m: keep(m["mask"]))
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, m: acc + m[what])

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("_own")) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("_earlier")) != 0

    # over all orders, each of the filters that a document fails comes first equally often
    times = F.array(*[F.lit(120 // k) for k in range(1, len(LETTERS) + 1)])
    share = F.aggregate(
        F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("bigint"),
        lambda acc, m: acc + m["n"] * F.element_at(times, F.bit_count(m["mask"])),
    )
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == F.col("_own")).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"), total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per part, order of the filters and step."""
    return interactions(counts(failures(docs, limit), labels))


def sql() -> str:
    """The same for DuckDB over ``documents`` and ``labels``."""
    words = r"list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    bits = " + ".join(f"CASE WHEN {{0}} LIKE '%{x}%' THEN {1 << i} ELSE 0 END" for i, x in enumerate(LETTERS))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS part FROM documents),
split AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY body) AS least FROM texts),
masked AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {UPPER} * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM split
),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM masked LEFT JOIN known USING (doc_id) GROUP BY part, mask
),
letters AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (
  SELECT filter_order, step, {bits.format('substring(filter_order, 1, step - 1)')} AS earlier, {bits.format('substring(filter_order, step, 1)')} AS own
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
first AS (
  SELECT part, own, sum(n) AS shapley FROM counted, steps WHERE mask & own <> 0 AND mask & earlier = 0 GROUP BY part, own
)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (mask & (earlier | s.own) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & s.own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & s.own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = s.own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & s.own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & s.own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(any_value(shapley), 0)::BIGINT AS shapley
FROM counted CROSS JOIN steps s LEFT JOIN first USING (part, own) GROUP BY part, filter_order, step
""".strip()
