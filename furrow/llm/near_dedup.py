"""Near-duplicate documents by b-bit MinHash.

Rows with one shingle set form a node. Bands of minima propose pairs, packed low bits of the minima
estimate their similarity with the chance agreements taken off, and full shingle sets confirm it.

No group is expanded into all its pairs. Sets that cannot link with any set of their bucket leave it first, by
exact bounds on what they share. Each node is then compared with its buckets' leader, the node with the least
of its own, and with a leader of another component; only nodes that this leaves in different components meet each
other, inside a join that keeps the pairs whose bounds and estimate are high enough. So every proposed link between different components is
tested, and components are those of the whole link graph.

Defined results: null or empty texts, and texts without words, have an empty set and no links; a null
doc_id takes no part in links and is its own group (component_id null, kept true); rows that repeat a doc_id share
its node if their sets are equal; ties go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import mix, shingles, text_slices, word_hashes
from furrow.operators.graph import components
from furrow.session import cut

WORDS = 5
MINIMA = 128  # two bits of each are packed into four longs
LANES = MINIMA // 32
# 25 bands of 5 minima propose a pair of similarity 0.85 but for 4e-7, of 0.8 but for 5e-5.
ROWS = 5
BANDS = MINIMA // ROWS
# An estimate from 128 minima has a standard deviation of at most 0.04 here; five of them are allowed for.
MARGIN = 0.2

_draw = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTOR, _SHIFT = _draw[:MINIMA] | np.uint64(1), _draw[MINIMA:]
_SIGNATURE = "doc_id bigint, text_hash bigint, n_shingles bigint, set_id bigint, " + ", ".join(
    f"low{i} bigint" for i in range(LANES)
) + ", bands array<bigint>"


def _minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``MINIMA`` x rows; every row must have a shingle."""
    out = np.empty((MINIMA, len(bounds) - 1), np.uint64)
    for j in range(MINIMA):
        out[j] = np.minimum.reduceat(sets * _FACTOR[j] + _SHIFT[j], bounds[:-1])
    return out


def _packed(minima: np.ndarray) -> list[np.ndarray]:
    """The two low bits of each mixed minimum, 32 to a long."""
    low = mix(minima) & np.uint64(3)
    packed = []
    for lane in range(LANES):
        word = np.zeros(minima.shape[1], np.uint64)
        for j in range(32):
            word |= low[lane * 32 + j] << np.uint64(2 * j)
        packed.append(word.view(np.int64))
    return packed


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            sets, bounds = shingles(*word_hashes(data, offsets), WORDS)
            sizes = np.diff(bounds)
            some = sizes > 0
            packed = np.zeros((LANES, hi - lo), np.int64)
            banded = np.zeros((0, BANDS), np.int64)
            ids = np.zeros(hi - lo, np.int64)
            if some.any():
                minima = _minima(sets, np.append(bounds[:-1][some], bounds[-1]))
                packed[:, some] = _packed(minima)
                acc = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
                for r in range(ROWS):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + minima[r:r + BANDS * ROWS:ROWS])
                banded = np.ascontiguousarray(acc.T).view(np.int64)
                sums = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][some])
                ids[some] = mix(sums + sizes[some].astype(np.uint64)).view(np.int64)
            ends = np.concatenate(([0], np.cumsum(some))) * BANDS
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(sizes), pa.array(ids),
                *map(pa.array, packed), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(banded.ravel())),
            ], names=["doc_id", "text_hash", "n_shingles", "set_id", *(f"low{i}" for i in range(LANES)), "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: set size and id, packed low bits, band hashes."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_sign, _SIGNATURE)


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed bits: agreements less those that two bits share by chance (1 in 4)."""
    differing = F.lit(0)
    for i in range(LANES):
        x = F.col(f"{a}low{i}").bitwiseXOR(F.col(f"{b}low{i}"))
        lanes = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differing = differing + F.bit_count(lanes)
    return (1 - differing / MINIMA - 0.25) / 0.75


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets_of(column: pa.Array) -> list[np.ndarray]:
            found = []
            for _, _, data, offsets in text_slices(column):
                sets, bounds = shingles(*word_hashes(data, offsets), WORDS)
                found += np.split(sets, bounds[1:-1])
            return found

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                keep = []
                for x, y in zip(sets_of(part.column("a_text")), sets_of(part.column("b_text")), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["src", "dst"]).filter(pa.array(keep))
    return run


def _attach(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs ``src, dst`` with columns of both nodes, prefixed by a_ and b_."""
    a = nodes.select(F.col("set_id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = nodes.select(F.col("set_id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "src").join(b, "dst")


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    whole = _attach(pairs, texts, ["text"]).select("src", "dst", "a_text", "b_text")
    return cut(whole.mapInArrow(_confirm(percent), "src bigint, dst bigint"))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            sets, bounds = shingles(*word_hashes(data, offsets), WORDS)
            ids = batch.column("set_id").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(bounds))), pa.array(sets.view(np.int64))], names=["set_id", "shingle"])


def _own_shingles(texts: DataFrame) -> DataFrame:
    """``set_id, n_own``: how many shingles of a node no other node of these has."""
    seen = texts.mapInArrow(_shingle_rows, "set_id bigint, shingle bigint").groupBy("shingle").agg(
        F.min("set_id").alias("set_id"), F.max("set_id").alias("last")
    )
    return seen.filter("set_id = last").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_own"))


def _able(members: DataFrame, percent: int) -> DataFrame:
    """Members that could link with some other set of their bucket: exact, by what they share at most.

    A set shares at most its ``n_common`` shingles, and a partner has at least as many as the smallest
    set of the bucket. Buckets left with one member fall away.
    """
    names = members.columns
    smallest = members.groupBy("band").agg(F.min("n_shingles").alias("n_least"))
    union = F.col("n_shingles") + F.greatest("n_least", "n_common") - F.col("n_common")
    able = members.join(smallest, "band").filter(100 * F.col("n_common") >= percent * union)
    several = able.groupBy("band").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("band")
    return able.join(several, "band").select(*names)


def _possible(percent: int) -> Column:
    """False for pairs a_, b_ that cannot link: exact, by sizes and by the shingles only one of them has."""
    most = F.least("a_n_common", "b_n_common")
    apart = F.greatest(F.col("a_n_own"), F.col("a_n_shingles") - most) + F.greatest(F.col("b_n_own"), F.col("b_n_shingles") - most)
    return 100 * most >= percent * (most + apart)


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n_shingles, text_hash, group, component`` of each row: the node and the smallest id of its group."""
    low = [f"low{i}" for i in range(LANES)]
    least = percent / 100 - MARGIN
    signed = cut(signatures(docs))
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = linkable.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("set_id", "first.*")
    nodes = linkable.join(first, ["set_id", "doc_id", "text_hash"])

    placed = nodes.select("set_id", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("a < b").select("band")
    placed = cut(placed.join(shared, "band"))
    met = nodes.join(placed.select("set_id").distinct(), "set_id").select("set_id", "doc_id", "text_hash", "n_shingles", *low)
    texts = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).join(
        met.select("set_id", "doc_id", "text_hash"), ["doc_id", "text_hash"]
    ).select("set_id", "text"))
    met = met.drop("doc_id", "text_hash").join(_own_shingles(texts), "set_id", "left")
    met = cut(met.withColumn("n_own", F.coalesce("n_own", F.lit(0))).withColumn("n_common", F.col("n_shingles") - F.col("n_own")))
    members = cut(_able(placed.join(met.select("set_id", "n_shingles", "n_own", "n_common"), "set_id"), percent))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        likely = _attach(ordered, met, low).filter(estimate("a_", "b_") >= least)
        return _links(likely.select("src", "dst"), texts, percent)

    def mixed(joined: DataFrame) -> DataFrame:
        """Members of the buckets whose nodes are not all in one component, with their component."""
        labelled = members.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
        ends = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
        return _able(labelled.join(ends, "band"), percent)

    # The leader of a bucket is the node with the least share of shingles that no other node has: of
    # copies of one text, the text itself or what is nearest to it.
    first_of = F.min(F.struct((F.col("n_own") / F.col("n_shingles")).alias("share"), "set_id")).alias("leader")
    leaders = members.groupBy("band").agg(first_of)
    to_one = members.join(leaders, "band").groupBy(F.col("set_id").alias("src")).agg(F.min("leader").alias("leader"))
    links = confirmed(to_one.select("src", F.col("leader.set_id").alias("dst")).filter("src <> dst"))

    left = cut(mixed(components(links)))
    leaders = left.groupBy("band").agg(F.min(F.struct((F.col("n_own") / F.col("n_shingles")).alias("share"), "set_id", "comp")).alias("leader"))
    to_other = left.join(leaders, "band").filter("comp <> leader.comp").groupBy(F.col("set_id").alias("src")).agg(F.min("leader").alias("leader"))
    links = links.unionByName(confirmed(to_other.select("src", F.col("leader.set_id").alias("dst"))))
    joined = components(links)

    rest = cut(mixed(joined))
    own_bands = rest.groupBy("set_id").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    rest = rest.join(met.select("set_id", *low).join(own_bands, "set_id"), "set_id")
    columns = ["set_id", "comp", "n_shingles", "n_own", "n_common", *low, "bands"]
    a = rest.select("band", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rest.select(F.col("band").alias("b_band"), *[F.col(c).alias(f"b_{c}") for c in columns])
    # a pair counts in the first band that both have
    once = F.array_intersect("a_bands", "b_bands")[0] == F.col("band")
    across = a.join(b, (F.col("band") == F.col("b_band")) & (F.col("a_comp") < F.col("b_comp")) & _possible(percent) & (estimate("a_", "b_") >= least) & once)
    more = _links(across.select(F.col("a_set_id").alias("src"), F.col("b_set_id").alias("dst")), texts, percent)
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    firsts = first.select(F.col("set_id").alias("node"), F.col("doc_id").alias("first_doc"))
    named = firsts.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("first_doc").alias("component"))
    named = named.join(smallest, "comp").select(F.col("node").alias("set_id"), F.col("comp").alias("group"), "component")
    return signed.select("doc_id", "n_shingles", "text_hash", "set_id").join(named, "set_id", "left").select(
        "doc_id", "n_shingles", "text_hash", F.when(F.col("n_shingles") > 0, F.col("group")).alias("group"), "component")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row, for links from ``percent`` % of similarity."""
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return _grouped(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: the smallest doc_id, then the smallest text hash.

    Here rows without a doc_id are members of groups too, after all others; of rows that repeat a doc_id and
    its text one stays. Rows without words all stay.
    """
    text_hash = F.xxhash64("text")
    last = F.lit(1 << 62) + text_hash.bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), last).alias("doc_id"), text_hash.alias("text_hash"), F.struct(*docs.columns).alias("row"))
    found = cut(_grouped(rows.select("doc_id", F.col("row.text").alias("text")), percent).filter(F.col("group").isNotNull()))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    others = found.join(first, "group").filter(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash").distinct()
    kept = rows.join(others, ["doc_id", "text_hash"], "left_anti")
    repeated = cut(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_hash"))
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(repeated, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.join(repeated, ["doc_id", "text_hash"], "left_anti").unionByName(once).select("row.*")


def sql(percent: int) -> str:
    """The same for DuckDB over the table ``documents``, by comparing all sets that share a shingle."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
),
reached(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
components AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components ON x = doc_id
""".strip()
