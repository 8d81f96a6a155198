"""Mix sources to target weights on a low-discrepancy schedule.

A golden-ratio sequence of points runs through the cumulative target shares, so that every stretch of the
schedule holds the sources in about their shares. The k-th slot of a source takes the k-th block of
``BLOCK`` words of that source's stream: its documents in hashed order, gone through twice at most.

Every position is a sum over groups of bounded size: slots are ranked in chunks of ``CHUNK`` slots and
documents are placed in stretches of the hash range, and only the totals of these groups are added up over
a whole source. Blocks and slots meet on source and block number, so no join key is hot.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own,
last in order; documents with one id and one source follow each other in order of text hash; repeated rows
are documents of their own; an empty table, or one without words, has targets of 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 64  # words
CHUNK = 1 << 14  # slots ranked together
PER_STRETCH = 4096  # documents placed together, about
CELLS = 1 << 12  # parts of the unit interval on which points and shares meet
_GOLDEN = 0.6180339887498949


# A source as two columns that join and group without null.
_NAME = ["_source", "_null"]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})


def words_of(text: Column) -> Column:
    """Number of runs outside space and 0x09-0x0D."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", -1)
    # only the first and the last part can be empty
    empty = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - empty).cast("bigint")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_size, target, lo, hi`` with its part of the unit interval.

    What a source gets above ``most`` times its size is shared again by weight until none is above.
    The windows here see one row per source, never documents.
    """
    by_order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_order) - 1
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    ))
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = -1.0  # words per unit of weight
    while True:
        full = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        taken, weight = sources.agg(
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not weight:
            break
        nxt = (whole - taken) / weight
        if nxt <= level:
            break
        level = nxt
    target = F.least(most * F.col("source_size"), F.lit(max(level, 0.0)) * F.col("weight"))
    total = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sources.withColumn("target", target.cast("double"))
    everything = placed.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    hi = F.sum("target").over(total)
    return placed.select(
        "source", "source_size", "target",
        ((hi - F.col("target")) / F.lit(everything or 1.0)).alias("lo"), (hi / F.lit(everything or 1.0)).alias("hi"),
    )


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, _source, _null, nth``: the source of each slot and its rank among that source's slots.

    The points give a source its share of the slots but for one or two. Ranks that its target does not
    need fall away, and ranks that are still missing get slots of their own behind the last point.
    """
    spark = shares.sparkSession
    slots = int(round((shares.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]) / block))
    # the fraction of slot x golden ratio, taken in two parts to keep its digits
    high, low = F.floor(F.col("slot") / (1 << 20)), F.col("slot") % (1 << 20)
    point = high * F.lit((1 << 20) * _GOLDEN % 1.0) + low * F.lit(_GOLDEN) + 0.5
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("bigint"))
    named = _named(shares)
    ordered = named.filter("hi > lo")
    last = ordered.agg(F.max("hi")).first()[0]
    # rounding may leave the last share short of 1
    ordered = ordered.withColumn("hi", F.when(F.col("hi") == F.lit(last), 2.0).otherwise(F.col("hi")))
    parts = ordered.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS).cast("bigint"), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("bigint"))
    ))).select(*_NAME, "lo", "hi", "cell")
    drawn = points.join(parts, "cell").filter((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi")))
    drawn = cut(drawn.select("slot", *_NAME, F.floor(F.col("slot") / CHUNK).alias("chunk")))
    counts = drawn.groupBy(*_NAME, "chunk").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*_NAME).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*_NAME, "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*_NAME, "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(firsts, [*_NAME, "chunk"])
    needed = named.select(*_NAME, F.ceil(F.col("target") / block).alias("needed"))
    ranked = ranked.join(needed, _NAME).select("slot", *_NAME, (F.col("first") + F.col("inside")).alias("nth"), "needed")
    short = needed.join(counts.groupBy(*_NAME).agg(F.sum("n").alias("had")), _NAME, "left").withColumn("had", F.coalesce("had", F.lit(0)))
    missing = short.filter("had < needed").select(*_NAME, F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("nth"))
    behind = F.row_number().over(Window.orderBy("nth", *_NAME)) - 1 + slots  # a row or two per source
    return ranked.filter("nth < needed").select("slot", *_NAME, "nth").unionByName(missing.select(behind.cast("bigint").alias("slot"), *_NAME, "nth"))


def placed(sized: DataFrame, seed: int) -> DataFrame:
    """Add ``start``: the words before each document in its source's hashed order."""
    rows = sized.count()
    stretches = max(1, rows // PER_STRETCH)
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)
    hashed = sized.withColumn("key", key).withColumn("stretch", F.floor(F.col("key") / (2.0 ** 63) * stretches))
    hashed = _named(hashed)
    totals = hashed.groupBy(*_NAME, "stretch").agg(F.sum("size").alias("n"))
    over = Window.partitionBy(*_NAME).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*_NAME, "stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    order = Window.partitionBy(*_NAME, "stretch").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = hashed.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return inside.join(firsts, [*_NAME, "stretch"]).select(
        "doc_id", "text_hash", "source", *_NAME, "size", (F.col("first") + F.col("inside")).alias("start")
    )


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, source, size`` of each document."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"),
    )


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed documents, the targets, and the mix: ``slot, doc_id, epoch, from_word, words`` pieces.

    Pieces of one slot follow each other by ``at``. ``row`` names the placed document.
    """
    sized = cut(sizes(docs))
    shares = cut(targets(sized))
    where = cut(placed(sized, seed).withColumn("row", F.monotonically_increasing_id()))
    streams = where.filter("size > 0").join(_named(shares).select(*_NAME, "source_size", "target"), _NAME)
    epochs = streams.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    epochs = epochs.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size"))
    epochs = epochs.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.round("target").cast("bigint"))).filter("hi > lo")
    pieces = epochs.withColumn("nth", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    first = F.greatest("lo", F.col("nth") * block)
    pieces = pieces.select(
        "row", "doc_id", "source", *_NAME, "epoch", "nth", first.alias("at"), (first - F.col("lo")).alias("from_word"),
        (F.least("hi", (F.col("nth") + 1) * block) - first).alias("words"),
    )
    return where, shares, pieces.join(schedule(shares, block), [*_NAME, "nth"]).drop(*_NAME, "nth")


def report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document."""
    where, shares, mixed = mix(docs, seed)
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    known = where.join(_named(shares).select(*_NAME, "source_size", "target"), _NAME)
    return known.join(taken, "row", "left").select(
        "doc_id", F.col("size").cast("bigint"), F.col("source_size").cast("bigint"), "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Each document as often as the mix goes through it, to the nearest whole time, with all columns.

    A source's words run through whole documents, so only the document at its end is rounded and its total is
    the nearest that whole documents give. A source with a target whose documents would all be rounded
    away keeps the one that the mix takes most of.
    """
    where, _, mixed = mix(docs, seed)
    taken = where.select("row", "doc_id", "text_hash", "source", "size").join(mixed.groupBy("row").agg(F.sum("words").alias("taken")), "row")
    taken = cut(taken.withColumn("times", F.round(F.col("taken") / F.col("size")).cast("int")))
    most = F.max(F.struct("taken", (-F.col("row")).alias("first")))
    lost = taken.groupBy("source").agg(F.sum("times").alias("all"), most.alias("most")).filter("all = 0").select((-F.col("most.first")).alias("row"), F.lit(1).alias("one"))
    times = taken.join(lost, "row", "left").withColumn("times", F.coalesce("one", "times")).filter("times > 0").groupBy("doc_id", "text_hash", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("times").alias("times"))
    # rows that repeat each other share their number of times
    copies = times.withColumn("copies", F.greatest(F.lit(1), F.round(F.col("times") / F.col("rows")).cast("int"))).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("source").alias("of"), "copies")
    packed = docs.select(
        F.col("doc_id").cast("bigint").alias("key"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("from"), F.struct(*docs.columns).alias("row"))
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")) & F.col("from").eqNullSafe(F.col("of"))
    return packed.join(copies, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
