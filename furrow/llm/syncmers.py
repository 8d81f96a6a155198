"""Document fingerprints from closed syncmers, with DataFrame functions only.

A syncmer is a stretch of ``K`` characters whose smallest inner stretch of ``S`` characters (by hash) lies
at its start or its end. Whether a stretch is one depends on its own characters alone, so an edit changes
no syncmer outside it and the same passage has the same syncmers at the same distances everywhere. A
fingerprint is all syncmers of a text with their positions, left to right, each as one number: the position
in the upper 32 bits, 32 bits of the hash in the lower. A link is two neighbouring syncmers and the distance
between them, so texts that share a link match there at one offset, wherever the passage lies in each. The
likeness of two texts is the Jaccard likeness of their sets of links, without an estimate.

Documents meet their successor in buckets of neighbouring ids; the bucket bounds are at most ``BUCKETS``
quantiles. Only the last row of a bucket takes its successor from a table of the buckets' first rows.

Defined results: null counts as the empty text; a text shorter than ``K`` has one anchor, its own hash; a
text of one anchor has that as its only link; an empty text has none and an empty fingerprint; two empty fingerprints are alike (1.0), an empty and another
one are not (0.0); rows of one doc_id follow each other by text hash, a null doc_id comes first; a table of
one row follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.arrays import let

K, S = 12, 8
LOW = (1 << 32) - 1
BUCKETS, PER_BUCKET = 4096, 2048


def inner_hashes(text: Column, s: int = S) -> Column:
    """Hash of the ``s`` characters from each position on; four bytes a character make every cut a copy of fixed place."""
    return let(F.encode(text, "UTF-32"), lambda b: F.when(
        F.octet_length(b) >= 4 * s,
        F.transform(F.sequence(F.lit(0), F.octet_length(b) - 4 * s, F.lit(4)), lambda i: F.xxhash64(F.substring(b, i + 1, F.lit(4 * s))))
    ).otherwise(F.array().cast("array<bigint>")))


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """All syncmers of a text from left to right, each as position and 32 bits of its hash in one number."""
    inner = k - s

    def packed(position: Column, found: Column) -> Column:
        return F.shiftleft(position.cast("bigint"), 32).bitwiseOR(F.shiftrightunsigned(found, 32))

    def chosen(h: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = h[i + inner]
            between = h[i + 1] if inner == 2 else F.least(*[h[i + j] for j in range(1, inner)])
            # past the end the left side of "and" is false, so nothing is looked up there
            return F.when((i < F.size(h) - inner) & (F.least(x, last) <= between), packed(i, F.xxhash64(x, last)))

        return F.array_compact(F.transform(h, one))

    whole = F.array(packed(F.lit(0), F.xxhash64(text)))
    return F.when(text == "", F.slice(whole, 1, 0)).otherwise(let(
        inner_hashes(text, s), lambda h: F.when(F.size(h) > inner, chosen(h)).otherwise(whole)))


def chain(found: Column) -> Column:
    """Hash of each anchor but the last with the next one and their distance; moving all anchors changes none."""
    pairs = F.transform(F.slice(found, 2, F.size(found) - 1), lambda x, i: F.xxhash64(
        found[i].bitwiseAND(LOW), x - F.shiftleft(F.shiftright(found[i], 32), 32)
    ))
    return F.when(F.size(found) > 1, pairs).otherwise(F.slice(found, 1, 0))


def links(found: Column, chained: Column) -> Column:
    """Distinct links of a fingerprint with its chain; a text of one anchor has that as its only link."""
    return F.array_distinct(F.when(F.size(found) > 1, chained).otherwise(F.transform(found, lambda x: F.xxhash64(x))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the links of either that both have."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(
        F.size(a) + F.size(b) == 0, 1.0
    ).otherwise(both / (F.size(a) + F.size(b) - both)))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text, bucket, text_hash, last``: each document with the one after it."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    total = docs.count()
    wanted = min(BUCKETS, total // PER_BUCKET)
    bounds = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        bounds = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 100_000)).first()[0] or []))
    bucket = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).cast("int"))

    # at most BUCKETS + 1 rows
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    ahead = Window.orderBy("bucket")
    start = F.first("first").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("bucket", F.coalesce(F.lead("first").over(ahead), start).alias("first"))
    after = after.select(F.col("bucket").alias("edge"), F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    edges = rows.select("doc_id", "text_hash", F.col("text").alias("edge_text")).join(
        F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    ).select("edge", "edge_text").dropDuplicates(["edge"])

    order = Window.partitionBy("bucket").orderBy("doc_id", "text_hash")
    led = rows.withColumns({"lead_text": F.lead("text").over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    return led.join(edges, led["bucket"] == edges["edge"], "left").select(
        "doc_id", "text", "text_hash", "bucket", "last", F.when(F.col("last"), F.col("edge_text")).otherwise(F.col("lead_text")).alias("next_text")
    )


def first_until(found: Column, last: Column) -> Column:
    """Number of anchors up to a position, by halving: they come in order."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (step <= F.size(found) - n) & (F.shiftright(F.get(found, n + step - 1), 32) <= last), n + step).otherwise(n))


def moved(found: Column, by: Column) -> Column:
    return F.transform(found, lambda x: x + F.shiftleft(by.cast("bigint"), 32))


def edited(rows: DataFrame) -> DataFrame:
    """Add ``changed`` and ``changed_chain``, the fingerprint of the edited text and its chain, without hashing it.

    A syncmer depends on its own characters alone, so those of the kept part are the text's own, those of the
    taken part the next text's, moved; only the stretches over the seam are new. Likewise for chains.
    """
    none = F.slice(F.col("own"), 1, 0)
    rows = rows.withColumns({
        "n_own": F.greatest(first_until(F.col("own"), F.col("kept") - K), F.lit(0)),
        "n_next": F.greatest(first_until(F.col("following"), F.col("taken") - K), F.lit(0)),
        "over": F.when(F.length("seam") >= K, moved(fingerprint(F.col("seam")), F.greatest(F.lit(0), F.col("kept") - (K - 1)))).otherwise(none),
    })
    # a short text has its own rule
    whole = F.length("edited") < K
    rows = rows.withColumn("left", F.slice("own", F.lit(1), F.col("n_own"))).withColumn("right", moved(F.slice("following", F.lit(1), F.col("n_next")), F.col("kept")))
    rows = rows.withColumn("alone", F.when(whole, fingerprint(F.col("edited"))))
    middle = F.concat(F.slice("left", F.greatest(F.col("n_own"), F.lit(1)), F.lit(1)), F.col("over"), F.slice("right", 1, 1))

    def inner(chained: str, n: str) -> Column:
        return F.slice(chained, F.lit(1), F.greatest(F.col(n) - 1, F.lit(0)))

    return rows.withColumn("middle", middle).withColumns({
        "changed": F.when(whole, F.col("alone")).otherwise(F.concat("left", "over", "right")),
        "changed_chain": F.when(whole, chain(F.col("alone"))).otherwise(F.concat(inner("chain", "n_own"), chain(F.col("middle")), inner("next_chain", "n_next"))),
    })


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    half = (F.length("text") / 2).cast("int")
    made = with_next(docs).withColumns({"kept": F.length("text") - half, "taken": F.least(half, F.length("next_text"))})
    made = made.withColumns({
        "edited": F.concat(F.left("text", F.col("kept")), F.left("next_text", half)),
        "seam": F.concat(F.right(F.left("text", F.col("kept")), F.lit(K - 1)), F.left("next_text", F.least(F.col("taken"), F.lit(K - 1)))),
    })
    whole = F.length("edited") < K
    made = made.select(
        "doc_id", "bucket", "text_hash", "last", "kept", "taken", "seam", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.when(whole, F.col("edited")).otherwise(F.repeat(F.lit("x"), F.lit(K))).alias("edited"),
        fingerprint(F.col("text")).alias("own"), F.when(F.col("last"), fingerprint(F.col("next_text"))).alias("beyond"),
    )
    made = made.withColumns({"chain": chain(F.col("own")), "beyond_chain": F.when(F.col("last"), chain(F.col("beyond")))})
    made = made.withColumns({"links": links(F.col("own"), F.col("chain")), "beyond_links": F.when(F.col("last"), links(F.col("beyond"), F.col("beyond_chain")))})
    order = Window.partitionBy("bucket").orderBy("doc_id", "text_hash")

    def after(own: str, beyond: str) -> Column:
        return F.when(F.col("last"), F.col(beyond)).otherwise(F.lead(own).over(order))

    ahead = edited(made.withColumns({
        "following": after("own", "beyond"), "next_chain": after("chain", "beyond_chain"), "next_links": after("links", "beyond_links")}))
    return ahead.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("changed").alias("edited_fingerprint"),
        likeness(F.col("links"), links(F.col("changed"), F.col("changed_chain"))).alias("near_edited"),
        likeness(F.col("links"), F.col("next_links")).alias("near_next"),
    )
