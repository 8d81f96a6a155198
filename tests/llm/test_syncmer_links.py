import random

import helpers
from furrow.llm import syncmers
from pyspark.sql import functions as F

DRAW = random.Random(5)


def prose(n):
    return " ".join("".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randint(2, 9))) for _ in range(n))


def links_of(found):
    pairs = {(a & syncmers.LOW, b & syncmers.LOW, (b >> 32) - (a >> 32)) for a, b in zip(found, found[1:])}
    return pairs or set(found)


def test_long_texts_that_share_a_passage(spark):
    passage = prose(200)
    a, b = prose(4000) + passage, prose(1000) + passage + prose(3000)
    got = syncmers.report(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert all(0.015 < r["near_next"] < 0.035 for r in got)
    assert all(len(r["fingerprint"]) > r["n_chars"] / 4 for r in got)


def test_one_edited_word_of_a_long_text_shows(spark):
    words = prose(4000).split()
    other = " ".join([*words[:2000], "zzzzzz", *words[2001:]])
    got = syncmers.report(spark.createDataFrame([(1, " ".join(words)), (2, other)], "doc_id long, text string")).collect()
    assert all(0.995 < r["near_next"] < 1.0 for r in got)


def test_likeness_against_sets_of_links(spark):
    docs = helpers.documents(spark).select("doc_id", "text").limit(60)
    got = sorted(syncmers.report(docs).collect(), key=lambda r: r["doc_id"])
    want = {r["doc_id"]: r["a"] for r in docs.select("doc_id", syncmers.fingerprint(F.coalesce("text", F.lit(""))).alias("a")).collect()}
    for n, r in enumerate(got):
        assert r["fingerprint"] == want[r["doc_id"]]
        for other, near in ((r["edited_fingerprint"], r["near_edited"]), (got[(n + 1) % len(got)]["fingerprint"], r["near_next"])):
            x, y = links_of(r["fingerprint"]), links_of(other)
            assert abs(near - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    texts = [prose(DRAW.randint(1, 12))[:DRAW.randint(0, 60)] for _ in range(150)] + ["", "a", "\U0001F600" * 9 + prose(9), prose(5) + "\U0001F601", "é" * 30]
    DRAW.shuffle(texts)
    got = sorted(syncmers.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    halves = [len(t) // 2 for t in texts]
    edited = [t[:len(t) - h] + texts[(i + 1) % len(texts)][:h] for i, (t, h) in enumerate(zip(texts, halves))]
    made = spark.createDataFrame(list(enumerate(edited)), "i int, t string").select("i", syncmers.fingerprint(F.col("t")).alias("f")).collect()
    assert [r["edited_fingerprint"] for r in got] == [r["f"] for r in sorted(made, key=lambda r: r["i"])]
