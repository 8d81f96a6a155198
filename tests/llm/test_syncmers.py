import hashlib
import re
from collections import Counter

import helpers
from furrow.llm import syncmers
from pyspark.sql import functions as F


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PER_BUCKET", 20)
    docs = helpers.documents(spark).select("doc_id", "text").unionByName(
        helpers.awkward(spark).select("doc_id", "text").filter("doc_id <> 9004 OR doc_id IS NULL").filter("doc_id IS NOT NULL"))
    rows = sorted(((i, t or "") for i, t in helpers.rows_of(docs)))
    got = syncmers.report(docs).collect()
    want = Counter()
    for n, (doc_id, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[:len(text) - half] + rows[(n + 1) % len(rows)][1][:half]
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = {}
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.25 > 0.05 > sum(r["near_next"] for r in long) / len(long)


def anchors_of(found):
    return {(x >> 32, x & syncmers.LOW) for x in found}


def test_anchors_do_not_depend_on_context(spark):
    inner = "the quick brown fox jumps over the lazy dog \U0001F600 and runs away"
    rows = spark.createDataFrame([(1, inner), (2, "something before " + inner + " and behind")], "i int, t string")
    found = {r["i"]: anchors_of(r["a"]) for r in rows.select("i", syncmers.fingerprint(F.col("t")).alias("a")).collect()}
    assert found[1] and {(p + 17, h) for p, h in found[1]} <= found[2]


def test_anchors_have_their_least_part_at_an_edge(spark):
    text = "some words of a text that is not so short, é and \U0001F600 in it"
    row = spark.createDataFrame([(text,)], "t string").select(
        syncmers.fingerprint(F.col("t")).alias("a"),
        F.transform(F.sequence(F.lit(1), F.lit(len(text) - syncmers.S + 1)), lambda i: F.xxhash64(
            F.encode(F.substr(F.col("t"), i, F.lit(syncmers.S)), "UTF-32"))).alias("h"),
    ).first()
    width = syncmers.K - syncmers.S
    want = [i for i in range(len(text) - syncmers.K + 1) if min(row["h"][i:i + width + 1]) in (row["h"][i], row["h"][i + width])]
    assert [x >> 32 for x in row["a"]] == want


def test_small_tables_and_plan(spark):
    assert syncmers.report(helpers.awkward(spark).limit(0)).count() == 0
    assert syncmers.report(helpers.awkward(spark)).count() == len(helpers.AWKWARD)
    one = syncmers.report(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert not re.search("Python|Pandas|Arrow", syncmers.report(helpers.documents(spark))._jdf.queryExecution().executedPlan().toString())
