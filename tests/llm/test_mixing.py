import re
from collections import Counter, defaultdict

import helpers
import pytest
from furrow.llm import mixing


def filled(sizes, weights, whole):
    """Targets by filling level after level."""
    full = set()
    while True:
        left = [s for s in sizes if s not in full]
        level = (whole - sum(2 * sizes[s] for s in full)) / sum(weights[s] for s in left) if left else 0
        over = {s for s in left if weights[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= over


@pytest.fixture(scope="module")
def docs(spark):
    return helpers.documents(spark).select("doc_id", "text", "source").unionByName(helpers.awkward(spark).select("doc_id", "text", "source"))


def test_targets_and_taken(spark, docs):
    sizes, sources = Counter(), defaultdict(set)
    for doc_id, text, source in helpers.rows_of(docs):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        sources[doc_id, n].add(source)
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    got = mixing.report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        source = min(sources[r["doc_id"], r["size"]], key=str)
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_runs_agree(spark, docs):
    a, b = (sorted(map(str, helpers.rows_of(mixing.report(d)))) for d in (docs, docs.repartition(7)))
    assert a == b


def test_schedule_is_even(spark, docs):
    shares = mixing.targets(mixing.sizes(docs)).cache()
    total = shares.agg({"target": "sum"}).first()[0]
    rows = mixing.schedule(shares).select("slot", "_source", "_null").collect()
    slots = sorted((r["slot"], None if r["_null"] else r["_source"]) for r in rows)
    assert len({s for s, _ in slots}) == len(slots)
    half = Counter(s for _, s in slots[:len(slots) // 2])
    for r in shares.collect():
        assert abs(half[r["source"]] - len(slots) / 2 * r["target"] / total) < 6


def test_small_tables(spark):
    assert mixing.report(helpers.awkward(spark).limit(0)).count() == 0
    one = spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")
    assert helpers.rows_of(mixing.report(one)) == [(1, 0, 0, 0.0, 0)]
    kept = mixing.mixed_documents(helpers.awkward(spark))
    assert kept.columns == helpers.awkward(spark).columns and kept.filter("trim(text) = ''").count() == 0


def test_a_source_of_one_long_document_stays(spark):
    rows = [(i, "word " * 100, "big") for i in range(50)] + [(99, "other " * 3000, "long"), (100, "x " * 40, "small")]
    docs = spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id long, text string, source string, _key string, row int")
    got = mixing.mixed_documents(docs).collect()
    assert {r["source"] for r in got} == {"big", "long", "small"}
    assert got[0].__fields__ == docs.columns and {(r["_key"], r["row"]) for r in got} == {("kept", 5)}
