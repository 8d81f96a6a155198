import zlib

import helpers
import numpy as np
import pytest
from furrow.llm import language_id


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in language_id.predict(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_every_byte_counts_and_cuts_do_not_matter(model):
    text = language_id.folded(np.frombuffer(b"the and of that " * 40, np.uint8))
    p, votes = language_id.label_positions(model, text, np.array([0, len(text)]))
    both, _ = language_id.label_positions(model, np.concatenate((text, text)), np.array([0, len(text), 2 * len(text)]))
    assert np.allclose(p[0], both[0]) and np.allclose(p[0], both[1]) and abs(p.sum() - 1) < 1e-4 and abs(votes.sum() - 1) < 1e-6


def test_gradients():
    rng = np.random.default_rng(0)
    inner, bias = rng.normal(size=(9, 3)), rng.normal(size=(3, 1))
    table, x = rng.normal(size=(9, language_id.PAD + 1)), rng.integers(0, 5, (6, 4))
    aim = rng.normal(size=(6, 3, 4))

    def loss():
        return float((language_id._pass(table, inner, bias, x) * aim).sum())

    trace: list = []
    language_id._pass(table, inner, bias, x, trace)
    _, d_inner, d_bias = language_id._backward(inner, trace, x, aim.astype(np.float32))
    for value, grad, at in ((inner, d_inner, (4, 1)), (inner, d_inner, (8, 2)), (bias, d_bias, (1, 0))):
        kept, ends = value[at], []
        for step in (1e-3, -1e-3):
            value[at] = kept + step
            ends.append(loss())
        value[at] = kept
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_awkward_rows(spark, model):
    docs = helpers.awkward(spark)
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(helpers.AWKWARD)
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.filter("lang IS NULL")).collect()} == {"und"}


def test_filter_keeps_clean_documents(spark):
    docs = helpers.documents(spark)
    kept = language_id.keep_known(docs.unionByName(helpers.awkward(spark).select("doc_id", "text", "lang", "source"), allowMissingColumns=True))
    assert kept.columns == docs.columns and docs.join(kept, "doc_id", "left_anti").count() == 0
    assert kept.filter("doc_id IN (9001, 9002, 9008)").count() == 0
