import math

import helpers
import numpy as np
import pytest
from furrow.llm import neighbours

UNIT = [float(i == 3) for i in range(64)]
ODD = [
    (None, UNIT), (900001, None), (900002, [0.0] * 64), (900003, UNIT[:63] + [None]), (900004, UNIT[:63] + [math.nan]), (900005, UNIT),
    (900100, UNIT), (900006, UNIT), (900007, [1.0, 2.0]), (900200, UNIT), (900200, UNIT), (900008, UNIT[:63] + [math.inf]),
]


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").unionByName(
        spark.createDataFrame(ODD, "vec_id long, embedding array<float>"))
    got = neighbours.search(rows, lambda i: i % 100 == 0).toPandas()
    usable = {i: v for i, v in helpers.rows_of(rows) if i is not None and v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)}
    ids, vectors = np.array(list(usable)), np.array(list(usable.values()), float)
    hits = 0
    asked = ids[ids % 100 == 0]
    assert set(got["query_id"]) == set(asked)
    for q in asked:
        scores = np.sqrt(((vectors - usable[q]) ** 2).sum(1))
        scores[ids == q] = np.inf
        best = ids[np.lexsort((ids, scores))[:10]]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], [scores[ids == v][0] for v in own["vec_id"]], rtol=0, atol=1e-12)
        assert sorted(zip(own["score"], own["vec_id"])) == list(zip(own["score"], own["vec_id"]))
        hits += len(set(best) & set(own["vec_id"]))
    assert hits / (10 * len(asked)) >= 0.9
    assert got[got["query_id"] == 900100].sort_values("rank")["vec_id"].tolist()[:3] == [900005, 900006, 900200]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = spark.createDataFrame([(100 * i, [float(i + 1), 2.0]) for i in range(n)], "vec_id long, embedding array<float>")
    assert neighbours.search(rows, lambda i: i % 100 == 0).count() == n * max(0, n - 1)
