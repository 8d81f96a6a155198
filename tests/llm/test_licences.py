import helpers
import oracle
import pytest
from furrow.llm import licences
from furrow.llm.queries import QUERIES, SQL


def test_query_matches_sql(spark):
    oracle.compare(spark, oracle.connect(helpers.SF), helpers.SF, "op1_licences", QUERIES["op1_licences"], SQL["op1_licences"])


def test_known_passages(spark):
    mit = dict((t, n) for n, t in licences.TEMPLATES if n == "MIT")
    whole = next(t for t in mit if t.startswith("Permission"))
    rows = [(1, "Hello\nReleased under the MIT licence!!\nbye"), (2, whole.upper().replace(" ", "\n")), (3, "Released under no terms at all"), (4, None)]
    got = {r["doc_id"]: r for r in licences.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["license"], got[1]["score"], got[1]["n_passages"]) == ("MIT", 1.0, 2)  # the line, and the short text around it
    assert got[2]["license"] == "MIT" and got[3]["license"] is None and got[4]["score"] == 0.0


@pytest.mark.parametrize("rows", [0, 12])
def test_awkward_rows(spark, rows):
    docs = helpers.awkward(spark).limit(rows)
    assert licences.report(docs).count() == rows and licences.scan(docs).count() == rows
