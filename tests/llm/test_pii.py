import hashlib
import re

import helpers
import oracle
from furrow.llm import pii
from furrow.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    (1, "a@b.cd+x@y.z é 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +49 (30) 123456789"), (2, "9" * 30000 + " x " + "a" * 50000),
    (3, "mail " + "a@b.co " * 2000), (4, "\U0001F600 x@y.zz \U0001F600 +12345678901 x 0001.02.3.255"), (5, "4111-1111-1111-1112 +1-2 a@b @c.d a@b."),
]


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_query_matches_sql(spark):
    oracle.compare(spark, oracle.connect(helpers.SF), helpers.SF, "op5_pii", QUERIES["op5_pii"], SQL["op5_pii"])


def test_against_regular_expressions(spark):
    docs = helpers.documents(spark).select("doc_id", "text").unionByName(helpers.awkward(spark).select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame(HARD, "doc_id long, text string"))
    texts = docs.withColumn("at", F.xxhash64("doc_id", "text"))
    got = pii.find_spans(texts).collect()
    assert len(got) == docs.count()
    for r in got:
        base = [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["kind"] in PATTERNS]
        if len(r["text"] or "") < 30000:
            assert base == brute(r["text"])
    for r in pii.report(docs.filter("doc_id = 1")).collect():
        want = brute(HARD[0][1]) if r["n_email"] == 2 else brute("")
        if r["n_email"] == 2:
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()


def test_checksums_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00"), (2, "IBAN DE89 3704 0044 0532 0130 01"), (3, "my ssn 123-45-6789"), (4, "part 123-45-6789")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "national_id:7:18", 4: ""}


def test_redaction_hides_every_span(spark):
    docs = helpers.awkward(spark).unionByName(spark.createDataFrame(HARD, "doc_id long, text string"), allowMissingColumns=True)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert pii.find_spans(clean.drop("spans")).filter(F.size("spans") > 0).count() == 0
    assert {r["text"] for r in clean.filter("doc_id = 4").collect()} == {"\U0001F600 <EMAIL> \U0001F600 <PHONE> x <IP>"}


def test_runs_without_python(spark):
    plan = pii.report(helpers.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
