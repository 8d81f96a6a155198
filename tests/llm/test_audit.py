import itertools
import random
import re
from collections import Counter, defaultdict

import helpers
import pytest
from furrow.llm import audit


def masks_of(rows):
    """Mask of each row ``doc_id, text, source`` by looking at all rows."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                doc_id is not None and doc_id > least[t]]
        out.append((doc_id, source or "", sum(b << i for i, b in enumerate(bits))))
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for doc_id, part, mask in masks_of(rows):
        parts[part].append((doc_id, mask))
    out = {}
    for part, own in parts.items():
        shapley, made = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone = [d for d, m in left if m & bit]
                failing = sum(1 for _, m in own if m & bit)
                left = [(d, m) for d, m in left if not m & bit]
                shapley[x] += len(gone)
                made["".join(order), step] = [len(left), len(gone), failing - len(gone), sum(m == bit for _, m in own),
                                             sum(d in good for d in gone), sum(d in toxic for d in gone), x]
        for (order, step), r in made.items():
            out[part, order, step] = (*r[:6], shapley[r[6]])
    return out


def got_of(frame):
    rows = frame.collect()
    assert frame.columns[:3] == ["part", "filter_order", "step"] and len({tuple(r[:3]) for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:10]) for r in rows}


def test_documents_in_all_orders(spark):
    docs = helpers.documents(spark)
    labels = spark.read.parquet(f"{helpers.SF}/labels.parquet")
    want = brute(helpers.rows_of(docs.select("doc_id", "text", "source")), helpers.rows_of(labels.select("doc_id", "quality", "toxic")))
    assert got_of(audit.report(docs, labels)) == want


def test_sql_says_the_same(spark):
    import oracle

    from furrow.llm import queries

    oracle.compare(spark, oracle.connect(helpers.SF), helpers.SF, "op11", queries.op11_filter_audit, queries.SQL["op11_filter_audit"])


@pytest.mark.parametrize("limit", [1, 3, audit.LIMIT])
def test_copies_over_many_tasks(spark, limit):
    rng = random.Random(limit)
    long = "y" * 70 + "".join(rng.choice("ab ") for _ in range(5000))
    rows = [(rng.randint(0, 400), rng.choice(["", None, "x", "x y", "B#", long, long[:-1], long + "z", long[:64], long[:2000] + "q" + long[2001:]]),
             rng.choice(["s", "t", None, ""])) for _ in range(600)]
    rows += [(i, t, s) for i, t, _, s in helpers.AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = Counter()
    for r in audit.failures(docs, limit).collect():
        got[r["key"] if r["has_id"] else None, r["source"], r["mask"]] += r["n"]
    assert got == Counter(masks_of(rows))


def test_trie_against_a_dictionary():
    rng = random.Random(6)
    root, rows = audit.Node(b""), []
    for i in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        rows.append((rng.randint(0, 999), text))
        audit.insert(root, text, (rows[-1][0], text, 0, 1))
    least = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    assert Counter((k, t, m) for k, _, t, m, _ in audit.flagged(root)) == Counter((i, t, 16 if i > least[t] else 0) for i, t in rows)


def test_awkward_rows_and_labels(spark):
    docs = helpers.awkward(spark)
    labels = spark.createDataFrame([(9003, 1, None), (9003, 0, 1), (None, 1, 1), (9005, None, None)], "doc_id long, quality int, toxic int")
    assert got_of(audit.report(docs, labels)) == brute([(i, t, s) for i, t, _, s in helpers.AWKWARD], [(9003, 1, None), (9003, 0, 1)])
    assert audit.report(docs.limit(0), labels).count() == 0
    assert got_of(audit.report(docs, labels.limit(0))) == brute([(i, t, s) for i, t, _, s in helpers.AWKWARD], [])
