import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import helpers
import numpy as np
import pytest
from furrow.llm import runs


def brute(words):
    """All runs of a list by trying every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    own = brute(words)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("slice_", [16, runs.SLICE])
def test_against_every_period(monkeypatch, slice_):
    monkeypatch.setattr(runs, "SLICE", slice_)
    rng = random.Random(4)
    texts = []
    for _ in range(600):
        letters = rng.choice([1, 2, 2, 3, 5])
        x = [rng.randrange(letters) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            at, part = rng.randint(0, len(x)), [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            x[at:at] = (part * 8)[:rng.randint(1, len(part) * 8)]
        texts.append(x)
    for lo in range(0, len(texts), 50):
        part = texts[lo:lo + 50]
        assert runs.find_runs([np.array(x, np.int64) for x in part]) == [brute(x) for x in part]


def test_squares_against_pairs():
    rng = random.Random(8)
    for _ in range(200):
        x = np.array([rng.randrange(2) for _ in range(rng.randint(0, 30))] + [9])
        steps = runs.doubled_ranks(x)
        got = set(zip(*(a.tolist() for a in runs.branching_squares(steps)), strict=True))
        want = set()
        for i in range(len(x)):
            for q in range(1, len(x) - i):
                same = next(k for k in range(len(x)) if i + q + k >= len(x) or x[i + k] != x[i + q + k])
                if same == q:
                    want.add((i, q))
        assert got == want


def test_documents_with_planted_runs(spark):
    docs = helpers.documents(spark).select("doc_id", "text")
    want = Counter(digest(*r) for r in helpers.rows_of(docs))
    assert Counter(helpers.rows_of(runs.report(docs))) == want
    assert sum(1 for r in want if r[1]) > 5


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    assert Counter(helpers.rows_of(runs.report(docs))) == Counter(
        digest(i, t) if i != 9005 else digest(i, t) for i, t, _, _ in helpers.AWKWARD)
    assert runs.report(docs.limit(0)).count() == 0


def test_one_word_very_often():
    n = 400_000
    assert runs.find_runs([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    word = np.tile(np.arange(1000), 300)
    assert runs.find_runs([np.concatenate((word, [5000], word[:4500]))]) == [[(0, 300_000, 1000), (300_001, 4500, 1000)]]


def test_operator_keeps_texts(spark):
    row = runs.collapse_runs(spark.createDataFrame([(1, "a  b\tc no no no no no no\nend")], "doc_id long, text string")).first()
    assert row["collapsed"] == "a b c no end" and [tuple(r) for r in row["runs"]] == [(3, 6, 1)] and row["n_words"] == 10
