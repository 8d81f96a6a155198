import hashlib
import random
import re
from collections import Counter

import helpers
import numpy as np
import pytest
from furrow.llm import repeats
from furrow.llm.suffix_groups import suffix_array


def brute(rows):
    """Digest rows by looking at every string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i:i + 200] for _, b in texts for i in range(len(b) - 199))
    out = Counter()
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(x, int)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("limit", [3, repeats.LIMIT])
def test_against_every_string(spark, limit):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(900))
    rows = [(i, t) for i, t, _, _ in helpers.AWKWARD if i != 9005] + [
        (1, base), (2, base), (3, base[:400] + "x" + base[401:]), (4, base[100:299]), (5, base[100:300]), (6, "a" * 500), (7, "zé" * 300),
    ]
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(900)] = rng.choice("xyz")
        at = rng.randint(0, 300)
        rows.append((100 + i, f"q{i}" + "".join(own[at:at + rng.randint(150, 600)]) + f"w{i}"))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert Counter((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in got) == brute(rows)


def test_documents(spark):
    docs = helpers.documents(spark).select("doc_id", "text")
    assert Counter(helpers.rows_of(repeats.report(docs))) == brute(helpers.rows_of(docs))


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_100_000))
    rows = [(1, long), (2, "x" + long[1_048_400:1_048_700] + "y")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (300, 1), 2: (300, 1)}


def test_empty_table(spark):
    assert repeats.report(helpers.awkward(spark).limit(0)).count() == 0
