import random
import re
from collections import defaultdict

import helpers
import numpy as np
import oracle
import pytest
from furrow.llm import near_dedup
from furrow.llm.queries import QUERIES, SQL
from furrow.llm.words import shingles, word_hashes


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent):
    """``doc_id, n_shingles, component_id`` by comparing all pairs that share a shingle."""
    sets, parent, holders = [sets_of(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (doc_id, _) in enumerate(rows):
        if doc_id is None:
            continue
        common = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((d if d is not None else -1, len(s), least[root(i)] if d is not None else -1) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got_of(frame):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in frame.collect())


def test_query_matches_sql(spark):
    oracle.compare(spark, oracle.connect(helpers.SF), helpers.SF, "op10_minhash", QUERIES["op10_minhash"], SQL["op10_minhash"])


def test_copies_with_many_edits(spark):
    """A large group in which most pairs are just below the limit, beside awkward rows and chains."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, t) for i, t, _, _ in helpers.AWKWARD]
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            own[rng.randrange(150)] = f"e{i}"
        rows.append((1000 + i, " ".join(own)))
    chain = list(base)
    for i in range(12):
        chain[i * 12] = f"c{i}"
        rows.append((2000 + i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert got_of(near_dedup.near_duplicates(docs, percent)) == brute(rows, percent)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.5, 0.8, 0.9):
        a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        b = a.copy()
        n = int(400 * (1 - share) / (1 + share))
        b[:n] = rng.integers(0, 1 << 63, n)
        low = near_dedup._packed(near_dedup._minima(np.concatenate((a, b)), np.array([0, 400, 800])))
        differ = 0
        for lane in low:
            x = int(lane.view(np.uint64)[0]) ^ int(lane.view(np.uint64)[1])
            differ += bin((x | x >> 1) & 0x5555555555555555).count("1")
        errors.append(abs((1 - differ / near_dedup.MINIMA - 0.25) / 0.75 - (400 - n) / (400 + n)))
    assert max(errors) < near_dedup.MARGIN


def test_shingle_counts():
    for text in ["", "a", "A b\tc\nd", "a b c d e", "a b c d e f a b c d e", "é ß\x0bx y z w"]:
        data = np.frombuffer(text.encode(), np.uint8)
        own, bounds = shingles(*word_hashes(data, np.array([0, len(data)])), 5)
        assert len(own) == bounds[-1] == len(sets_of(text))


@pytest.mark.parametrize("rows", [0, 12])
def test_one_of_each_group_stays(spark, rows):
    docs = helpers.awkward(spark).limit(rows)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    if rows:
        ids = [r["doc_id"] for r in kept.collect()]
        # 9003 once, with the row of the same words; "a b" has no words in common with any
        assert ids.count(9003) == 1 and ids.count(9004) == 2 and ids.count(None) == 2


def test_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "other")
    rows = [(None, text), (None, near), (None, text), (7, text), (7, near), (7, text), (8, near), (None, "only here and nowhere else at all"), (None, None), (9, ""), (9, "")]
    kept = near_dedup.keep_first(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _text_hash int")).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "_text_hash"] and all(r["_text_hash"] == 1 for r in kept)
    alike = [r for r in kept if r["text"] in (text, near)]
    assert len(alike) == 1 and alike[0]["doc_id"] == 7
    assert sorted(str(r["text"]) for r in kept if r not in alike) == sorted(["None", "", "", "only here and nowhere else at all"])
    only_null = near_dedup.keep_first(spark.createDataFrame([(None, text), (None, near)], "doc_id long, text string")).collect()
    assert len(only_null) == 1
