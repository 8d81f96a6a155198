import random
import textwrap

import pytest
from furrow.llm import licences

FULL = dict(licences.full_texts())
KNOWN = licences.compiled(licences.TEMPLATES, list(FULL.items()), licences.LEAST)
NOTICES = [t for n, t in licences.TEMPLATES if n in ("GPL-3.0", "BSD-3-Clause") and len(t) > 100]
PROSE = " ".join(random.Random(1).choices("long ago a river ran through hills where people lived by it and fished all day".split(), k=300))


@pytest.mark.parametrize("notice", NOTICES)
def test_wrapped_notice_in_a_document(notice):
    lines = "\n".join("# " + x for x in textwrap.wrap(notice, 45))
    want = next(n for n, t in licences.TEMPLATES if t == notice)
    assert licences.found_in(f"{PROSE}\n{lines}\n{PROSE}", KNOWN) == [(1.0, want)]


def test_notice_beside_other_words_and_two_in_one_text():
    text = f"{PROSE} Released under the MIT License. {PROSE}\nthe other part: Licensed under CC BY 4.0, says {PROSE}"
    assert licences.found_in(text, KNOWN) == [(1.0, "CC-BY-4.0"), (1.0, "MIT")]


@pytest.mark.parametrize("name", sorted(FULL))
def test_full_texts(name):
    got = licences.found_in(f"{PROSE}\nCopyright (c) 2020 A. Person\n\n{FULL[name]}\n{PROSE}", KNOWN)
    assert (1.0, name) in got
    assert licences.found_in(f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{FULL['MIT']}", KNOWN)[0][1] == "MIT"


def test_windows_against_brute_force():
    draw = random.Random(3)
    template = "a b c d a b e f g"
    known = licences.compiled([("T", template)], [], 0.8)
    pairs_of, own = licences.pairs_of, set(licences.pairs_of(template.split()))
    hits = 0
    for _ in range(400):
        words = draw.choices("abcdefgx", k=6) + [w for w in template.split() if draw.random() > 0.04] + draw.choices("abcdefgx", k=6)
        pairs = pairs_of(words)
        best = 0.0
        for i in range(len(pairs)):
            for j in range(i, min(len(pairs), i + int(len(pairs_of(template.split())) * 1.5 + 1e-9))):
                part = set(pairs[i:j + 1])
                best = max(best, 2.0 * len(part & own) / (len(part) + len(own)))
        got = licences._windows(pairs, known)
        assert (got[0][0] if got else 0.0) == pytest.approx(best if best >= 0.8 else 0.0)
        hits += best >= 0.8
    assert 100 < hits < 400


def test_report_of_a_wrapped_notice(spark):
    rows = [(1, PROSE + "\n" + "\n".join(textwrap.wrap(NOTICES[0], 40)) + "\n" + PROSE), (2, PROSE)]
    got = {r["doc_id"]: (r["license"], r["n_passages"]) for r in licences.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("BSD-3-Clause", 1), 2: (None, 0)}
