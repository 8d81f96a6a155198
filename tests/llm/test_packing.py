import random
import zlib
from collections import defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest
from furrow.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def padding(rows, capacity=packing.CAPACITY):
    """Share of padded ids, after a look at every sequence's offsets."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    padded = total = 0
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(1, total)


def test_every_id_in_one_piece(spark):
    docs = helpers.documents(spark).select("doc_id", "text")
    texts = dict(helpers.rows_of(docs))
    want = dict(zip(texts, ids_of(texts.values()), strict=True))
    rows = packing.report(docs, PATH).collect()
    seen = defaultdict(list)
    for r in rows:
        own = want[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
    for doc_id, own in want.items():
        at = 0
        for start, length in sorted(seen[doc_id]):
            assert start == at
            at += length
        assert at == len(own)
    assert padding(rows) < 0.005


def test_words_give_the_ids_of_the_whole_text():
    rng = random.Random(2)
    chars = "aB'sé́ Σς  \n\t\x0b\x1c\x85日本😀1٣<|endoftext|>.,!İıﬁÅ"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["<|startoftext|> x<|endoftext|>", "x" * 500 + " y" * 9]
    letters = [chr(c) for c in range(0x21, 0x250)] + ["'s", "'LL", "'d", "<|endoftext|>", "E\u0301", "\u212b", "ẞ", "Σ"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(600)] + ["Tab\x00x", "a\xa0b", "a\u2028b", "\xad", "x\x7fy"]
    encoder = packing.Encoder(PATH)
    for text, want in zip(texts, ids_of(texts), strict=True):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want[:-1], repr(text)


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    monkeypatch.setattr(packing, "KNOWN", 20)
    text = " ".join(f"word{i} it's" for i in range(300)) + "z" * 200
    assert np.frombuffer(packing.Encoder(PATH).encode(text.encode()), "<u4").tolist() == ids_of([text])[0][:-1]


def test_pieces_are_reciprocal_parts():
    for n in range(1, 5000):
        cut = packing.piece_lengths(n)
        assert sum(cut) == n and all(c & (c - 1) == 0 for c in cut[:-1]) and (cut[-1] < packing.WHOLE or cut[-1] & (cut[-1] - 1) == 0)


@pytest.mark.parametrize("capacity", [1, 8, 2048])
def test_bins_of_one_class_hold_a_fixed_number(capacity):
    rng = random.Random(capacity)
    bins = packing.Bins(7 << 32, capacity)
    total = 0
    for i in range(3000):
        n = rng.randint(1, capacity)
        bins.add((i, 0, bytes(4 * n), n))
        total += n
    assert all(len(held) < k for k, held in bins.open.items())
    by_sequence = defaultdict(list)
    for row in bins.done:
        by_sequence[row[5]].append(row[2])
    for lengths in by_sequence.values():
        assert {capacity // n for n in lengths} == {len(lengths)}
    bins.finish()
    rows = [{"sequence_id": d[5], "offset": d[6], "length": d[2]} for d in bins.done]
    padding(rows, capacity)
    assert sum(r["length"] for r in rows) == total


def test_awkward_rows_and_small_tables(spark):
    docs = helpers.awkward(spark)
    rows = packing.pack(docs, PATH).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids_of([t for _, t, _, _ in helpers.AWKWARD])))
    assert padding(rows) < 0.02
    assert {r["doc_id"] for r in rows} == {i for i, _, _, _ in helpers.AWKWARD}
    assert packing.pack(docs.limit(0), PATH).count() == 0
    one = packing.pack(spark.createDataFrame([(3, None)], "doc_id long, text string"), PATH).collect()
    assert [(r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in one] == [(0, 1, 1, 0)]
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, capacity=100)


def test_no_shuffle(spark):
    assert "Exchange" not in packing.report(helpers.documents(spark), PATH)._jdf.queryExecution().executedPlan().toString()
