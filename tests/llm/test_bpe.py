import hashlib
import random

import helpers
import public_tokenizers
import tiktoken
from furrow.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


def test_ids_and_round_trip(spark):
    ranks = bpe.load_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = helpers.documents(spark).select("doc_id", "text").unionByName(helpers.awkward(spark).select("doc_id", "text"))
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == reference.encode_ordinary(text) and r["n_tokens"] == len(r["ids"]) and bytes(r["decoded"]) == text.encode()
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert digests == {(
        r["doc_id"], r["n_tokens"], hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(bytes(r["decoded"])).hexdigest()
    ) for r in got}


def test_one_tree_and_many_trees_agree():
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("theandingoré ") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    pieces = [p for p in pieces if p not in ranks]
    assert bpe.merge_many(pieces, bpe.PairTable(ranks)) == [bpe.merge_pairs(p, ranks) for p in pieces]


def test_long_texts_in_parts(monkeypatch):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    text = "Some words, some more words; and 1234 numbers.\n" * 30
    whole = b"".join(f[1] for _, found in codec.pieces([text]) for f in found)
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "STEP", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert b"".join(f[1] for _, found in codec.pieces([text]) for f in found) == whole


def test_long_run_is_fast():
    ids = bpe.merge_pairs(b"a" * 100_000, bpe.load_ranks(PATH))
    assert sum(len(bpe.Codec(PATH, public_tokenizers.PATTERN).tokens[i]) for i in set(ids)) > 0


def test_empty_table(spark):
    assert bpe.digests(helpers.awkward(spark).limit(0), PATH, public_tokenizers.PATTERN).count() == 0
