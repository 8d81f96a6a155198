"""Columns whose names the operators use themselves keep their values."""

import public_tokenizers
from furrow.llm import bpe, licences, page_text
from pyspark.sql import functions as F


def test_hidden_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "<p>page</p>")], "doc_id long, text string, html string").withColumns(
        {n: F.lit(7) for n in ("_text", "_TEXT_", "_html", "_text__")})
    for made in (bpe.encode(docs, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN), licences.scan(docs), page_text.extract(docs)):
        row = made.first()
        assert [row[n] for n in ("_text", "_TEXT_", "_html", "_text__")] == [7, 7, 7, 7] and row["doc_id"] == 1
