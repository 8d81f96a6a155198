"""The queries of the corpus operators: each reads its whole table and calls its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from furrow.llm import (
    audit, bpe, language_id, licences, mixing, near_dedup, neighbours, packing, page_text, pii, repeats, runs, syncmers,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(_read(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents at a similarity of 0.85."""
    found = near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows that are not held out."""
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded again."""
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to their target weights takes of every document."""
    return mixing.report(_read(spark, sf_dir, "documents"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.report(_read(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    return neighbours.search(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its bytes in strings of 200 bytes that occur more than once."""
    return repeats.report(_read(spark, sf_dir, "documents"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence templates found in every document."""
    return licences.report(_read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, per source."""
    return audit.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2048 tokens."""
    return packing.report(_read(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them made periodic."""
    return runs.report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_repeats": op2_repeats,
    "op3_mix": op3_mix,
    "op5_pii": op5_pii,
    "op4_neighbours": op4_neighbours,
    "op6_page_text": op6_page_text,
    "op7_syncmers": op7_syncmers,
    "op8_bpe": op8_bpe,
    "op9_language": op9_language,
    "op10_minhash": op10_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_runs": op13_runs,
}
SQL: dict[str, str] = {
    "op1_licences": licences.sql(),
    "op5_pii": pii.sql(),
    "op10_minhash": near_dedup.sql(percent=85),
    "op11_filter_audit": audit.sql(),
}
