"""Pages that share an address are checked against their own checksums."""

from furrow.checks import contract


def test_repeated_addresses(spark, tmp_path):
    rows = [(1, "a", "one"), (2, "a", "two"), (3, "a", "three"), (20, "b", "four"), (11, "b", "five")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = contract.queries()["J12_manifest_check"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a", "no_checksum"), ("a", "ok"), ("a", "ok"), ("b", "mismatch"), ("b", "ok")]
