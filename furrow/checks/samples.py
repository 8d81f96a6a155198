"""Sample index, inventory, manifest and subsampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.registry import query, with_
from furrow.functions import text
from furrow.operators import sampling
from furrow.session import scratch_path
from furrow.sinks import writers
from furrow.sources import samples as C


@query("S1_P3_chip_index", with_(B.CHIPS_SQL, body="SELECT country, aoi_id FROM chips WHERE split = 'train'"))
def chip_index(spark, sf_dir):
    """Chip index written per country, scanned back, one split kept."""
    path = scratch_path(spark, "chips")
    B.chips(spark, sf_dir).write.partitionBy("country").parquet(path)
    return C.of_split(spark.read.parquet(path), "train").select("country", "aoi_id")


@query("S2_J1_sample_assembly", with_(B.CHIPS_SQL, B.FILES_SQL, body="""
SELECT c.country, c.aoi_id, c.split, a.path AS window_a, b.path AS window_b, m.path AS mask FROM chips c
JOIN files a ON a.aoi_id = c.aoi_id AND a.kind = 'window_a' JOIN files b ON b.aoi_id = c.aoi_id AND b.kind = 'window_b'
JOIN files m ON m.aoi_id = c.aoi_id AND m.kind = 'semantic_2class'"""))
def assembly(spark, sf_dir):
    return C.assemble(B.chips(spark, sf_dir), B.sample_files(spark, sf_dir)).select(
        "country", "aoi_id", "split", "window_a", "window_b", "mask")


@query("S2_three_class_assembly", with_(B.CHIPS_SQL, B.FILES_SQL, body="""
SELECT c.country, c.aoi_id, m.path AS mask FROM chips c
JOIN files a ON a.aoi_id = c.aoi_id AND a.kind = 'window_a' JOIN files b ON b.aoi_id = c.aoi_id AND b.kind = 'window_b'
JOIN files m ON m.aoi_id = c.aoi_id AND m.kind = 'semantic_3class'"""))
def assembly_three(spark, sf_dir):
    return C.assemble(B.chips(spark, sf_dir), B.sample_files(spark, sf_dir), boundaries=True).select("country", "aoi_id", "mask")


@query("S3_layout_report", with_(B.FILES_SQL, body="""
SELECT country, 1::BIGINT AS n_index, count_if(kind = 'window_a')::BIGINT AS n_window_a, count_if(kind = 'window_b')::BIGINT AS n_window_b,
  count_if(kind = 'semantic_3class')::BIGINT AS n_mask, count_if(kind = 'window_a') > 0 AND count_if(kind = 'window_b') > 0
  AND count_if(kind = 'semantic_3class') > 0 AS ok FROM files GROUP BY country"""))
def layout(spark, sf_dir):
    index = B.chips(spark, sf_dir).select("country").distinct()
    return C.layout_report(index, B.sample_files(spark, sf_dir), boundaries=True)


@query("S4_J2_skip_list", with_(B.CHIPS_SQL, B.SKIP_SQL, body="""
SELECT country, aoi_id, split FROM chips c WHERE NOT EXISTS (SELECT 1 FROM skips s WHERE s.country = c.country AND s.aoi_id = c.aoi_id)"""))
def skipped(spark, sf_dir):
    """Skip list written as CSV, read back and taken out."""
    path = scratch_path(spark, "skips")
    B.skip_list(spark, sf_dir).select("country", "aoi_id").write.csv(path)
    bad = C.read_skip_list(spark, path).withColumn("aoi_id", F.col("aoi_id").cast("bigint"))
    return C.without_skipped(B.chips(spark, sf_dir), bad).select("country", "aoi_id", "split")


@query("J3_S12_resume", """
SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels USING (doc_id)
WHERE quality = 0 AND toxic = 1)""")
def resume(spark, sf_dir):
    """Work left after earlier results; results are read back from a metrics table."""
    path = scratch_path(spark, "metrics")
    d = B.table(spark, sf_dir, "documents")
    bad = B.table(spark, sf_dir, "labels").filter((F.col("quality") == 0) & (F.col("toxic") == 1))
    writers.write_csv(d.join(bad, "doc_id", "left_semi").select("source").distinct(), path)
    done = spark.read.schema("source string").option("header", True).csv(path)
    return C.without_done(d.select("doc_id", "source"), done, "source")


@query("P1_P2_country_parse", """
WITH q AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ' DE,fr ,xx' WHEN 'MACHINERY' THEN 'fr,full_data' ELSE 'en, Es,' END AS raw FROM customer),
known AS (SELECT DISTINCT lang AS country FROM documents),
parts AS (SELECT c_custkey, raw, trim(unnest(string_split(lower(raw), ','))) AS country FROM q)
SELECT DISTINCT p.c_custkey, k.country FROM parts p JOIN known k USING (country) WHERE p.raw NOT LIKE '%full_data%'
UNION ALL SELECT q.c_custkey, k.country FROM q, known k WHERE q.raw LIKE '%full_data%' AND k.country <> 'en'""")
def country_parse(spark, sf_dir):
    """Country requests against the country dimension; English plays presence-only."""
    seg = F.col("c_mktsegment")
    raw = F.when(seg == "BUILDING", " DE,fr ,xx").when(seg == "MACHINERY", "fr,full_data").otherwise("en, Es,")
    known = B.table(spark, sf_dir, "documents").select(F.col("lang").alias("country")).distinct()
    asked = B.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return C.parse_countries(asked, "raw", known.withColumn("full_data", F.col("country") != "en")).select("c_custkey", "country")


@query("S10_manifest_parse", """
SELECT url AS path, md5(html) AS md5 FROM pages WHERE length(url) % 5 <> 0""")
def manifest_parse(spark, sf_dir):
    """Checksum lines, some with a missing part."""
    line = F.when(F.length("url") % 5 == 0, F.md5("html")).otherwise(F.concat_ws("  ", F.md5("html"), "url"))
    return C.parse_manifest(B.table(spark, sf_dir, "pages").select(line.alias("value")))


@query("S10_country_manifest", """
SELECT lower(lang) AS country, md5(text) AS md5 FROM documents WHERE doc_id % 3 <> 0""")
def country_manifest(spark, sf_dir):
    """Country and checksum in one line; lines with a part too many are left out."""
    line = F.concat_ws(",", F.concat(F.lit(" "), F.upper("lang")), F.md5("text"), F.when(F.col("doc_id") % 3 == 0, "more"))
    return C.parse_country_manifest(B.table(spark, sf_dir, "documents").select(line.alias("value")))


@query("S11_content_hash", "SELECT url AS path, md5(html) AS md5 FROM pages")
def content_hash(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.md5("html").alias("md5"))


@query("J12_manifest_check", """
SELECT url AS path, CASE WHEN page_id % 7 = 3 THEN 'no_checksum' WHEN page_id % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM pages""")
def manifest_check(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    listed = F.when(F.col("page_id") % 10 == 0, F.md5(F.concat("html", F.lit("x")))).otherwise(F.md5("html"))
    expected = p.withColumn("md5", F.when(F.col("page_id") % 7 != 3, listed)).filter("md5 IS NOT NULL")
    actual = p.select(F.col("url").alias("path"), "page_id", F.md5("html").alias("md5"))
    # an address can hold several pages
    return C.check_manifest(expected.select(F.col("url").alias("path"), "page_id", "md5"), actual, ["page_id"]).select("path", "status")


RANKED = """SELECT country, aoi_id, row_number() OVER (ORDER BY md5(concat_ws('|', country, aoi_id, 42)), country, aoi_id) AS rn,
  count(*) OVER () AS n FROM chips WHERE split = 'train'"""


@query("R1_percent_subsample", with_(B.CHIPS_SQL, body=f"""
SELECT country, aoi_id FROM ({RANKED}) WHERE rn <= greatest(1, floor(n * 12.5 / 100))"""))
def percent_subsample(spark, sf_dir):
    return sampling.subsample(B.chips(spark, sf_dir), ["country", "aoi_id"], percent=12.5).select("country", "aoi_id")


@query("R1_fixed_subsample", with_(B.CHIPS_SQL, body=f"SELECT country, aoi_id FROM ({RANKED}) WHERE rn <= 50"))
def fixed_subsample(spark, sf_dir):
    return sampling.subsample(B.chips(spark, sf_dir), ["country", "aoi_id"], num_samples=50).select("country", "aoi_id")


@query("A18_counts_report", with_(B.CHIPS_SQL, B.FILES_SQL, B.SKIP_SQL, body="""
SELECT c.country, c.split, count(*) AS existing, count_if(m.aoi_id IS NOT NULL AND s.aoi_id IS NULL)::BIGINT AS selected,
  count_if(s.aoi_id IS NOT NULL)::BIGINT AS filtered FROM chips c
LEFT JOIN (SELECT aoi_id FROM files WHERE kind = 'semantic_2class') m USING (aoi_id)
LEFT JOIN skips s ON s.aoi_id = c.aoi_id AND s.country = c.country GROUP BY 1, 2"""))
def counts(spark, sf_dir):
    has = B.sample_files(spark, sf_dir).filter(F.col("kind") == "semantic_2class").select("country", "aoi_id")
    return C.counts_report(B.chips(spark, sf_dir), has, B.skip_list(spark, sf_dir), ["country", "aoi_id"], ["country", "split"])


@query("E4_K5_country_label", """
WITH full_set AS (SELECT list_sort(list(DISTINCT lang)) AS f FROM documents),
per AS (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY source)
SELECT source, CASE WHEN l = f THEN 'all' ELSE array_to_string(l, ';') END AS countries FROM per, full_set""")
def country_label(spark, sf_dir):
    """Countries of each source as the metrics sink writes them."""
    d = B.table(spark, sf_dir, "documents")
    full = d.agg(F.sort_array(F.collect_set("lang")).alias("f")).scalar()
    per = d.groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    return per.select("source", C.country_label(F.col("l"), full).alias("countries"))


@query("T8_result_key", "SELECT page_id, replace(replace(url || '/last.ckpt', '/', '_'), '.ckpt', '') AS key FROM pages")
def result_key(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", text.result_key(F.concat("url", F.lit("/last.ckpt"))).alias("key"))


@query("T10_edge_path", with_(B.FILES_SQL, body="SELECT aoi_id, kind, replace(path, 'semantic_3class', 'edges') AS edge FROM files"))
def edge_path(spark, sf_dir):
    return B.sample_files(spark, sf_dir).select("aoi_id", "kind", text.edge_path(F.col("path")).alias("edge"))


@query("S12_done_set", "SELECT DISTINCT lang || '_' || source AS key FROM documents")
def done_set(spark, sf_dir):
    """Finished results recognised by path: one result folder per key."""
    path = scratch_path(spark, "results")
    keyed = B.table(spark, sf_dir, "documents").select(F.concat_ws("_", "lang", "source").alias("key"), "doc_id")
    keyed.write.partitionBy("key").parquet(path)
    return C.done_set(spark, path, r"/key=([^/]+)/")
