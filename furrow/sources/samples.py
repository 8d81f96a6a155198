"""Training samples: chip index, file inventory, skip lists, manifests and earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.constants import ALL_COUNTRIES, FULL_DATA_COUNTRIES, SPLITS
from furrow.functions import text


def read_chips(spark: SparkSession, root: str) -> DataFrame:
    """Chip index below ``root`` (``<country>/chips_<country>.parquet``); country from the path."""
    path = F.regexp_extract(F.col("_metadata.file_path"), r"chips_([a-z_]+)\.parquet", 1)
    return spark.read.option("pathGlobFilter", "chips_*.parquet").option("recursiveFileLookup", True).parquet(root).select(
        "*", path.alias("country")
    )


def of_split(chips: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return chips.filter(F.col("split") == split)


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Sample files by kind; only names are read, not contents."""
    path = F.col("path")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(root)
    return listing.select(
        path,
        F.regexp_extract(path, r"/([^/]+)/(?:s2_images|label_masks)/", 1).alias("country"),
        F.regexp_extract(path, r"/(?:s2_images|label_masks)/([^/]+)/", 1).alias("kind"),
        F.regexp_extract(path, r"/([^/]+)\.tif$", 1).alias("aoi_id"),
    )


def read_skip_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("country string, aoi_id string").csv(path)
    return rows.withColumn("aoi_id", F.trim("aoi_id")).distinct()


def assemble(chips: DataFrame, files: DataFrame, boundaries: bool = False, edges: bool = False) -> DataFrame:
    """Chips that have both windows and the chosen mask, with their paths.

    One pivot of the inventory by kind and one join. A missing edge file is an error, not a skip.
    """
    mask = "semantic_3class" if boundaries else "semantic_2class"
    kinds = {"window_a": "window_a", "window_b": "window_b", "mask": mask} | ({"edge": "edges"} if edges else {})
    paths = files.filter(F.col("kind").isin(list(kinds.values()))).groupBy("country", "aoi_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(n) for n, k in kinds.items()]
    )
    ready = chips.join(paths, ["country", "aoi_id"]).filter(
        F.col("window_a").isNotNull() & F.col("window_b").isNotNull() & F.col("mask").isNotNull()
    )
    if edges:
        ready = ready.withColumn("edge", F.coalesce(
            "edge", F.raise_error(F.concat(F.lit("missing edge file for "), F.col("aoi_id").cast("string"))).cast("string")
        ))
    return ready


def without_skipped(samples: DataFrame, skips: DataFrame) -> DataFrame:
    return samples.join(skips.select("country", "aoi_id"), ["country", "aoi_id"], "left_anti")


def without_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: only what has no result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def layout_report(chips_files: DataFrame, files: DataFrame, boundaries: bool = False) -> DataFrame:
    """Per country: exactly one chip index and every required folder."""
    mask = "semantic_3class" if boundaries else "semantic_2class"
    need = ["window_a", "window_b", mask]
    per = files.groupBy("country").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{i}") for i, k in enumerate(need)])
    idx = chips_files.groupBy("country").agg(F.count(F.lit(1)).alias("n_index"))
    out = idx.join(per, "country", "full_outer").na.fill(0)
    ok = (F.col("n_index") == 1) & (F.col("n_0") > 0) & (F.col("n_1") > 0) & (F.col("n_2") > 0)
    return out.withColumn("ok", ok).withColumnsRenamed({"n_0": "n_window_a", "n_1": "n_window_b", "n_2": "n_mask"})


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """``md5 path`` lines; lines without two parts are left out."""
    parts = F.split(F.trim(column), r"\s+")
    return lines.filter(F.size(parts) == 2).select(
        F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(0)).alias("md5")
    )


def parse_country_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """``country,md5`` lines; the country in lower case."""
    parts = F.split(F.trim(column), ",")
    return lines.filter(F.size(parts) == 2).select(
        F.lower(F.trim(F.get(parts, F.lit(0)))).alias("country"), F.trim(F.get(parts, F.lit(1))).alias("md5")
    )


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.md5("content").alias("md5"))


def check_manifest(expected: DataFrame, actual: DataFrame, version: list[str] | None = None) -> DataFrame:
    """Status per path: ok, mismatch, missing (listed, no file) or no_checksum.

    Where several files were stored under one path, ``version`` names the columns that tell them apart on both sides.
    """
    keys = ["path", *(version or [])]
    e = expected.select(*keys, F.col("md5").alias("expected"))
    a = actual.select(*keys, F.col("md5").alias("actual"))
    status = (
        F.when(F.col("expected").isNull(), "no_checksum").when(F.col("actual").isNull(), "missing")
        .when(F.col("expected") == F.col("actual"), "ok").otherwise("mismatch")
    )
    return e.join(a, keys, "full_outer").withColumn("status", status)


def expand_countries(countries: list[str]) -> list[str]:
    """``full_data`` (or ``all``) anywhere replaces the whole list."""
    if "full_data" in countries:
        return list(FULL_DATA_COUNTRIES)
    if "all" in countries:
        return list(ALL_COUNTRIES)
    return list(countries)


def parse_countries(requests: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Comma-separated requests -> known countries, one row each; ``known``: ``country, full_data``.

    ``full_data`` or ``all`` in a request stands for the whole matching list.
    """
    asked = requests.withColumn("_list", text.country_list(F.col(column)))
    macro = (
        F.when(F.array_contains("_list", "full_data"), "full_data")
        .when(F.array_contains("_list", "all"), "all")
    )
    asked = asked.withColumn("_macro", macro)
    plain = asked.filter(F.col("_macro").isNull()).withColumn("country", F.explode(F.array_distinct("_list")))
    plain = plain.join(known.select("country"), "country", "left_semi")
    whole = known.agg(
        F.collect_set(F.when(F.col("full_data"), F.col("country"))).alias("_full"), F.collect_set("country").alias("_all")
    )
    sets = F.when(F.col("_macro") == "full_data", F.col("_full")).otherwise(F.col("_all"))
    macros = asked.filter(F.col("_macro").isNotNull())
    expanded = macros.withColumns({
        "_full": whole.select("_full").scalar(), "_all": whole.select("_all").scalar(),
    }).withColumn("country", F.explode(sets)).drop("_full", "_all")
    return plain.unionByName(expanded.select(plain.columns)).drop("_list", "_macro")


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def country_label(countries: Column, full: Column) -> Column:
    """Joined list, or ``all`` for exactly the full-data set."""
    return F.when(same_set(countries, full), F.lit("all")).otherwise(F.concat_ws(";", countries))


def done_set(spark: SparkSession, root: str, pattern: str = r"consensus_results_(.+)\.csv") -> DataFrame:
    """Keys of finished results from their file names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_extract("path", pattern, 1).alias("key")).filter(F.col("key") != "").distinct()


def counts_report(samples: DataFrame, labelled: DataFrame, bad: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group: samples there are, those selected (labelled and not bad) and those filtered out as bad."""
    marked = samples.join(labelled.select(*keys).distinct().withColumn("_has", F.lit(True)), keys, "left").join(
        bad.select(*keys).distinct().withColumn("_bad", F.lit(True)), keys, "left")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("existing"), F.count_if(F.col("_has") & F.col("_bad").isNull()).alias("selected"), F.count_if("_bad").alias("filtered"))
