"""Awkward rows that every operator must take, and small readers."""

SF = "/root/testdata/sf0.001"

# null id and text, empty, blank, repeated rows, one id with two texts, a long text, text beyond the BMP
AWKWARD = [
    (None, None, None, None), (None, "a b", None, "src1"), (9001, "", "en", None), (9002, " \n\t", None, ""), (9003, "x y z", "en", "src1"),
    (9003, "x y z", "en", "src1"), (9004, "one text", "fr", "src2"), (9004, "other text", "fr", "src2"), (9005, "w " * 30000, "de", "src3"),
    (9006, "\U0001F600é ß " * 40, "es", "src4"), (9007, "a" * 20000, None, "src5"), (9008, "123 456 !!", "en", "src6"),
]


def awkward(spark):
    """The rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    extra = ["spans", "score", "ids", "row", "_text", "text_hash", "set_id", "bucket", "label", "size", "found", "text_id", "key"]
    return rows.withColumns({name: F.lit(7) for name in extra})


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(value):
    return None if value != value else value


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]
