import helpers
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_one_after_the_other(spark, tmp_path):
    docs = helpers.documents(spark).unionByName(helpers.awkward(spark).select("doc_id", "text", "lang", "source"), allowMissingColumns=True)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, helpers.SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name in ("language", "near_duplicates", "mix"):
            assert out.join(docs, "doc_id", "left_anti").filter("doc_id IS NOT NULL").count() == 0
        if name == "personal_data":
            assert out.count() == docs.count() and out.filter(F.col("text").contains("@mail")).count() == 0
        docs = out
    assert docs.count() > 100 and docs.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_empty_table(spark):
    docs = helpers.documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, helpers.SF).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in names} and "pipeline" in names
