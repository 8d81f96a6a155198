"""Evaluation queries: confusion, object matching, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.fields import reach_sql
from furrow.checks.pixels import unit
from furrow.checks.registry import query, with_
from furrow.operators import evaluation as E
from furrow.plans import flows
from furrow.session import cut, scratch_path
from furrow.sinks import writers

SIDE = 32
KEY = ["raster_id"]
CHIPS = B.cells_sql(SIDE)
WHOLE = 1 << 20


def chips(spark, sf_dir):
    """Evaluation chips with their country."""
    return B.chip_country(B.cells(spark, sf_dir, SIDE), B.table(spark, sf_dir, "nation"))


MATCH_SQL = (
    CHIPS, reach_sql("tr", "cls = 1", WHOLE), reach_sql("pr", "pred = 1", WHOLE), """
ts AS (SELECT raster_id, comp AS t, count(*) AS nt FROM tr GROUP BY 1, 2),
ps AS (SELECT raster_id, comp AS p, count(*) AS np FROM pr GROUP BY 1, 2),
both_c AS (SELECT tr.raster_id, tr.comp AS t, pr.comp AS p, count(*) AS nb FROM tr JOIN pr USING (raster_id, y, x) GROUP BY 1, 2, 3),
matched AS (SELECT b.raster_id, t, p, nb / (nt + np - nb)::DOUBLE AS iou FROM both_c b JOIN ts USING (raster_id, t) JOIN ps USING (raster_id, p)
  WHERE nb / (nt + np - nb)::DOUBLE > 0.5)""")

STATS_SQL = (*MATCH_SQL, """
px AS (SELECT raster_id, count_if(cls <> 3 AND cls = 1 AND pred = 1)::BIGINT AS p_tp, count_if(cls <> 3 AND cls <> 1 AND pred = 1)::BIGINT AS p_fp,
  count_if(cls = 1 AND pred <> 1)::BIGINT AS p_fn FROM cells GROUP BY 1),
st AS (SELECT px.*, coalesce(m.n, 0)::BIGINT AS o_tp, (coalesce(p.n, 0) - coalesce(m.n, 0))::BIGINT AS o_fp, (coalesce(t.n, 0) - coalesce(m.n, 0))::BIGINT AS o_fn
  FROM px LEFT JOIN (SELECT raster_id, count(*) AS n FROM matched GROUP BY 1) m USING (raster_id)
  LEFT JOIN (SELECT raster_id, count(*) AS n FROM ps GROUP BY 1) p USING (raster_id)
  LEFT JOIN (SELECT raster_id, count(*) AS n FROM ts GROUP BY 1) t USING (raster_id))""")

METRIC_SQL = """
round(p_tp / (p_tp + p_fp + p_fn)::DOUBLE, 6) AS pixel_iou, round(p_tp / (p_tp + p_fp)::DOUBLE, 6) AS pixel_precision,
round(p_tp / (p_tp + p_fn)::DOUBLE, 6) AS pixel_recall, round(o_tp / (o_tp + o_fp)::DOUBLE, 6) AS object_precision,
round(o_tp / (o_tp + o_fn)::DOUBLE, 6) AS object_recall, round(2.0::DOUBLE * o_tp / (2 * o_tp + o_fp + o_fn), 6) AS object_f1"""
SUMS_SQL = "sum(p_tp)::BIGINT AS p_tp, sum(p_fp)::BIGINT AS p_fp, sum(p_fn)::BIGINT AS p_fn, sum(o_tp)::BIGINT AS o_tp, sum(o_fp)::BIGINT AS o_fp, sum(o_fn)::BIGINT AS o_fn"


@query("A1_J14_confusion_matrix", with_(CHIPS, body="SELECT raster_id, cls::BIGINT AS label, pred::BIGINT AS pred, count(*) AS n FROM cells WHERE cls <> 3 GROUP BY 1, 2, 3"))
def confusion(spark, sf_dir):
    """Labels and predictions kept as two tables and joined pixel by pixel."""
    c = B.cells(spark, sf_dir, SIDE)
    both = c.select(*KEY, "y", "x", "cls").join(c.select(*KEY, "y", "x", "pred"), [*KEY, "y", "x"])
    return E.confusion(both, KEY)


CLASS_SQL = """
cc AS (SELECT raster_id, k, count_if(cls = k AND pred = k)::BIGINT AS tp, count_if(cls <> k AND pred = k)::BIGINT AS fp,
  count_if(cls = k AND pred <> k)::BIGINT AS fn FROM cells, range(3) t(k) WHERE cls <> 3 GROUP BY 1, 2)"""


@query("A2_class_scores", with_(CHIPS, CLASS_SQL, body="""
SELECT raster_id, k, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0 END AS recall,
  CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn)::DOUBLE, 6) ELSE 0 END AS iou FROM cc"""))
def class_scores(spark, sf_dir):
    return E.class_scores(E.class_counts(E.confusion(B.cells(spark, sf_dir, SIDE), KEY), KEY, 3))


@query("A3_macro_scores", with_(CHIPS, CLASS_SQL, body="""
SELECT raster_id, round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END), 6) AS precision_macro,
  round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END), 6) AS recall_macro,
  round(avg(tp / (tp + fp + fn)::DOUBLE), 6) AS iou_macro FROM cc WHERE tp + fp + fn > 0 GROUP BY 1"""))
def macro(spark, sf_dir):
    scores = E.class_scores(E.class_counts(E.confusion(B.cells(spark, sf_dir, SIDE), KEY), KEY, 3))
    return E.macro_scores(scores, KEY)


@query("J11_object_matches", with_(*MATCH_SQL, body="SELECT raster_id, t, p, round(iou, 6) AS iou FROM matched", recursive=True))
def matches(spark, sf_dir):
    return E.object_overlaps(B.cells(spark, sf_dir, SIDE), KEY).filter("match").select("raster_id", "t", "p", "iou")


@query("E3_unmatched_predictions", with_(*MATCH_SQL, body="""
SELECT raster_id, p FROM ps WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.raster_id = ps.raster_id AND m.p = ps.p)""", recursive=True))
def unmatched(spark, sf_dir):
    met = E.object_overlaps(B.cells(spark, sf_dir, SIDE), KEY)
    return met.filter(F.col("p_first") & ~F.col("p_matched")).select("raster_id", "p")


@query("A4_chip_stats", with_(*STATS_SQL, body="SELECT * FROM st", recursive=True))
def chip_stats(spark, sf_dir):
    return E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY)


@query("A4_J11_chips_wider_than_a_tile", with_(*STATS_SQL, body="SELECT * FROM st", recursive=True))
def chip_stats_over_tiles(spark, sf_dir):
    """Tiles far smaller than a chip: objects that cross their edges stay whole."""
    return E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY, stride=5)


@query("A5_E2_pooled_metrics", with_(*STATS_SQL, f"pooled AS (SELECT {SUMS_SQL} FROM st)", body=f"SELECT *, {METRIC_SQL} FROM pooled", recursive=True))
def pooled(spark, sf_dir):
    """Metrics of all chips pooled: sums of counts stand for concatenated pixels."""
    return E.metrics_from_counts(E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY).agg(*E.sum_counts()))


@query("A6_validation_object_scores", with_(*STATS_SQL, body="""
SELECT raster_id, CASE WHEN o_tp + o_fp > 0 THEN round(o_tp / (o_tp + o_fp)::DOUBLE, 6) ELSE 0 END AS object_precision,
  CASE WHEN o_tp + o_fn > 0 THEN round(o_tp / (o_tp + o_fn)::DOUBLE, 6) ELSE 0 END AS object_recall,
  CASE WHEN o_tp > 0 THEN round(2.0::DOUBLE * o_tp / (2 * o_tp + o_fp + o_fn), 6) ELSE 0 END AS object_f1 FROM st""", recursive=True))
def validation_scores(spark, sf_dir):
    """Per chip, with 0 instead of NaN where nothing was found."""
    stats = E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY)
    return E.metrics_from_counts(stats, empty=0.0).select("raster_id", "object_precision", "object_recall", "object_f1")


@query("A21_country_metrics", with_(*STATS_SQL, f"""
per AS (SELECT n_name AS country, {SUMS_SQL}, count(*) AS chips FROM st JOIN nation ON n_nationkey = raster_id % 25 GROUP BY 1
  UNION ALL SELECT 'all', {SUMS_SQL}, count(*) FROM st)""", body=f"SELECT country, chips, p_tp, p_fp, p_fn, o_tp, o_fp, o_fn, {METRIC_SQL} FROM per", recursive=True))
def country_metrics(spark, sf_dir):
    """The evaluation flow: everything and each country from one rollup."""
    return flows.evaluate(chips(spark, sf_dir), KEY)


@query("K5_metrics_append", with_(*STATS_SQL, f"pooled AS (SELECT {SUMS_SQL} FROM st)", body=f"""
SELECT model, {METRIC_SQL} FROM pooled, (SELECT unnest(['first', 'second']) AS model)""", recursive=True))
def metrics_append(spark, sf_dir):
    path = scratch_path(spark, "results")
    row = cut(E.metrics_from_counts(E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY).agg(*E.sum_counts())))
    for model in ("first", "second"):
        writers.append_metrics(row.select(F.lit(model).alias("model"), *E.METRICS), path)
    return spark.read.parquet(path)


DRAW_SQL = f"""
ix AS (SELECT *, row_number() OVER (ORDER BY raster_id) - 1 AS idx, count(*) OVER () AS total FROM st),
draws AS (SELECT rep, floor({unit('rep, idx')} * total)::BIGINT AS idx FROM ix, range(1000) t(rep)),
reps AS (SELECT rep, {SUMS_SQL} FROM draws JOIN ix USING (idx) GROUP BY 1),
mets AS (SELECT p_tp / (p_tp + p_fp + p_fn)::DOUBLE AS pixel_iou, p_tp / (p_tp + p_fp)::DOUBLE AS pixel_precision,
  p_tp / (p_tp + p_fn)::DOUBLE AS pixel_recall, o_tp / (o_tp + o_fp)::DOUBLE AS object_precision,
  o_tp / (o_tp + o_fn)::DOUBLE AS object_recall, 2.0::DOUBLE * o_tp / (2 * o_tp + o_fp + o_fn) AS object_f1 FROM reps),
long AS (UNPIVOT mets ON COLUMNS(*) INTO NAME metric VALUE v)"""


@query("A7_R6_bootstrap_draws", with_(*STATS_SQL, DRAW_SQL, body="""
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM long GROUP BY 1""", recursive=True))
def bootstrap_draws(spark, sf_dir):
    return E.bootstrap_by_draws(cut(E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY)), "raster_id")


@query("A7_bootstrap_blocks")
def bootstrap_blocks(spark, sf_dir):
    """Same law, block-wise multinomials; no draw is shuffled."""
    return E.bootstrap_by_blocks(cut(E.chip_stats(B.cells(spark, sf_dir, SIDE), KEY)), "raster_id")


@query("A19_class_weights", with_(CHIPS, """
n AS (SELECT raster_id, count(*) AS n, count_if(cls = 0) AS n0, count_if(cls = 1) AS n1, count_if(cls = 2) AS n2 FROM cells WHERE cls <> 3 GROUP BY 1),
w AS (SELECT *, n / nullif(n0, 0)::DOUBLE AS i0, n / nullif(n1, 0)::DOUBLE AS i1, n / nullif(n2, 0)::DOUBLE AS i2 FROM n)""", body="""
SELECT raster_id, round(coalesce(i0 / (coalesce(i0, 0) + coalesce(i1, 0) + coalesce(i2, 0)), 1e-5), 6) AS w0,
 round(coalesce(i1 / (coalesce(i0, 0) + coalesce(i1, 0) + coalesce(i2, 0)), 1e-5), 6) AS w1,
 round(coalesce(i2 / (coalesce(i0, 0) + coalesce(i1, 0) + coalesce(i2, 0)), 1e-5), 6) AS w2 FROM w"""))
def class_weights(spark, sf_dir):
    w = E.class_weights(B.cells(spark, sf_dir, SIDE), "raster_id", 3)
    return w.select("raster_id", *[F.get("class_weights", F.lit(k)).alias(f"w{k}") for k in range(3)])
