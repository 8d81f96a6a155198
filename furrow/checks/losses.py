"""Loss values over scored pixels; one batch per raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.registry import query, with_
from furrow.functions.raster_math import gaussian_kernel
from furrow.operators import losses as L

N = 3
BATCH = "raster_id"
WEIGHTS = [0.2, 0.5, 0.3]


def scored(spark, sf_dir):
    """Logits from the line items under each cell."""
    c = B.cells(spark, sf_dir)
    z = [(F.col("s") % 7) / 3.0 - 1.0, (F.col("s") % 5) / 2.0 - 1.0, (F.col("n") % 3) / 1.5 - 0.5]
    return L.scored(c.select(BATCH, "y", "x", "cls", F.array(*z).alias("logits")), N)


LOGITS_SQL = """
lg AS (SELECT raster_id, y, x, cls, (s % 7) / 3.0::DOUBLE - 1.0 AS z0, (s % 5) / 2.0::DOUBLE - 1.0 AS z1, (n % 3) / 1.5::DOUBLE - 0.5 AS z2 FROM cells),
sc AS (SELECT *, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS p0, exp(z1) / (exp(z0) + exp(z1) + exp(z2)) AS p1, exp(z2) / (exp(z0) + exp(z1) + exp(z2)) AS p2,
  CASE WHEN cls = 0 THEN 1.0::DOUBLE ELSE 0 END AS t0, CASE WHEN cls = 1 THEN 1.0::DOUBLE ELSE 0 END AS t1, CASE WHEN cls = 2 THEN 1.0::DOUBLE ELSE 0 END AS t2 FROM lg)"""
BASE = (B.cells_sql(), LOGITS_SQL)


def sums_sql(source: str, where: str = "") -> str:
    parts = ", ".join(f"sum(p{k}) AS sp{k}, sum(t{k}) AS st{k}, sum(p{k} * t{k}) AS pt{k}, sum(p{k} * p{k}) AS pp{k}" for k in range(N))
    return f"sm AS (SELECT raster_id, count(*) AS n, {parts} FROM {source} {where} GROUP BY 1)"


SKIP = sums_sql("sc", "WHERE cls <> 3")
KEEP = sums_sql("sc")
FLAT = f"""
fl AS (SELECT raster_id, {", ".join(f"CASE WHEN cls = 3 THEN 1.0::DOUBLE / 3 ELSE p{k} END AS p{k}" for k in range(N))},
  {", ".join(f"CASE WHEN cls = 3 THEN {1.0 if k == 0 else 0.0}::DOUBLE ELSE t{k} END AS t{k}" for k in range(N))} FROM sc),
{sums_sql("fl")}"""

NLL = "-ln(CASE cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)"
CW = f"(CASE cls WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END)::DOUBLE"
CE_SQL = f"ce AS (SELECT raster_id, sum({NLL}) / count(*) AS ce, sum({NLL} * {CW}) / sum({CW}) AS wce FROM sc WHERE cls <> 3 GROUP BY 1)"


def mean(term: str) -> str:
    return "(" + " + ".join(term.replace("#", str(k)) for k in range(N)) + f") / {N}"


DICE = mean("(CASE WHEN st# > 0 THEN 1 - 2 * pt# / greatest(sp# + st#, 1e-7) ELSE 0 END)")
WDICE = "(" + " + ".join(f"{w} * (CASE WHEN st{k} > 0 THEN 1 - 2 * pt{k} / greatest(sp{k} + st{k}, 1e-7) ELSE 0 END)" for k, w in enumerate(WEIGHTS)) + f") / {N}"


def out(expr: str, name: str, *ctes: str, join: str = "") -> str:
    return with_(*BASE, *ctes, body=f"SELECT raster_id, round({expr}, 6) + 0.0::DOUBLE AS {name} FROM {join or 'sm'}")


def from_sums(mode, name, expr):
    """Query of one loss that is arithmetic on the class sums."""
    def run(spark, sf_dir):
        return L.overlap_sums(scored(spark, sf_dir), BATCH, N, mode=mode).select(BATCH, expr().alias(name))

    return run


@query("L1_weighted_cross_entropy", out("wce", "ce", CE_SQL, join="ce"))
def weighted_ce(spark, sf_dir):
    return L.cross_entropy_sums(scored(spark, sf_dir), BATCH, N, WEIGHTS)


KERNEL = "ker(d, w) AS (VALUES " + ", ".join(f"({i - 3}, {w!r}::DOUBLE)" for i, w in enumerate(gaussian_kernel(7, 3.0))) + ")"
# index mirrored at 0 and 63 without repeating the border
BLUR_SQL = f"""{KERNEL},
b0 AS (SELECT raster_id, y, x, cls, CASE WHEN cls = 2 THEN 1.0::DOUBLE ELSE 0 END AS v FROM cells),
b1 AS (SELECT c.raster_id, c.y, c.x, c.cls, sum(s.v * w) AS v FROM b0 c, ker JOIN b0 s ON s.raster_id = c.raster_id AND s.y = c.y
  AND s.x = CASE WHEN abs(c.x + d) > 63 THEN 126 - abs(c.x + d) ELSE abs(c.x + d) END GROUP BY 1, 2, 3, 4),
b2 AS (SELECT c.raster_id, c.y, c.x, c.cls, sum(s.v * w) AS v FROM b1 c, ker JOIN b1 s ON s.raster_id = c.raster_id AND s.x = c.x
  AND s.y = CASE WHEN abs(c.y + d) > 63 THEN 126 - abs(c.y + d) ELSE abs(c.y + d) END GROUP BY 1, 2, 3, 4)"""


@query("W12_boundary_weights", with_(B.cells_sql(), BLUR_SQL, body="""
SELECT raster_id, y, x, CASE WHEN cls = 3 THEN 0 ELSE round(v * 2 + 1, 6) END AS weight FROM b2"""))
def boundary_weights(spark, sf_dir):
    c = B.cells(spark, sf_dir).select(BATCH, "y", "x", "cls")
    return L.boundary_weights(c, [BATCH], scale=2.0).select(BATCH, "y", "x", "weight")


@query("L2_pixel_weighted_ce", with_(*BASE, BLUR_SQL, body=f"""
SELECT raster_id, round(sum({NLL} * {CW} * (v + 1)) / sum(v + 1), 6) AS pixel_weighted_ce FROM sc JOIN b2 USING (raster_id, y, x, cls) WHERE cls <> 3 GROUP BY 1"""))
def pixel_weighted_ce(spark, sf_dir):
    df = L.boundary_weights(scored(spark, sf_dir), [BATCH])
    return L.pixel_weighted_ce(df, BATCH, N, WEIGHTS)


query("L3_jaccard_masked", out(mean("(CASE WHEN st# > 0 THEN 1 - pt# / greatest(sp# + st# - pt#, 1e-7) ELSE 0 END)"), "loss", FLAT))(
    from_sums("flatten", "loss", lambda: L.masked(L.jaccard(N))))


BCE = "(greatest(z#, 0) - z# * t# + ln(1 + exp(-abs(z#))))"
FOCAL = " + ".join(f"sum(pow(1 - exp(-{BCE}), 2) * {BCE}) / greatest(sum(pow(1 - exp(-{BCE}), 2)), 1e-6) / count(*)".replace("#", str(k)) for k in range(N))


@query("L4_focal", with_(*BASE, body=f"SELECT raster_id, round({FOCAL}, 6) AS focal FROM sc WHERE cls <> 3 GROUP BY 1"))
def focal(spark, sf_dir):
    return L.focal(scored(spark, sf_dir), BATCH, N)


query("L5_tversky", out(mean("(CASE WHEN st# > 0 THEN 1 - pt# / greatest(0.5 * sp# + 0.5 * st#, 1e-7) ELSE 0 END)"), "loss", SKIP))(
    from_sums("skip", "loss", lambda: L.tversky(N)))
query("L6_dice", out(DICE, "loss", SKIP))(from_sums("skip", "loss", lambda: L.dice(N)))
query("L6_dice_masked", out(DICE, "loss", FLAT))(from_sums("flatten", "loss", lambda: L.masked(L.dice(N))))
query("L7_log_cosh_dice", out(f"ln(cosh({WDICE}))", "loss", SKIP))(from_sums("skip", "loss", lambda: L.log_cosh_dice(N, WEIGHTS)))


def with_ce(mode, expr, weights, w1=0.5, w2=0.5):
    """Query of a loss combined with cross-entropy."""
    def run(spark, sf_dir):
        df = scored(spark, sf_dir)
        both = L.overlap_sums(df, BATCH, N, mode=mode, ce_weights=weights).filter("n_valid > 0")
        return both.select(BATCH, L.combined(F.col("ce"), expr(), w1, w2).alias("loss"))

    return run


CE_JOIN = "sm JOIN ce USING (raster_id)"
query("L6_ce_plus_dice", out(f"ce + {DICE}", "loss", SKIP, CE_SQL, join=CE_JOIN))(with_ce("skip", lambda: L.dice(N), None, 1.0, 1.0))
query("L8_log_cosh_dice_ce", out(f"0.5 * wce + 0.5 * ln(cosh({WDICE}))", "loss", SKIP, CE_SQL, join=CE_JOIN))(
    with_ce("skip", lambda: L.log_cosh_dice(N, WEIGHTS), WEIGHTS))


def tanimoto_sql() -> str:
    def one(pl, pp, ll):
        return f"(({pl} + 1e-5) * (" + " + ".join(f"1 / ({2.0**d} * ({pp} + {ll}) - {2 * 2.0**d - 1} * {pl} + 1e-5)" for d in range(5)) + ") / 5)"

    def cls(k):
        dual = one(f"(n - sp{k} - st{k} + pt{k})", f"(n - 2 * sp{k} + pp{k})", f"(n - st{k})")
        return f"{WEIGHTS[k]} * (1 - 0.5 * ({one(f'pt{k}', f'pp{k}', f'st{k}')} + {dual}))"

    return "((" + " + ".join(cls(k) for k in range(N)) + f") / {N})"


query("L9_fractal_tanimoto", out(tanimoto_sql(), "loss", KEEP))(from_sums("keep", "loss", lambda: L.fractal_tanimoto(N, WEIGHTS)))
query("L10_ce_tanimoto", out(f"0.5 * wce + 0.5 * {tanimoto_sql()}", "loss", KEEP, CE_SQL, join=CE_JOIN))(
    with_ce("keep", lambda: L.fractal_tanimoto(N, WEIGHTS), WEIGHTS))

TF = "pow(1 - (pt# + 1) / (pt# + 0.7 * (st# - pt#) + 0.3 * (sp# - pt#) + 1), 1 / 1.33::DOUBLE)"
WTF = " + ".join(f"{w} * {TF}".replace("#", str(k)) for k, w in enumerate(WEIGHTS))
query("L11_tversky_focal", out(mean(TF), "loss", SKIP))(from_sums("skip", "loss", lambda: L.tversky_focal(N)))
query("L11_tversky_focal_binary", out(TF.replace("#", "1"), "loss", SKIP))(from_sums("skip", "loss", lambda: L.binary_tversky_focal(1)))
query("L13_tversky_focal_ce", out(f"0.5 * ({WTF}) + 0.5 * wce", "loss", SKIP, CE_SQL, join=CE_JOIN))(
    with_ce("skip", lambda: L.tversky_focal(N, WEIGHTS), WEIGHTS))


@query("L12_local_tversky_focal", out(" + ".join(
    f"coalesce((n / nullif(st{k}, 0)) / (coalesce(n / nullif(st0, 0), 0) + coalesce(n / nullif(st1, 0), 0) + coalesce(n / nullif(st2, 0), 0)), 1e-5) * {TF}".replace("#", str(k))
    for k in range(N)), "loss", SKIP))
def local_tversky(spark, sf_dir):
    """Weights from the label frequencies of the batch itself."""
    df = scored(spark, sf_dir)
    return L.overlap_sums(df, BATCH, N).select(BATCH, L.tversky_focal(N, L.local_weights(N)).alias("loss"))
