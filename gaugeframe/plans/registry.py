"""The queries over the engine's own operators, with SQL for each. Numbers are rounded to six digits in both, and NaN
is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from . import evaluate
from ..operators import depth, rays, resize, rgb, rules, sets, stencil
from ..sources import adapters as A


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(c), F.round(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _over(source, step):
    return lambda spark, sf_dir: _rounded(step(source(spark, sf_dir)))


def _features(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    v = A.read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == odd)
    return v.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _with_depth(df: DataFrame) -> DataFrame:
    """Some depths are NaN, and some images have none that is positive."""
    k = F.col("img") * 64 + F.col("r") * 8 + F.col("c")
    return df.withColumn("depth", F.when(F.col("img") % 23 == 1, -1.0).when(k % 41 == 0, float("nan")).otherwise(F.col("gr") * 12 - 3))


def _kid(spark, sf_dir):
    return sets.kernel_distance(_features(spark, sf_dir, 0), _features(spark, sf_dir, 1)).select(F.round("kid", 9).alias("kid"))


def _hierarchy(spark, sf_dir):
    """A scene's calibration for each of its samples."""
    h = A.hierarchy(spark, sf_dir)
    scene = F.concat_ws("/", F.slice(F.split("full_id", "/"), 1, 2))
    cal = A.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") + 500).cast("double").alias("fx"))
    return h.join(F.broadcast(cal), "nation", "left").select("full_id", scene.alias("scene"), F.element_at(F.split("full_id", "/"), -1).alias("file"), "fx")  # 25 rows


def _matched(spark, sf_dir):
    """Orders as reference samples, customers as predictions."""
    gt = A.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("full_id")).agg(F.count(F.lit(1)).alias("n_gt"))
    return sets.match(gt, A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("full_id")))


def _unmatched(spark, sf_dir):
    """Suppliers as reference samples, nations as predictions."""
    gt = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("full_id"))
    return sets.unmatched(gt, A.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("full_id")))


def _projected(spark, sf_dir):
    return _rounded(sets.project(A.points(spark, sf_dir), 20.0, 20.0, 16.0, 16.0, 32, 32))


def _sparse(spark, sf_dir):
    """Points, pixels they reach, and the mean depth there."""
    p = A.points(spark, sf_dir)
    n = p.groupBy("img").agg(F.count(F.lit(1)).alias("input_points"))
    d = sets.project(p, 20.0, 20.0, 16.0, 16.0, 32, 32).groupBy("img").agg(F.count(F.lit(1)).alias("projected_pixels"), F.avg("gt").alias("mean_depth"))
    return _rounded(n.join(d, "img", "left").select("img", "input_points", F.coalesce("projected_pixels", F.lit(0)).alias("projected_pixels"), "mean_depth"))


def _fov(spark, sf_dir):
    f = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img"), ((F.col("s_suppkey") % 40) * 25 + 40).cast("double").alias("f"))
    deg = P.fov_degrees(F.lit(480.0), F.lit(640.0), F.col("f"), F.col("f"))
    return _rounded(f.select("img", deg.alias("degrees"), P.fov_domain(deg).alias("domain")))


def _spatial(spark, sf_dir):
    s = A.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), (F.col("l_linenumber") * 8).cast("int").alias("b")).distinct()
    return s.select("a", "b", P.spatial_class(F.col("a"), F.col("b"), F.col("a") - F.col("a") % 4, F.col("b")).alias("how"))


def _radial(spark, sf_dir):
    g = A.grids(spark, sf_dir)
    return _rounded(g.select("img", "r", "c", P.planar_to_radial(F.col("gt"), F.col("c"), F.col("r"), F.lit(6.0), F.lit(7.0), F.lit(3.5), F.lit(3.5)).alias("radial")))


def _scores(spark, sf_dir):
    px = A.depth_pixels(spark, sf_dir)
    ok = P.valid(F.col("gt"), F.col("pred"))
    base = px.groupBy("img").agg(F.max(F.when(ok, F.col("gt"))).alias("depth_max"), F.min(F.when(ok, F.col("gt"))).alias("depth_min"), F.count_if(ok).alias("n_valid"))
    st = depth.stats(px).select("img", "absrel_median", "absrel_p90", "rmse", "silog")
    return base.join(st, "img").withColumns({"peak": F.col("depth_max"), "depth_range": F.col("depth_max") - F.col("depth_min")})


TIGHT = {"depth_max": 104.0, "psnr_max_high": 104.0, "absrel_median": 0.03, "absrel_p90": 0.07, "rmse_share": 0.02, "silog": 0.045}


def _warned(spark, sf_dir):
    return _rounded(rules.warnings(_scores(spark, sf_dir), TIGHT))


def _four_digits(v: Column) -> Column:
    """As the SQL rounds: the double times 10 000, where a tie of the decimals need not be one."""
    return (F.round(v * 10000) / 10000).cast("decimal(20,4)").cast("string")


def _warning_summary(spark, sf_dir):
    s = rules.summary(rules.warnings(_scores(spark, sf_dir), TIGHT))
    return s.select("metric", "warning_type", "n", F.array_join(F.transform("first_values", _four_digits), ",").alias("first_values"))


def _edge_macro(df):
    return stencil.macro_f1(stencil.depth_edge_f1(df))


def _run_depth(spark, sf_dir):
    """Fitted per image: native and metric space, benchmark bins, no stencils (as for sparse references)."""
    return _rounded(evaluate.evaluate_depth(A.depth_pixels(spark, sf_dir), hint="affine", benchmark=(1.0, 80.0), dense=False).summary)


def _run_rays(spark, sf_dir):
    return _rounded(evaluate.evaluate_rays(A.rays(spark, sf_dir), "pano").summary.select("path", "value"))


def _ancestors(spark, sf_dir):
    """The nearest node above a sample; nations with an odd key have one, regions all."""
    h = A.hierarchy(spark, sf_dir).select("full_id")
    n, r = A.read(spark, sf_dir, "nation"), A.read(spark, sf_dir, "region")
    at_nation = n.where("n_nationkey % 2 = 1").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("node"), (F.col("n_nationkey") + 500).cast("double").alias("fx"))
    return sets.ancestor(h, at_nation.unionByName(r.select(F.col("r_name").alias("node"), (F.col("r_regionkey") + 900).cast("double").alias("fx"))))


def _odd_scores(spark, sf_dir):
    """Scores on both sides of every limit of C7-C17, some infinite or NaN; one image a part."""
    k = F.col("p_partkey").cast("long")
    share = lambda by, of, less=0, scale=100: (((k * by) % of) - less).cast("double") / scale
    return A.read(spark, sf_dir, "part").select(
        k.alias("img"), share(7, 60, 0, 1).alias("mean_normal_angle"), (k * 13 % 150).alias("normal_pixels"), share(1, 1000, 0, 1600).alias("gt_edge_ratio"), share(1, 10, -95).alias("rgb_max"), share(1, 4, 2).alias("rgb_min"),
        F.when(k % 50 == 0, float("inf")).otherwise(share(1, 70, 0, 1)).alias("rgb_psnr"), share(1, 100).alias("rgb_ssim"), share(3, 100).alias("rgb_lpips"), share(7, 100).alias("tail_p99"), share(1, 21, 10, 10).alias("hf_relative_diff"), (k % 9).alias("bin_pixels"),
        share(1, 20).alias("norm_error"), (k % 11).alias("n_rays"), F.when(k % 13 == 0, float("nan")).otherwise(share(11, 100)).alias("rho_a"), share(1, 45, 0, 1).alias("mean_ray_angle"),
    )


def _spaces(spark, sf_dir):
    """The space of inputs as they are, scaled down, and hinted at, and what a fitted and a plain run report."""
    px, rows = A.depth_pixels(spark, sf_dir).where("pred > 0"), []
    small = px.withColumn("pred", F.col("pred") / 1000)
    for name, df, hint in (("as_is", px, None), ("small", small, None), ("relative", px, "relative"), ("affine", small, "affine")):
        space = depth.input_space(df, hint)
        rows += [(name, space, fitted, *depth.emitted(space, fitted).values()) for fitted in (False, True)]
    return spark.createDataFrame(rows, "name string, space string, fitted boolean, native boolean, metric boolean")


def _threshold(spark, sf_dir):
    """Y4 by the domain that Y3 finds."""
    limits = F.create_map(*(F.lit(x) for d in P.FOV_THRESHOLDS for x in (d, P.fov_threshold(d.upper()))))
    return _fov(spark, sf_dir).select("img", limits[F.col("domain")].alias("threshold"))


def _min_depth(spark, sf_dir):
    """P4."""
    ok = {f"n_{n}": F.count_if(P.valid(F.col("gt"), F.col("pred"), min_depth=m)) for n, m in (("default", 1e-3), ("far", 30.0))}
    return A.depth_pixels(spark, sf_dir).groupBy("img").agg(*(x.alias(n) for n, x in ok.items()))


QUERIES = {
    "C7_C17_warnings": lambda spark, sf_dir: _rounded(rules.warnings(_odd_scores(spark, sf_dir))),
    "P4_valid_min_depth": _min_depth,
    "P16_P17_spaces": _spaces,
    "Y4_fov_threshold": _threshold,
    "E1_evaluate_depth_spaces": _run_depth,
    "E4_evaluate_rays": _run_rays,
    "J3_nearest_ancestor": _ancestors,
    "D1_depth_standard_per_image": _over(A.depth_pixels, depth.standard),
    "P2_depth_standard_sky_masked": _over(A.depth_pixels, lambda d: depth.standard(d, ~F.col("sky"))),
    "A1_depth_standard_reducers": _over(A.depth_pixels, depth.reducers),
    "D2_depth_psnr": _over(A.depth_pixels, depth.psnr),
    "D4_D5_D6_depth_stats": _over(A.depth_pixels, depth.stats),
    "A2_A3_pooled_quantiles": _over(A.depth_pixels, depth.pooled_quantiles),
    "P6_A12_benchmark_bins": _over(A.depth_pixels, lambda d: depth.by_bin(d, 1.0, 80.0)),
    "A16_scale_and_shift": _over(A.depth_pixels, depth.scale_and_shift),
    "A16_scale_and_shift_trimmed": _over(A.depth_pixels, lambda d: depth.scale_and_shift(d, True)),
    "P15_aligned_standard": _over(A.depth_pixels, lambda d: depth.standard(depth.aligned(d))),
    "D7_D8_normal_consistency": _over(A.holed_grids, stencil.normal_consistency),
    "A4_normal_consistency_pooled": _over(A.holed_grids, lambda d: stencil.normal_consistency(d, by=())),
    "D9_D10_D11_depth_edge_f1": _over(A.holed_grids, stencil.depth_edge_f1),
    "D9_depth_edge_f1_sobel": _over(A.holed_grids, lambda d: stencil.depth_edge_f1(d, 0.6, "sobel")),
    "A5_edge_f1_macro": _over(A.holed_grids, _edge_macro),
    "D3_depth_ssim": _over(A.holed_grids, stencil.depth_ssim),
    "R1_rgb_psnr": _over(A.rgb, rgb.psnr),
    "R3_rgb_psnr_masked": _over(A.rgb, lambda d: rgb.psnr(d, F.col("gr") > 0.5)),
    "R2_rgb_ssim": _over(A.rgb, rgb.ssim),
    "R4_rgb_sce": _over(A.rgb, rgb.structure_weighted_chroma),
    "R6_R8_rgb_edge_f1": _over(A.rgb, lambda d: rgb.edge_f1(d, 0.3)),
    "R6_rgb_edge_f1_canny": _over(A.rgb, lambda d: rgb.edge_f1(d, 0.2, "canny_approx")),
    "R9_tail_errors": _over(A.rgb, rgb.tails),
    "R9b_tail_errors_by_channel": _over(A.rgb, rgb.tails_by_channel),
    "R9c_tail_pixels": _over(A.rgb, rgb.tail_pixels),
    "A7_tail_errors_pooled": _over(A.rgb, lambda d: rgb.tails(d, ())),
    "R10_high_frequency": _over(A.rgb, rgb.high_frequency),
    "R10d_spectrum_bands": _over(A.rgb, rgb.spectrum_bands),
    "R11_depth_binned": _over(A.rgb, lambda d: rgb.depth_binned(_with_depth(d))),
    "A6_A15_depth_binned_set": _over(A.rgb, lambda d: rgb.depth_binned(_with_depth(d)).groupBy("bin").agg(F.avg("mae").alias("mae"), F.avg("mse").alias("mse"))),
    "Y1_ray_angles": _over(A.rays, rays.angles),
    "Y2_rays_per_image": _over(A.rays, lambda d: rays.by_image(d, 120.0)),
    "A9_rho_over_images": _over(A.rays, lambda d: rays.over_images(rays.by_image(d, 120.0))),
    "A10_ray_angles_pooled": _over(A.rays, rays.pooled),
    "A11_ray_histogram_median": _over(A.rays, rays.histogram_median),
    "Y3_fov_domain": _fov,
    "F3_kernel_distance": _kid,
    "J1_matched": _matched,
    "J1_unmatched": _unmatched,
    "J3_hierarchical": _hierarchy,
    "J5_projection": _projected,
    "A17_sparse_counters": _sparse,
    "P11_planar_to_radial": _radial,
    "P13_spatial_class": _spatial,
    "P14_align_area": _over(A.grids, lambda d: resize.align_to_prediction(d, ["gt"], "depth", 8, 8, 3, 5)),
    "P14_align_nearest": _over(A.grids, lambda d: resize.align_to_prediction(d, ["gt"], "depth", 8, 8, 11, 9)),
    "P14_align_linear": _over(A.rgb, lambda d: resize.align_to_prediction(d, ["gr", "gg", "gb"], "rgb", 8, 8, 11, 10)),
    "P12_normalised": _over(A.grids, lambda d: resize.normalised(d, "gt").select("img", "r", "c", "normalised")),
    "A8_high_frequency_set": _over(A.rgb, lambda d: rgb.high_frequency_over_images(rgb.high_frequency(d))),
    "C_warnings": _warned,
    "A18_warning_summary": _warning_summary,
}

# ---------------------------------------------------------------- the same in SQL

PX = """px AS (
  SELECT l_suppkey AS img, CASE WHEN l_quantity = 1 OR l_suppkey % 17 = 5 THEN 0.0::DOUBLE WHEN l_quantity = 3 THEN 'Infinity'::DOUBLE ELSE l_extendedprice::DOUBLE / 1000 END AS gt,
    CASE WHEN l_quantity = 2 THEN 'NaN'::DOUBLE ELSE l_extendedprice::DOUBLE / 1000 * (1 - l_discount::DOUBLE) * (1 + l_tax::DOUBLE) END AS pred, l_returnflag = 'R' AS sky FROM lineitem
)"""
ERR = "e AS (SELECT *, pred - gt AS d, abs(pred - gt) / gt AS rel, ln(pred) - ln(gt) AS l, greatest(pred / gt, gt / pred) AS ratio FROM (SELECT * FROM px WHERE gt > 0 AND pred > 0 AND isfinite(gt) AND isfinite(pred)))"
EVERY = "every AS (SELECT i.img, e.* EXCLUDE (img) FROM (SELECT DISTINCT img FROM px) i LEFT JOIN e ON e.img = i.img{})"
STD = {
    "absrel": "avg(rel)", "sqrel": "avg(d * d / gt)", "mae": "avg(abs(d))", "rmse": "sqrt(avg(d * d))", "rmse_log": "sqrt(avg(l * l))", "log10": "avg(abs(l)) / ln(10)", "silog": "sqrt(greatest(avg(l * l) - avg(l) * avg(l), 0))",
    **{f"delta{k}": f"avg(CASE WHEN ratio < {1.25**k!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for k in (1, 2, 3)},
}
STANDARD = ", ".join(f"CASE WHEN count(rel) > 0 THEN round({v}, 6) END AS {k}" for k, v in STD.items())


def _q(x: str, p: float, name: str) -> str:
    return f"round(quantile_cont({x}, {p}), 6) AS {name}"


STATS = ", ".join([
    "round(avg(rel), 6) AS absrel", _q("rel", 0.5, "absrel_median"), _q("rel", 0.9, "absrel_p90"), "round(sqrt(avg(d * d)), 6) AS rmse", _q("abs(d)", 0.5, "rmse_median"), _q("abs(d)", 0.9, "rmse_p90"),
    f"CASE WHEN count(rel) > 0 THEN round({STD['silog']}, 6) END AS silog", _q("abs(l)", 0.5, "silog_median"), _q("abs(l)", 0.9, "silog_p90"),
])
NEAR, MID = P.benchmark_edges(1.0, 80.0)
BIN = f"CASE WHEN gt >= 1 AND gt < {NEAR!r}::DOUBLE THEN 'near' WHEN gt >= {NEAR!r}::DOUBLE AND gt < {MID!r}::DOUBLE THEN 'mid' WHEN gt >= {MID!r}::DOUBLE AND gt <= 80 THEN 'far' END"
FIT = """f AS (
  SELECT img, count(*) AS n, avg(pred) AS p, avg(gt) AS g, min(pred) = max(pred) AS flat, regr_slope(gt, pred) AS slope, regr_intercept(gt, pred) AS icpt FROM k GROUP BY img
), fit AS (
  SELECT img, n, CASE WHEN n < 2 THEN 1.0::DOUBLE WHEN flat THEN p * g / (p * p + 1) ELSE slope END AS s, CASE WHEN n < 2 THEN 0.0::DOUBLE WHEN flat THEN g / (p * p + 1) ELSE icpt END AS t FROM f
)"""
GRID = """g AS (
  SELECT a.vec_id AS img, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, a.embedding[i + 1]::DOUBLE + 1 AS gt, b.embedding[i + 1]::DOUBLE + 1 AS pred
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) t(i)
)"""
HOLED = GRID.replace("g AS (", "g0 AS (", 1) + """, g AS (
  SELECT img, r, c, CASE WHEN img % 29 = 3 THEN 0.0::DOUBLE WHEN (img * 64 + r * 8 + c) % 61 = 0 THEN 'NaN'::DOUBLE ELSE gt END AS gt,
    CASE WHEN (img * 64 + r * 8 + c) % 67 = 0 THEN 0.0::DOUBLE WHEN (img * 64 + r * 8 + c) % 71 = 0 THEN 'Infinity'::DOUBLE ELSE pred END AS pred FROM g0
)"""
OK = "(gt > 0 AND pred > 0 AND isfinite(gt) AND isfinite(pred))"
RGB = """c1 AS (SELECT vec_id // 3 AS img, vec_id % 3 AS ch, i, (embedding[i + 1]::DOUBLE + 1) / 2 AS x FROM embeddings, range(64) t(i)
), o AS (SELECT img, i, max(x) FILTER (WHERE ch = 0) AS r_, max(x) FILTER (WHERE ch = 1) AS g_, max(x) FILTER (WHERE ch = 2) AS b_ FROM c1 GROUP BY ALL HAVING count(*) = 3
), g AS (SELECT a.img, CAST(a.i // 8 AS INTEGER) AS r, CAST(a.i % 8 AS INTEGER) AS c, a.r_ AS gr, a.g_ AS gg, a.b_ AS gb, b.r_ AS pr, b.g_ AS pg, b.b_ AS pb FROM o a JOIN o b ON b.img = a.img + 1 AND b.i = a.i)"""
ABS3 = "(abs(pr - gr) + abs(pg - gg) + abs(pb - gb)) / 3"
SQ3 = "((pr - gr) ** 2 + (pg - gg) ** 2 + (pb - gb) ** 2) / 3"
LUMA = {s: f"(0.299::DOUBLE * {s}r + 0.587::DOUBLE * {s}g + 0.114::DOUBLE * {s}b)" for s in "gp"}


def _tap(x: str, step: int, axis: str, pad: str) -> str:
    f = "lead" if step > 0 else "lag"
    w = "PARTITION BY img, r ORDER BY c" if axis == "c" else "PARTITION BY img, c ORDER BY r"
    return f"coalesce({f}({x}, {abs(step)}) OVER ({w}), {x if pad == 'reflect' else '0.0::DOUBLE'})"


def _gradients(source: str, out: str, names: list[str], side: float, middle: float, scale: float, pad: str) -> str:
    one = ", ".join(f"{_tap(n, 1, a, pad)} - {_tap(n, -1, a, pad)} AS {n}_d{o}" for n in names for a, o in (("c", "x"), ("r", "y")))
    two = ", ".join(f"({side} * {_tap(f'{n}_d{o}', -1, a, pad)} + {middle} * {n}_d{o} + {side} * {_tap(f'{n}_d{o}', 1, a, pad)}) / {scale}::DOUBLE AS {n}_{o}" for n in names for a, o in (("r", "x"), ("c", "y")))
    return f"{out}_1 AS (SELECT *, {one} FROM {source}), {out} AS (SELECT *, {two} FROM {out}_1)"


def _dilate(source: str, out: str, name: str) -> str:
    return f"{out}_a AS (SELECT *, max({name}) OVER (PARTITION BY img, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a_{name} FROM {source}), {out} AS (SELECT *, max(a_{name}) OVER (PARTITION BY img, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w_{name} FROM {out}_a)"


def _f1(source: str) -> str:
    return f"""{_dilate(source, 'm1', 'eg')}, {_dilate('m1', 'm2', 'ep')}, s1 AS (
  SELECT img, CAST(sum(ep) AS BIGINT) AS n_pred, CAST(sum(eg) AS BIGINT) AS n_gt, CAST(sum(ep * w_eg) AS DOUBLE) AS hp, CAST(sum(eg * w_ep) AS DOUBLE) AS hg FROM m2 GROUP BY img
), s2 AS (SELECT img, n_pred, n_gt, CASE WHEN n_pred > 0 THEN hp / n_pred ELSE 0 END AS precision, CASE WHEN n_gt > 0 THEN hg / n_gt ELSE 0 END AS recall FROM s1
), s3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s2)"""


F1_OUT = "SELECT img, n_pred, n_gt, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s3"
SPAN = ", ".join(f"CAST(greatest(abs({_tap(n, 1, 'c', 'zero')} - {_tap(n, -1, 'c', 'zero')}), abs({_tap(n, 1, 'r', 'zero')} - {_tap(n, -1, 'r', 'zero')})) > 0.1::DOUBLE * {n} AND NOT isnan(greatest(abs({_tap(n, 1, 'c', 'zero')} - {_tap(n, -1, 'c', 'zero')}), abs({_tap(n, 1, 'r', 'zero')} - {_tap(n, -1, 'r', 'zero')}))) AND {OK} AS INTEGER) AS {o}" for n, o in (("gt", "eg"), ("pred", "ep")))
NORMAL = f"""{HOLED}, {_gradients('g', 'n', ['gt', 'pred'], 1, 2, 8, 'zero')}, inside AS (
  SELECT a.img, a.r, a.c FROM g a JOIN g b ON b.img = a.img AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND b.gt > 0 AND b.pred > 0 AND isfinite(b.gt) AND isfinite(b.pred) GROUP BY ALL HAVING count(*) = 9
), i AS (
  SELECT n.*, greatest(-1, least(1, (gt_x * pred_x + gt_y * pred_y + 1) / (sqrt(gt_x ** 2 + gt_y ** 2 + 1) * sqrt(pred_x ** 2 + pred_y ** 2 + 1)))) AS dot FROM n JOIN inside USING (img, r, c)
), a AS (SELECT p.img, dot, degrees(acos(dot)) AS angle FROM (SELECT DISTINCT img FROM g) p LEFT JOIN i ON i.img = p.img)"""
NORMAL_OUT = "round(avg(angle), 6) AS mean_angle, round(median(angle), 6) AS median_angle, round(avg(dot), 6) AS mean_dot, " + ", ".join(f"round(avg(CASE WHEN angle < {t} THEN 1.0::DOUBLE WHEN angle >= {t} THEN 0.0::DOUBLE END) * 100, 6) AS below_{n}" for n, t in (("11_25", 11.25), ("22_5", 22.5), ("30", 30.0)))
KERNEL = """kt AS (SELECT i, CASE WHEN i + d < 0 THEN -(i + d) - 1 WHEN i + d > 7 THEN 15 - (i + d) ELSE i + d END AS j, exp(-d * d / (2 * (11.0::DOUBLE / 6) ** 2)) AS w FROM range(8) a(i), range(-5, 6) b(d)
), kw AS (SELECT i, j, sum(w) / (SELECT sum(exp(-d * d / (2 * (11.0::DOUBLE / 6) ** 2))) FROM range(-5, 6) b(d)) AS w FROM kt GROUP BY i, j)"""


def _ssim(source: str, out: str, weighted: bool = False) -> str:
    """source has key, r, c, a, b; and v where the mean is over pixels of which over half of the window has v = 1."""
    names = [("a", "a"), ("b", "b"), ("aa", "a * a"), ("bb", "b * b"), ("ab", "a * b")] + [("v", "v")] * weighted
    first = ", ".join(f"sum(w * {x}) AS {n}" for n, x in names)
    second = ", ".join(f"sum(w * {n}) AS {n}" for n, _ in names)
    return f"""{out}_1 AS (SELECT key, i AS r, c, {first} FROM {source} JOIN kw ON r = j GROUP BY key, i, c), {out}_2 AS (SELECT key, r, i AS c, {second} FROM {out}_1 JOIN kw ON c = j GROUP BY key, r, i), {out} AS (
  SELECT key, avg((2 * a * b + 0.0001::DOUBLE) * (2 * (ab - a * b) + 0.0009::DOUBLE) / ((a * a + b * b + 0.0001::DOUBLE) * (aa - a * a + bb - b * b + 0.0009::DOUBLE))) {"FILTER (WHERE v > 0.5)" if weighted else ""} AS ssim FROM {out}_2 GROUP BY key)"""


DFT = f"""y AS (SELECT img, r, c, {LUMA['g']} AS g, {LUMA['p']} AS p FROM g
), f1 AS (SELECT img, r, v, {', '.join(f'sum({s} * {fn}(-2 * pi() * v * c / 8)) AS {s}{o}' for s in 'gp' for fn, o in (('cos', 're'), ('sin', 'im')))} FROM y, range(8) t(v) GROUP BY img, r, v
), f2 AS (SELECT img, u, v, {', '.join(f'sum({s}re * cos(-2 * pi() * u * r / 8) - {s}im * sin(-2 * pi() * u * r / 8)) AS {s}re, sum({s}re * sin(-2 * pi() * u * r / 8) + {s}im * cos(-2 * pi() * u * r / 8)) AS {s}im' for s in 'gp')} FROM f1, range(8) t(u) GROUP BY img, u, v
), f3 AS (SELECT img, sqrt((((u + 4) % 8 - 4) ** 2 + ((v + 4) % 8 - 4) ** 2)::DOUBLE) / sqrt(32.0::DOUBLE) AS dist, gre ** 2 + gim ** 2 AS g, pre ** 2 + pim ** 2 AS p FROM f2)"""
BINNED = f"""x AS (SELECT img, CASE WHEN img % 23 = 1 THEN -1.0::DOUBLE WHEN (img * 64 + r * 8 + c) % 41 = 0 THEN 'NaN'::DOUBLE ELSE gr * 12 - 3 END AS depth, {ABS3} AS a, {SQ3} AS s FROM g
), y AS (SELECT img, CASE WHEN depth <= 1 THEN 'near' WHEN depth <= 5 THEN 'mid' ELSE 'far' END AS bin, a, s FROM x WHERE depth > 0 AND isfinite(depth)
), z AS (SELECT img, coalesce(bin, 'all') AS bin, avg(a) AS mae, avg(s) AS mse, count(*) AS n FROM y GROUP BY GROUPING SETS ((img, bin), (img))
), b AS (SELECT i.img, k.bin, coalesce(mae, 0) AS mae, coalesce(mse, 0) AS mse, coalesce(n, 0) AS n FROM (SELECT DISTINCT img FROM g) i CROSS JOIN (VALUES ('near'), ('mid'), ('far'), ('all')) k(bin) LEFT JOIN z ON z.img = i.img AND z.bin = k.bin)"""
RAYS = """y AS (SELECT a.vec_id AS img, CAST(k AS INTEGER) AS ray, list_transform(a.embedding[3 * k + 1 : 3 * k + 3], lambda x: x::DOUBLE) AS g, CASE WHEN a.vec_id % 31 = 7 OR (a.vec_id * 21 + k) % 37 = 0 THEN NULL ELSE list_transform(b.embedding[3 * k + 1 : 3 * k + 3], lambda x: x::DOUBLE) END AS p
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(21) t(k)
), n AS (SELECT *, sqrt(g[1] ** 2 + g[2] ** 2 + g[3] ** 2) AS ng, sqrt(p[1] ** 2 + p[2] ** 2 + p[3] ** 2) AS np FROM y
), a AS (SELECT img, ray, degrees(acos(greatest(-1, least(1, (g[1] * p[1] + g[2] * p[2] + g[3] * p[3]) / (ng * np))))) AS angle FROM n WHERE ng > 1e-8 AND np > 1e-8)"""
RHO = """rho AS (SELECT i.img, count(angle) AS n, avg(angle) AS mean_angle, median(angle) AS median_angle FROM (SELECT DISTINCT img FROM y) i LEFT JOIN a ON a.img = i.img GROUP BY i.img
), curve AS (SELECT img, k, avg(CASE WHEN angle <= k * 120.0::DOUBLE / 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM a, range(101) t(k) GROUP BY img, k
), area AS (SELECT img, sum(v * CASE WHEN k IN (0, 100) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) / 100 AS rho_a FROM curve GROUP BY img)"""
BELOW = ", ".join(f"round(avg(CASE WHEN angle < {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS below_{t}" for t in rays.LIMITS)
PROJ = """pt AS (SELECT l_suppkey AS img, l_orderkey * 10 + l_linenumber AS pt, l_discount::DOUBLE * 40 - 2 AS x, l_tax::DOUBLE * 40 - 2 AS y, (l_quantity - 5)::DOUBLE AS z FROM lineitem
), pj AS (SELECT *, CAST(round_even(20 * x / nullif(greatest(z, 0), 0) + 16, 0) AS BIGINT) AS u, CAST(round_even(20 * y / nullif(greatest(z, 0), 0) + 16, 0) AS BIGINT) AS v FROM pt WHERE z > 1e-8
), pk AS (SELECT *, row_number() OVER (PARTITION BY img, v, u ORDER BY z, pt, x, y) AS k FROM pj WHERE u BETWEEN 0 AND 31 AND v BETWEEN 0 AND 31
), pd AS (SELECT img, v AS r, u AS c, sqrt(x * x + y * y + z * z) AS gt FROM pk WHERE k = 1)"""
SCORES = f"""{PX}, {ERR}, {EVERY.format('')}, sc AS (SELECT img, max(gt) AS depth_max, min(gt) AS depth_min, count(rel) AS n_valid, max(gt) - min(gt) AS depth_range, quantile_cont(rel, 0.5) AS absrel_median, quantile_cont(rel, 0.9) AS absrel_p90, sqrt(avg(d * d)) AS rmse, {STD['silog']} AS silog FROM every GROUP BY img
), w AS (
  SELECT img, 'depth_input' AS metric, 'depth_too_large' AS warning_type, depth_max AS observed FROM sc WHERE depth_max > 104
  UNION ALL SELECT img, 'depth_input', 'no_valid_pixels', 0.0::DOUBLE FROM sc WHERE n_valid = 0
  UNION ALL SELECT img, 'depth_psnr', 'too_high', depth_max FROM sc WHERE depth_max > 104
  UNION ALL SELECT img, 'depth_psnr', 'too_low', depth_max FROM sc WHERE depth_max < 0.1
  UNION ALL SELECT img, 'depth_ssim', 'too_low', depth_range FROM sc WHERE depth_range < 0.1
  UNION ALL SELECT img, 'depth_absrel', 'median_too_high', absrel_median FROM sc WHERE absrel_median > 0.03
  UNION ALL SELECT img, 'depth_absrel', 'p90_too_high', absrel_p90 FROM sc WHERE absrel_p90 > 0.07
  UNION ALL SELECT img, 'depth_rmse', 'too_high', rmse FROM sc WHERE rmse > 0.02 * depth_range
  UNION ALL SELECT img, 'depth_silog', 'too_high', silog FROM sc WHERE silog > 0.045
)"""


def _sobel(side: str, out: str, threshold: float) -> str:
    return f"CAST(sqrt(y{side}_x ** 2 + y{side}_y ** 2) > {threshold}::DOUBLE AS INTEGER) AS {out}"


def _canny(side: str, out: str, source: str, to: str) -> str:
    m = f"m{side}"
    at = lambda dr, dc: f"{m}_{dr + 1}{dc + 1}"
    row = "PARTITION BY img, r ORDER BY c"
    col = "PARTITION BY img, c ORDER BY r"
    return f"""{to}_a AS (SELECT *, sqrt(y{side}_x ** 2 + y{side}_y ** 2) AS {m}, ((degrees(atan2(y{side}_y, y{side}_x)) % 180) + 180) % 180 AS t{side} FROM {source}
), {to}_b AS (SELECT *, lag({m}) OVER ({col}) AS {at(-1, 0)}, lead({m}) OVER ({col}) AS {at(1, 0)}, lag({m}) OVER ({row}) AS {at(0, -1)}, lead({m}) OVER ({row}) AS {at(0, 1)} FROM {to}_a
), {to}_c AS (SELECT *, lag({at(-1, 0)}) OVER ({row}) AS {at(-1, -1)}, lead({at(-1, 0)}) OVER ({row}) AS {at(-1, 1)}, lag({at(1, 0)}) OVER ({row}) AS {at(1, -1)}, lead({at(1, 0)}) OVER ({row}) AS {at(1, 1)} FROM {to}_b
), {to} AS (SELECT *, CAST(coalesce({m} > 0.2::DOUBLE AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 AND CASE
  WHEN t{side} < 22.5 OR t{side} >= 157.5 THEN {m} >= {at(0, -1)} AND {m} >= {at(0, 1)} WHEN t{side} < 67.5 THEN {m} >= {at(-1, -1)} AND {m} >= {at(1, 1)}
  WHEN t{side} < 112.5 THEN {m} >= {at(-1, 0)} AND {m} >= {at(1, 0)} ELSE {m} >= {at(-1, 1)} AND {m} >= {at(1, -1)} END, FALSE) AS INTEGER) AS {out} FROM {to}_c)"""


YG = f"yy AS (SELECT *, {LUMA['g']} AS yg, {LUMA['p']} AS yp FROM g)"
PSNR3 = "CASE WHEN mse IS NULL THEN 'NaN'::DOUBLE WHEN mse < 1e-10 THEN 'Infinity'::DOUBLE ELSE round(10 * log10(1 / mse), 6) END"

PX_FITTED = PX.replace("px AS", "px0 AS", 1) + f", k AS (SELECT * FROM px0 WHERE gt > 0 AND isfinite(gt) AND isfinite(pred)), {FIT}, px AS (SELECT px0.img, gt, coalesce(s, 1) * pred + coalesce(t, 0) AS pred FROM px0 LEFT JOIN fit USING (img))"


def _run(space: str, px: str) -> str:
    """Summary of a space: without bins, and in each bin of the benchmark."""
    err = ERR.replace("AS (SELECT *,", "AS (SELECT img, gt,", 1)
    i = ", ".join(f"{v} AS {k}" for k, v in STD.items())
    rows = [f"SELECT bin, 'standard.image_mean.{m}' AS path, avg({m}) AS value FROM i GROUP BY bin UNION ALL SELECT bin, 'standard.image_median.{m}', median({m}) FROM i GROUP BY bin UNION ALL SELECT bin, 'standard.pixel_pool.{m}', {m} FROM p" for m in STD]
    rows += [f"SELECT bin, 'depth_metrics.{m}.{n}', quantile_cont({x}, {q}) FROM b GROUP BY bin" for m, x in (("absrel", "rel"), ("rmse", "abs(d)"), ("silog", "abs(l)")) for n, q in (("median", 0.5), ("p90", 0.9))]
    rows.append("SELECT bin, 'depth_metrics.silog.mean', avg(silog) FROM i GROUP BY bin")
    return f"(WITH {px}, {err}, b0 AS (SELECT *, {BIN} AS one FROM e), b AS (SELECT *, '' AS bin FROM b0 UNION ALL SELECT *, one FROM b0 WHERE one IS NOT NULL UNION ALL SELECT *, 'all' FROM b0 WHERE one IS NOT NULL), i AS (SELECT img, bin, {i} FROM b GROUP BY img, bin), p AS (SELECT bin, {i} FROM b GROUP BY bin) SELECT '{space}' AS space, bin, path, round(value, 6) AS value FROM ({' UNION ALL '.join(rows)}))"


def _run_rays_sql() -> str:
    rho = RHO.replace("120.0", "30.0")
    below = ", ".join(f"avg(CASE WHEN angle < {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS b{t}" for t in rays.LIMITS)
    rows = ["SELECT 'rho_a.mean' AS path, avg(rho_a) AS value FROM area", "SELECT 'rho_a.median', median(rho_a) FROM area", "SELECT 'rho_a.std', stddev_pop(rho_a) FROM area", "SELECT 'angle.mean', avg(angle) FROM a", "SELECT 'angle.median', (min(bin) + 0.5) * 0.01 FROM hk WHERE cum >= al / 2"]
    rows += [f"SELECT 'angle.percent_below_{t}', b{t} FROM bl" for t in rays.LIMITS]
    return f"WITH {RAYS}, {rho}, h AS (SELECT least(floor(angle * 100), 17999) AS bin, count(*) AS n FROM a GROUP BY 1), hk AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS al FROM h), bl AS (SELECT {below} FROM a) SELECT path, round(value, 6) AS value FROM ({' UNION ALL '.join(rows)})"


ORACLES = {
    "E1_evaluate_depth_spaces": f"{_run('native', PX)} UNION ALL {_run('metric', PX_FITTED)}",
    "E4_evaluate_rays": _run_rays_sql(),
    "J3_nearest_ancestor": "SELECT r_name || '/' || n_name || '/' || s_name AS full_id, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey + 500.0::DOUBLE ELSE r_regionkey + 900.0::DOUBLE END AS fx FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "D1_depth_standard_per_image": f"WITH {PX}, {ERR}, {EVERY.format('')} SELECT img, count(rel) AS n, {STANDARD} FROM every GROUP BY img",
    "P2_depth_standard_sky_masked": f"WITH {PX}, {ERR}, {EVERY.format(' AND NOT e.sky')} SELECT img, count(rel) AS n, {STANDARD} FROM every GROUP BY img",
    "A1_depth_standard_reducers": f"WITH {PX}, {ERR}, i AS (SELECT img, {', '.join(f'{v} AS {k}' for k, v in STD.items())} FROM e GROUP BY img), p AS (SELECT {', '.join(f'{v} AS {k}' for k, v in STD.items())} FROM e) " + " UNION ALL ".join(
        f"SELECT 'image_mean' AS reduction, '{m}' AS metric, round(avg({m}), 6) AS value FROM i UNION ALL SELECT 'image_median', '{m}', round(median({m}), 6) FROM i UNION ALL SELECT 'pixel_pool', '{m}', round({m}, 6) FROM p" for m in STD),
    "D2_depth_psnr": f"WITH {PX}, m AS (SELECT img, avg((pred - gt) ** 2) FILTER (WHERE ok) AS mse, max(gt) FILTER (WHERE ok) AS peak FROM (SELECT img, CASE WHEN isfinite(gt) AND isfinite(pred) THEN gt END AS gt, CASE WHEN isfinite(gt) AND isfinite(pred) THEN pred END AS pred, gt > 0 AND pred > 0 AND isfinite(gt) AND isfinite(pred) AS ok FROM px) GROUP BY img) SELECT img, CASE WHEN mse IS NULL THEN 0.0::DOUBLE WHEN mse < 1e-10 THEN 'Infinity'::DOUBLE ELSE round(10 * log10(peak * peak / mse), 6) END AS psnr FROM m",
    "D4_D5_D6_depth_stats": f"WITH {PX}, {ERR}, {EVERY.format('')} SELECT img, {STATS} FROM every GROUP BY img",
    "A2_A3_pooled_quantiles": f"WITH {PX}, {ERR} SELECT {', '.join(_q(x, p, f'{m}_{n}') for m, x in (('absrel', 'rel'), ('rmse', 'abs(d)'), ('silog', 'abs(l)')) for p, n in ((0.5, 'median'), (0.9, 'p90')))} FROM e",
    "P6_A12_benchmark_bins": f"WITH {PX}, {ERR}, b AS (SELECT *, {BIN} AS bin FROM e) SELECT img, coalesce(bin, 'all') AS bin, count(*) AS n, {STANDARD} FROM b WHERE bin IS NOT NULL GROUP BY GROUPING SETS ((img, bin), (img))",
    "A16_scale_and_shift": f"WITH {PX}, k AS (SELECT * FROM px WHERE gt > 0 AND isfinite(gt) AND isfinite(pred)), {FIT} SELECT img, n, round(s, 6) AS s, round(t, 6) AS t FROM fit",
    "A16_scale_and_shift_trimmed": f"WITH {PX}, k0 AS (SELECT *, quantile_cont(gt, 0.95) OVER (PARTITION BY img) AS lim FROM px WHERE gt > 0 AND isfinite(gt) AND isfinite(pred)), k AS (SELECT * FROM k0 WHERE gt <= lim), {FIT} SELECT img, n, round(s, 6) AS s, round(t, 6) AS t FROM fit",
    "P15_aligned_standard": f"WITH {PX.replace('px AS', 'px0 AS', 1)}, k AS (SELECT * FROM px0 WHERE gt > 0 AND isfinite(gt) AND isfinite(pred)), {FIT}, px AS (SELECT px0.img, gt, coalesce(s, 1) * pred + coalesce(t, 0) AS pred FROM px0 LEFT JOIN fit USING (img)), {ERR.replace('AS (SELECT *,', 'AS (SELECT img, gt,', 1)}, {EVERY.format('')} SELECT img, count(rel) AS n, {STANDARD} FROM every GROUP BY img",
    "D7_D8_normal_consistency": f"WITH {NORMAL} SELECT img, {NORMAL_OUT} FROM a GROUP BY img",
    "A4_normal_consistency_pooled": f"WITH {NORMAL} SELECT {NORMAL_OUT} FROM a",
    "D9_D10_D11_depth_edge_f1": f"WITH {HOLED}, ed AS (SELECT *, {SPAN} FROM g), {_f1('ed')} {F1_OUT}",
    "D9_depth_edge_f1_sobel": f"WITH {HOLED}, {_gradients('g', 'n', ['gt', 'pred'], 1, 2, 1, 'reflect')}, ed AS (SELECT *, CAST(sqrt(gt_x ** 2 + gt_y ** 2) > 0.6::DOUBLE AND NOT isnan(sqrt(gt_x ** 2 + gt_y ** 2)) AND {OK} AS INTEGER) AS eg, CAST(sqrt(pred_x ** 2 + pred_y ** 2) > 0.6::DOUBLE AND NOT isnan(sqrt(pred_x ** 2 + pred_y ** 2)) AND {OK} AS INTEGER) AS ep FROM n), {_f1('ed')} {F1_OUT}",
    "A5_edge_f1_macro": f"WITH {HOLED}, ed AS (SELECT *, {SPAN} FROM g), {_f1('ed')} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n_images FROM s3 WHERE n_pred > 0 OR n_gt > 0",
    "D3_depth_ssim": f"WITH {HOLED}, {KERNEL}, o AS (SELECT *, {OK} AS ok FROM g), e AS (SELECT img, least(min(gt) FILTER (WHERE ok), min(pred) FILTER (WHERE ok)) AS lo, greatest(max(gt) FILTER (WHERE ok), max(pred) FILTER (WHERE ok)) AS hi FROM o GROUP BY img), "
    "x AS (SELECT img AS key, r, c, CASE WHEN ok THEN (gt - lo) / (hi - lo) ELSE 0.0::DOUBLE END AS a, CASE WHEN ok THEN (pred - lo) / (hi - lo) ELSE 0.0::DOUBLE END AS b, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM o JOIN e USING (img) WHERE hi - lo >= 1e-8), "
    f"{_ssim('x', 's', True)} SELECT e.img, round(CASE WHEN hi - lo < 1e-8 THEN 1.0::DOUBLE ELSE coalesce(ssim, 0) END, 6) AS ssim FROM e LEFT JOIN s ON s.key = e.img",
    "R1_rgb_psnr": f"WITH {RGB}, m AS (SELECT img, avg({SQ3}) AS mse FROM g GROUP BY img) SELECT img, {PSNR3} AS psnr FROM m",
    "R3_rgb_psnr_masked": f"WITH {RGB}, m AS (SELECT img, avg({SQ3}) FILTER (WHERE gr > 0.5) AS mse FROM g GROUP BY img) SELECT img, {PSNR3} AS psnr FROM m",
    "R2_rgb_ssim": f"WITH {RGB}, {KERNEL}, x AS (SELECT img * 3 + k AS key, r, c, CASE k WHEN 0 THEN gr WHEN 1 THEN gg ELSE gb END AS a, CASE k WHEN 0 THEN pr WHEN 1 THEN pg ELSE pb END AS b FROM g, range(3) t(k)), {_ssim('x', 's')} SELECT key // 3 AS img, round(avg(ssim), 6) AS ssim FROM s GROUP BY key // 3",
    "R4_rgb_sce": f"WITH {RGB}, {YG}, {_gradients('yy', 'n', ['yg', 'yp'], 3, 10, 16, 'reflect')}, w AS (SELECT img, (sqrt(yg_x ** 2 + yg_y ** 2) + sqrt(yp_x ** 2 + yp_y ** 2)) / 2 AS w, ({' + '.join(f'abs({p} / (pr + pg + pb + 1e-6) - {q} / (gr + gg + gb + 1e-6))' for q, p in rgb.PAIRS)}) / 3 AS err FROM n) SELECT img, round(CASE WHEN avg(w) < 1e-6 THEN 0 ELSE avg(w * err) / (avg(w) + 1e-6) END, 6) AS sce FROM w GROUP BY img",
    "R6_R8_rgb_edge_f1": f"WITH {RGB}, {YG}, {_gradients('yy', 'n', ['yg', 'yp'], 1, 2, 1, 'reflect')}, ed AS (SELECT *, {_sobel('g', 'eg', 0.3)}, {_sobel('p', 'ep', 0.3)} FROM n), {_f1('ed')} {F1_OUT}",
    "R6_rgb_edge_f1_canny": f"WITH {RGB}, {YG}, {_gradients('yy', 'n', ['yg', 'yp'], 1, 2, 1, 'reflect')}, {_canny('g', 'eg', 'n', 'cg')}, {_canny('p', 'ep', 'cg', 'cp')}, {_f1('cp')} {F1_OUT}",
    "R9_tail_errors": f"WITH {RGB}, x AS (SELECT img, {ABS3} AS e FROM g) SELECT img, {_q('e', 0.95, 'p95')}, {_q('e', 0.99, 'p99')}, round(max(e), 6) AS max_error FROM x GROUP BY img",
    "R9b_tail_errors_by_channel": f"WITH {RGB}, x AS (" + " UNION ALL ".join(f"SELECT img, '{q[1]}' AS channel, abs({p} - {q}) AS e FROM g" for q, p in rgb.PAIRS) + f") SELECT img, channel, {_q('e', 0.95, 'p95')}, {_q('e', 0.99, 'p99')} FROM x GROUP BY img, channel",
    "R9c_tail_pixels": f"WITH {RGB}, x AS (SELECT img, r, c, {ABS3} AS e FROM g), y AS (SELECT *, quantile_cont(e, 0.95) OVER (PARTITION BY img) AS lim FROM x) SELECT img, r, c, round(e, 6) AS e FROM y WHERE e >= lim",
    "A7_tail_errors_pooled": f"WITH {RGB}, x AS (SELECT img, {ABS3} AS e FROM g) SELECT {_q('e', 0.95, 'p95')}, {_q('e', 0.99, 'p99')}, round(max(e), 6) AS max_error FROM x",
    "R10_high_frequency": f"WITH {RGB}, {DFT}, h AS (SELECT img, sum(CASE WHEN dist > 0.75 THEN g ELSE 0 END) / sum(g) AS g, sum(CASE WHEN dist > 0.75 THEN p ELSE 0 END) / sum(p) AS p FROM f3 GROUP BY img) SELECT img, round(p, 6) AS pred_ratio, round(g, 6) AS gt_ratio, round((p - g) / g, 6) AS relative_diff, round(abs(p - g), 6) AS absolute_diff, round(least(p / g, 1), 6) AS preservation FROM h",
    "R10d_spectrum_bands": f"WITH {RGB}, {DFT} SELECT img, CAST(floor(dist * 4) AS INTEGER) AS band, round(sum(g), 6) AS gt_energy, round(sum(p), 6) AS pred_energy, round(1 - least(abs(sum(p) / sum(g) - 1), 1), 6) AS similarity FROM f3 WHERE dist < 1 GROUP BY ALL",
    "R11_depth_binned": f"WITH {RGB}, {BINNED} SELECT img, bin, round(mae, 6) AS mae, round(mse, 6) AS mse, n FROM b",
    "A6_A15_depth_binned_set": f"WITH {RGB}, {BINNED} SELECT bin, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse FROM b GROUP BY bin",
    "Y1_ray_angles": f"WITH {RAYS} SELECT img, ray, round(angle, 6) AS angle FROM a",
    "Y2_rays_per_image": f"WITH {RAYS}, {RHO} SELECT img, n, round(mean_angle, 6) AS mean_angle, round(median_angle, 6) AS median_angle, round(rho_a, 6) AS rho_a FROM rho LEFT JOIN area USING (img)",
    "A9_rho_over_images": f"WITH {RAYS}, {RHO} SELECT round(avg(rho_a), 6) AS rho_mean, round(median(rho_a), 6) AS rho_median, round(stddev_pop(rho_a), 6) AS rho_std FROM area",
    "A10_ray_angles_pooled": f"WITH {RAYS} SELECT round(avg(angle), 6) AS mean_angle, round(median(angle), 6) AS median_angle, {BELOW} FROM a",
    "A11_ray_histogram_median": f"WITH {RAYS}, h AS (SELECT least(floor(angle * 100), 17999) AS bin, count(*) AS n FROM a GROUP BY 1), k AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS al FROM h) SELECT (SELECT round((min(bin) + 0.5) * 0.01, 6) FROM k WHERE cum >= al / 2) AS median_angle, round(avg(angle), 6) AS mean_angle, {BELOW} FROM a",
    "Y3_fov_domain": "WITH f AS (SELECT s_suppkey AS img, degrees(2 * atan(sqrt((640 / (2 * ((s_suppkey % 40) * 25 + 40.0::DOUBLE))) ** 2 + (480 / (2 * ((s_suppkey % 40) * 25 + 40.0::DOUBLE))) ** 2))) AS d FROM supplier) SELECT img, round(d, 6) AS degrees, CASE WHEN d <= 90 THEN 'sfov' WHEN d >= 160 THEN 'pano' ELSE 'lfov' END AS domain FROM f",
    "F3_kernel_distance": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), k AS (SELECT a.vec_id % 2 AS p, b.vec_id % 2 AS q, (list_inner_product(a.x, b.x) / 64 + 1) ** 3 AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT round(avg(k) FILTER (WHERE p = 0 AND q = 0) + avg(k) FILTER (WHERE p = 1 AND q = 1) - 2 * avg(k) FILTER (WHERE p = 0 AND q = 1), 9) AS kid FROM k",
    "J1_matched": "SELECT o_custkey AS full_id, count(*) AS n_gt FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey",
    "J1_unmatched": "SELECT s_suppkey AS full_id, 'gt' AS side FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, 'pred' FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier)",
    "J3_hierarchical": "SELECT r_name || '/' || n_name || '/' || s_name AS full_id, r_name || '/' || n_name AS scene, s_name AS file, (n_nationkey + 500)::DOUBLE AS fx FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "J5_projection": f"WITH {PROJ} SELECT img, r, c, round(gt, 6) AS gt FROM pd",
    "A17_sparse_counters": f"WITH {PROJ} SELECT a.img, input_points, coalesce(projected_pixels, 0) AS projected_pixels, round(mean_depth, 6) AS mean_depth FROM (SELECT img, count(*) AS input_points FROM pt GROUP BY img) a LEFT JOIN (SELECT img, count(*) AS projected_pixels, avg(gt) AS mean_depth FROM pd GROUP BY img) b USING (img)",
    "P11_planar_to_radial": f"WITH {GRID} SELECT img, r, c, round(gt * sqrt(((c - 3.5) / 6) ** 2 + ((r - 3.5) / 7) ** 2 + 1), 6) AS radial FROM g",
    "P13_spatial_class": "WITH s AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS a, CAST(l_linenumber * 8 AS INTEGER) AS b FROM lineitem) SELECT a, b, CASE WHEN a % 4 = 0 THEN 'none' WHEN (a - a % 4) % 8 = 0 THEN 'vae_crop' ELSE 'resize' END AS how FROM s",
    "A8_high_frequency_set": f"WITH {RGB}, {DFT}, h AS (SELECT img, sum(CASE WHEN dist > 0.75 THEN g ELSE 0 END) / sum(g) AS g, sum(CASE WHEN dist > 0.75 THEN p ELSE 0 END) / sum(p) AS p FROM f3 GROUP BY img) SELECT round(avg(p), 6) AS pred_ratio_mean, round(avg(g), 6) AS gt_ratio_mean, round(avg((p - g) / g), 6) AS relative_diff_mean, round(stddev_pop((p - g) / g), 6) AS relative_diff_std FROM h",
    "P12_normalised": f"WITH {GRID}, m AS (SELECT img, min(gt) FILTER (WHERE gt > 0) AS a, max(gt) FILTER (WHERE gt > 0) AS b FROM g GROUP BY img) SELECT img, r, c, round(CASE WHEN gt > 0 AND b - a >= 1e-8 THEN (gt - a) / (b - a) ELSE 0 END, 6) AS normalised FROM g JOIN m USING (img)",
    "P14_align_area": f"WITH {GRID}, o AS (SELECT img, y.t AS r, x.t AS c, gt, least((y.t + 1) * 8 / 3, g.r + 1) - greatest(y.t * 8 / 3, g.r) AS wy, least((x.t + 1) * 8 / 5, g.c + 1) - greatest(x.t * 8 / 5, g.c) AS wx FROM g, range(3) y(t), range(5) x(t)) SELECT img, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(sum(gt * wy * wx) / (64 / 15), 6) AS gt FROM o WHERE wy > 0 AND wx > 0 GROUP BY ALL",
    "P14_align_nearest": f"WITH {GRID}, t AS (SELECT CAST(y.t AS INTEGER) AS tr, CAST(x.t AS INTEGER) AS tc, floor(y.t * 8 / 11) AS sr, floor(x.t * 8 / 9) AS sc FROM range(11) y(t), range(9) x(t)) SELECT img, tr AS r, tc AS c, round(gt, 6) AS gt FROM g JOIN t ON g.r = sr AND g.c = sc",
    "P14_align_linear": f"WITH {RGB}, t AS (SELECT CAST(y.t AS INTEGER) AS tr, CAST(x.t AS INTEGER) AS tc, least(greatest((y.t + 0.5::DOUBLE) * 8 / 11 - 0.5, 0), 7) AS fy, least(greatest((x.t + 0.5::DOUBLE) * 8 / 10 - 0.5, 0), 7) AS fx FROM range(11) y(t), range(10) x(t)), "
    "k AS (SELECT tr, tc, floor(fy) + dy.d AS sr, floor(fx) + dx.d AS sc, CASE dy.d WHEN 0 THEN 1 - fy + floor(fy) ELSE fy - floor(fy) END * CASE dx.d WHEN 0 THEN 1 - fx + floor(fx) ELSE fx - floor(fx) END AS w FROM t, range(2) dy(d), range(2) dx(d)) "
    "SELECT img, tr AS r, tc AS c, round(sum(gr * w), 6) AS gr, round(sum(gg * w), 6) AS gg, round(sum(gb * w), 6) AS gb FROM g JOIN k ON g.r = sr AND g.c = sc GROUP BY ALL",
    "C7_C17_warnings": """
WITH s AS (
  SELECT p_partkey AS img, p_partkey * 7 % 60 * 1.0::DOUBLE AS normal, p_partkey * 13 % 150 * 1.0::DOUBLE AS pixels, p_partkey % 1000 / 1600::DOUBLE AS edge, (p_partkey % 10 + 95) / 100::DOUBLE AS mx, (p_partkey % 4 - 2) / 100::DOUBLE AS mn,
    CASE WHEN p_partkey % 50 <> 0 THEN p_partkey % 70 * 1.0::DOUBLE END AS psnr, p_partkey % 100 / 100::DOUBLE AS ssim, p_partkey * 3 % 100 / 100::DOUBLE AS lpips, p_partkey * 7 % 100 / 100::DOUBLE AS tail, (p_partkey % 21 - 10) / 10::DOUBLE AS hf,
    p_partkey % 9 * 1.0::DOUBLE AS bin, p_partkey % 20 / 100::DOUBLE AS norm, p_partkey % 11 * 1.0::DOUBLE AS rays, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 11 % 100 / 100::DOUBLE END AS rho, p_partkey % 45 * 1.0::DOUBLE AS angle FROM part
), w AS (
  SELECT img, 'normal_consistency' AS metric, 'too_high' AS warning_type, normal AS observed FROM s WHERE normal > 45
  UNION ALL SELECT img, 'normal_consistency', 'few_pixels', pixels FROM s WHERE pixels < 100
  UNION ALL SELECT img, 'depth_edge_f1', 'too_low', edge FROM s WHERE edge < 0.001
  UNION ALL SELECT img, 'depth_edge_f1', 'too_high', edge FROM s WHERE edge > 0.5
  UNION ALL SELECT img, 'rgb_input', 'too_high', mx FROM s WHERE mx > 1.01::DOUBLE
  UNION ALL SELECT img, 'rgb_input', 'too_low', mn FROM s WHERE mn < -0.01::DOUBLE
  UNION ALL SELECT img, 'rgb_psnr', 'too_low', psnr FROM s WHERE psnr < 10
  UNION ALL SELECT img, 'rgb_psnr', 'too_high', psnr FROM s WHERE psnr > 60
  UNION ALL SELECT img, 'rgb_ssim', 'too_low', ssim FROM s WHERE ssim < 0.3::DOUBLE
  UNION ALL SELECT img, 'rgb_lpips', 'too_high', lpips FROM s WHERE lpips > 0.7::DOUBLE
  UNION ALL SELECT img, 'tail_errors', 'too_high', tail FROM s WHERE tail > 0.5
  UNION ALL SELECT img, 'high_freq_energy', 'too_low', hf FROM s WHERE hf < -0.5
  UNION ALL SELECT img, 'depth_binned', 'empty_bin', bin FROM s WHERE bin = 0
  UNION ALL SELECT img, 'rays_input', 'not_unit', norm FROM s WHERE norm > 0.1::DOUBLE
  UNION ALL SELECT img, 'rays_input', 'no_valid_pixels', rays FROM s WHERE rays = 0
  UNION ALL SELECT img, 'rays_rho_a', 'too_low', rho FROM s WHERE rho < 0.3::DOUBLE
  UNION ALL SELECT img, 'rays_rho_a', 'too_high', angle FROM s WHERE angle > 30
)
SELECT img, metric, warning_type, round(observed, 6) AS observed FROM w""",
    "P4_valid_min_depth": f"WITH {PX} SELECT img, count(*) FILTER (WHERE isfinite(gt) AND isfinite(pred) AND gt > 0.001 AND pred > 0.001) AS n_default, count(*) FILTER (WHERE isfinite(gt) AND isfinite(pred) AND gt > 30 AND pred > 30) AS n_far FROM px GROUP BY img",
    "P16_P17_spaces": f"""
WITH {PX}, f AS (
  SELECT max(pred) AS hi FROM px WHERE pred > 0 AND isfinite(pred) AND img = (SELECT min(img) FROM px WHERE pred > 0)
), d AS (
  SELECT 'as_is' AS name, CASE WHEN hi <= 1.001 THEN 'normalized' ELSE 'metric' END AS space FROM f
  UNION ALL SELECT 'small', CASE WHEN hi / 1000 <= 1.001 THEN 'normalized' ELSE 'metric' END FROM f
  UNION ALL SELECT 'relative', 'relative' UNION ALL SELECT 'affine', 'affine'
)
SELECT name, space, fitted, fitted OR space <> 'metric' AS native, fitted OR space = 'metric' AS metric FROM d, (VALUES (false), (true)) t(fitted)""",
    "Y4_fov_threshold": "WITH f AS (SELECT s_suppkey AS img, degrees(2 * atan(sqrt((640 / (2 * ((s_suppkey % 40) * 25 + 40.0::DOUBLE))) ** 2 + (480 / (2 * ((s_suppkey % 40) * 25 + 40.0::DOUBLE))) ** 2))) AS d FROM supplier) SELECT img, CASE WHEN d <= 90 THEN 15.0::DOUBLE WHEN d >= 160 THEN 30.0::DOUBLE ELSE 20.0::DOUBLE END AS threshold FROM f",
    "C_warnings": f"WITH {SCORES} SELECT img, metric, warning_type, round(observed, 6) AS observed FROM w",
    "A18_warning_summary": f"WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY metric, warning_type ORDER BY img) AS k FROM w) SELECT metric, warning_type, count(*) AS n, string_agg(CAST(CAST(round(observed, 4) AS DECIMAL(20, 4)) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) AS first_values FROM k GROUP BY metric, warning_type",
}
