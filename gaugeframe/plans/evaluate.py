"""Evaluation runs: from relations of pixels to scores by image and a summary of the set.

A run returns two long relations, ``images`` (space, img, path, value) and ``summary`` (space, bin, path, value); the
paths are those of the result tree. Spaces and depth bins are part of the image's key, so one pass serves all of them,
and nothing but the summary is small enough to be gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import depth, rays, rgb, sets, stencil
from ..sinks import results


@dataclass(frozen=True)
class Evaluation:
    images: DataFrame
    summary: DataFrame
    space: str = ""

    def tree(self, root: str) -> dict:
        """K4, K6-K8: {root: {space: {bin: {category: ...}}}}; without spaces or bins these levels are left out."""
        rows = [(".".join(x for x in (root, r["space"], r["bin"], r["path"]) if x), r["value"]) for r in self.summary.collect()]
        return results.clean(results.nest(sorted(rows)))

    def files(self) -> dict:
        """K5: the {children, files} tree of the images' scores; an image without any keeps an empty entry."""
        rows = self.images.groupBy("img").agg(F.collect_list(F.struct("space", "path", "value")).alias("x")).orderBy("img").collect()
        return results.file_tree([(str(r["img"]), results.nest([(".".join(p for p in (v["space"], v["path"]) if p), v["value"]) for v in r["x"]])) for r in rows])


def _long(df: DataFrame, keys: list[str | Column], paths: dict[str, Column]) -> DataFrame:
    """A row (keys, path, value) for each of the paths."""
    rows = F.array(*(F.struct(F.lit(k).alias("path"), v.cast("double").alias("value")) for k, v in paths.items()))
    wide = df.select(*keys, F.explode(rows).alias("x"))
    return wide.select(*(c for c in wide.columns if c != "x"), "x.*")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_spaces(pixels: DataFrame, mode: str = "auto_affine", hint: str | None = None, sky: bool = False) -> tuple[str, DataFrame]:
    """The detected space, and the pixels in each space that is reported, which becomes part of img. mode:
    none, affine (always fitted) or auto_affine (fitted where predictions are not metric). With sky masks the fit
    leaves out references above their 95th percentile."""
    if mode not in ("none", "affine", "auto_affine"):
        raise ValueError(f"unknown alignment {mode!r}")
    found = depth.input_space(pixels, hint)
    masks = [F.col("sky_valid")] if sky else []
    fitted = mode == "affine" or mode == "auto_affine" and found != "metric"
    wanted = depth.emitted(found, fitted)
    fit = depth.settled(depth.scale_and_shift(pixels, sky, *masks)) if fitted and wanted["metric"] else None
    frames = [(n, depth.with_fit(pixels, fit) if n == "metric" and fitted else pixels) for n in ("native", "metric") if wanted[n]]
    return found, _union([f.withColumn("img", F.struct(F.lit(n).alias("space"), F.col("img").alias("id"))) for n, f in frames])


def _keys() -> list[Column]:
    return [F.col("img.space").alias("space"), F.col("img.id").alias("img")]


def _depth_summary(px: DataFrame, masks: list[Column], benchmark: tuple[float, float] | None) -> list[DataFrame]:
    """The standard scores, and medians and 90th percentiles over pixels, by space and bin; the bin of all pixels is
    empty. Sums are taken once for each bin and added up to ``all`` and the set."""
    bin_ = P.benchmark_bin(F.col("gt"), *benchmark) if benchmark else F.lit(None).cast("string")
    e = depth.errors(px, *masks).select("img", F.col("img.space").alias("space"), bin_.alias("bin"), "gt", "rel", "d", "l", "ratio")
    bins = F.explode(F.when(F.col("bin").isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("bin"), F.lit("all")))).alias("bin")
    parts = e.groupBy("img", "space", "bin").agg(*depth.sums())
    stats = [c for c in parts.columns if c not in ("img", "space", "bin")]
    images = parts.select("img", "space", bins, *stats).groupBy("img", "space", "bin").agg(*(F.sum(c).alias(c) for c in stats))
    path = F.concat_ws(".", F.lit("standard"), "reduction", "metric")
    also = F.when(path == "standard.image_mean.silog", F.array(path, F.lit("depth_metrics.silog.mean"))).otherwise(F.array(path))
    standard = depth.over_images(images, ("space", "bin")).select("space", "bin", F.explode(also).alias("path"), "value")
    q = depth.group_quantiles(e.select("space", bins, "rel", "d", "l"), ["space", "bin"], {"absrel": F.col("rel"), "rmse": F.abs("d"), "silog": F.abs("l")}, [0.5, 0.9], 1024)
    rows = [(*g, f"depth_metrics.{m}.{n}", x) for g, of in q.items() for m, pair in of.items() for n, x in zip(("median", "p90"), pair, strict=True)]
    return [standard, px.sparkSession.createDataFrame(rows, "space string, bin string, path string, value double")]


def evaluate_depth(pixels: DataFrame, mode: str = "auto_affine", hint: str | None = None, sky: bool = False, benchmark: tuple[float, float] | None = None, dense: bool = True) -> Evaluation:
    """Depth maps (img, r, c, gt, pred [, sky_valid]). benchmark: depths between which near, mid, far and all are
    reported. dense: also PSNR, SSIM (without the sky mask), normals and edges; sparse references have none of them."""
    found, px = in_spaces(pixels, mode, hint, sky)
    masks = [F.col("sky_valid")] if sky else []
    standard = depth.standard(px, *masks)
    one = {f"standard.{m}": F.col(m) for m in depth.STANDARD} | {"depth_metrics.absrel": F.col("absrel"), "depth_metrics.rmse": F.col("rmse"), "depth_metrics.silog": F.col("silog")}
    images = [_long(standard, _keys(), one if dense else one | {"depth_metrics.valid_pixel_count": F.col("n")})]
    summary = []
    if dense:
        psnr, ssim = depth.psnr(px, *masks), stencil.depth_ssim(px)
        normals, edges = stencil.normal_consistency(px, *masks), stencil.depth_edge_f1(px, 0.1, "relative", *masks)
        images += [_long(psnr, _keys(), {"image_quality.psnr": F.col("psnr")}), _long(ssim, _keys(), {"image_quality.ssim": F.col("ssim")}), _long(normals, _keys(), {"geometric_metrics.normal_consistency.mean_angle": F.col("mean_angle")})]
        images.append(_long(edges, _keys(), {f"geometric_metrics.depth_edge_f1.{m}": F.col(m) for m in ("precision", "recall", "f1")}))
        of_space = F.col("img.space").alias("space")
        for df, m in ((psnr, "psnr"), (ssim, "ssim")):
            summary.append(df.groupBy(of_space).agg(P.mean_finite(F.col(m)).alias("value")).select("space", F.lit(f"image_quality.{m}").alias("path"), "value"))
        angles = stencil.normal_angles(px, *masks).select(of_space, "angle")
        shares = angles.groupBy("space").agg(F.avg("angle").alias("mean"), *(F.avg((F.col("angle") < t).cast("double") * 100).alias(n) for n, t in (("11_25", 11.25), ("22_5", 22.5), ("30", 30.0))))
        at = "geometric_metrics.normal_consistency"
        summary.append(_long(shares, ["space"], {f"{at}.mean_angle": F.col("mean"), **{f"{at}.percent_below_{n}": F.col(n) for n in ("11_25", "22_5", "30")}}))
        spaces = [n for n, wanted in depth.emitted(found, mode == "affine" or mode == "auto_affine" and found != "metric").items() if wanted]
        median = depth.exact_quantiles(angles, {n: F.when(F.col("space") == n, F.col("angle")) for n in spaces}, [0.5])
        summary.append(px.sparkSession.createDataFrame([(n, f"{at}.median_angle", median[n][0]) for n in spaces], "space string, path string, value double"))
        macro = stencil.macro_f1(edges.withColumn("space", F.col("img.space")), ("space",))
        summary.append(_long(macro, ["space"], {f"geometric_metrics.depth_edge_f1.{m}": F.col(m) for m in ("precision", "recall", "f1")}))
    rows = _depth_summary(px, masks, benchmark) + [s.select("space", F.lit("").alias("bin"), "path", "value") for s in summary]
    return Evaluation(_union(images), _union(rows), found)


def evaluate_sparse_depth(points: DataFrame, pred: DataFrame, camera: dict, mode: str = "auto_affine", hint: str | None = None, sky: bool = False, benchmark: tuple[float, float] | None = None) -> Evaluation:
    """Point clouds (img, pt, x, y, z) against maps (img, r, c, pred [, sky_valid]). camera: what sets.project takes.
    An image whose points reach no pixel keeps a count of 0."""
    gt = sets.project(points, **camera)
    pixels = pred.join(gt, ["img", "r", "c"], "left")
    return evaluate_depth(pixels.withColumn("gt", F.coalesce("gt", F.lit(0.0))), mode, hint, sky, benchmark, dense=False)


def evaluate_rgb(pixels: DataFrame, has_depth: bool = False, sky: bool = False, features: tuple[DataFrame, DataFrame] | None = None) -> Evaluation:
    """RGB images (img, r, c, gr, gg, gb, pr, pg, pb [, depth, sky_valid]). With a sky mask both images are black where
    it does not hold (P9). A score that is not finite is left out of the means (P21). features: (id, x) of both sides
    from any extractor, for the distances between sets."""
    if sky:
        pixels = pixels.withColumns({c: F.when(F.col("sky_valid"), F.col(c)).otherwise(0.0) for g, p in rgb.PAIRS for c in (g, p)})
    edges, tails, waves = rgb.edge_f1(pixels), rgb.tails(pixels), rgb.high_frequency(pixels)
    parts = [
        (rgb.psnr(pixels, F.col("sky_valid") if sky else None), {"image_quality.psnr": "psnr"}), (rgb.ssim(pixels), {"image_quality.ssim": "ssim"}), (rgb.structure_weighted_chroma(pixels), {"image_quality.sce": "sce"}),
        (edges, {f"edge_f1.{m}": m for m in ("precision", "recall", "f1")}), (tails, {f"tail_errors.{m}": m for m in ("p95", "p99")}), (waves, {f"high_frequency.{m}": m for m in ("pred_ratio", "gt_ratio", "relative_diff")}),
    ]
    images = [_long(df, ["img"], {k: F.col(c) for k, c in names.items()}) for df, names in parts]
    skipped = ("edge_f1.", "tail_errors.")
    means = [x for x, (_, names) in zip(images, parts, strict=True) if not next(iter(names)).startswith(skipped)]
    if has_depth:
        binned = rgb.depth_binned(pixels)
        rows = F.array(*(F.struct(F.concat(F.lit(f"depth_binned.{m}."), "bin").alias("path"), F.col(m).alias("value")) for m in ("mae", "mse")))
        images.append(binned.select("img", F.explode(rows).alias("x")).select("img", "x.*"))
        means.append(images[-1])
    summary = [_union(means).groupBy("path").agg(P.mean_finite(F.col("value")).alias("value"))]
    summary.append(_long(stencil.macro_f1(edges), [], {f"edge_f1.{m}": F.col(m) for m in ("precision", "recall", "f1")}))
    q = depth.exact_quantiles(pixels, {"e": rgb.absolute()}, [0.95, 0.99])["e"]
    summary.append(pixels.sparkSession.createDataFrame([("tail_errors.p95", q[0]), ("tail_errors.p99", q[1])], "path string, value double"))
    if features:
        rows = [("image_quality.fid", sets.frechet_distance(*features)), ("image_quality.kid", float(sets.kernel_distance(*features).first()[0]))]
        summary.append(pixels.sparkSession.createDataFrame(rows, "path string, value double"))
    blank = F.lit("")
    return Evaluation(_union(images).select(blank.alias("space"), "img", "path", "value"), _union(summary).select(blank.alias("space"), blank.alias("bin"), "path", "value"))


def evaluate_rays(directions: DataFrame, domain: str) -> Evaluation:
    """Camera rays (img, ray, gx..gz, px..pz) with the threshold of a field-of-view domain."""
    one = rays.by_image(directions, P.fov_threshold(domain))
    images = _long(one, ["img"], {"rho_a": F.col("rho_a"), "angle.mean": F.col("mean_angle"), "angle.median": F.col("median_angle")})
    over = _long(rays.over_images(one), [], {"rho_a.mean": F.col("rho_mean"), "rho_a.median": F.col("rho_median"), "rho_a.std": F.col("rho_std")})
    pooled = _long(rays.histogram_median(directions), [], {"angle.mean": F.col("mean_angle"), "angle.median": F.col("median_angle"), **{f"angle.percent_below_{t}": F.col(f"below_{t}") for t in rays.LIMITS}})
    blank = F.lit("")
    return Evaluation(images.select(blank.alias("space"), "img", "path", "value"), over.unionByName(pooled).select(blank.alias("space"), blank.alias("bin"), "path", "value"))
