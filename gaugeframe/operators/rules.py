"""Sanity rules as data (C1-C17, A18, K10): a rule is a condition over a row of scores; a warning is a row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P

#: The default limits.
DEFAULTS = {
    "depth_max": 100.0, "psnr_max_high": 100.0, "psnr_max_low": 0.1, "ssim_range": 0.1, "absrel_median": 1.0, "absrel_p90": 2.0, "rmse_share": 0.5, "silog": 0.5, "normal_angle": 45.0, "normal_pixels": 100, "edge_low": 0.001, "edge_high": 0.5,
    "rgb_max": 1.01, "rgb_min": -0.01, "rgb_psnr_low": 10.0, "rgb_psnr_high": 60.0, "rgb_ssim": 0.3, "lpips": 0.7, "tail_p99": 0.5, "high_freq": -0.5, "ray_norm": 0.1, "rho_low": 0.3, "ray_angle": 30.0,
}


@dataclass(frozen=True)
class Rule:
    metric: str
    kind: str
    needs: tuple[str, ...]
    holds: object = field(repr=False)
    observed: str = ""


def rules(limits: dict | None = None) -> list[Rule]:
    t = DEFAULTS | (limits or {})
    c = F.col
    over = lambda m, col, k, kind="too_high": Rule(m, kind, (col,), lambda: P.finite(c(col)) & (c(col) > t[k]), col)
    under = lambda m, col, k, kind="too_low": Rule(m, kind, (col,), lambda: P.finite(c(col)) & (c(col) < t[k]), col)
    return [
        over("depth_input", "depth_max", "depth_max", "depth_too_large"), Rule("depth_input", "negative_depth", ("depth_min",), lambda: c("depth_min") < 0, "depth_min"), Rule("depth_input", "no_valid_pixels", ("n_valid",), lambda: c("n_valid") == 0, "n_valid"),
        over("depth_psnr", "peak", "psnr_max_high"), under("depth_psnr", "peak", "psnr_max_low"), under("depth_ssim", "depth_range", "ssim_range"), over("depth_absrel", "absrel_median", "absrel_median", "median_too_high"), over("depth_absrel", "absrel_p90", "absrel_p90", "p90_too_high"),
        Rule("depth_rmse", "too_high", ("rmse", "depth_range"), lambda: P.finite(c("rmse")) & (c("rmse") > t["rmse_share"] * c("depth_range")), "rmse"), over("depth_silog", "silog", "silog"), over("normal_consistency", "mean_normal_angle", "normal_angle"), under("normal_consistency", "normal_pixels", "normal_pixels", "few_pixels"),
        under("depth_edge_f1", "gt_edge_ratio", "edge_low"), over("depth_edge_f1", "gt_edge_ratio", "edge_high"), over("rgb_input", "rgb_max", "rgb_max"), under("rgb_input", "rgb_min", "rgb_min"),
        Rule("rgb_psnr", "too_low", ("rgb_psnr",), lambda: P.finite(c("rgb_psnr")) & (c("rgb_psnr") < t["rgb_psnr_low"]), "rgb_psnr"), Rule("rgb_psnr", "too_high", ("rgb_psnr",), lambda: P.finite(c("rgb_psnr")) & (c("rgb_psnr") > t["rgb_psnr_high"]), "rgb_psnr"),
        under("rgb_ssim", "rgb_ssim", "rgb_ssim"), over("rgb_lpips", "rgb_lpips", "lpips"), over("tail_errors", "tail_p99", "tail_p99"), under("high_freq_energy", "hf_relative_diff", "high_freq"),
        Rule("depth_binned", "empty_bin", ("bin_pixels",), lambda: c("bin_pixels") == 0, "bin_pixels"), over("rays_input", "norm_error", "ray_norm", "not_unit"), Rule("rays_input", "no_valid_pixels", ("n_rays",), lambda: c("n_rays") == 0, "n_rays"), under("rays_rho_a", "rho_a", "rho_low"), over("rays_rho_a", "mean_ray_angle", "ray_angle"),
    ]


def warnings(scores: DataFrame, limits: dict | None = None, key: str = "img") -> DataFrame:
    """(img, metric, warning_type, observed): rules whose columns are there, one pass, no join."""
    cols = set(scores.columns)
    rows: list[Column] = [F.when(r.holds(), F.struct(F.lit(r.metric).alias("metric"), F.lit(r.kind).alias("warning_type"), F.col(r.observed).cast("double").alias("observed"))) for r in rules(limits) if cols.issuperset(r.needs)]
    if not rows:
        raise ValueError("no rule applies to these columns")
    return scores.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("w")).select(key, "w.*")


def summary(found: DataFrame, key: str = "img", first: int = 5) -> DataFrame:
    """Count and the first observed values of each kind; only those few rows of a kind are gathered."""
    w = Window.partitionBy("metric", "warning_type").orderBy(key)
    few = found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).groupBy("metric", "warning_type").agg(F.array_sort(F.collect_list(F.struct("k", "observed"))).alias("x"))
    counts = found.groupBy("metric", "warning_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(few, ["metric", "warning_type"]).select("metric", "warning_type", "n", F.transform("x", lambda v: v["observed"]).alias("first_values"))
