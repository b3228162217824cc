"""RGB scores (R1-R11) over (img, r, c, gr, gg, gb, pr, pg, pb [, depth, valid])."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from . import stencil as S

PAIRS = (("gr", "pr"), ("gg", "pg"), ("gb", "pb"))


def gray(side: str) -> Column:
    return 0.299 * F.col(f"{side}r") + 0.587 * F.col(f"{side}g") + 0.114 * F.col(f"{side}b")


def squared() -> Column:
    return sum(((F.col(p) - F.col(g)) ** 2 for g, p in PAIRS), F.lit(0.0)) / 3


def absolute() -> Column:
    return sum((F.abs(F.col(p) - F.col(g)) for g, p in PAIRS), F.lit(0.0)) / 3


def psnr(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """R1; R3 with a mask, where an image without pixels is NaN."""
    e = squared() if mask is None else F.when(mask, squared())
    out = df.groupBy("img").agg(F.avg(e).alias("mse"))
    return out.select("img", F.when(F.col("mse").isNull(), float("nan")).otherwise(P.psnr(F.col("mse"), F.lit(1.0))).alias("psnr"))


def ssim(df: DataFrame) -> DataFrame:
    """R2: the mean of the three channels' mean maps."""
    return S.ssim_map(S.together(df), list(PAIRS)).groupBy("img").agg(F.avg("ssim").alias("ssim"))


def structure_weighted_chroma(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Chromaticity error weighted by Scharr gradients of luminance."""
    total = {s: F.col(f"{s}r") + F.col(f"{s}g") + F.col(f"{s}b") + eps for s in "gp"}
    err = sum((F.abs(F.col(p) / total["p"] - F.col(g) / total["g"]) for g, p in PAIRS), F.lit(0.0)) / 3
    x = S.gradients(S.together(df).withColumns({"err": err, "yg": gray("g"), "yp": gray("p")}), ["yg", "yp"], 3.0, 10.0, 16.0, "reflect")
    w = (F.sqrt(F.col("yg_x") ** 2 + F.col("yg_y") ** 2) + F.sqrt(F.col("yp_x") ** 2 + F.col("yp_y") ** 2)) / 2
    a = x.withColumn("w", w).groupBy("img").agg(F.avg(F.col("w") * F.col("err")).alias("we"), F.avg("w").alias("w"))
    return a.select("img", F.when(F.col("w") < eps, 0.0).otherwise(F.col("we") / (F.col("w") + eps)).alias("sce"))


def edges(df: DataFrame, side: str, out: str, threshold: float = 0.1, method: str = "sobel") -> DataFrame:
    """Sobel magnitude; canny_approx keeps ridges across the gradient's direction, inside the border."""
    n = f"__{side}"
    x = S.gradients(df.withColumn(n, gray(side)), [n], 1.0, 2.0, 1.0, "reflect")
    gx, gy = F.col(f"{n}_x"), F.col(f"{n}_y")
    x = x.withColumn("__m", F.sqrt(gx * gx + gy * gy))
    edge = F.col("__m") > threshold
    if method == "canny_approx":
        angle = F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(180.0))
        x = x.withColumns({"__up": F.lag("__m").over(S.column()), "__down": F.lead("__m").over(S.column()), "__left": F.lag("__m").over(S.row()), "__right": F.lead("__m").over(S.row()), "__angle": angle})
        x = x.withColumns({"__ul": F.lag("__up").over(S.row()), "__ur": F.lead("__up").over(S.row()), "__dl": F.lag("__down").over(S.row()), "__dr": F.lead("__down").over(S.row())})
        ridge = lambda a, b: (F.col("__m") >= F.col(a)) & (F.col("__m") >= F.col(b))
        t = F.col("__angle")
        keep = F.when((t < 22.5) | (t >= 157.5), ridge("__left", "__right")).when(t < 67.5, ridge("__ul", "__dr")).when(t < 112.5, ridge("__up", "__down")).otherwise(ridge("__ur", "__dl"))
        edge = edge & F.coalesce(keep & F.col("__ul").isNotNull() & F.col("__dr").isNotNull(), F.lit(False))
    return x.withColumn(out, edge.cast("int")).select(*df.columns, out)


def edge_f1(df: DataFrame, threshold: float = 0.1, method: str = "sobel") -> DataFrame:
    """R8."""
    return S.match_edges(edges(edges(S.together(df), "g", "eg", threshold, method), "p", "ep", threshold, method), "ep", "eg")


def tails(df: DataFrame, by: tuple[str, ...] = ("img",)) -> DataFrame:
    """R9 by image, A7 with by=()."""
    a = df.withColumn("e", absolute()).groupBy(*by).agg(F.percentile("e", F.array(F.lit(0.95), F.lit(0.99))).alias("q"), F.max("e").alias("max_error"))
    return a.select(*by, F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"), "max_error")


def tails_by_channel(df: DataFrame) -> DataFrame:
    """R9b."""
    e = [F.struct(F.lit(g[1]).alias("channel"), F.abs(F.col(p) - F.col(g)).alias("e")) for g, p in PAIRS]
    x = df.select("img", F.explode(F.array(*e)).alias("x")).select("img", "x.*")
    a = x.groupBy("img", "channel").agg(F.percentile("e", F.array(F.lit(0.95), F.lit(0.99))).alias("q"))
    return a.select("img", "channel", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))


def tail_pixels(df: DataFrame, percentile: float = 0.95) -> DataFrame:
    """Pixels at or above the image's percentile."""
    x = df.withColumn("e", absolute())
    return x.join(x.groupBy("img").agg(F.percentile("e", percentile).alias("limit")), "img").where("e >= limit").select("img", "r", "c", "e")


def depth_binned(df: DataFrame, near: float = 1.0, far: float = 5.0) -> DataFrame:
    """Mean errors in near, mid, far and all; a bin without pixels scores 0."""
    x = df.select("img", "depth", absolute().alias("a"), squared().alias("s")).where(P.finite(F.col("depth")) & (F.col("depth") > 0))
    parts = x.groupBy("img", P.depth_bin(F.col("depth"), near, far).alias("bin")).agg(F.sum("a").alias("a"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    both = parts.unionByName(parts.groupBy("img").agg(F.sum("a").alias("a"), F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("bin", F.lit("all")))
    every = df.select("img").distinct().withColumn("bin", F.explode(F.array(*map(F.lit, ("near", "mid", "far", "all")))))
    out = every.join(both, ["img", "bin"], "left")
    return out.select("img", "bin", *(F.coalesce(F.col(k) / F.col("n"), F.lit(0.0)).alias(m) for k, m in (("a", "mae"), ("s", "mse"))), F.coalesce("n", F.lit(0)).alias("n"))


def spectra(df: DataFrame) -> DataFrame:
    """(img, u, v, dist, g, p): the power of the discrete Fourier transforms of both luminances. An image is a task's
    unit: its pixels meet once, and a fast transform takes the place of a row for each pixel and frequency."""

    def transform(key, pixels: pd.DataFrame) -> pd.DataFrame:
        r, c = pixels["r"].to_numpy(), pixels["c"].to_numpy()
        h, w = r.max() + 1, c.max() + 1
        out = {}
        for side in "gp":
            y = np.zeros((h, w))
            y[r, c] = pixels[side].to_numpy()
            out[side] = (np.abs(np.fft.fft2(y)) ** 2).ravel()
        u, v = np.divmod(np.arange(h * w), w)
        centred = lambda k, n: (k + n // 2) % n - n // 2
        far = np.hypot(h // 2, w // 2) or 1.0
        return pd.DataFrame({"img": [key[0]] * (h * w), "u": u, "v": v, "dist": np.sqrt(centred(u, h) ** 2.0 + centred(v, w) ** 2.0) / far, **out})

    transform.__annotations__ = {}
    kind = df.schema["img"].dataType.simpleString()
    x = df.select("img", "r", "c", gray("g").alias("g"), gray("p").alias("p"))
    return S.together(x).groupBy("img").applyInPandas(transform, f"img {kind}, u int, v int, dist double, g double, p double")


def high_frequency(df: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """The share of power beyond 1 - cutoff of the largest distance, and how it is kept."""
    share = lambda s: F.coalesce(F.try_divide(F.sum(F.when(F.col("dist") > 1 - cutoff, F.col(s)).otherwise(0.0)), F.sum(s)), F.lit(0.0)).alias(s)  # noqa: E731  a black image has none
    x = spectra(df).groupBy("img").agg(share("g"), share("p"))
    g, p = F.col("g"), F.col("p")
    rel = F.when(g > 1e-10, (p - g) / g).when(p > 1e-10, float("inf")).otherwise(0.0)
    kept = F.when(g > 1e-10, F.least(p / g, F.lit(1.0))).when(p > 1e-10, 0.0).otherwise(1.0)
    return x.select("img", p.alias("pred_ratio"), g.alias("gt_ratio"), rel.alias("relative_diff"), F.abs(p - g).alias("absolute_diff"), kept.alias("preservation"))


def high_frequency_over_images(scores: DataFrame) -> DataFrame:
    """Mean shares; mean and population deviation of the finite differences."""
    d = F.when(P.finite(F.col("relative_diff")), F.col("relative_diff"))
    return scores.agg(F.avg("pred_ratio").alias("pred_ratio_mean"), F.avg("gt_ratio").alias("gt_ratio_mean"), F.avg(d).alias("relative_diff_mean"), F.stddev_pop(d).alias("relative_diff_std"))


def spectrum_bands(df: DataFrame, bands: int = 4) -> DataFrame:
    """R10d: energy by radial band and how alike it is; the farthest corner is in none."""
    x = spectra(df).where("dist < 1").groupBy("img", F.floor(F.col("dist") * bands).cast("int").alias("band")).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    ratio = F.when(F.col("g") > 1e-10, F.col("p") / F.col("g")).otherwise(F.when(F.col("p") > 1e-10, float("inf")).otherwise(1.0))
    return x.select("img", "band", F.col("g").alias("gt_energy"), F.col("p").alias("pred_energy"), (1 - F.least(F.abs(ratio - 1), F.lit(1.0))).alias("similarity"))
