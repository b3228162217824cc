"""Stencils over (img, r, c, ...) relations by windows along rows and columns. ``together`` brings an image's pixels to
one partition first, which serves the windows of both directions; without it they would be shuffled for each.

Taps beyond the border are zero or repeat the border pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P


def together(df: DataFrame) -> DataFrame:
    """The one shuffle of a chain of stencils, into as many partitions as the session says: work on images outweighs
    their bytes, by which partitions would be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img")


def row():
    return Window.partitionBy("img", "r").orderBy("c")


def column():
    return Window.partitionBy("img", "c").orderBy("r")


def tap(x: Column, step: int, along: str, pad: str) -> Column:
    w = row() if along == "c" else column()
    near = (F.lead if step > 0 else F.lag)(x, abs(step))
    return F.coalesce(near.over(w), x if pad == "reflect" else F.lit(0.0))


def gradients(df: DataFrame, columns: list[str], side: float, middle: float, scale: float, pad: str) -> DataFrame:
    """name_x and name_y: a difference along one axis, smoothed by (side, middle, side) along the other."""
    first = {}
    for n in columns:
        x = F.col(n)
        for axis, out in (("c", "x"), ("r", "y")):
            first[f"{n}_d{out}"] = tap(x, 1, axis, pad) - tap(x, -1, axis, pad)
    df = df.withColumns(first)
    second = {}
    for n in columns:
        for axis, out in (("r", "x"), ("c", "y")):
            d = F.col(f"{n}_d{out}")
            second[f"{n}_{out}"] = (side * tap(d, -1, axis, pad) + middle * d + side * tap(d, 1, axis, pad)) / scale
    return df.withColumns(second).drop(*first)


def neighbourhood(df: DataFrame, name: str, out: str, how: str) -> DataFrame:
    """Dilation (how = max) or erosion (min, outside false) of a 0/1 column over 3 x 3."""
    f = F.max if how == "max" else F.min
    rows, cols = row().rowsBetween(-1, 1), column().rowsBetween(-1, 1)
    whole = F.count(F.lit(1)).over(rows) == 3
    a = f(name).over(rows) if how == "max" else F.when(whole, f(name).over(rows)).otherwise(0)
    df = df.withColumn("__a", a)
    whole = F.count(F.lit(1)).over(cols) == 3
    b = f("__a").over(cols) if how == "max" else F.when(whole, f("__a").over(cols)).otherwise(0)
    return df.withColumn(out, b).drop("__a")


def _angles(df: DataFrame, *masks: Column) -> DataFrame:
    """Every pixel, with the angle between its normals where the 3 x 3 neighbourhood is valid."""
    ok = F.coalesce(P.valid(F.col("gt"), F.col("pred"), *masks), F.lit(False)).cast("int")
    df = gradients(together(df).withColumn("ok", ok), ["gt", "pred"], 1.0, 2.0, 8.0, "zero")
    df = neighbourhood(df, "ok", "inner", "min")
    length = lambda n: F.sqrt(F.col(f"{n}_x") ** 2 + F.col(f"{n}_y") ** 2 + 1)
    dot = (F.col("gt_x") * F.col("pred_x") + F.col("gt_y") * F.col("pred_y") + 1) / (length("gt") * length("pred"))
    dot = F.when(F.col("inner") == 1, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    return df.select("img", "r", "c", dot.alias("dot"), F.degrees(F.acos(dot)).alias("angle"))


def normal_angles(df: DataFrame, *masks: Column) -> DataFrame:
    """Degrees between surface normals where the 3 x 3 neighbourhood is valid."""
    return _angles(df, *masks).where("angle is not null")


def normal_consistency(df: DataFrame, *masks: Column, by: tuple[str, ...] = ("img",)) -> DataFrame:
    """D8b by image, A4 with by=(). An image without a valid neighbourhood has NaN throughout."""
    below = {f"below_{n}": F.avg((F.col("angle") < t).cast("double")) * 100 for n, t in (("11_25", 11.25), ("22_5", 22.5), ("30", 30.0))}
    found = {"mean_angle": F.avg("angle"), "median_angle": F.median("angle"), "mean_dot": F.avg("dot"), **below}
    return _angles(df, *masks).groupBy(*by).agg(*(P.or_nan(x).alias(n) for n, x in found.items()))


def depth_edges(df: DataFrame, name: str, out: str, threshold: float = 0.1, method: str = "relative", mask: Column | None = None) -> DataFrame:
    """Spans of two pixels against a share of the depth (zero padding) or a depth, or Sobel (reflect). Edges lie
    on valid pixels (by default those of this map alone), and none where a NaN takes part."""
    x = F.col(name)
    ok = P.finite(x) & (x > 0) if mask is None else mask
    edge = lambda span, limit: F.coalesce(ok & ~F.isnan(span) & (span > limit), F.lit(False)).cast("int")
    if method == "sobel":
        df = gradients(df, [name], 1.0, 2.0, 1.0, "reflect")
        return df.withColumn(out, edge(F.sqrt(F.col(f"{name}_x") ** 2 + F.col(f"{name}_y") ** 2), threshold)).drop(f"{name}_x", f"{name}_y")
    span = F.greatest(*(F.abs(tap(x, 1, a, "zero") - tap(x, -1, a, "zero")) for a in ("c", "r")))  # NaN is the greatest
    return df.withColumn(out, edge(span, threshold * x if method == "relative" else F.lit(threshold)))


def match_edges(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """Precision, recall and F1 with a pixel of tolerance."""
    df = neighbourhood(neighbourhood(df, gt, "__dg", "max"), pred, "__dp", "max")
    a = df.groupBy("img").agg(F.sum(pred).alias("n_pred"), F.sum(gt).alias("n_gt"), F.sum(F.col(pred) * F.col("__dg")).alias("hit_p"), F.sum(F.col(gt) * F.col("__dp")).alias("hit_g"))
    p = F.when(F.col("n_pred") > 0, F.col("hit_p") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_gt") > 0, F.col("hit_g") / F.col("n_gt")).otherwise(0.0)
    a = a.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return a.select("img", "n_pred", "n_gt", "precision", "recall", f1.alias("f1"))


def depth_edge_f1(df: DataFrame, threshold: float = 0.1, method: str = "relative", *masks: Column) -> DataFrame:
    """Edges of both maps on pixels valid in both."""
    ok = P.valid(F.col("gt"), F.col("pred"), *masks)
    return match_edges(depth_edges(depth_edges(together(df), "gt", "eg", threshold, method, ok), "pred", "ep", threshold, method, ok), "ep", "eg")


def macro_f1(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A5: over images with an edge on either side."""
    return scores.where("n_pred > 0 or n_gt > 0").groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count(F.lit(1)).alias("n_images"))


def blurred(df: DataFrame, columns: list[str], keep: tuple[str, ...] = (), radius: int = 5, sigma: float = 11 / 6) -> DataFrame:
    """A Gaussian of 2 * radius + 1 taps along both axes, mirrored with the border pixel repeated; null counts as 0.
    The numbers of ``keep`` stay as they are (null as NaN). df: as ``together`` or a window by img leaves it. An image is a task's unit: its pixels meet once and are blurred as arrays, without a row for each pixel and tap."""
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    weights /= weights.sum()

    def blur(pixels: pa.Table) -> pa.Table:
        r, c = (pixels[k].to_numpy() for k in ("r", "c"))
        h, w = int(r.max()) + 1, int(c.max()) + 1
        out = [pixels["img"].combine_chunks().take(pa.array(np.zeros(h * w, np.int64)))]
        out += [pa.array(k.astype(np.int32)) for k in np.divmod(np.arange(h * w), w)]
        for n in columns:
            y = np.zeros((h, w))
            y[r, c] = pixels[n].to_numpy()
            for pad in (((radius, radius), (0, 0)), ((0, 0), (radius, radius))):
                wide = np.pad(y, pad, mode="symmetric")
                y = sum(k * (wide[i : i + h] if pad[0][0] else wide[:, i : i + w]) for i, k in enumerate(weights))
            out.append(pa.array(y.ravel()))
        for n in keep:
            y = np.full((h, w), np.nan)
            y[r, c] = pixels[n].to_numpy()
            out.append(pa.array(y.ravel()))
        return pa.table(out, names=["img", "r", "c", *columns, *keep])

    blur.__annotations__ = {"pixels": pa.Table, "return": pa.Table}
    kind = df.schema["img"].dataType.simpleString()  # the cast lets the fields of a struct be null, as this type says
    x = df.select(F.col("img").cast(kind).alias("img"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in columns), *(F.col(n).cast("double").alias(n) for n in keep))
    return x.groupBy("img").applyInArrow(blur, f"img {kind}, r int, c int, " + ", ".join(f"`{n}` double" for n in (*columns, *keep)))


def ssim_map(df: DataFrame, pairs: list[tuple[str, str]], k1: float = 0.01, k2: float = 0.03, weight: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(img, r, c, ssim), the mean over the pairs of columns, the blurred weight if one is named, and ``keep``."""
    c1, c2, inputs, scores = k1**2, k2**2, {}, []
    for i, (p, q) in enumerate(pairs):
        inputs |= {f"a{i}": F.col(p), f"b{i}": F.col(q), f"aa{i}": F.col(p) ** 2, f"bb{i}": F.col(q) ** 2, f"ab{i}": F.col(p) * F.col(q)}
        a, b, aa, bb, ab = (F.col(f"{n}{i}") for n in ("a", "b", "aa", "bb", "ab"))
        scores.append((2 * a * b + c1) * (2 * (ab - a * b) + c2) / ((a**2 + b**2 + c1) * (aa - a**2 + bb - b**2 + c2)))
    if weight:
        inputs["weight"] = F.col(weight)
    m = blurred(df.select("img", "r", "c", *(x.alias(n) for n, x in inputs.items()), *keep), list(inputs), keep)
    return m.select("img", "r", "c", (sum(scores[1:], scores[0]) / len(scores)).alias("ssim"), *(["weight"] if weight else []), *keep)


def depth_ssim(df: DataFrame, *masks: Column) -> DataFrame:
    """D3: both maps scaled by their common extremes over valid pixels, others 0; the mean where over half of the
    window's weight is valid. Equal constants score 1; an image without valid pixels, or enough of them, 0."""
    ok = F.coalesce(P.valid(F.col("gt"), F.col("pred"), *masks), F.lit(False))
    w = Window.partitionBy("img")
    of = lambda f, g: f(*(g(F.when(F.col("ok"), F.col(n))).over(w) for n in ("gt", "pred")))
    x = together(df.withColumn("ok", ok)).withColumns({"lo": of(F.least, F.min), "hi": of(F.greatest, F.max)}).withColumn("span", F.col("hi") - F.col("lo"))
    scaled = lambda c: F.when(F.col("ok") & (F.col("span") >= 1e-8), (F.col(c) - F.col("lo")) / F.col("span")).otherwise(0.0)
    x = x.withColumns({"a": scaled("gt"), "b": scaled("pred"), "weight": F.col("ok").cast("double")})
    s = ssim_map(x, [("a", "b")], weight="weight", keep=("span",)).groupBy("img").agg(F.avg(F.when(F.col("weight") > 0.5, F.col("ssim"))).alias("s"), F.min("span").alias("span"))
    return s.select("img", F.coalesce(F.when(F.col("span") < 1e-8, 1.0), "s", F.lit(0.0)).alias("ssim"))
