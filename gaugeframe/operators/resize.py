"""Reference frames brought to the prediction's size (P14) and shown in [0, 1].

A pixel knows which target pixels it reaches and with what weight on each axis, so a resize is one explode and one
sum by (img, r, c), combined before the shuffle; no frame is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P


def _weight(how: str, i: Column, t: Column, g: int, p: int) -> Column:
    """Of source index i in target index t, on an axis of g source and p target pixels."""
    s = g / p
    if how == "nearest":
        return (F.least(F.floor(t * s), F.lit(g - 1)) == i).cast("double")
    if how == "area":
        return F.greatest(F.lit(0.0), F.least((t + 1) * s, i + 1.0) - F.greatest(t * s, i.cast("double"))) / s
    x = F.greatest(F.lit(0.0), F.least(F.lit(g - 1.0), (t + 0.5) * s - 0.5))
    return F.greatest(F.lit(0.0), 1 - F.abs(x - i))


def _reached(how: str, i: Column, g: int, p: int) -> Column:
    """The targets with a weight above rounding noise, as an array of (t, w)."""
    s, far = g / p, 2 if how == "linear" else 1
    first, last = F.greatest(F.lit(0), F.floor((i - far) / s) - 1), F.least(F.lit(p - 1), F.ceil((i + far) / s) + 1)
    pairs = F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda t: F.struct(t.alias("t"), _weight(how, i, t, g, p).alias("w")))
    return F.filter(pairs, lambda x: x["w"] > 1e-12)


def method(kind: str, gh: int, gw: int, ph: int, pw: int) -> str:
    """none, crop, nearest, area or linear. kind: depth, mask or rgb."""
    if (gh, gw) == (ph, pw):
        return "none"
    if ph % 8 == 0 and pw % 8 == 0 and 0 <= gh - ph < 8 and 0 <= gw - pw < 8:
        return "crop"
    if kind == "mask":
        return "nearest"
    if ph * pw < gh * gw:
        if ph > gh or pw > gw:
            raise ValueError("an area mean needs both axes to shrink")
        return "area"
    return "linear" if kind == "rgb" else "nearest"


def resize(df: DataFrame, columns: list[str], how: str, gh: int, gw: int, ph: int, pw: int) -> DataFrame:
    """(img, r, c, columns) at the new size. A mean or a blend that a NaN pixel takes part in is NaN."""
    if how == "none":
        return df.select("img", "r", "c", *columns)
    if how == "crop":
        return df.where((F.col("r") < ph) & (F.col("c") < pw)).select("img", "r", "c", *columns)
    rows = df.select("img", F.col("c").alias("c0"), *columns, F.explode(_reached(how, F.col("r"), gh, ph)).alias("y"))
    both = rows.select("img", "y", *columns, F.explode(_reached(how, F.col("c0"), gw, pw)).alias("x"))
    at = both.groupBy("img", F.col("y.t").alias("r"), F.col("x.t").alias("c"))
    if how == "nearest":
        return at.agg(*(F.first(c).alias(c) for c in columns))  # one source pixel for each target
    return at.agg(*(F.sum(F.col(c) * F.col("y.w") * F.col("x.w")).alias(c) for c in columns))


def align_to_prediction(df: DataFrame, columns: list[str], kind: str, gh: int, gw: int, ph: int, pw: int) -> DataFrame:
    """P14 for frames of one size; frames of further sizes are further calls."""
    return resize(df, columns, method(kind, gh, gw, ph, pw), gh, gw, ph, pw)


def normalised(df: DataFrame, depth: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Depth in [0, 1] between the image's own limits or given ones; invalid pixels and flat images are 0."""
    d, w = F.col(depth), Window.partitionBy("img")
    ok = P.finite(d) & (d > 0)
    a = F.lit(low) if low is not None else F.min(F.when(ok, d)).over(w)
    b = F.lit(high) if high is not None else F.max(F.when(ok, d)).over(w)
    x = df.withColumns({"__a": a, "__b": b})
    flat = (F.col("__b") - F.col("__a") < 1e-8) | F.col("__b").isNull()
    share = (d - F.col("__a")) / F.when(flat, 1.0).otherwise(F.col("__b") - F.col("__a"))
    return x.withColumn("normalised", F.when(ok & ~flat, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)).drop("__a", "__b")
