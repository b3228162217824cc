"""Camera-ray scores (Y1, Y2, A9-A11) over (img, ray, gx, gy, gz, px, py, pz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P


def _angles(df: DataFrame) -> DataFrame:
    """Every ray, with the angle where both directions are finite and 1e-8 long at least."""
    norm = lambda s: F.sqrt(sum((F.col(f"{s}{k}") ** 2 for k in "xyz"), F.lit(0.0)))
    x = df.withColumns({"ng": norm("g"), "np": norm("p")})
    ok = P.finite(F.col("ng")) & P.finite(F.col("np")) & (F.col("ng") > 1e-8) & (F.col("np") > 1e-8)
    dot = sum((F.col(f"g{k}") * F.col(f"p{k}") for k in "xyz"), F.lit(0.0)) / (F.col("ng") * F.col("np"))
    return x.select("img", "ray", F.when(ok, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))).alias("angle"))


def angles(df: DataFrame) -> DataFrame:
    """Degrees between directions; those that are not finite or too short drop out."""
    return _angles(df).where("angle is not null")


def rho(angle: Column, threshold: float, bins: int = 100) -> Column:
    """Y2 in one pass: each error adds to the trapezoid sum of the curve the thresholds that reach it."""
    k = F.greatest(F.lit(0.0), bins + 1 - F.ceil(F.greatest(angle, F.lit(0.0)) * bins / threshold))
    k = F.when(angle > threshold, 0.0).when(angle.isNotNull(), k)
    return F.avg((k - 0.5 * (angle <= 0).cast("double") - 0.5 * (angle <= threshold).cast("double")) / bins)


def by_image(df: DataFrame, threshold: float) -> DataFrame:
    """An image without a valid ray has NaN throughout."""
    found = {"mean_angle": F.avg("angle"), "median_angle": F.median("angle"), "rho_a": F.when(F.count("angle") > 0, rho(F.col("angle"), threshold))}
    return _angles(df).groupBy("img").agg(F.count("angle").alias("n"), *(P.or_nan(x).alias(n) for n, x in found.items()))


def over_images(scores: DataFrame) -> DataFrame:
    """A9."""
    x = scores.where(P.finite(F.col("rho_a")))
    return x.agg(F.avg("rho_a").alias("rho_mean"), F.median("rho_a").alias("rho_median"), F.stddev_pop("rho_a").alias("rho_std"))


LIMITS = (5, 10, 15, 20, 30)


def pooled(df: DataFrame) -> DataFrame:
    """A10."""
    return angles(df).agg(F.avg("angle").alias("mean_angle"), F.median("angle").alias("median_angle"), *((F.avg((F.col("angle") < t).cast("double")) * 100).alias(f"below_{t}") for t in LIMITS))


def histogram_median(df: DataFrame) -> DataFrame:
    """Mean and shares exactly, the median as the centre of a hundredth of a degree; a table of 18000 rows at
    most is all that is gathered."""
    h = angles(df).groupBy(F.least(F.floor(F.col("angle") * 100), F.lit(17999)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("angle").alias("s"), *(F.count_if(F.col("angle") < t).alias(f"b{t}") for t in LIMITS))
    w = Window.orderBy("bin")
    total = Window.partitionBy()
    c = h.withColumns({"cum": F.sum("n").over(w), "all": F.sum("n").over(total)})
    return c.agg(((F.min(F.when(F.col("cum") >= F.col("all") / 2, F.col("bin"))) + 0.5) * 0.01).alias("median_angle"), (F.sum("s") / F.sum("n")).alias("mean_angle"), *((F.sum(f"b{t}") / F.sum("n") * 100).alias(f"below_{t}") for t in LIMITS))
