"""Column functions over a pixel relation (img, gt, pred, ...): masks, errors, reducers. All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def valid(gt: Column, pred: Column, *more: Column, min_depth: float = 0.0) -> Column:
    """Both depths positive (above min_depth) and finite, and whatever masks are given."""
    out = finite(gt) & finite(pred) & (gt > min_depth) & (pred > min_depth)
    for m in more:
        out = out & m
    return out


def fit_mask(gt: Column, source: Column, *more: Column) -> Column:
    """P5: the fit also uses predictions that are not positive."""
    out = (gt > 0) & finite(gt) & finite(source)
    for m in more:
        out = out & m
    return out


def absrel(gt: Column, pred: Column) -> Column:
    return F.abs(pred - gt) / gt


def log_error(gt: Column, pred: Column) -> Column:
    return F.ln(pred) - F.ln(gt)


def ratio(gt: Column, pred: Column) -> Column:
    return F.greatest(pred / gt, gt / pred)


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def mean_finite(x: Column) -> Column:
    """P10: the mean of what is finite; null if nothing is."""
    return F.avg(F.when(finite(x), x))


def quantile(held: Column, p: float) -> Column:
    """The interpolated quantile of a sorted array, null if it is empty. As in the SQL, whose quantile_cont rounds the
    first product and the sum at once: values that are equal but for their last bit straddle the limits of the rules."""
    at = p * (F.size(held) - 1)
    k = F.floor(at).cast("int")
    low, high, part = F.get(held, k), F.get(held, F.least(k + 1, F.size(held) - 1)), at - k
    mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when(F.size(held) > 0, F.when(low == high, low).otherwise(mixed))


def or_nan(x: Column) -> Column:
    """The score of an image without valid pixels."""
    return F.coalesce(x, F.lit(NAN))


def psnr(mse: Column, peak: Column) -> Column:
    return F.when(mse.isNull(), 0.0).when(mse < 1e-10, INF).otherwise(10 * F.log10(peak * peak / F.greatest(mse, F.lit(1e-300))))


def benchmark_edges(low: float, high: float) -> tuple[float, float]:
    """Near, mid and far are equal steps of the square root between the two depths."""
    if not 0 <= low < high:
        raise ValueError("0 <= low < high is needed")
    a, b = low**0.5, high**0.5
    return (a + (b - a) / 3) ** 2, (a + 2 * (b - a) / 3) ** 2


def benchmark_bin(depth: Column, low: float, high: float) -> Column:
    """near and mid exclude their upper edge, far holds the last; null outside."""
    near, mid = benchmark_edges(low, high)
    return F.when((depth >= low) & (depth < near), "near").when((depth >= near) & (depth < mid), "mid").when((depth >= mid) & (depth <= high), "far")


def depth_bin(depth: Column, near: float = 1.0, far: float = 5.0) -> Column:
    """(0, near], (near, far], (far, inf); null for depths that are not positive and finite."""
    return F.when(~finite(depth) | (depth <= 0), None).when(depth <= near, "near").when(depth <= far, "mid").otherwise("far")


def benchmark_key(low: float, high: float) -> str:
    """P19, for example benchmark_0_5m_100m."""
    text = lambda x: f"{x:g}".replace(".", "_")
    return f"benchmark_{text(low)}m_{text(high)}m"


def planar_to_radial(depth: Column, u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Depth along the optical axis to depth along the ray."""
    return depth * F.sqrt(F.pow((u - cx) / fx, 2) + F.pow((v - cy) / fy, 2) + 1)


def spatial_class(gh: Column, gw: Column, ph: Column, pw: Column) -> Column:
    """How a reference frame is brought to the prediction's size."""
    dh, dw = gh - ph, gw - pw
    crop = (ph % 8 == 0) & (pw % 8 == 0) & dh.between(0, 7) & dw.between(0, 7)
    return F.when((dh == 0) & (dw == 0), "none").when(crop, "vae_crop").otherwise("resize")


def fov_degrees(h: Column, w: Column, fx: Column, fy: Column) -> Column:
    tx, ty = w / (2 * fx), h / (2 * fy)
    return F.degrees(2 * F.atan(F.sqrt(tx * tx + ty * ty)))


def fov_domain(degrees: Column) -> Column:
    """Y3."""
    return F.when(degrees <= 90, "sfov").when(degrees >= 160, "pano").otherwise("lfov")


#: Y4, fixed values: degrees up to which accuracy is integrated.
FOV_THRESHOLDS = {"sfov": 15.0, "lfov": 20.0, "pano": 30.0}


def fov_threshold(domain: str) -> float:
    if domain.lower() not in FOV_THRESHOLDS:
        raise ValueError(f"unknown domain {domain!r}")
    return FOV_THRESHOLDS[domain.lower()]
