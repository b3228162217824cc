"""Depth scores by image and over a set of images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P


def errors(df: DataFrame, *masks) -> DataFrame:
    """Every pixel, with its errors where it is valid and nulls elsewhere, so that an image without valid pixels stays."""
    gt, pred = F.col("gt"), F.col("pred")
    ok = P.valid(gt, pred, *masks)
    found = {"d": pred - gt, "rel": P.absrel(gt, pred), "l": P.log_error(gt, pred), "ratio": P.ratio(gt, pred)}
    return df.withColumns({k: F.when(ok, v) for k, v in found.items()})


STANDARD = ("absrel", "sqrel", "mae", "rmse", "rmse_log", "log10", "silog", "delta1", "delta2", "delta3")


def sums() -> list:
    """The sufficient statistics of the standard scores: they add up over images, partitions and batches."""
    d, l = F.col("d"), F.col("l")  # noqa: E741
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0.0)).alias(name)
    hits = [F.count_if(F.col("ratio") < 1.25**k).cast("long").alias(f"hits{k}") for k in (1, 2, 3)]
    parts = {"s_rel": F.col("rel"), "s_sq": d * d / F.col("gt"), "s_abs": F.abs(d), "s_d2": d * d, "s_l": l, "s_l2": l * l, "s_al": F.abs(l)}
    return [F.count("rel").alias("n"), *(total(x, name) for name, x in parts.items()), *hits]


def from_sums() -> list:
    """The scores, NaN without valid pixels."""
    n = F.when(F.col("n") > 0, F.col("n"))
    mean = lambda c: F.col(c) / n
    scores = {
        "absrel": mean("s_rel"), "sqrel": mean("s_sq"), "mae": mean("s_abs"), "rmse": F.sqrt(mean("s_d2")), "rmse_log": F.sqrt(mean("s_l2")), "log10": mean("s_al") / F.ln(F.lit(10.0)),
        "silog": F.when(F.col("n") > 0, F.sqrt(F.greatest(mean("s_l2") - mean("s_l") * mean("s_l"), F.lit(0.0)))), **{f"delta{k}": F.col(f"hits{k}") / n for k in (1, 2, 3)},
    }
    return [P.or_nan(x).alias(name) for name, x in scores.items()]


def standard(df: DataFrame, *masks, by: tuple[str, ...] = ("img",)) -> DataFrame:
    """Count and ten scores for each image; without valid pixels 0 and NaN."""
    return errors(df, *masks).groupBy(*by).agg(*sums()).select(*by, "n", *from_sums())


def reducers(df: DataFrame, *masks, by: tuple[str, ...] = ()) -> DataFrame:
    """A1: each score as mean and median over images that have it, and over the pool of all pixels; one pass over the
    pixels."""
    return over_images(errors(df, *masks).groupBy("img", *by).agg(*sums()), by)


def over_images(images: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A1 from the sums of each image (img, by, ...)."""
    stats = [c for c in images.columns if c not in ("img", *by)]
    scored = images.select("*", *from_sums())
    many = scored.groupBy(*by).agg(*(F.sum(c).alias(c) for c in stats), *(P.mean_finite(F.col(m)).alias(f"{m}_mean") for m in STANDARD), *(F.median(F.when(P.finite(F.col(m)), F.col(m))).alias(f"{m}_median") for m in STANDARD))
    pooled = many.select(*by, "n", *from_sums(), *(c for c in many.columns if c.endswith(("_mean", "_median"))))
    rows = [F.struct(F.lit(r).alias("reduction"), F.lit(m).alias("metric"), F.col(c).alias("value")) for m in STANDARD for r, c in (("image_mean", f"{m}_mean"), ("image_median", f"{m}_median"), ("pixel_pool", m))]
    return pooled.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def psnr(df: DataFrame, *masks) -> DataFrame:
    """By the greatest valid reference depth; an image without valid pixels scores 0."""
    ok = P.valid(F.col("gt"), F.col("pred"), *masks)
    d = F.when(ok, F.col("pred") - F.col("gt"))
    a = df.groupBy("img").agg(F.avg(d * d).alias("mse"), F.max(F.when(ok, F.col("gt"))).alias("peak"))
    return a.select("img", P.psnr(F.col("mse"), F.col("peak")).alias("psnr"))


def stats(df: DataFrame, *masks) -> DataFrame:
    """Mean, median and 90th percentile of each error within an image; NaN without any. An
    image's errors meet in a task, as they do for percentiles."""
    e = errors(df, *masks)
    held = lambda c: F.sort_array(F.collect_list(c))
    a = e.groupBy("img").agg(F.avg("rel").alias("absrel"), held("rel").alias("hr"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), held(F.abs("d")).alias("hd"), F.avg(F.col("l") * F.col("l")).alias("l2"), F.avg("l").alias("l1"), held(F.abs("l")).alias("hl"))
    silog = F.when(F.col("l1").isNotNull(), F.sqrt(F.greatest(F.col("l2") - F.col("l1") * F.col("l1"), F.lit(0.0))))
    found = {"absrel": F.col("absrel"), "absrel_median": P.quantile(F.col("hr"), 0.5), "absrel_p90": P.quantile(F.col("hr"), 0.9), "rmse": F.col("rmse"), "rmse_median": P.quantile(F.col("hd"), 0.5), "rmse_p90": P.quantile(F.col("hd"), 0.9), "silog": silog, "silog_median": P.quantile(F.col("hl"), 0.5), "silog_p90": P.quantile(F.col("hl"), 0.9)}
    return a.select("img", *(P.or_nan(x).alias(name) for name, x in found.items()))


def exact_quantiles(df: DataFrame, values: dict, probabilities: list[float], buckets: int = 4096) -> dict[str, list[float]]:
    """A2 at scale: exact interpolated quantiles of several expressions over all rows; name -> expression."""
    return group_quantiles(df, [], values, probabilities, buckets)[()]


def group_quantiles(df: DataFrame, by: list[str], values: dict, probabilities: list[float], buckets: int = 4096) -> dict[tuple, dict[str, list[float]]]:
    """Exact interpolated quantiles of several expressions in each group, without gathering a column. values: name ->
    expression; what is not finite is left out. The values are counted in equal buckets between their extremes, in one
    pass for all names and groups, then the buckets that hold a wanted rank are cut into finer ones, until they hold
    ``buckets`` values at most or one value. Only counts and the values at the wanted ranks come to the driver, which
    must hold the groups. The values must be the same in each pass; an error if they were seen to move."""
    names = list(values)
    v = [x.cast("double") for x in values.values()]
    ok = [F.when(P.finite(x), x) for x in v]
    ends = df.groupBy(*by).agg(*(f(x).alias(f"{n}{j}") for j, x in enumerate(ok) for n, f in (("low", F.min), ("high", F.max), ("n", F.count)))).collect()
    size = {(tuple(r[c] for c in by), j): r[f"n{j}"] for r in ends for j in range(len(names))}
    ranks = {key: sorted({k for p in probabilities for k in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))}) if n else [] for key, n in size.items()}
    x = df.select(*by, F.explode(F.array(*(F.struct(F.lit(j).alias("name"), e.alias("v")) for j, e in enumerate(v)))).alias("x")).select(*by, "x.*").where(P.finite(F.col("v")))
    found: dict[tuple, float] = {}
    # (group and name, first value, last value, rank of the first, number) of the ranges that hold a wanted rank
    work = [((g, j), r[f"low{j}"], r[f"high{j}"], 0, r[f"n{j}"]) for r in ends for g in (tuple(r[c] for c in by),) for j in range(len(names)) if r[f"n{j}"]]
    while work:
        small, wide = [], []
        for key, low, high, first, n in work:
            if low == high:
                found.update({(key, k): low for k in ranks[key] if first <= k < first + n})
            else:
                (small if n <= buckets else wide).append((key, low, high, first, n))
        if small:
            wanted = [[k for k in ranks[key] if first <= k < first + n] for key, _, _, first, n in small]
            offsets = [[k - first for k in ks] for ks, (_, _, _, first, _) in zip(wanted, small, strict=True)]
            held = _within(x, by, small, offsets).groupBy("i", "offsets").agg(F.sort_array(F.collect_list("v")).alias("held"))  # ``buckets`` at most
            for r in held.select("i", F.transform("offsets", lambda o: F.get("held", o)).alias("at")).collect():
                found.update({(small[r["i"]][0], k): at for k, at in zip(wanted[r["i"]], r["at"], strict=True) if at is not None})
        work = []
        if wide:
            step = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets)).cast("int")
            counts = _within(x, by, wide).groupBy("i", step.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # ``buckets`` rows a range
            first = [w[3] for w in wide]
            for r in sorted(counts, key=lambda r: (r["i"], r["low"])):
                key, start = wide[r["i"]][0], first[r["i"]]
                if any(start <= k < start + r["n"] for k in ranks[key]):
                    work.append((key, r["low"], r["high"], start, r["n"]))
                first[r["i"]] += r["n"]

    def quantile(key: tuple, p: float) -> float:
        n = size[key]
        if not n:
            return float("nan")
        k = int(p * (n - 1))
        if (key, k) not in found or (key, min(k + 1, n - 1)) not in found:
            raise RuntimeError("values differ from one pass to the next")
        a, b, part = found[key, k], found[key, min(k + 1, n - 1)], p * (n - 1) - k
        return a if a == b else math.fma(a, 1 - part, b * part)  # as pixels.quantile

    out: dict[tuple, dict[str, list[float]]] = {}
    for g, j in size:
        out.setdefault(g, {})[names[j]] = [quantile((g, j), p) for p in probabilities]
    return out


def _within(x: DataFrame, by: list[str], ranges: list[tuple], offsets: list[list[int]] | None = None) -> DataFrame:
    """(i, low, high, offsets, v): the values of x (by, name, v) that lie in range i. A few ranges for each group and
    name, so they are sent to all tasks."""
    kinds = [f"__g{k} {x.schema[c].dataType.simpleString()}" for k, c in enumerate(by)]
    rows = [(i, *g, j, low, high, offsets[i] if offsets else None) for i, ((g, j), low, high, _, _) in enumerate(ranges)]
    r = x.sparkSession.createDataFrame(rows, ", ".join(["i int", *kinds, "__name int", "low double", "high double", "offsets array<int>"]))
    same = (F.col("name") == F.col("__name")) & F.col("v").between(F.col("low"), F.col("high"))
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return x.join(F.broadcast(r), same).select("i", "low", "high", "offsets", "v")


def pooled_quantiles(df: DataFrame, *masks) -> DataFrame:
    """A2, A3: medians and 90th percentiles over all pixels of the set."""
    q = exact_quantiles(errors(df, *masks), {"absrel": F.col("rel"), "rmse": F.abs("d"), "silog": F.abs("l")}, [0.5, 0.9])
    return df.sparkSession.range(1).select(*(F.lit(v).alias(f"{m}_{n}") for m, pair in q.items() for n, v in zip(("median", "p90"), pair, strict=True)))


def by_bin(df: DataFrame, low: float, high: float) -> DataFrame:
    """Standard scores of each image in near, mid, far and all, from one pass over the pixels."""
    e = errors(df).withColumn("bin", P.benchmark_bin(F.col("gt"), low, high)).where("bin is not null and rel is not null")
    binned = e.groupBy("img", "bin").agg(*sums())
    stats = [c for c in binned.columns if c not in ("img", "bin")]
    every = binned.groupBy("img").agg(*(F.sum(c).alias(c) for c in stats)).withColumn("bin", F.lit("all"))
    return binned.unionByName(every).select("img", "bin", "n", *from_sums())


def scale_and_shift(df: DataFrame, trim: bool = False, *masks) -> DataFrame:
    """Least squares gt = s * pred + t for each image; trim leaves out references above their 95th percentile.
    Under two pixels: s = 1, t = 0. A constant prediction: the solution of least norm."""
    kept = df.where(P.fit_mask(F.col("gt"), F.col("pred"), *masks))
    if trim:
        limit = kept.groupBy("img").agg(F.percentile("gt", 0.95).alias("limit"))
        kept = kept.join(limit, "img").where("gt <= limit")
    a = kept.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("p"), F.avg("gt").alias("g"), F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.regr_slope("gt", "pred").alias("slope"), F.regr_intercept("gt", "pred").alias("cut"))
    flat = F.col("lo") == F.col("hi")
    p, g = F.col("p"), F.col("g")
    s = F.when(F.col("n") < 2, 1.0).when(flat, p * g / (p * p + 1)).otherwise(F.col("slope"))
    t = F.when(F.col("n") < 2, 0.0).when(flat, g / (p * p + 1)).otherwise(F.col("cut"))
    return a.select("img", "n", s.alias("s"), t.alias("t"))


def aligned(df: DataFrame, trim: bool = False, *masks) -> DataFrame:
    """Predictions after the fit; images without one keep theirs."""
    return with_fit(df, scale_and_shift(df, trim, *masks))


def settled(fit: DataFrame) -> DataFrame:
    """A row an image, computed once: the sums of a fit are added up in another order each time, which moves its last
    digits, and what passes over the pixels more than once (``group_quantiles``) must see the same predictions."""
    sc = fit.sparkSession.sparkContext
    return fit.checkpoint() if sc.getCheckpointDir() else fit.localCheckpoint()


def with_fit(df: DataFrame, fit: DataFrame) -> DataFrame:
    fit = fit.select("img", "s", "t")
    return df.join(fit, "img", "left").withColumn("pred", F.coalesce(F.col("s"), F.lit(1.0)) * F.col("pred") + F.coalesce(F.col("t"), F.lit(0.0))).drop("s", "t")


def input_space(df: DataFrame, hint: str | None = None) -> str:
    """By the first image: a hint decides, else values within 1.001 of zero are normalised."""
    if hint in ("relative", "affine"):
        return hint
    first = df.agg(F.min("img")).first()[0]
    low, high = df.where((F.col("img") == first) & P.finite(F.col("pred"))).agg(F.min("pred"), F.max("pred")).first()
    return "normalized" if high is not None and high <= 1.001 and low >= -1.001 else "metric"


def emitted(space: str, applied: bool) -> dict[str, bool]:
    """Which spaces a run reports."""
    normalised = space in ("normalized", "relative", "affine")
    return {"native": applied or normalised, "metric": applied or not normalised}
