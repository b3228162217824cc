import json
import math
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import pixels as P
from gaugeframe.operators import depth, sets
from gaugeframe.plans import registry
from gaugeframe.sinks import results
from gaugeframe.sources import arrays, config


def test_standard_goldens(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.4), (1, 2.0, 3.0), (1, 0.0, 1.0)], "img int, gt double, pred double")
    r = depth.standard(df).first()
    assert r.n == 3 and r.delta1 == pytest.approx(1 / 3) and r.delta2 == r.delta3 == 1.0 and r.mae == pytest.approx(1.4 / 3)


def test_benchmark_edges():
    assert P.benchmark_edges(0.01, 80) == pytest.approx((9.290856529333297, 35.95418986266663))
    assert P.benchmark_key(0.5, 100) == "benchmark_0_5m_100m"
    with pytest.raises(ValueError):
        P.benchmark_edges(5, 1)


def test_fit_recovers_and_degenerates(spark):
    rows = [(1, 50 * x / 10 + 5, x / 10) for x in range(1, 20)] + [(2, 20.0, 0.5), (2, 30.0, 0.5)] + [(3, 4.0, 1.0)]
    got = {r.img: (r.s, r.t) for r in depth.scale_and_shift(spark.createDataFrame(rows, "img int, gt double, pred double")).collect()}
    assert got[1] == pytest.approx((50, 5)) and got[2] == pytest.approx((10, 20)) and got[3] == (1.0, 0.0)


def test_exact_quantiles(spark):
    x = np.random.default_rng(1).normal(size=500).round(2)
    df = spark.createDataFrame([(float(v),) for v in [*x, math.nan, math.inf]], "v double")
    at = [0.0, 0.5, 0.9, 1.0]
    got = depth.exact_quantiles(df, {"v": F.col("v"), "skewed": F.exp(3 * F.col("v")), "same": F.when(F.abs("v") < 9, 1.0), "none": F.lit(None)}, at, 16)
    for name, y in (("v", x), ("skewed", np.exp(3 * x)), ("same", np.ones(500))):
        assert got[name] == pytest.approx([float(np.quantile(y, p)) for p in at]), name
    assert all(math.isnan(v) for v in got["none"])


def test_projection_keeps_the_nearest(spark):
    pts = [(1, 0, 2.0, 2.0, 2.0), (1, 1, 4.0, 4.0, 4.0), (1, 2, 0.0, 0.0, -1.0), (1, 3, float("nan"), 0.0, 1.0), (1, 4, 8.0, 4.0, 4.0)]
    got = {(r.r, r.c): r.gt for r in sets.project(spark.createDataFrame(pts, "img int, pt int, x double, y double, z double"), 1, 1, 0, 0, 3, 3).collect()}
    assert got == pytest.approx({(1, 1): math.sqrt(12), (1, 2): math.sqrt(96)})


def test_frechet(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(200, 3))
    make = lambda x: spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(x)], "id long, x array<double>")
    assert sets.frechet_distance(make(a), make(a)) == pytest.approx(0, abs=1e-6)
    assert sets.frechet_distance(make(a), make(a + 2)) == pytest.approx(12, rel=1e-6)


def test_kernel_distance(spark, monkeypatch):
    """Over all features, also where there are more than 1000 a side and several blocks."""
    r = np.random.default_rng(4)
    a, b = r.normal(size=(1300, 3)), r.normal(size=(1100, 3)) + 0.1
    make = lambda x: spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(x)], "id long, x array<double>")
    k = lambda x, y: (x @ y.T / 3 + 1) ** 3
    mean = lambda x: (k(x, x).sum() - np.trace(k(x, x))) / len(x) / (len(x) - 1)
    monkeypatch.setattr(sets, "BLOCK", 3 * 700)
    assert sets.kernel_distance(make(a), make(b)).first().kid == pytest.approx(mean(a) + mean(b) - 2 * k(a, b).mean(), abs=1e-9)
    whole = sets.kernel_distance_subsets(make(a[:50]), make(b[:50]), subsets=3).first()
    assert whole.kid == pytest.approx(mean(a[:50]) + mean(b[:50]) - 2 * k(a[:50], b[:50]).mean(), abs=1e-9) and whole.kid_std == pytest.approx(0, abs=1e-9)
    assert sets.kernel_distance_subsets(make(a), make(b), subsets=4, size=40).first().kid_std > 0


def test_selectors_and_config():
    m = config.parse_selector("/data/x:val#scope=left", "rgb")
    assert (m.path, m.split, m.metadata_scope) == ("/data/x", "val", "left")
    assert config.parse_selector("C:/data", "rgb").split is None
    for bad in ("/d:a#scope=", "/d#x=1"):
        with pytest.raises(ValueError):
            config.parse_selector(bad, "rgb")
    with pytest.raises(ValueError):
        config.validate({"gt": {"depth": {"path": "x"}}, "datasets": [{"name": "a", "depth": {}, "affine_depth": {}}]})


def test_trees_and_archives(tmp_path):
    assert results.clean({"a": None, "b": {"c": math.nan}, "d": 1.0, "e": [None]}) == {"d": 1.0, "e": [None]}
    tree = results.file_tree([("/s/c/1", {"m": 1}), ("/s/c/1", {"m": 2})])
    assert tree["children"]["s"]["children"]["c"]["files"] == [{"id": "1", "metrics": {"m": 2}}]
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("keep.txt", "k")
        f.writestr("eval.json", "old")
    results.save({"x": 1}, str(z / "eval.json"))
    with zipfile.ZipFile(z) as f:
        assert json.loads(f.read("eval.json")) == {"x": 1} and f.read("keep.txt") == b"k"


def test_array_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"s{i}").mkdir()
        np.save(tmp_path / f"s{i}" / "d.npy", np.arange(6, dtype=np.float32).reshape(2, 3) + i)
    got = {r.img + f"/{r.r}/{r.c}": r.d for r in arrays.to_pixels(arrays.read_depth(spark, str(tmp_path)), "d").collect()}
    assert len(got) == 12 and got["s1/d/1/2"] == 6.0


def test_resize(spark):
    from gaugeframe.operators import resize

    assert [resize.method(*a) for a in (("depth", 9, 9, 9, 9), ("depth", 15, 9, 8, 8), ("mask", 9, 9, 3, 3), ("depth", 9, 9, 3, 3), ("rgb", 4, 4, 9, 9), ("depth", 4, 4, 9, 9))] == ["none", "crop", "nearest", "area", "linear", "nearest"]
    with pytest.raises(ValueError):
        resize.method("depth", 9, 9, 3, 10)
    df = spark.createDataFrame([(1, r, c, float("nan") if (r, c) == (0, 0) else float(9 * r + c)) for r in range(9) for c in range(9)], "img long, r int, c int, v double")
    cropped = resize.align_to_prediction(df, ["v"], "depth", 9, 9, 8, 8)
    assert cropped.count() == 64 and cropped.agg({"v": "count"}).first()[0] == 64
    mean = {(x.r, x.c): x.v for x in resize.align_to_prediction(df, ["v"], "depth", 9, 9, 3, 3).collect()}
    assert len(mean) == 9 and mean[0, 0] != mean[0, 0] and mean[1, 1] == pytest.approx(40)
    assert resize.align_to_prediction(df.limit(0), ["v"], "depth", 9, 9, 3, 3).count() == 0
    flat = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 2.0), (2, 0, 0, None), (2, 0, 1, -1.0)], "img long, r int, c int, d double")
    assert {x.normalised for x in resize.normalised(flat, "d").collect()} == {0.0}


def test_quantiles_of_an_image_are_those_of_sql(spark, tmp_path):
    """To the last bit, as the limits of the rules lie on values that are equal but for it."""
    rng = np.random.default_rng(3)
    rows = [(i, 1.0, 1 + float(p)) for i in range(60) for p in rng.random(1 + i * 3)]
    df = spark.createDataFrame([*rows, (99, 0.0, 1.0)], "img int, gt double, pred double")
    df.write.parquet(str(tmp_path / "px"))
    want = duckdb.sql(f"SELECT img, quantile_cont(abs(pred - gt) / gt, 0.5), quantile_cont(abs(pred - gt) / gt, 0.9) FROM '{tmp_path}/px/*.parquet' WHERE gt > 0 GROUP BY img").fetchall()
    got = {r.img: (r.img, r.absrel_median, r.absrel_p90) for r in depth.stats(df).collect()}
    assert math.isnan(got.pop(99)[1]) and sorted(got.values()) == sorted(want)


def test_four_digits_as_in_sql(spark):
    """Depths of five decimals: 104.00025 times 10 000 is under the tie."""
    df = spark.createDataFrame([(x / 100000,) for x in range(10400005, 10420000, 10)], "v double")
    got = sorted((r.v, r.s) for r in df.select("v", registry._four_digits(F.col("v")).alias("s")).collect())
    assert got == duckdb.sql("SELECT v, CAST(CAST(round(v, 4) AS DECIMAL(20, 4)) AS VARCHAR) FROM (SELECT x / 100000::DOUBLE AS v FROM range(10400005, 10420000, 10) t(x)) ORDER BY v").fetchall()
