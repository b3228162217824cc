"""Evaluation runs: spaces, bins, sparse references, and agreement with the single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import depth, rgb, sets, stencil
from gaugeframe.plans import evaluate as E
from gaugeframe.sources import index


def maps(spark, frames):
    """frames: {img: (gt rows, pred rows)}"""
    rows = [(i, r, c, float(g), float(p)) for i, (gt, pred) in frames.items() for r, (a, b) in enumerate(zip(gt, pred, strict=True)) for c, (g, p) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(rows, "img string, r int, c int, gt double, pred double")


def values(df, *where):
    return {tuple(r[k] for k in where): r["value"] for r in df.collect()}


GT = {"a": [[10, 20], [30, 40]], "b": [[6, 12], [18, 24]]}


def test_normalised_predictions_report_both_spaces(spark):
    px = maps(spark, {"a": (GT["a"], [[(x - 5) / 50 for x in r] for r in GT["a"]]), "b": (GT["b"], [[(x - 3) / 30 for x in r] for r in GT["b"]])})
    run = E.evaluate_depth(px)
    s = values(run.summary, "space", "path")
    assert run.space == "normalized" and {k[0] for k in s} == {"native", "metric"}
    assert s["metric", "standard.image_mean.absrel"] == pytest.approx(0, abs=1e-9) and s["native", "standard.image_mean.absrel"] > 0.5
    tree = run.tree("depth")
    assert tree["depth"]["metric"]["standard"]["pixel_pool"]["delta1"] == 1.0
    assert {f["id"] for f in run.files()["files"]} == {"a", "b"}


def test_metric_predictions_report_one_space(spark):
    px = maps(spark, {"a": (GT["a"], [[x * 1.02 for x in r] for r in GT["a"]]), "b": (GT["b"], [[x * 0.98 for x in r] for r in GT["b"]])})
    run = E.evaluate_depth(px, benchmark=(5.0, 50.0))
    assert run.space == "metric" and {r["space"] for r in run.summary.select("space").distinct().collect()} == {"metric"}
    s = values(run.summary, "bin", "path")
    assert s["", "standard.image_mean.absrel"] == pytest.approx(0.02) == s["all", "standard.image_mean.absrel"]
    i = values(run.images, "img", "path")
    one = {(r.img, m): r[m] for r in depth.standard(px).collect() for m in depth.STANDARD}
    assert all(i[img, f"standard.{m}"] == pytest.approx(v) for (img, m), v in one.items())
    assert i["a", "image_quality.ssim"] == pytest.approx({r.img: r.ssim for r in stencil.depth_ssim(px).collect()}["a"])
    fitted = E.evaluate_depth(px, mode="affine")
    assert {r["space"] for r in fitted.summary.select("space").distinct().collect()} == {"native", "metric"}
    with pytest.raises(ValueError):
        E.evaluate_depth(px, mode="other")


def test_sky_is_left_out_of_scores_and_fit(spark):
    px = maps(spark, {"a": ([[900, 20], [30, 40]], [[1, 20], [30, 40]])}).withColumn("sky_valid", F.col("gt") < 100)
    s = values(E.evaluate_depth(px, sky=True).summary, "path")
    assert s["standard.pixel_pool.absrel",] == 0 and s["depth_metrics.rmse.p90",] == 0


def test_sparse_counts_and_images_without_points(spark):
    points = spark.createDataFrame([("a", 0, 2.0, 2.0, 2.0), ("a", 1, 4.0, 4.0, 4.0), ("b", 0, 0.0, 0.0, -1.0)], "img string, pt int, x double, y double, z double")
    camera = {"fx": 1.0, "fy": 1.0, "cx": 0.0, "cy": 0.0, "h": 3, "w": 3}
    pred = spark.createDataFrame([(i, r, c, math.sqrt(12.0)) for i in "ab" for r in range(3) for c in range(3)], "img string, r int, c int, pred double")
    run = E.evaluate_sparse_depth(points, pred, camera)
    i = values(run.images, "img", "path")
    assert i["a", "depth_metrics.valid_pixel_count"] == 1 and i["a", "standard.absrel"] == pytest.approx(0)
    assert i["b", "depth_metrics.valid_pixel_count"] == 0 and math.isnan(i["b", "standard.absrel"])
    assert run.files()["files"][1] == {"id": "b", "metrics": {"metric": {"depth_metrics": {"valid_pixel_count": 0.0}}}}


def test_rgb_and_features(spark):
    rows = [(i, r, c, *(((i + r * 8 + c + k) % 13) / 13 for k in range(3)), *(((i + r * 8 + c + k) % 11) / 12 for k in range(3)), float(r)) for i in range(2) for r in range(8) for c in range(8)]
    px = spark.createDataFrame(rows, "img int, r int, c int, gr double, gg double, gb double, pr double, pg double, pb double, depth double")
    side = lambda k: spark.createDataFrame([(i, [float((i * 7 + j * k) % 5) for j in range(3)]) for i in range(9)], "id int, x array<double>")
    run = E.evaluate_rgb(px, has_depth=True, features=(side(1), side(2)))
    s = values(run.summary, "path")
    assert s["image_quality.psnr",] == pytest.approx(sum(r.psnr for r in rgb.psnr(px).collect()) / 2)
    assert s["image_quality.fid",] == pytest.approx(sets.frechet_distance(side(1), side(2)))
    assert ("depth_binned.mae.near",) in s and ("tail_errors.p99",) in s
    dark = E.evaluate_rgb(px.withColumn("sky_valid", F.lit(False)), sky=True)
    assert values(dark.summary, "path")["image_quality.ssim",] == pytest.approx(1)


TREE = {"name": "x", "type": "depth", "meta": {"scale_to_meters": 0.01}, "dataset": {"children": {"Scene01": {"children": {"clone": {"files": [{"path": "a.npy", "id": "1"}, {"path": "b.npy", "id": "2", "split": "val"}]}}, "files": [{"path": "k.txt", "id": "K"}]}}}}


def test_indexes(spark):
    files = index.files(spark, TREE)
    assert sorted(r.full_id for r in files.collect()) == ["/Scene01/K", "/Scene01/clone/1", "/Scene01/clone/2"]
    assert [r.id for r in index.files(spark, TREE, "val").collect()] == ["2"]
    pred = {"dataset": {"children": {"Scene01": {"children": {"clone": {"files": [{"path": "p.npy", "id": "1"}]}}}}}}
    got = index.samples(files, index.files(spark, pred), by_node={"calibration": files.where("id = 'K'")}).collect()
    assert [(r.full_id, r.gt, r.pred, r.calibration) for r in got] == [("/Scene01/clone/1", "a.npy", "p.npy", "k.txt")]
    assert index.metadata(TREE, "depth") == {"scale_to_meters": 0.01, "radial_depth": True}
    sky = spark.createDataFrame([(29,), (3,), (None,)], "k int").select(index.sky_valid(F.col("k"), 29).alias("v"), index.sky_valid(F.col("k"), None).alias("w")).collect()
    assert [tuple(r) for r in sky] == [(False, True), (True, True), (True, True)]


def test_jobs_do_not_grow_with_the_ranges_of_quantiles(spark):
    """Spaces, bins and errors share the passes over the pixels."""
    frames = {str(i): ([[1 + (i * 7 + k * 3) % 70 for k in range(9)]], [[0.01 * (1 + (i * 5 + k * 3) % 60) for k in range(9)]]) for i in range(20)}
    px = maps(spark, frames)
    spark.sparkContext.setJobGroup("jobs of a run", "")
    run = E.evaluate_depth(px, benchmark=(1.0, 80.0), dense=False)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("jobs of a run"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    s = values(run.summary, "space", "bin", "path")
    assert {k[:2] for k in s} == {(a, b) for a in ("native", "metric") for b in ("", "near", "mid", "far", "all")} and jobs <= 40, jobs
    e = depth.errors(px.withColumn("bin", E.P.benchmark_bin(F.col("gt"), 1.0, 80.0)))
    for b, of in (("", e), ("near", e.where("bin = 'near'")), ("all", e.where("bin is not null"))):
        assert s["native", b, "depth_metrics.rmse.p90"] == pytest.approx(of.select(F.percentile(F.abs("d"), 0.9)).first()[0])
        assert s["native", b, "standard.pixel_pool.absrel"] == pytest.approx(of.select(F.avg("rel")).first()[0])


def test_passes_see_the_same_predictions(spark):
    """The fit is not computed again in each pass, and values that move are an error, not a wrong quantile."""
    px = maps(spark, {"a": (GT["a"], [[x / 100 for x in r] for r in GT["a"]])})
    assert "regr_" not in E.in_spaces(px)[1]._jdf.queryExecution().optimizedPlan().toString()
    moving = F.udf(lambda _: random.random(), "double").asNondeterministic()
    with pytest.raises(RuntimeError, match="differ"):
        depth.group_quantiles(spark.range(3000).select(moving("id").alias("v")), [], {"v": F.col("v")}, [0.0, 0.5, 1.0], 16)
