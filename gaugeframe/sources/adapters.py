"""Star-schema tables as image relations. Only the columns that a plan uses are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, gt, pred, sky): one image a supplier. Quantity 1 marks holes of the reference, 2 predictions that are NaN
    and 3 references that are infinite; every 17th image has no reference at all."""
    price = F.col("l_extendedprice") / 1000
    gt = F.when((F.col("l_quantity") == 1) | (F.col("l_suppkey") % 17 == 5), 0.0).when(F.col("l_quantity") == 3, float("inf")).otherwise(price)
    pred = F.when(F.col("l_quantity") == 2, float("nan")).otherwise(price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("img"), gt.alias("gt"), pred.alias("pred"), (F.col("l_returnflag") == "R").alias("sky"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, r, c, gt, pred): 8 x 8 grids; the prediction is the vector of the next id."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pixel = F.posexplode(F.arrays_zip("embedding", "other")).alias("pos", "v")
    p = v.join(nxt, "vec_id").select(F.col("vec_id").alias("img"), pixel)
    return p.select("img", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), (F.col("v.embedding").cast("double") + 1).alias("gt"), (F.col("v.other").cast("double") + 1).alias("pred"))


def holed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grids with pixels that are NaN (reference), 0 or infinite (prediction), and images without any reference."""
    k = F.col("img") * 64 + F.col("r") * 8 + F.col("c")
    gt = F.when(F.col("img") % 29 == 3, 0.0).when(k % 61 == 0, float("nan")).otherwise(F.col("gt"))
    pred = F.when(k % 67 == 0, 0.0).when(k % 71 == 0, float("inf")).otherwise(F.col("pred"))
    return grids(spark, sf_dir).withColumns({"gt": gt, "pred": pred})


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, r, c, gr, gg, gb, pr, pg, pb): three vectors are the channels; the prediction is the next image."""
    v = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("img"), F.col("vec_id") % 3, F.posexplode("embedding").alias("pos", "v")).toDF("img", "ch", "pos", "v")
    x = (F.col("v").cast("double") + 1) / 2
    one = v.groupBy("img", "pos").agg(*(F.max(F.when(F.col("ch") == i, x)).alias(n) for i, n in enumerate(("gr", "gg", "gb")))).where("gr is not null and gg is not null and gb is not null")
    nxt = one.select((F.col("img") - 1).alias("img"), "pos", F.col("gr").alias("pr"), F.col("gg").alias("pg"), F.col("gb").alias("pb"))
    return one.join(nxt, ["img", "pos"]).select("img", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), "gr", "gg", "gb", "pr", "pg", "pb")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, ray, gx, gy, gz, px, py, pz): 21 directions a vector; the prediction is the next vector, NaN for every 31st
    image and for some rays."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    at = lambda a, k: F.element_at(a, (3 * F.col("ray") + k + 1).cast("int")).cast("double")
    p = v.join(nxt, "vec_id").withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(20))))
    lost = (F.col("vec_id") % 31 == 7) | ((F.col("vec_id") * 21 + F.col("ray")) % 37 == 0)
    p = p.select("vec_id", "ray", lost.alias("lost"), *(at(a, k).alias(f"{n}{'xyz'[k]}") for n, a in (("g", "embedding"), ("p", "other")) for k in range(3)))
    return p.select(F.col("vec_id").alias("img"), "ray", "gx", "gy", "gz", F.when(F.col("lost"), float("nan")).otherwise(F.col("px")).alias("px"), "py", "pz")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, pt, x, y, z): a cloud for each supplier."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("img"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pt"), (F.col("l_discount") * 40 - 2).alias("x"), (F.col("l_tax") * 40 - 2).alias("y"), (F.col("l_quantity") - 5).cast("double").alias("z"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(full_id, scene, nation, supplier): region / nation / supplier as a path."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows
    return j.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("full_id"), F.col("n_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"))
