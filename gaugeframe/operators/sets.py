"""Distances between sets of features (F2, F3) and joins of modalities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Numbers in a block of features, vectors in a chunk that meets it, and kernel values computed at a time.
BLOCK, CHUNK, CELLS = 1 << 20, 250, 1 << 20


def kernel_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """unbiased squared discrepancy with k = (x.y / d + 1)^3 over all features (id, x) of both sides."""
    na, nb = a.count(), b.count()
    if min(na, nb) < 2:
        raise ValueError("two features a side are needed")
    return _discrepancy(_sides(a, b).withColumn("subset", F.lit(0)), na + nb).select("kid")


def kernel_distance_subsets(a: DataFrame, b: DataFrame, subsets: int = 100, size: int = 1000) -> DataFrame:
    """F3 as the reference takes it: mean and deviation over seeded subsets of ``size`` features a side, or as many as
    the smaller side has."""
    n = min(size, a.count(), b.count())
    if n < 2:
        raise ValueError("two features a side are needed")
    seeds = a.sparkSession.range(subsets).select(F.col("id").cast("int").alias("subset"))
    dealt = Window.partitionBy("subset", "side").orderBy(F.xxhash64("id", "subset"), "id")
    chosen = _sides(a, b).crossJoin(F.broadcast(seeds)).withColumn("k", F.row_number().over(dealt)).where(F.col("k") <= n).drop("k")
    return _discrepancy(chosen, 2 * n).agg(F.avg("kid").alias("kid"), F.stddev_pop("kid").alias("kid_std"))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", "x", F.lit(0).alias("side")).unionByName(b.select("id", "x", F.lit(1).alias("side")))


def _discrepancy(both: DataFrame, n: int) -> DataFrame:
    """(subset, kid) for features (subset, side, id, x), about n a subset. Chunks of one copy meet every block of the
    other, so a task holds one of each, whatever the size of the sets."""
    from collections.abc import Iterator

    import pyarrow as pa

    d = len(both.select("x").first()[0])
    blocks, chunks = -(-n * d // BLOCK), -(-n // CHUNK)
    part = lambda k: F.pmod(F.xxhash64("id", "side"), F.lit(k)).cast("int")
    gather = lambda k, names: both.groupBy("subset", part(k).alias("part")).agg(*(F.collect_list(F.struct("side", "id", "x")).getField(c).alias(f"{c}{names}") for c in ("side", "id", "x")))
    left = gather(chunks, 1).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = gather(blocks, 2).withColumnRenamed("part", "block")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                subset, *columns = (c[r] for c in batch.columns)
                s1, i1, s2, i2 = (c.values.to_numpy(zero_copy_only=False) for c in columns[:4])
                x, y = (c.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in columns[4:])
                total, count = np.zeros((2, 2)), np.zeros((2, 2), np.int64)
                step = max(1, CELLS // len(s1))
                for k in range(0, len(s2), step):
                    kernel = (x @ y[k : k + step].T / d + 1) ** 3
                    same = (i1[:, None] == i2[None, k : k + step]) & (s1[:, None] == s2[None, k : k + step])
                    for p in (0, 1):
                        for q in (0, 1):
                            held = (s1 == p)[:, None] & (s2[k : k + step] == q)[None, :] & ~same
                            total[p, q] += kernel[held].sum()
                            count[p, q] += held.sum()
                rows = [(subset.as_py(), p, q, total[p, q], int(count[p, q])) for p in (0, 1) for q in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["subset", "p", "q", "total", "n"])

    pairs = left.join(right, ["subset", "block"]).select("subset", "side1", "id1", "side2", "id2", "x1", "x2")
    cells = pairs.mapInArrow(sums, "subset int, p int, q int, total double, n long")
    cell = lambda p, q: F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("total"))) / F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("n")))
    return cells.groupBy("subset").agg((cell(0, 0) + cell(1, 1) - 2 * cell(0, 1)).alias("kid"))


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sample covariance of a set: sums over partitions, d x d numbers to the driver."""
    d = len(df.select("x").first()[0])
    from collections.abc import Iterator

    import pandas as pd

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    sums.__annotations__ = {}
    parts = df.select("x").mapInPandas(sums, "n long, s array<double>, q array<double>")
    at = lambda name: F.posexplode(name).alias("i", "v")
    n = parts.agg(F.sum("n")).first()[0]
    gather = lambda name, size: np.array([r[1] for r in sorted(parts.select(at(name)).groupBy("i").agg(F.sum("v")).collect())]).reshape(size)
    s, q = gather("s", (d,)), gather("q", (d, d))
    mean = s / n
    return n, mean, (q - n * np.outer(mean, mean)) / (n - 1)


def frechet_distance(a: DataFrame, b: DataFrame) -> float:
    """from the two sets' moments; the trace of the root from the eigenvalues of the covariances' product."""
    (_, m1, c1), (_, m2, c2) = moments(a), moments(b)
    eig = np.linalg.eigvals(c1 @ c2)
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(eig.real, 0)).sum())


def match(gt: DataFrame, pred: DataFrame, *more: DataFrame, on: str = "full_id") -> DataFrame:
    """Samples that every modality has."""
    out = gt.join(pred, on)
    for m in more:
        out = out.join(m, on)
    return out


def unmatched(gt: DataFrame, pred: DataFrame, on: str = "full_id") -> DataFrame:
    """Ids that one side lacks."""
    return gt.select(on).join(pred, on, "left_anti").withColumn("side", F.lit("gt")).unionByName(pred.select(on).join(gt, on, "left_anti").withColumn("side", F.lit("pred")))


def ancestor(samples: DataFrame, nodes: DataFrame, on: str = "full_id", node: str = "node") -> DataFrame:
    """Each sample with the columns of its nearest ancestor in nodes (by path), null where there is none. A sample
    looks under each prefix of its path, so the join is on equal paths."""
    parts = F.split(F.regexp_replace(on, "^/", ""), "/")
    steps = F.sequence(F.lit(0), F.size(parts))
    prefixes = samples.select(on, F.explode(F.transform(steps, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))).alias("x")).select(on, "x.*")
    values = [c for c in nodes.columns if c != node]
    found = prefixes.join(nodes.withColumn("prefix", F.regexp_replace(node, "^/", "")), "prefix").groupBy(on).agg(F.max_by(F.struct(*values), "depth").alias("nearest"))
    return samples.join(found, on, "left").select(*samples.columns, *(F.col(f"nearest.{c}").alias(c) for c in values))


def project(points: DataFrame, fx: float, fy: float, cx: float, cy: float, h: int, w: int, pose: list[list[float]] | None = None) -> DataFrame:
    """Points to pixels; of those at a pixel the nearest along the axis wins, ties by order. Radial depth."""
    t = pose or [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    finite = F.col("x").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (F.abs("z") < float("inf"))
    cam = {n: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3] for n, r in zip(("cam_x", "cam_y", "cam_z"), t, strict=False)}
    p = points.where(finite).withColumns(cam).where("cam_z > 1e-8")
    p = p.withColumns({"u": F.rint(fx * F.col("cam_x") / F.col("cam_z") + cx).cast("long"), "v": F.rint(fy * F.col("cam_y") / F.col("cam_z") + cy).cast("long")})
    p = p.where(F.col("u").between(0, w - 1) & F.col("v").between(0, h - 1))
    best = F.row_number().over(Window.partitionBy("img", "v", "u").orderBy("cam_z", "pt", "cam_x", "cam_y"))
    depth = F.sqrt(F.col("cam_x") ** 2 + F.col("cam_y") ** 2 + F.col("cam_z") ** 2)
    return p.withColumn("k", best).where("k = 1").select("img", F.col("v").alias("r"), F.col("u").alias("c"), depth.alias("gt"))
