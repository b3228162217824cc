"""Connected components of a table of links, by large-star and small-star rounds.

Each round is two aggregates and two equi-joins on node ids, whatever the shape of the graph; the links of a round are
written to the shared folder, so a lost executor costs a round at most. Only a count and a sum come to the driver.

A round is some nine stages, however few the links. Up to ``DRIVER_LINKS`` links, counted first, are joined on the
driver instead. Both forms are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that are joined on the driver, 16 bytes each.
DRIVER_LINKS = 200_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), ascending, and the least node that each reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    least = np.arange(len(nodes))  # of each node one that is not greater; at the top a node of itself
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while ((above := least[least]) != least).any():
            least = above
    return nodes, nodes[least]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v. Each node's neighbours (large: the greater ones) are linked to its least neighbour."""
    ways = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = ways.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
    near = ways.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 40, most: int = DRIVER_LINKS) -> DataFrame:
    """(node, component) for each node of links (u, v): component is its least reachable node. Links may repeat and
    point either way; loops are ignored. No links: no rows. most: links that are joined on the driver."""
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    if links.count() <= most:
        held = links.toArrow()
        nodes, least = joined(*(held[c].to_numpy() for c in ("u", "v")))
        return links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())}))
    links = cut(links.distinct())
    state = None
    for _ in range(rounds):
        links = cut(_star(_star(links, True).where("u <> v").distinct(), False).where("u <> v").distinct())
        n, checksum = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == (n, checksum):
            break
        state = (n, checksum)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
