"""Standard depth scores of a stream of pixels: the sums add up, so a streaming aggregate in update or complete mode
gives the same scores as a batch. Windows of event time with a watermark for late pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import depth


def standard(stream: DataFrame, by: tuple[str, ...] = ("img",)) -> DataFrame:
    return depth.standard(stream, by=by)


def windowed(stream: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    x = depth.errors(stream.withWatermark(time, late)).groupBy(F.window(time, every)).agg(*depth.sums())
    return x.select(F.col("window.start").alias("start"), "n", *depth.from_sums())
