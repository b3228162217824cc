"""Array files (S10, S12): .npy through Spark's binary reader, so any store that Spark reads will do."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_npy(data: bytes) -> np.ndarray:
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = data[6] >= 2
    size = int.from_bytes(data[8 : 12 if wide else 10], "little")
    start = (12 if wide else 10) + size
    head = ast.literal_eval(data[start - size : start].decode("latin-1"))
    return np.frombuffer(data, np.dtype(head["descr"]), offset=start).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def as_depth(a: np.ndarray) -> np.ndarray:
    """(H, W); a leading or trailing axis of one is dropped."""
    if a.ndim == 3 and 1 in (a.shape[0], a.shape[2]):
        a = a[0] if a.shape[0] == 1 else a[:, :, 0]
    if a.ndim != 2:
        raise ValueError(f"a depth map has two axes, not {a.shape}")
    return a.astype(np.float32)


def as_rgb(a: np.ndarray) -> np.ndarray:
    """(H, W, 3) in [0, 1]; a leading channel axis is moved when the shape says so."""
    if a.ndim != 3 or 3 not in (a.shape[0], a.shape[2]):
        raise ValueError(f"an RGB image has three channels, not {a.shape}")
    if a.shape[0] == 3 and a.shape[2] == 3:
        raise ValueError(f"the channel axis of {a.shape} is ambiguous")
    a = np.moveaxis(a, 0, 2) if a.shape[2] != 3 else a
    return (a / 255 if a.dtype == np.uint8 else a).astype(np.float32)


def as_extrinsics(a: np.ndarray) -> np.ndarray:
    if a.shape == (3, 4):
        a = np.vstack([a, [0, 0, 0, 1]])
    if a.shape != (4, 4):
        raise ValueError(f"extrinsics are 4 x 4, not {a.shape}")
    return a.astype(np.float32)


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """(full_id, h, w, data) for each .npy file below path; full_id is the path without its suffix."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps = [as_depth(parse_npy(x)) for x in b["content"]]
            yield pd.DataFrame({"full_id": b["path"], "h": [m.shape[0] for m in maps], "w": [m.shape[1] for m in maps], "data": [m.ravel() for m in maps]})

    decode.__annotations__ = {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    root = F.lit(path.rstrip("/").removeprefix("file:").lstrip("/"))
    name = F.regexp_replace(F.element_at(F.split("path", root, 2), -1), r"^/|\.npy$", "")
    return files.select(name.alias("path"), "content").mapInPandas(decode, "full_id string, h int, w int, data array<float>")


def to_pixels(maps: DataFrame, value: str) -> DataFrame:
    """A row for each pixel of (full_id, h, w, data)."""
    x = maps.select("full_id", "w", F.posexplode("data").alias("pos", "v"))
    return x.select(F.col("full_id").alias("img"), F.floor(F.col("pos") / F.col("w")).cast("int").alias("r"), (F.col("pos") % F.col("w")).alias("c"), F.col("v").cast("double").alias(value))
