"""Dataset indexes (S1-S4, S7, S8, J1-J3): a JSON tree of files as a relation, and modalities matched by path."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets

FILES = "full_id string, hierarchy array<string>, id string, path string"


def _walk(node: dict, way: tuple[str, ...]) -> Iterator[tuple[str, list[str], str, str]]:
    for f in node.get("files") or ():
        yield "/" + "/".join((*way, str(f["id"]))), list(way), str(f["id"]), f["path"]
    for name, child in (node.get("children") or {}).items():
        yield from _walk(child, (*way, name))


def files(spark: SparkSession, index: dict | str, split: str | None = None) -> DataFrame:
    """The files of an index, one row each. index: the tree or the path of its JSON; split: files of one split only
    (those whose ``split`` entry, or that of a node above them, says so)."""
    tree = json.loads(Path(index).read_text()) if isinstance(index, str) else index
    root = tree.get("dataset", tree)
    if split is not None:
        root = _of_split(root, split, None) or {}
    return spark.createDataFrame(list(_walk(root, ())), FILES)


def _of_split(node: dict, split: str, own: str | None) -> dict | None:
    own = node.get("split", own)
    kept = [f for f in node.get("files") or () if f.get("split", own) == split]
    children = {k: c for k, v in (node.get("children") or {}).items() if (c := _of_split(v, split, own))}
    return {"files": kept, "children": children} if kept or children else None


#: What a modality's metadata say where they are silent.
DEFAULTS = {"depth": {"scale_to_meters": 1.0, "radial_depth": True}, "sparse_depth": {"radial_depth": True}, "rgb": {"rgb_range": None}, "rays": {"fov_domain": None}, "segmentation": {"sky_class_id": None}}


def metadata(index: dict, modality: str) -> dict:
    """The flags of a modality, defaults filled in."""
    return DEFAULTS.get(modality, {}) | {k: v for k, v in (index.get("meta") or {}).items() if v is not None}


def sky_valid(class_id: Column, sky_class_id: int | None) -> Column:
    """True where a pixel is not sky; without a class for sky everywhere."""
    return F.lit(True) if sky_class_id is None else F.coalesce(class_id != sky_class_id, F.lit(True))


def samples(gt: DataFrame, pred: DataFrame, by_file: dict[str, DataFrame] | None = None, by_node: dict[str, DataFrame] | None = None) -> DataFrame:
    """Files that reference, prediction and every modality of by_file have, with their paths; each modality of
    by_node (calibration, intrinsics, poses) comes from the nearest node above, or is null."""
    one = lambda df, name: df.select("full_id", F.col("path").alias(name))
    out = sets.match(one(gt, "gt"), one(pred, "pred"), *(one(df, n) for n, df in (by_file or {}).items()))
    for name, df in (by_node or {}).items():
        nodes = df.groupBy(F.array_join("hierarchy", "/").alias("node")).agg(F.min_by("path", "id").alias(name))  # the first file of a node
        out = sets.ancestor(out, nodes)
    return out
