"""Run configuration and modality selectors."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Modality:
    name: str
    path: str
    split: str | None = None
    scope: str | None = None

    @property
    def metadata_scope(self) -> str:
        return self.scope or self.name


def parse_selector(text: str, name: str, split: str | None = None, scope: str | None = None) -> Modality:
    """``path[:split][#scope=name]``; a colon within the first two characters belongs to a drive. Two different splits
    or scopes for one modality are an error."""
    path, _, fragment = text.partition("#")
    if fragment:
        key, eq, value = fragment.partition("=")
        if key != "scope" or not eq or not value:
            raise ValueError(f"unknown selector {fragment!r}")
        if scope not in (None, value):
            raise ValueError(f"two scopes for {name}: {scope}, {value}")
        scope = value
    at = path.rfind(":")
    if at > 1 and "/" not in path[at + 1 :] and "\\" not in path[at + 1 :]:
        path, own = path[:at], path[at + 1 :]
        if not own:
            raise ValueError("an empty split")
        if split not in (None, own):
            raise ValueError(f"two splits for {name}: {split}, {own}")
        split = own
    return Modality(name, path, split, scope)


DEPTHS = ("depth", "relative_depth", "affine_depth")
GT = {"rgb", "depth", "sparse_depth", "rays", "calibration", "segmentation", "intrinsics", "extrinsics", "camera_extrinsics", "name"}


def load(path: str) -> dict:
    return validate(json.loads(Path(path).read_text()))


def validate(config: dict) -> dict:
    """One ground truth, one or more datasets with one kind of depth each; sparse depth needs both camera parts."""
    gt = config.get("gt")
    if not isinstance(gt, dict):
        raise ValueError("gt is missing")
    for name, entry in gt.items():
        if name != "name" and (not isinstance(entry, dict) or not entry.get("path")):
            raise ValueError(f"gt.{name} needs a path")
    if "sparse_depth" in gt and not (({"intrinsics", "calibration"} & gt.keys()) and ({"extrinsics", "camera_extrinsics"} & gt.keys())):
        raise ValueError("gt.sparse_depth needs intrinsics and extrinsics")
    datasets = config.get("datasets")
    if not isinstance(datasets, list) or not datasets:
        raise ValueError("datasets is missing")
    for d in datasets:
        if not d.get("name"):
            raise ValueError("a dataset needs a name")
        if sum(k in d for k in DEPTHS) > 1:
            raise ValueError(f"{d['name']}: more than one kind of depth")
        if not {*DEPTHS, "rgb", "rays"} & d.keys():
            raise ValueError(f"{d['name']}: nothing to compare")
    return config


def space_hint(dataset: dict) -> str | None:
    return {"relative_depth": "relative", "affine_depth": "affine"}.get(next((k for k in DEPTHS if k in dataset), ""))
