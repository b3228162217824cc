"""Result trees and their sinks (K1-K8). What is collected here is a report: scores by image or by set."""

from __future__ import annotations

import json
import math
import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    """K3: of rows for the same (hierarchy, id) the last one counts."""
    w = Window.partitionBy("hierarchy", "id").orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def finite_only(rows: DataFrame, value: str = "value") -> DataFrame:
    """K4 over a long table."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def clean(tree):
    """K4 over a nested one: no null, no number that is not finite, no empty branch; lists stay."""
    if not isinstance(tree, dict):
        return tree
    out = {k: clean(v) for k, v in tree.items()}
    return {k: v for k, v in out.items() if v is not None and v != {} and not (isinstance(v, float) and not math.isfinite(v))}


def nest(rows: list[tuple[str, object]]) -> dict:
    """{"a.b": 1} as {"a": {"b": 1}}."""
    out: dict = {}
    for path, value in rows:
        *way, last = path.split(".")
        at = out
        for k in way:
            at = at.setdefault(k, {})
        at[last] = value
    return out


def file_tree(rows: list[tuple[str, dict]]) -> dict:
    """{children, files} from (full_id, metrics); a repeated id replaces what was there."""
    root: dict = {"children": {}, "files": []}
    for full_id, metrics in rows:
        *way, name = full_id.strip("/").split("/")
        at = root
        for k in way:
            at = at["children"].setdefault(k, {"children": {}, "files": []})
        at["files"] = [f for f in at["files"] if f["id"] != name] + [{"id": name, "metrics": clean(metrics)}]
    return root


def metric_set(namespace: str, metrics: dict, axes: dict) -> dict:
    return {"namespace": namespace, "axes": axes, "metrics": clean(metrics)}


def save(result: dict, target: str) -> None:
    """K1, K2: a JSON file; a path inside an archive replaces that entry and keeps the others."""
    text = json.dumps(result, indent=2)
    path = Path(target)
    archive = next((p for p in path.parents if p.suffix == ".zip" and p.is_file()), None)
    if archive is None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return
    name, new = path.relative_to(archive).as_posix(), archive.with_suffix(".tmp")
    with zipfile.ZipFile(archive) as old, zipfile.ZipFile(new, "w", zipfile.ZIP_DEFLATED) as out:
        for item in old.infolist():
            if item.filename != name:
                out.writestr(item, old.read(item.filename))
        out.writestr(name, text)
    os.replace(new, archive)
