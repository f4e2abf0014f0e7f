"""Sinks: split datasets, versions that appear whole, reports, guarded folders."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.schema import CLASSES


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def dataset_yaml(path: str) -> str:
    """The text that training reads."""
    lines = [f"path: {path}", *(f"{s}: images/{s}" for s in ("train", "val", "test")), "names:", *(f"  {k}: {v}" for k, v in CLASSES.items())]
    return "\n".join(lines) + "\n"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _swap(fs, new, target, path) -> None:
    """Puts `new` in the place of `target`. What was there steps aside and is deleted last; it comes back if that fails, so
    at any moment the old version or the new one is there, in its place or beside it under a name that begins alike."""
    aside = new.suffix(".old") if fs.exists(target) else None  # a name that no other writer has
    if aside is not None and not fs.rename(target, aside):
        raise OSError(f"{path} can't be moved aside")
    try:
        done = fs.rename(new, target)
    except Exception:
        if aside is not None:
            fs.rename(aside, target)
        raise
    if not done:
        if aside is not None and not fs.rename(aside, target):
            raise OSError(f"{path} can't be replaced; its last version is {aside.toString()}")
        raise OSError(f"{path} can't be replaced")
    if aside is not None:
        fs.delete(aside, True)


def _replaced(spark: SparkSession, path: str, write, swap=_swap) -> None:
    """write(folder) beside, then swapped into place; nothing is left behind if either fails."""
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fs, new = _fs(spark, beside)
    try:
        write(beside)
        swap(fs, new, _fs(spark, path)[1], path)
    finally:
        if fs.exists(new):
            fs.delete(new, True)


def replace_version(rows: DataFrame, path: str) -> None:
    """A table that appears whole: written beside and swapped into place."""
    _replaced(rows.sparkSession, path, lambda beside: rows.write.parquet(beside))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header; for reports, which are small."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def upsert_csv(spark: SparkSession, existing: DataFrame, new: DataFrame, path: str) -> bool:
    """Adds rows whose experiment isn't there, and columns that aren't. Nothing is written if there are neither."""
    from skeinwork.operators.experiments import upserted

    more = set(new.columns) - set(existing.columns)
    if not more and not new.join(existing, "experiment", "left_anti").limit(1).count():
        return False
    _replaced(spark, path, lambda beside: write_csv(upserted(existing, new), beside))
    return True


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small report as a table; longer ones are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many rows for a report")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)]) + "\n"


def summary_json(values: dict) -> str:
    return json.dumps(values, sort_keys=True, indent=2)


def may_reset(path: str, allowed_parent: str) -> bool:
    """Only strict descendants of the allowed folder may be emptied."""
    def clean(p: str) -> PurePosixPath:
        out: list[str] = []
        for part in PurePosixPath(p).parts:
            if part == "..":
                out = out[:-1] if len(out) > 1 else out
            elif part != ".":
                out.append(part)
        return PurePosixPath(*out)

    a, b = clean(path), clean(allowed_parent)
    return a != b and b in a.parents


def reset_folder(spark: SparkSession, path: str, allowed_parent: str) -> None:
    if not may_reset(path, allowed_parent):
        raise ValueError(f"{path} is not inside {allowed_parent}")
    fs, where = _fs(spark, path)
    if fs.exists(where):
        fs.delete(where, True)
    fs.mkdirs(where)
