"""Sources: image, label and report files as DataFrames, and the paths that pair them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.schema import IMAGE_SUFFIXES, SPLITS, VIDEO_SUFFIXES, all_strings

_PROBE = "ok boolean, height int, width int, channels int, reason string"


def with_names(files: DataFrame) -> DataFrame:
    """Adds name, stem and ext (lower case) from path."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, first: int | None = None) -> DataFrame:
    """Files of the suffixes in any case, by name; the first ones only if asked. Contents are read only if used."""
    files = with_names(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).where(F.col("ext").isin(*suffixes))
    return files.orderBy("name").limit(first) if first else files


def videos(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    return scan(spark, path, VIDEO_SUFFIXES, first)


def unsupported(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    return with_names(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).where(~F.col("ext").isin(*suffixes)).select("path")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """stem, text of whole label files, for functions.annotations.label_lines()."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("path", F.input_file_name())
    return with_names(files).select("stem", F.col("value").alias("text"))


def lenient_boxes(lines: DataFrame) -> DataFrame:
    """Label rows of five fields, cast without any test; others are passed over."""
    p = F.split(F.trim("raw"), r"\s+")
    d = lines.withColumn("p", p).where(F.size("p") == 5)
    return d.select("stem", F.get("p", F.lit(0)).try_cast("double").cast("int").alias("class_id"), *(F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("xc", "yc", "w", "h"), 1)))


def header(content: bytes | None) -> tuple[bool, int | None, int | None, int | None, str | None]:
    """Whether bytes begin as a readable PNG or JPEG, with height, width, channels, or why not."""
    if not content:
        return False, None, None, None, "empty"
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        if len(content) < 29 or content[12:16] != b"IHDR":
            return False, None, None, None, "truncated"
        w, h, _, kind = struct.unpack(">IIBB", content[16:26])
        channels = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(kind)
    elif content[:2] == b"\xff\xd8":
        at, w = 2, None
        while at + 9 < len(content) and content[at] == 0xFF:
            mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w, channels = *struct.unpack(">HH", content[at + 5 : at + 9]), content[at + 9]
                break
            at += 2 + size
        if w is None:
            return False, None, None, None, "truncated"
    else:
        return False, None, None, None, "not_an_image"
    if not w or not h:
        return False, h, w, channels, "empty"
    if channels not in (1, 3, 4):
        return False, h, w, channels, "channels"
    return True, h, w, channels, None


def probed(images: DataFrame) -> DataFrame:
    """Images with ok, height, width, channels, reason in place of their content."""
    keep = [f for f in images.schema if f.name != "content"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), _PROBE])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = pd.DataFrame([header(c) for c in pdf["content"]], columns=["ok", "height", "width", "channels", "reason"])
            for c in ("height", "width", "channels"):
                found[c] = found[c].astype("Int32")
            yield pd.concat([pdf[[f.name for f in keep]].reset_index(drop=True), found], axis=1)

    return images.mapInPandas(run, schema)


def companion(path: Column, part: str, other: str, suffix: str | None = None) -> Column:
    """The path with its last component `part` (in any case) replaced; null if there is none."""
    parts = F.split(path, "/")
    last = F.array_max(F.transform(parts, lambda x, i: F.when(F.lower(x) == part, i)))
    moved = F.concat_ws("/", F.transform(parts, lambda x, i: F.when(i == last, F.lit(other)).otherwise(x)))
    return F.when(last.isNotNull(), F.regexp_replace(moved, r"\.[^./]*$", f".{suffix}") if suffix else moved)


def paired_clips(clips: DataFrame, masks: DataFrame) -> DataFrame:
    """Clips with their mask's path by name; a clip without a mask fails the job that reads it."""
    d = clips.join(masks.select("name", F.col("path").alias("mask_path")), "name", "left")
    return d.withColumn("mask_path", F.when(F.col("mask_path").isNull(), F.raise_error(F.concat(F.lit("no mask for "), "name")).cast("string")).otherwise(F.col("mask_path")))


def source_kind(spark: SparkSession, source: str) -> str:
    """webcam for digits, video for a video file or a folder with videos and no images, else image."""
    if source.isdigit():
        return "webcam"
    ext = source.rsplit(".", 1)[-1].lower()
    if ext in VIDEO_SUFFIXES:
        return "video"
    if ext in IMAGE_SUFFIXES:
        return "image"
    files = with_names(spark.read.format("binaryFile").load(source)).select("ext")
    r = files.agg(F.bool_or(F.col("ext").isin(*VIDEO_SUFFIXES)).alias("v"), F.bool_or(F.col("ext").isin(*IMAGE_SUFFIXES)).alias("i")).first()
    return "video" if r["v"] and not r["i"] else "image"


def imported(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Images of source splits (train before valid) without repeated content: kept rows with new names, and counters.

    parts: split -> images (name, stem, ext, content_md5). The first by split and name of each digest is kept."""
    every = None
    for order, (split, d) in enumerate(parts.items()):
        p = d.select("name", "stem", "ext", "content_md5", F.lit(split).alias("source_split"), F.lit(order).alias("ord"))
        every = p if every is None else every.unionByName(p)
    first = every.groupBy("content_md5").agg(F.min(F.struct("ord", "name")).alias("first"))
    marked = every.join(first, "content_md5").withColumn("kept", F.struct("ord", "name") == F.col("first")).drop("first")
    kept = marked.where("kept").select("name", F.concat(F.lit("rh_"), "source_split", F.lit("_"), "stem", F.lit("."), "ext").alias("new_name"), "source_split", "content_md5")
    counters = marked.groupBy("source_split").agg(F.count("*").alias("n_found"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_repeated"))
    return kept, counters


def csv_rows(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A report with a header, all cells as text; a byte order mark is taken off."""
    d = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    d = d.toDF(*(c.lstrip("﻿") for c in d.columns))
    return d.select(*(F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in columns), *(c for c in d.columns if c not in columns))


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """One document, or None if there is no such file."""
    jvm, sc = spark._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def per_class(document: DataFrame) -> DataFrame:
    """Rows of a metrics document's per_class array."""
    return document.select(F.explode("per_class").alias("c")).select("c.*")


def check_dataset_config(config: dict[str, Any]) -> list[str]:
    """Problems of a dataset's description: class map, paths of the three splits."""
    from skeinwork.schema import CLASSES

    names = config.get("names")
    names = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in (names or {}).items()}
    problems = [] if names == CLASSES else ["class map differs"]
    return problems + [f"no path for {s}" for s in SPLITS if not config.get(s)]


def check_suite(suite: dict[str, Any]) -> list[str]:
    """Problems of a suite's description: required keys, unique names, each file naming its experiment."""
    rows = suite.get("experiments") or []
    names = [r.get("name") for r in rows]
    problems = [f"no {k}" for k in ("name", "experiments", "training") if not suite.get(k)]
    problems += [f"repeated {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    return problems + [f"{r.get('name')} has another name in its file" for r in rows if r.get("config", {}).get("experiment_name", r.get("name")) != r.get("name")]


def newest_or(canonical: DataFrame, dated: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest dated row of each key, or the canonical one where there is none."""
    from skeinwork.operators.experiments import latest

    best = latest(dated, keys, time).drop(time)
    return best.unionByName(canonical.join(best, keys, "left_anti").select(*best.columns))


def available(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that both listings have."""
    return first.select(key).intersect(second.select(key))


