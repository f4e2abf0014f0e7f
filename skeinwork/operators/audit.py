"""The audit of a built dataset: five counters of label lines, files without a partner, leakage, and a verdict.

It is looser than the gate of quality.structural_errors: one line may raise several counters, coordinates are tested as they
are (no tolerance, no corners), and files without a partner are told but leave the dataset valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.annotations import INTEGER, NUMBER
from skeinwork.operators.quality import leaking
from skeinwork.schema import CLASSES

# The counters of label lines, in the order of the report.
COUNTERS = ("invalid_class_ids", "out_of_bounds_coords", "non_positive_wh", "nan_inf_values", "malformed_lines")


def _value(x):
    """A number as the label format has it, with nan and the infinities; null if it is none."""
    plain = F.when(x.rlike(NUMBER), F.replace(x, F.lit("_"), F.lit("")).try_cast("double"))
    infinite = F.when(x.rlike(r"(?i)^[+]?(inf|infinity)$"), float("inf")).when(x.rlike(r"(?i)^-(inf|infinity)$"), float("-inf"))
    return F.coalesce(plain, infinite, F.when(x.rlike(r"(?i)^[+-]?nan$"), float("nan")))


def line_faults(lines: DataFrame) -> DataFrame:
    """Adds a boolean for each counter, and class_id where the line is an object of a known class. lines: raw, not blank."""
    parts = F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), r"\s+")
    d = lines.withColumn("__p", parts).withColumn("__n", F.transform(F.slice("__p", 2, 4), _value))
    five = F.size("__p") == 5
    number = F.get("__p", F.lit(0)).rlike(INTEGER) & ~F.exists("__n", F.isnull)
    read = five & number
    known = F.coalesce(F.replace(F.get("__p", F.lit(0)), F.lit("_"), F.lit("")).try_cast("int").isin(*CLASSES), F.lit(False))
    unbounded = F.exists("__n", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    outside = F.exists("__n", lambda x: ~((x >= 0) & (x <= 1)) | F.isnan(x))
    empty = F.exists(F.slice("__n", 3, 2), lambda x: (x <= 0) & ~F.isnan(x))
    faults = (read & ~known, read & outside, read & empty, five & (~number | unbounded), ~five)
    d = d.withColumns({c: F.coalesce(f, F.lit(False)) for c, f in zip(COUNTERS, faults, strict=True)})
    return d.withColumn("class_id", F.when(read & known, F.replace(F.get("__p", F.lit(0)), F.lit("_"), F.lit("")).try_cast("int"))).drop("__p", "__n")


def class_distribution(lines: DataFrame) -> DataFrame:
    """split, n_objects of each class and in all, by the lines that the audit counts."""
    return line_faults(lines).groupBy("split").agg(*(F.count_if(F.col("class_id") == c).alias(name) for c, name in CLASSES.items()), F.count("class_id").alias("total_objects"))


def audit(lines: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the counters, total_valid_objects, missing_labels, missing_images, keys in several splits by stem, digest and
    group_key, and is_valid. lines: split, raw; images: split, stem, digest, group_key; labels: split, stem."""
    counted = line_faults(lines).agg(*(F.count_if(c).alias(c) for c in COUNTERS), F.count("class_id").alias("total_valid_objects"))
    on = ["split", "stem"]
    parts = [
        images.join(labels, on, "left_anti").agg(F.count("*").alias("missing_labels")), labels.join(images, on, "left_anti").agg(F.count("*").alias("missing_images")),
        *(leaking(images, key).agg(F.count("*").alias(f"{key}_overlaps")) for key in ("stem", "digest", "group_key")),
    ]
    d = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [counted, *parts])  # one row each
    faults = [F.col(c) for c in (*COUNTERS, "stem_overlaps", "digest_overlaps", "group_key_overlaps")]
    return d.withColumn("is_valid", reduce(lambda a, b: a + b, faults) == 0)
