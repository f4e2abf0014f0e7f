"""Annotation statistics: classes, combinations, splits, sizes, imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.geometry import size_class
from skeinwork.schema import CLASSES, MEDIUM_AREA, classes, combinations, splits


def class_counts(boxes: DataFrame) -> DataFrame:
    """Objects by split and class, with totals (nulls)."""
    return boxes.rollup("split", "class_id").agg(F.count("*").alias("n_objects"))


def images_containing(boxes: DataFrame) -> DataFrame:
    """Images with each class by split, zero-filled."""
    spark = boxes.sparkSession
    n = boxes.groupBy("split", "class_id").agg(F.countDistinct("frame_id").alias("n_images"))
    every = splits(spark).join(F.broadcast(classes(spark)), F.lit(True)).select("split", "class_id", "class_name")
    return every.join(n, ["split", "class_id"], "left").select("split", "class_name", F.coalesce("n_images", F.lit(0)).alias("n_images"))


def _combos(images: DataFrame, boxes: DataFrame) -> DataFrame:
    each = boxes.groupBy("frame_id").agg(F.sort_array(F.collect_set("class_id")).alias("combo"))
    return images.join(each, "frame_id", "left").withColumn("combo", F.coalesce("combo", F.array().cast("array<int>")))


def class_combinations(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images by exact set of classes, all eight zero-filled. images: frame_id."""
    n = _combos(images.select("frame_id"), boxes).groupBy("combo").agg(F.count("*").alias("n_images"))
    return combinations(images.sparkSession).join(n, "combo", "left").select("combination", F.coalesce("n_images", F.lit(0)).alias("n_images"))


def split_statistics(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row per split: images, objects, percentages of classes and of images with objects. images: frame_id, split."""
    each = boxes.groupBy("frame_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("class_id") == c).alias(f"n{c}") for c in range(3)))
    joined = images.join(each, "frame_id", "left")
    agg = joined.groupBy("split").agg(
        F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.count("n").alias("positive"),
        *(F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"objects_{c}") for c in range(3)), *(F.count_if(F.col(f"n{c}") > 0).alias(f"images_{c}") for c in range(3)),
    )
    at_least = lambda x: F.greatest(F.col(x), F.lit(1))
    hundred = F.lit(100.0)
    return agg.select(
        "split", "images", "objects", *(F.col(f"objects_{c}") for c in range(3)), *((hundred * F.col(f"objects_{c}") / at_least("objects")).alias(f"class_pct_{c}") for c in range(3)),
        (hundred * F.col("positive") / at_least("images")).alias("positive_pct"), *((hundred * F.col(f"images_{c}") / at_least("images")).alias(f"positive_pct_{c}") for c in range(3)),
        (F.col("objects") / at_least("images")).alias("objects_per_image"),
    )


def deviation_warnings(stats: DataFrame, points: float) -> DataFrame:
    """Classes whose share in a split is more than `points` away from their share overall."""
    total = stats.agg(F.sum("objects").alias("all"), *(F.sum(f"objects_{c}").alias(f"all_{c}") for c in range(3)))
    long = stats.select("split", F.inline(F.array(*(F.struct(F.lit(c).alias("class_id"), F.col(f"class_pct_{c}").alias("pct")) for c in range(3)))))
    overall = total.select(F.inline(F.array(*(F.struct(F.lit(c).alias("class_id"), (F.lit(100.0) * F.col(f"all_{c}") / F.greatest(F.col("all"), F.lit(1))).alias("overall_pct")) for c in range(3)))))
    return long.join(F.broadcast(overall), "class_id").where(F.abs(F.col("pct") - F.col("overall_pct")) > F.lit(points)).select("split", "class_id", "pct", "overall_pct")


def achieved_ratios(images: DataFrame) -> DataFrame:
    """Each split's part of all images, zero-filled."""
    n = images.groupBy("split").agg(F.count("*").alias("images"))
    total = n.agg(F.sum("images").alias("all"))
    every = splits(images.sparkSession).join(n, "split", "left").join(F.broadcast(total), F.lit(True))
    return every.select("split", F.coalesce("images", F.lit(0)).alias("images"), (F.coalesce("images", F.lit(0)) / F.greatest(F.coalesce("all", F.lit(0)), F.lit(1))).alias("ratio"))


def at_sizes(boxes: DataFrame, sizes: list[int], side: int) -> DataFrame:
    """Boxes in pixels of square model inputs, a row per size: imgsz, class_id, width, height, area."""
    each = boxes.withColumn("imgsz", F.explode(F.array(*(F.lit(s) for s in sorted(set(sizes))))))
    scale = F.col("imgsz") / F.lit(float(side))
    w, h = (F.col("x2") - F.col("x1")) * scale, (F.col("y2") - F.col("y1")) * scale
    return each.select("imgsz", "class_id", w.alias("width"), h.alias("height"), (w * h).alias("area"))


def size_summary(sized: DataFrame) -> DataFrame:
    """Distribution of widths, heights and areas, for every class and for all of a size, in one pass of grouping sets."""
    aggs = [F.count("*").alias("n")]
    for c in ("width", "height", "area"):
        p = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.min(c).alias(f"{c}_min"), p.alias(f"{c}_p"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    d = sized.groupingSets([["imgsz", "class_id"], ["imgsz"]], "imgsz", "class_id").agg(*aggs)
    out = ["imgsz", "class_id", "n"]
    for c in ("width", "height", "area"):
        out += [f"{c}_min", *(F.get(f"{c}_p", F.lit(k)).alias(f"{c}_{name}") for k, name in enumerate(("p25", "median", "p75"))), f"{c}_max", f"{c}_mean"]
    return d.select(*out)


def size_buckets(sized: DataFrame) -> DataFrame:
    """Counts and shares of small, medium and large boxes by size and class."""
    b = sized.withColumn("bucket", size_class(F.col("area")))
    names = ("small", "medium", "large")
    g = b.groupBy("imgsz", "class_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("bucket") == k).alias(k) for k in names))
    return g.select("imgsz", "class_id", "n", *names, *((F.col(k) / F.col("n")).alias(f"{k}_share") for k in names))


def class_imbalance(boxes: DataFrame) -> DataFrame:
    """Shares of classes, and the train split's ratio of the most to the least frequent (that occurs) with its level."""
    spark = boxes.sparkSession
    n = boxes.groupBy("class_id").agg(F.count("*").alias("objects"), F.count_if(F.col("split") == "train").alias("train_objects"))
    full = classes(spark).join(n, "class_id", "left").select("class_id", "class_name", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("train_objects", F.lit(0)).alias("train_objects"))
    some = F.when(F.col("train_objects") > 0, F.col("train_objects"))
    total = full.agg(F.sum("objects").alias("all"), F.sum("train_objects").alias("train"), F.coalesce(F.max(some) / F.min(some), F.lit(0.0)).alias("train_ratio"))
    level = F.when(F.col("train_ratio") >= 2.0, "HIGH").when(F.col("train_ratio") >= 1.5, "MODERATE").otherwise("LOW")
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return full.join(F.broadcast(total), F.lit(True)).select(
        "class_name", "objects", part("objects", "all").alias("share"), "train_objects", part("train_objects", "train").alias("train_share"), "train_ratio", level.alias("level")
    )


# Codes, severity and limits of the warnings of class balance.
SMALL_ALL, SMALL_CLASS, IMBALANCE, SEVERITY = "MANY_SMALL_OBJECTS_AT_320", "MANY_SMALL_{}_AT_320", "CLASS_IMBALANCE", "HIGH"
SMALL_SIZE, SMALL_SHARE, SMALL_CLASS_SHARE = 320, 0.25, 0.5


def balance_warnings(sized: DataFrame, boxes: DataFrame, overall: float = SMALL_SHARE, of_class: float = SMALL_CLASS_SHARE) -> DataFrame:
    """code, severity, value: too many small boxes at SMALL_SIZE pixels, of all and of a class, and classes out of balance.

    sized: as of at_sizes(); boxes: class_id, split."""
    g = sized.where(F.col("imgsz") == SMALL_SIZE).rollup("class_id").agg(F.avg((F.col("area") < MEDIUM_AREA).cast("double")).alias("value"))
    named = F.create_map(*(F.lit(x) for k, n in CLASSES.items() for x in (k, SMALL_CLASS.format(n.upper()))))
    code = F.when(F.col("class_id").isNull(), SMALL_ALL).otherwise(named[F.col("class_id")])
    small = g.where(F.when(F.col("class_id").isNull(), F.col("value") >= overall).otherwise(F.col("value") >= of_class)).select(code.alias("code"), F.lit(SEVERITY).alias("severity"), "value")
    uneven = class_imbalance(boxes).where("level = 'HIGH'").agg(F.max("train_ratio").alias("value")).where("value is not null")
    return small.unionByName(uneven.select(F.lit(IMBALANCE).alias("code"), F.lit(SEVERITY).alias("severity"), "value"))


def pixel_statistics(images: DataFrame) -> DataFrame:
    """Over images (mean, std, low, high): mean of means, mean of deviations, extremes."""
    return images.agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.min("low").alias("low"), F.max("high").alias("high"))
