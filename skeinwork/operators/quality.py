"""Dataset quality: exact duplicates, missing and orphan labels, leakage between splits, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.schema import SPLITS


def duplicate_groups(images: DataFrame) -> DataFrame:
    """content_md5, n_images, n_signatures, first_name of digests that several images have."""
    g = images.groupBy("content_md5").agg(F.count("*").alias("n_images"), F.countDistinct("signature").alias("n_signatures"), F.min("name").alias("first_name"))
    return g.where("n_images > 1")


def with_outcome(images: DataFrame) -> DataFrame:
    """Adds outcome. Images of one digest: with one label signature the first by name is kept and others are duplicates;
    with several signatures all are in conflict and none is kept."""
    groups = duplicate_groups(images).select("content_md5", "n_signatures", "first_name")
    outcome = F.when(F.col("n_signatures") > 1, "conflict").when(F.col("first_name") != F.col("name"), "duplicate").otherwise("kept")
    return images.join(groups, "content_md5", "left").withColumn("outcome", outcome).drop("n_signatures", "first_name")


def labelled(images: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    return images.join(labels, on, "left_semi")


def missing(images: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Images without a label."""
    return images.join(labels, on, "left_anti")


def orphans(images: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Labels without an image."""
    return labels.join(images, on, "left_anti")


def leaking(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in several splits: key, n_rows, splits."""
    g = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.concat_ws(",", F.sort_array(F.collect_set("split"))).alias("splits"), F.countDistinct("split").alias("n_splits"))
    return g.where("n_splits > 1").drop("n_splits")


def split_overlaps(rows: DataFrame, key: str) -> DataFrame:
    """How many keys each two splits share, zero-filled; from a bit per split and key, no self-join."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.max(F.when(F.col("split") == s, F.lit(1 << i)).otherwise(F.lit(0))) for i, s in enumerate(SPLITS)])
    seen = rows.groupBy(key).agg(bits.alias("bits"))
    pairs = [(a, b) for a in range(3) for b in range(a + 1, 3)]
    counts = seen.agg(*(F.count_if(F.col("bits").bitwiseAND(F.lit(1 << a | 1 << b)) == F.lit(1 << a | 1 << b)).alias(f"p{a}{b}") for a, b in pairs))
    items = F.array(*(F.struct(F.lit(SPLITS[a]).alias("split_a"), F.lit(SPLITS[b]).alias("split_b"), F.col(f"p{a}{b}").alias("n_keys")) for a, b in pairs))
    return counts.select(F.inline(items))


def near_duplicate_report(matches: DataFrame, roots: DataFrame, placed: DataFrame) -> DataFrame:
    """Near-duplicate matches (group_a, group_b, distance) whose groups ended up in different splits.

    roots: group_key, group_root; placed: group_root, split."""
    where = roots.join(placed, "group_root").select("group_key", "split")
    a = where.select(F.col("group_key").alias("group_a"), F.col("split").alias("split_a"))
    b = where.select(F.col("group_key").alias("group_b"), F.col("split").alias("split_b"))
    return matches.join(a, "group_a").join(b, "group_b").where("split_a <> split_b")


def empty_splits(rows: DataFrame) -> DataFrame:
    """Splits without a row."""
    from skeinwork.schema import splits

    return splits(rows.sparkSession).join(rows.select("split").distinct(), "split", "left_anti")


def structural_errors(images: DataFrame, labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """split, item, error for a processed dataset; it passes if there is none.

    images: split, stem, ok (readable); labels: split, stem; boxes: split, stem, line_no, status, changed."""
    on = ["split", "stem"]
    parts = [
        images.join(labels, on, "left_anti").select("split", "stem", F.lit("missing_label").alias("error")),
        labels.join(images, on, "left_anti").select("split", "stem", F.lit("orphan_label").alias("error")),
        images.where(~F.col("ok")).select("split", "stem", F.lit("unreadable_image").alias("error")),
        boxes.where((F.col("status") != "valid") | F.col("changed")).select("split", F.concat_ws(":", "stem", "line_no").alias("stem"), F.lit("invalid_box").alias("error")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("stem", "item")


def integrity_errors(images: DataFrame, labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Structural errors and leakage by digest, stem and group. images also have digest and group_key."""
    parts = [structural_errors(images, labels, boxes)]
    for key in ("digest", "stem", "group_key"):
        parts.append(leaking(images, key).select(F.col("splits").alias("split"), F.col(key).alias("item"), F.lit(f"leakage_by_{key}").alias("error")))
    return reduce(DataFrame.unionByName, parts)


def first_errors(errors: DataFrame, n: int = 20) -> DataFrame:
    """The report shows the first errors only."""
    return errors.orderBy("split", "item", "error").limit(n)


def tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, in order."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)
