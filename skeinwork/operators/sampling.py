"""Top rows of each split: priorities, seeded samples, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.geometry import near_edge


def seeded(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n distinct rows by a seeded hash, sorted by key: the same for the same seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).orderBy(key)


def quotas(rows: DataFrame, key: str, by: dict[str, int]) -> DataFrame:
    """The first rows of each split by key, as many as its quota."""
    limit = F.create_map(*(F.lit(x) for kv in by.items() for x in kv))
    k = F.row_number().over(Window.partitionBy("split").orderBy(key))
    return rows.withColumn("k", k).where(F.col("k") <= max(by.values())).where(F.col("k") <= limit[F.col("split")]).drop("k")


def for_review(boxes: DataFrame, n: int, seed: int) -> DataFrame:
    """Frames of each split to look at: with a box near the edge first, then of several classes, then others; ties by
    a seeded hash. boxes: split, frame_id, class_id and the normalised box."""
    f = boxes.groupBy("split", "frame_id").agg(F.bool_or(near_edge(*(F.col(c) for c in ("xc", "yc", "w", "h")))).alias("edge"), F.countDistinct("class_id").alias("n_classes"))
    f = f.withColumn("priority", F.when(F.col("edge"), 0).when(F.col("n_classes") > 1, 1).otherwise(2))
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("frame_id").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("split").orderBy("priority", tie, "frame_id"))
    return f.withColumn("rank", k).where(F.col("rank") <= n).select("split", "frame_id", "priority", "rank")
