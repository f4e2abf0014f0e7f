"""Average precision of detections by class: confidence order, running counts, envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import ordered
from skeinwork.operators.matching import greedy, iou_pairs
from skeinwork.schema import classes


def scored(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """class_id, confidence, tp (0 or 1) of each prediction: whether the one-to-one matching of its frame gives it a box."""
    keys = ["frame_id", "class_id"]
    hit = greedy(iou_pairs(gt, pred, threshold), keys).select(*keys, F.explode("matches.pred_id").alias("pred_id"), F.lit(1).cast("long").alias("tp"))
    return pred.join(hit, [*keys, "pred_id"], "left").select("class_id", "confidence", F.coalesce("tp", F.lit(0).cast("long")).alias("tp"))


def curve(points: DataFrame, n_gt: DataFrame) -> DataFrame:
    """class_id, confidence, precision, recall, envelope: a point per class and distinct confidence, all at least as confident
    predictions counted; the envelope is the best precision at this recall or more. n_gt: class_id, n."""
    pooled = points.groupBy("class_id", "confidence").agg(F.sum("tp").alias("tp"), F.count("*").alias("all"))
    parts = ordered.sorted_parts(pooled, "class_id", F.desc("confidence"))
    parts = ordered.others(parts, "tp", F.sum, ["class_id"], "tp_before")
    parts = ordered.others(parts, "all", F.sum, ["class_id"], "all_before")
    hits, seen = F.col("tp") + F.coalesce("tp_before", F.lit(0)), F.col("all") + F.coalesce("all_before", F.lit(0))
    parts = parts.join(F.broadcast(n_gt), "class_id").select("class_id", "confidence", "tp", "n", (hits / seen).alias("precision"), (hits / F.col("n")).alias("recall"), ordered.PART, ordered.AT)
    parts = ordered.others(parts, "precision", F.max, ["class_id"], "later", after=True)
    return parts.select("class_id", "confidence", "tp", "n", "precision", "recall", F.greatest("precision", "later").alias("envelope"))


def average_precision(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """class_name, n_gt, n_pred, ap of every class: the area under the envelope over recall, with four decimals; 0 without
    predictions, null without a box of the class."""
    spark, points = gt.sparkSession, scored(gt, pred, threshold)
    n_gt = gt.groupBy("class_id").agg(F.count("*").alias("n"))  # a row per class
    area = curve(points, n_gt).groupBy("class_id").agg((F.sum(F.col("tp") * F.col("envelope")) / F.max("n")).alias("ap"))
    n_pred = pred.groupBy("class_id").agg(F.count("*").alias("n_pred"))
    d = classes(spark).join(n_gt, "class_id", "left").join(n_pred, "class_id", "left").join(area, "class_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.select("class_name", zero("n").alias("n_gt"), zero("n_pred").alias("n_pred"), F.when(F.col("n") > 0, F.round(F.coalesce("ap", F.lit(0.0)), 4)).alias("ap"))
