"""Detections against ground truth: overlapping pairs, greedy one-to-one matching, totals, confusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.geometry import overlap
from skeinwork.schema import CLASSES, classes

BOX = ("x1", "y1", "x2", "y2")


def iou_pairs(gt: DataFrame, pred: DataFrame, threshold: float, by_class: bool = True) -> DataFrame:
    """Pairs of a frame (and class) that overlap by the threshold or more: frame_id, class_id, box_id, pred_id, iou."""
    on = ["frame_id", "class_id"] if by_class else ["frame_id"]
    g = gt.select("frame_id", "class_id", "box_id", *(F.col(c).alias(f"g_{c}") for c in BOX))
    p = pred.select("frame_id", *(["class_id"] if by_class else [F.col("class_id").alias("pred_class_id")]), "pred_id", *(F.col(c).alias(f"p_{c}") for c in BOX))
    both, union = overlap(tuple(F.col(f"g_{c}") for c in BOX), tuple(F.col(f"p_{c}") for c in BOX))
    pairs = g.join(p, on).select(*on, *([] if by_class else ["class_id", "pred_class_id"]), "box_id", "pred_id", both.alias("both"), union.alias("union"))
    return pairs.where("union > 0").withColumn("iou", F.col("both") / F.col("union")).where(F.col("iou") >= threshold).drop("both", "union")


def greedy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches of each key group, by falling overlap; equal overlaps take the higher box, then the higher
    prediction. A fold over the sorted candidates of the group, without Python: keys, matches (array of box, pred)."""
    order = F.sort_array(F.collect_list(F.struct("iou", "box_id", "pred_id")), asc=False)
    start = F.array().cast("array<struct<box_id:bigint,pred_id:bigint>>")

    def step(taken, c):
        free = ~F.exists(taken, lambda t: (t["box_id"] == c["box_id"]) | (t["pred_id"] == c["pred_id"]))
        return F.when(free, F.concat(taken, F.array(F.struct(c["box_id"].cast("long").alias("box_id"), c["pred_id"].cast("long").alias("pred_id"))))).otherwise(taken)

    return pairs.groupBy(*keys).agg(order.alias("c")).select(*keys, F.aggregate("c", start, step).alias("matches"))


def match_counts(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn by frame and class, wherever a box of either side is."""
    keys = ["frame_id", "class_id"]
    matched = greedy(iou_pairs(gt, pred, threshold), keys).select(*keys, F.size("matches").cast("long").alias("tp"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = gt.select(*keys, one.alias("g"), none.alias("p")).unionByName(pred.select(*keys, none.alias("g"), one.alias("p")))
    # counted and matched rows have the same partitioning by frame and class, so that their join needs no other shuffle
    counted = sides.groupBy(*keys).agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"))
    d = counted.join(matched, keys, "left").na.fill(0, ["tp"])
    return d.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def totals(counts: DataFrame, zero: bool = False) -> DataFrame:
    """Counts of each class over frames, every class reported, with precision and recall; null (or 0) without a base."""
    d = _summed(counts, classes(counts.sparkSession), ["class_id"])
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    if not zero:
        return d.select("class_name", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))
    return d.select("class_name", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def _summed(counts: DataFrame, every: DataFrame, by: list[str]) -> DataFrame:
    s = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return every.join(s, by, "left").na.fill(0, ["tp", "fp", "fn"])


def totals_by_way(counts: DataFrame) -> DataFrame:
    """totals() of each way of scored_ways()."""
    ways = counts.sparkSession.createDataFrame([("raw",), ("voted",), ("kept",)], "way string")
    d = _summed(counts, classes(counts.sparkSession).crossJoin(ways), ["way", "class_id"])  # nine rows
    return d.select("way", "class_name", "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def confusion(pairs: DataFrame) -> DataFrame:
    """predicted, actual, n in long form. pairs: predicted, actual (null: background)."""
    name = lambda c: F.coalesce(c, F.lit("background"))
    return pairs.groupBy(name(F.col("predicted")).alias("predicted"), name(F.col("actual")).alias("actual")).agg(F.count("*").alias("n"))


def column_normalised(matrix: DataFrame) -> DataFrame:
    """Each count's part of its actual class. The sums join back, so no window gathers a class."""
    total = matrix.groupBy("actual").agg(F.sum("n").alias("total"))
    return matrix.join(total, "actual").select("predicted", "actual", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0)).alias("rate"))


# The confusions that reports name, as (actual, predicted).
NAMED = (("pothole", "manhole"), ("manhole", "pothole"), ("crack", "background"), ("pothole", "background"))


def named_confusions(matrix: DataFrame) -> DataFrame:
    """actual, predicted, count, actual_instances, rate for the named confusions, zero-filled."""
    agg = matrix.agg(
        *(F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))), F.lit(0)).alias(f"n{i}") for i, (a, p) in enumerate(NAMED)),
        *(F.coalesce(F.sum(F.when(F.col("actual") == a, F.col("n"))), F.lit(0)).alias(f"t{i}") for i, (a, _) in enumerate(NAMED)),
    )
    rows = F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{i}").alias("count"), F.col(f"t{i}").alias("actual_instances")) for i, (a, p) in enumerate(NAMED)))
    d = agg.select(F.inline(rows))
    return d.withColumn("rate", F.when(F.col("actual_instances") > 0, F.col("count") / F.col("actual_instances")).otherwise(F.lit(0.0)))


def linked_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """predicted and actual class names of predictions that say which box they mean (pred_id is 2 * box_id, or that plus 1
    for a second one of the box, which counts as background), and of boxes without a prediction."""
    name = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    first = pred.where("pred_id % 2 = 0").select((F.col("pred_id") / 2).cast("long").alias("box_id"), F.col("class_id").alias("p"))
    one = gt.select("box_id", "class_id").join(first, "box_id", "left").select(name[F.col("p")].alias("predicted"), name[F.col("class_id")].alias("actual"))
    return one.unionByName(pred.where("pred_id % 2 = 1").select(name[F.col("class_id")].alias("predicted"), F.lit(None).cast("string").alias("actual")))


def scored_ways(gt: DataFrame, tracked: DataFrame, min_hits: int = 3, threshold: float = 0.5) -> DataFrame:
    """match_counts() three ways, as `way`: 'raw' by the class of each frame, 'voted' by the track's class by vote up to the
    frame, 'kept' by that, too, but only detections of tracks with min_hits in the end.

    tracked: frame_id, pred_id, stream_id, track_id, class_id, track_class_id and the box."""
    confirmed = tracked.groupBy("stream_id", "track_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
    voted = tracked.withColumn("class_id", F.col("track_class_id"))
    ways = {"raw": tracked, "voted": voted, "kept": voted.join(confirmed, ["stream_id", "track_id"], "left_semi")}
    return reduce(DataFrame.unionByName, (match_counts(gt, d, threshold).withColumn("way", F.lit(w)) for w, d in ways.items()))


def pooled_suite_row(videos: DataFrame) -> DataFrame:
    """One row of a suite: pooled counts and scores, sums, and plain means over the scored videos.

    videos: scored (has ground truth), frames, tp, fp, fn, confirmed, unconfirmed, ms."""
    s = videos.where("scored").agg(
        F.count("*").alias("videos"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("frames", "tp", "fp", "fn", "confirmed", "unconfirmed")), F.avg("ms").alias("mean_ms")
    )
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return s.select("*", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0)).alias("f1"))
