"""Fixed dimensions and row types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Class ids and names, splits in their order, combination names by set of classes.
CLASSES = {0: "pothole", 1: "crack", 2: "manhole"}
SPLITS = ("train", "val", "test")
COMBINATIONS = {
    (): "no object",
    (0,): "pothole only",
    (1,): "crack only",
    (2,): "manhole only",
    (0, 1): "pothole + crack",
    (0, 2): "pothole + manhole",
    (1, 2): "crack + manhole",
    (0, 1, 2): "all 3 classes",
}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv")
EPSILON = 1e-5

# Patterns of capture file names (without suffix), in the order they are tried.
IMPORTED_NAME = r"^rh_(?:train|valid)_(.+?)(?:_aug_.+|_augmented)?$"
DATED_NAME = r"(?i)^vlcsnap[-_]([0-9]{4}-[0-9]{2}-[0-9]{2})[-_][0-9]{2}h"
PLAIN_NAME = r"^([0-9]{8})(?:[_-]|$)"
UNSEQUENCED_NAME = r"(?i)^vlcsnap-[0-9]+"

# Box areas from which a box is medium and large, in square pixels of the model input.
MEDIUM_AREA, LARGE_AREA = 32**2, 96**2

PIXEL_BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("class_id", "x1", "y1", "x2", "y2")] + [T.StructField("confidence", T.DoubleType())])

# Columns of a flat experiment result and of a visual review, in the order of their files.
RESULT_COLUMNS = (
    "experiment", "preprocessing", "epochs", "batch", "imgsz", "fraction", "seed", "precision", "recall", "mAP50", "mAP50_95",
    "pothole_mAP50", "crack_mAP50", "manhole_mAP50", "preprocessing_ms", "inference_ms", "total_ms",
)
FAIR_COLUMNS = ("epochs", "batch", "imgsz", "fraction", "seed")
METRIC_COLUMNS = ("precision", "recall", "mAP50", "mAP50_95", "pothole_mAP50", "crack_mAP50", "manhole_mAP50")
REVIEW_COLUMNS = ("experiment", "status", "reviewed_images", "bbox_alignment", "texture_preservation", "representative_failures", "reviewer")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES.items()), "class_id int, class_name string")


def splits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(SPLITS)], "split string, ord int")


def combinations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(list(k), v) for k, v in COMBINATIONS.items()], "combo array<int>, combination string")


def all_strings(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
