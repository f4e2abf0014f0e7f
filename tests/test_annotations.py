from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skeinwork.functions.annotations import canonical, group_key, label_lines, label_text, parsed, signature, validated
from skeinwork.functions.geometry import check_ranges, letterbox, letterbox_padding, to_pixels

LINES = [
    ("0 0.5 0.5 0.2 0.3", "valid", None),
    ("3 0.5 0.5 0.2 0.2", "rejected", "unsupported_class"),
    ("7 0.5 0.5 0.2 0.2", "rejected", "unsupported_class"),
    ("1 0.5000005 0.5 1.000001 0.2", "clipped", None),
    ("1 0.6 0.5 0.9 0.2", "rejected", "corners_out_of_bounds"),
    ("2 0.95 0.5 0.2 0.2", "rejected", "corners_out_of_bounds"),
    ("1 0.5 0.5 0 0.2", "rejected", "size_out_of_range"),
    ("0 0.5 0.5 0.0 0.2", "rejected", "size_out_of_range"),
    ("1 0.5 0.5 0.2", "rejected", "field_count"),
    ("2.0 0.5 0.5 0.2 0.2", "rejected", "not_numeric"),
    ("1 0.5 0.5d 0.2 0.2", "rejected", "not_numeric"),
    ("1_0 0.5 0.5 0.2 0.2", "rejected", "unsupported_class"),
    ("+1 .5 5e-1 0.2 0.2", "valid", None),
    ("1 0.5 inf 0.2 0.2", "rejected", "not_finite"),
    ("9 nan 0.5 0.2 0.2", "rejected", "unsupported_class"),
    ("1 1.2 0.5 0.2 0.2", "rejected", "centre_out_of_range"),
]


def test_lines_are_tested_in_order(spark):
    d = spark.createDataFrame([("s", i, raw) for i, (raw, _, _) in enumerate(LINES)], "stem string, line_no int, raw string")
    got = {r["line_no"]: (r["status"], r["reason"]) for r in validated(parsed(d)).collect()}
    assert [got[i] for i in range(len(LINES))] == [(s, r) for _, s, r in LINES]


def test_line_numbers_survive_blank_lines_and_odd_ends(spark):
    d = spark.createDataFrame([("a", "0 1\r\n\n1 2\x1c2 3\n"), ("b", "")], "stem string, text string")
    assert [(r["stem"], r["line_no"], r["raw"]) for r in label_lines(d).orderBy("line_no").collect()] == [("a", 1, "0 1"), ("a", 3, "1 2"), ("a", 4, "2 3")]
    assert signature(label_lines(d)).collect()[0]["signature"] == ["0 1", "1 2", "2 3"]


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("vlcsnap-2025-02-19-14h41m29s105.jpg", "session_2025-02-19"),
        ("vlcsnap-2025-02-19-15h00m00s000.jpg", "session_2025-02-19"),
        ("20250223_143826.jpg", "session_2025-02-23"),
        ("rh_train_1001.jpg", "rh_1001"),
        ("rh_valid_1001_aug_vertical_flip.jpg", "rh_1001"),
        ("rh_train_1001_augmented.jpg", "rh_1001"),
        ("train_0001_f0000.jpg", "file_train_0001_f0000"),
        ("VLCSNAP-00012.jpg", "vlcsnap_unsequenced"),
    ],
)
def test_group_keys(spark, name, key):
    assert spark.range(1).select(group_key(F.lit(name))).first()[0] == key


def test_label_text_rounds_as_binary(spark):
    d = spark.createDataFrame([(1, 0.123456785, 0.5, 0.2, 0.2)], "c int, x double, y double, w double, h double")
    assert d.select(label_text("c", "x", "y", "w", "h")).first()[0] == "1 0.12345678 0.50000000 0.20000000 0.20000000"


def test_canonical_sizes_never_overflow(spark):
    d = spark.createDataFrame([(0.123456789, 0.5, 0.246913579, 0.2)], "x double, y double, w double, h double")
    r = d.select(canonical(*(F.col(c) for c in "xywh")).alias("b")).first()["b"]
    assert r["xc"] - r["w"] / 2 >= 0


def test_pixels_round_half_to_even(spark):
    d = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)], "x double, y double, w double, h double")
    b = d.select(to_pixels(*(F.col(c) for c in "xywh"), 10, 6).alias("b")).first()["b"]
    assert tuple(b) == (2, 2, 8, 4)


def test_letterbox_of_a_wide_image(spark):
    assert letterbox_padding((640, 360), (640, 640)) == (140, 140, 0, 0)
    d = spark.createDataFrame([(0.5, 0.5, 0.25, 0.5)], "x double, y double, w double, h double")
    b = d.select(letterbox(*(F.col(c) for c in "xywh"), (80, 40), (80, 80)).alias("b")).first()["b"]
    assert (b["yc"], b["h"]) == (0.5, 0.25)


def test_augmentation_ranges():
    check_ranges({"gamma": (0.9, 1.1)})
    with pytest.raises(ValueError, match="rotation"):
        check_ranges({"rotation": (0, 11)})
