"""Label lines and capture names as columns: parsing, the tolerance policy, canonical text, group keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.schema import DATED_NAME, EPSILON, IMPORTED_NAME, PLAIN_NAME, UNSEQUENCED_NAME

#: What int() and float() of the label format accept: a sign, digits with single underscores, exponents, nan and inf.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
NUMBER = r"(?i)^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
LINE_ENDS = r"(\R)|[\x1c-\x1e]"


def label_lines(files: DataFrame) -> DataFrame:
    """stem, line_no (from 1, blank lines counted), raw of non-blank lines. files: stem, text (whole)."""
    lines = F.posexplode(F.split("text", LINE_ENDS)).alias("pos", "raw")
    return files.select("stem", lines).select("stem", (F.col("pos") + 1).alias("line_no"), "raw").where(F.trim("raw") != "")


def _number(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), F.replace(x, F.lit("_"), F.lit("")).try_cast("double")).when(x.rlike(NOT_FINITE), F.lit(float("nan")))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds class_id, xc, yc, w, h and reason (the first test that fails, null if none)."""
    p = F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), r"\s+")
    d = lines.withColumn("parts", p)
    numeric = F.get("parts", F.lit(0)).rlike(INTEGER)
    for k in range(1, 5):
        numeric = numeric & (F.get("parts", F.lit(k)).rlike(NUMBER) | F.get("parts", F.lit(k)).rlike(NOT_FINITE))
    d = d.withColumn("class_id", F.replace(F.get("parts", F.lit(0)), F.lit("_"), F.lit("")).try_cast("int"))
    for k, name in enumerate(("xc", "yc", "w", "h"), 1):
        d = d.withColumn(name, _number(F.get("parts", F.lit(k))))
    finite = ~(F.isnan("xc") | F.isnan("yc") | F.isnan("w") | F.isnan("h"))
    reason = (
        F.when(F.size("parts") != 5, "field_count")
        .when(~numeric, "not_numeric")
        .when(F.col("class_id").isNull() | ~F.col("class_id").isin(0, 1, 2), "unsupported_class")
        .when(~finite, "not_finite")
    )
    return d.withColumn("reason", reason).drop("parts")


def validated(boxes: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Adds status (valid, clipped, rejected), reason, and the corrected box in xc, yc, w, h.

    Overflow of at most epsilon is clipped, more is rejected; never clipped silently."""
    e, one, zero = F.lit(epsilon), F.lit(1.0), F.lit(0.0)

    def tested(b: Column) -> Column:
        xc, yc, w, h = b["xc"], b["yc"], b["w"], b["h"]
        left, top, right, bottom = xc - w / 2, yc - h / 2, xc + w / 2, yc + h / 2
        why = (
            F.when(~((w > 0) & (w <= one + e) & (h > 0) & (h <= one + e)), "size_out_of_range")
            .when(~((xc >= -e) & (xc <= one + e) & (yc >= -e) & (yc <= one + e)), "centre_out_of_range")
            .when((left < -e) | (top < -e) | (right > one + e) | (bottom > one + e), "corners_out_of_bounds")
        )
        over = (left < 0) | (top < 0) | (right > 1) | (bottom > 1)
        l2, t2, r2, b2 = F.greatest(zero, left), F.greatest(zero, top), F.least(one, right), F.least(one, bottom)
        fixed = F.when(over, F.struct(((l2 + r2) / 2).alias("xc"), ((t2 + b2) / 2).alias("yc"), (r2 - l2).alias("w"), (b2 - t2).alias("h"))).otherwise(
            F.struct(F.greatest(zero, F.least(one, xc)).alias("xc"), F.greatest(zero, F.least(one, yc)).alias("yc"), F.least(one, w).alias("w"), F.least(one, h).alias("h"))
        )
        return F.struct(why.alias("why"), over.alias("over"), fixed.alias("box"))

    # a lambda over one box: its parts are computed once, however often the tests use them
    d = boxes.withColumn("v", F.get(F.transform(F.array(F.struct("xc", "yc", "w", "h")), tested), F.lit(0)))
    d = d.withColumn("reason", F.coalesce("reason", "v.why") if "reason" in boxes.columns else F.col("v.why"))
    d = d.withColumn("status", F.when(F.col("reason").isNotNull(), "rejected").when(F.col("v.over"), "clipped").otherwise("valid"))
    return d.withColumns({c: F.when(F.col("reason").isNull(), F.col(f"v.box.{c}")) for c in ("xc", "yc", "w", "h")}).drop("v")


def clipped_or_null(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    """The box cut to the image without any test; null if nothing is left."""
    left, right = F.greatest(F.lit(0.0), xc - w / 2), F.least(F.lit(1.0), xc + w / 2)
    top, bottom = F.greatest(F.lit(0.0), yc - h / 2), F.least(F.lit(1.0), yc + h / 2)
    box = F.struct(((left + right) / 2).alias("xc"), ((top + bottom) / 2).alias("yc"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when((right > left) & (bottom > top), box)


def eight(x: Column) -> Column:
    """Eight decimals, ties to even."""
    return F.rint(x * F.lit(1e8)) / F.lit(1e8)


def floored(x: Column) -> Column:
    return F.floor(x * F.lit(1e8)) / F.lit(1e8)


def canonical(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    """Numbers of a canonical label: eight decimals, sizes floored against the centre only where they would overflow."""
    x, y, a, b = eight(xc), eight(yc), eight(w), eight(h)
    a2 = F.when((x - a / 2 < 0) | (x + a / 2 > 1), floored(F.least(a, F.lit(2.0) * F.least(x, F.lit(1.0) - x)))).otherwise(a)
    b2 = F.when((y - b / 2 < 0) | (y + b / 2 > 1), floored(F.least(b, F.lit(2.0) * F.least(y, F.lit(1.0) - y)))).otherwise(b)
    return F.struct(x.alias("xc"), y.alias("yc"), a2.alias("w"), b2.alias("h"))


def label_text(class_id: Column, xc: Column, yc: Column, w: Column, h: Column) -> Column:
    """The canonical line. A pandas UDF: Spark's own printf rounds ties differently."""
    @F.pandas_udf(T.StringType())
    def text(c: pd.Series, x: pd.Series, y: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f"{k} {p:.8f} {q:.8f} {r:.8f} {t:.8f}" for k, p, q, r, t in zip(c, x, y, a, b, strict=True)])

    return text(class_id, xc, yc, w, h)


def group_key(filename: Column) -> Column:
    """The capture group of a file name: all that must stay in one split."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    imported = F.regexp_extract(stem, IMPORTED_NAME, 1)
    dated = F.regexp_extract(stem, DATED_NAME, 1)
    plain = F.regexp_extract(stem, PLAIN_NAME, 1)
    day = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
    return (
        F.when(imported != "", F.concat(F.lit("rh_"), imported))
        .when(dated != "", F.concat(F.lit("session_"), dated))
        .when(plain != "", F.concat(F.lit("session_"), day))
        .when(stem.rlike(UNSEQUENCED_NAME), "vlcsnap_unsequenced")
        .otherwise(F.concat(F.lit("file_"), stem))
    )


def signature(lines: DataFrame) -> DataFrame:
    """stem, signature: the sorted multiset of trimmed non-blank lines."""
    return lines.where(F.trim("raw") != "").groupBy("stem").agg(F.sort_array(F.collect_list(F.trim("raw"))).alias("signature"))
