"""Views that give the engine's operators boxes, labels, images, frames and results over the given tables.

Each has a DataFrame form, and an SQL form of the same integers for the comparison with another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SIDE = 640  # of the square canvas of boxes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gt_boxes(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    x1, y1 = (o * 37) % 560, (o * 53) % 560
    split = F.when(F.col("o_custkey") % 20 < 14, "train").when(F.col("o_custkey") % 20 < 17, "val").otherwise("test")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("frame_id"), o.alias("box_id"), (o % 3).cast("int").alias("class_id"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        (x1 + 10 + (o * 7) % 70).cast("int").alias("x2"), (y1 + 10 + (o * 11) % 70).cast("int").alias("y2"), split.alias("split"),
    )


def pred_boxes(spark: SparkSession, d: str) -> DataFrame:
    g, b = gt_boxes(spark, d), F.col("box_id")
    moved = {"x1": b % 9 - 4, "y1": b % 7 - 3, "x2": b % 9 - 4, "y2": b % 7 - 3}
    box = [(F.col(c) + m).cast("int").alias(c) for c, m in moved.items()]
    flipped = F.when(b % 13 == 0, (F.col("class_id") + 1) % 3).otherwise(F.col("class_id")).cast("int").alias("class_id")
    first = g.where(b % 10 != 3).select("frame_id", (b * 2).alias("pred_id"), flipped, *box, ((1 + b % 100).cast("double") / 101).alias("confidence"))
    again = g.where(b % 17 == 0).select("frame_id", (b * 2 + 1).alias("pred_id"), "class_id", *box, ((1 + b % 50).cast("double") / 101).alias("confidence"))
    return first.unionByName(again)


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """V1 boxes as fractions of the canvas."""
    side = F.lit(float(SIDE))
    return gt_boxes(spark, d).select(
        "frame_id", "box_id", "class_id", "split", ((F.col("x1") + F.col("x2")) / F.lit(2.0) / side).alias("xc"), ((F.col("y1") + F.col("y2")) / F.lit(2.0) / side).alias("yc"),
        ((F.col("x2") - F.col("x1")) / side).alias("w"), ((F.col("y2") - F.col("y1")) / side).alias("h"),
    )


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    digits = lambda x: F.lpad(x.cast("string"), 3, "0")
    whole = F.concat((o % 3).cast("string"), F.lit(" 0."), digits(300 + o % 400), F.lit(" 0."), digits(300 + (o * 7) % 400), F.lit(" 0."), digits(10 + o % 300), F.lit(" 0."), digits(10 + (o * 3) % 300))
    # One planted line for each test of the tolerance policy.
    planted = ("3 0.5 0.5 0.2 0.2", "1 0.5 0.5 0.2", "x 0.5 0.5 0.2 0.2", "0 nan 0.5 0.2 0.2", "1 0.5 0.5 0 0.2", "2 1.2 0.5 0.2 0.2", "1 0.95 0.5 0.2 0.2", "0 0.500005 0.5 1.000005 0.2", "   ")
    raw = whole
    for k, line in reversed(list(enumerate(planted))):
        raw = F.when(o % 12 == k, line).otherwise(raw)
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int")
    return table(spark, d, "orders").select(F.concat(F.lit("img_"), F.col("o_custkey").cast("string")).alias("stem"), number.alias("line_no"), raw.alias("raw"))


def images(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    split = F.when(i % 20 < 14, "train").when(i % 20 < 17, "val").otherwise("test")
    return table(spark, d, "documents").select(
        i, F.concat(F.lit("doc_"), F.lpad(i.cast("string"), 6, "0"), F.lit(".jpg")).alias("name"), F.md5(F.col("text").cast("binary")).alias("content_md5"),
        F.col("source").alias("group_key"), split.alias("split"), F.concat("lang", F.lit(":"), (i % 2).cast("string")).alias("signature"),
    )


def phashes(spark: SparkSession, d: str) -> DataFrame:
    from skeinwork.functions.hashing import threshold_bits

    high, low = threshold_bits(F.col("embedding"), 9, 64)
    return table(spark, d, "embeddings").select("vec_id", "label", high.alias("sig_hi"), low.alias("sig_lo"))


def planted_signatures(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    digest = F.md5(F.floor(o / 4).cast("long").cast("string").cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    bits = F.when(o % 4 == 0, 0).when(o % 4 == 1, 1).when(o % 4 == 2, 6).otherwise(1023).cast("long")
    return table(spark, d, "orders").select(o.alias("sig_id"), part(1).bitwiseXOR(bits).alias("sig_hi"), part(9).alias("sig_lo"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    class_id = F.when(kind.isin("click", "view"), 0).when(kind.isin("purchase", "signup"), 1).otherwise(2).cast("int")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("stream_id"), frame.alias("frame"), F.col("event_id").alias("det_id"), (F.col("event_id") % 7).cast("int").alias("track_id"),
        class_id.alias("class_id"), (1 + F.col("event_id") % 100).cast("int").alias("conf_pct"),
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("experiment")).agg(
        F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("score"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("latency_units")
    )
    first = p.agg(F.min("experiment").alias("first"))
    kind = F.when(F.col("experiment") == F.col("first"), "raw").otherwise("filter")
    return p.join(F.broadcast(first), F.lit(True)).select("experiment", kind.alias("preprocessing"), "n", "score", "latency_units")


def filenames(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    name = (
        F.when(i % 7 == 0, F.concat(F.lit("rh_train_"), s(i % 50), F.lit(".jpg"))).when(i % 7 == 1, F.concat(F.lit("rh_valid_"), s(i % 50), F.lit("_aug_flip.jpg")))
        .when(i % 7 == 2, F.concat(F.lit("rh_train_"), s(i % 50), F.lit("_augmented.jpg"))).when(i % 7 == 3, F.concat(F.lit("vlcsnap-2025-02-"), s(10 + i % 15), F.lit("-14h41m29s105.jpg")))
        .when(i % 7 == 4, F.concat(F.lit("202502"), s(10 + i % 15), F.lit("_143826.jpg"))).when(i % 7 == 5, F.concat(F.lit("vlcsnap-"), F.lpad(s(i), 5, "0"), F.lit(".jpg")))
        .otherwise(F.concat(F.lit("clip_"), s(i), F.lit(".jpg")))
    )
    return table(spark, d, "documents").select("doc_id", name.alias("filename"))


def frame_detections(spark: SparkSession, d: str) -> DataFrame:
    """V1 predictions as streams of a hundred frames: stream_id, frame, det_id and the box. From every 20th frame on a stream is
    dark for 4 to 9 frames, by its number: fewer than a track may miss, as many, and more."""
    lit = F.col("frame") % 20 >= 4 + F.col("stream_id") % 6
    return pred_boxes(spark, d).select(
        F.floor(F.col("frame_id") / 100).cast("long").alias("stream_id"), (F.col("frame_id") % 100).cast("int").alias("frame"), F.col("pred_id").alias("det_id"), "class_id", "confidence", "x1", "y1", "x2", "y2"
    ).where(lit)


def processed_frames(spark: SparkSession, d: str) -> DataFrame:
    """All frames of those streams: every customer is one."""
    return table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 100).cast("long").alias("stream_id"), (F.col("c_custkey") % 100).cast("int").alias("frame"))


# SQL forms ------------------------------------------------------------------------------------------------------------
SQL = {
    "gt": """SELECT o_custkey AS frame_id, o_orderkey AS box_id, CAST(o_orderkey % 3 AS INT) AS class_id,
  CAST((o_orderkey*37) % 560 AS INT) AS x1, CAST((o_orderkey*53) % 560 AS INT) AS y1,
  CAST((o_orderkey*37) % 560 + 10 + (o_orderkey*7) % 70 AS INT) AS x2, CAST((o_orderkey*53) % 560 + 10 + (o_orderkey*11) % 70 AS INT) AS y2,
  CASE WHEN o_custkey % 20 < 14 THEN 'train' WHEN o_custkey % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM orders""",
    "pred": """SELECT frame_id, box_id*2 AS pred_id, CAST(CASE WHEN box_id % 13 = 0 THEN (class_id+1) % 3 ELSE class_id END AS INT) AS class_id,
  CAST(x1 + box_id % 9 - 4 AS INT) AS x1, CAST(y1 + box_id % 7 - 3 AS INT) AS y1, CAST(x2 + box_id % 9 - 4 AS INT) AS x2, CAST(y2 + box_id % 7 - 3 AS INT) AS y2,
  CAST(1 + box_id % 100 AS DOUBLE) / 101 AS confidence FROM gt WHERE box_id % 10 <> 3
  UNION ALL SELECT frame_id, box_id*2+1, class_id, CAST(x1 + box_id % 9 - 4 AS INT), CAST(y1 + box_id % 7 - 3 AS INT),
  CAST(x2 + box_id % 9 - 4 AS INT), CAST(y2 + box_id % 7 - 3 AS INT), CAST(1 + box_id % 50 AS DOUBLE) / 101 FROM gt WHERE box_id % 17 = 0""",
    "norm": """SELECT frame_id, box_id, class_id, split, (x1 + x2) / 2.0::DOUBLE / 640.0::DOUBLE AS xc, (y1 + y2) / 2.0::DOUBLE / 640.0::DOUBLE AS yc,
  (x2 - x1) / 640.0::DOUBLE AS w, (y2 - y1) / 640.0::DOUBLE AS h FROM gt""",
    "lines": """SELECT concat('img_', CAST(o_custkey AS STRING)) AS stem, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line_no,
  CASE o_orderkey % 12 WHEN 0 THEN '3 0.5 0.5 0.2 0.2' WHEN 1 THEN '1 0.5 0.5 0.2' WHEN 2 THEN 'x 0.5 0.5 0.2 0.2' WHEN 3 THEN '0 nan 0.5 0.2 0.2'
  WHEN 4 THEN '1 0.5 0.5 0 0.2' WHEN 5 THEN '2 1.2 0.5 0.2 0.2' WHEN 6 THEN '1 0.95 0.5 0.2 0.2' WHEN 7 THEN '0 0.500005 0.5 1.000005 0.2' WHEN 8 THEN '   '
  ELSE concat(CAST(o_orderkey % 3 AS STRING), ' 0.', lpad(CAST(300 + o_orderkey % 400 AS STRING),3,'0'), ' 0.', lpad(CAST(300 + (o_orderkey*7) % 400 AS STRING),3,'0'), ' 0.',
  lpad(CAST(10 + o_orderkey % 300 AS STRING),3,'0'), ' 0.', lpad(CAST(10 + (o_orderkey*3) % 300 AS STRING),3,'0')) END AS raw FROM orders""",
    "images": """SELECT doc_id, concat('doc_', lpad(CAST(doc_id AS STRING),6,'0'), '.jpg') AS name, md5(text) AS content_md5, source AS group_key,
  CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, concat(lang, ':', CAST(doc_id % 2 AS STRING)) AS signature FROM documents""",
    "phash": """SELECT vec_id, label, list_sum(list_transform(generate_series(1, 32), lambda i: CASE WHEN CAST(e[i] AS DOUBLE) > m THEN 1::BIGINT << (32 - i)::INT ELSE 0 END))::BIGINT AS sig_hi,
  list_sum(list_transform(generate_series(1, 32), lambda i: CASE WHEN CAST(e[i + 32] AS DOUBLE) > m THEN 1::BIGINT << (32 - i)::INT ELSE 0 END))::BIGINT AS sig_lo
  FROM (SELECT vec_id, label, embedding AS e, (CAST(list_sort(embedding[9:64])[28] AS DOUBLE) + CAST(list_sort(embedding[9:64])[29] AS DOUBLE)) / 2 AS m FROM embeddings)""",
    "sigs": """SELECT o_orderkey AS sig_id, xor(CAST(concat('0x', substr(md5(CAST(o_orderkey // 4 AS STRING)),1,8)) AS BIGINT),
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 1023 END AS BIGINT)) AS sig_hi,
  CAST(concat('0x', substr(md5(CAST(o_orderkey // 4 AS STRING)),9,8)) AS BIGINT) AS sig_lo FROM orders""",
    "frames": """SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, event_id AS det_id, CAST(event_id % 7 AS INT) AS track_id,
  CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 2 END AS INT) AS class_id, CAST(1 + event_id % 100 AS INT) AS conf_pct FROM events""",
    "results": """SELECT p_brand AS experiment, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 'raw' ELSE 'filter' END AS preprocessing, count(*) AS n,
  CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS score, CAST(sum(CAST(round(p_retailprice*100) AS BIGINT)) AS BIGINT) AS latency_units FROM part GROUP BY p_brand""",
    "files": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('rh_train_', CAST(doc_id % 50 AS STRING), '.jpg') WHEN 1 THEN concat('rh_valid_', CAST(doc_id % 50 AS STRING), '_aug_flip.jpg')
  WHEN 2 THEN concat('rh_train_', CAST(doc_id % 50 AS STRING), '_augmented.jpg') WHEN 3 THEN concat('vlcsnap-2025-02-', CAST(10 + doc_id % 15 AS STRING), '-14h41m29s105.jpg')
  WHEN 4 THEN concat('202502', CAST(10 + doc_id % 15 AS STRING), '_143826.jpg') WHEN 5 THEN concat('vlcsnap-', lpad(CAST(doc_id AS STRING),5,'0'), '.jpg')
  ELSE concat('clip_', CAST(doc_id AS STRING), '.jpg') END AS filename FROM documents""",
    "classes": "SELECT * FROM (VALUES (0, 'pothole'), (1, 'crack'), (2, 'manhole')) t(class_id, class_name)",
    "splits": "SELECT * FROM (VALUES ('train', 0), ('val', 1), ('test', 2)) t(split, ord)",
}
_NEEDS = {"pred": ["gt"], "norm": ["gt"]}


def sql(query: str, *views: str, recursive: bool = False, extra: str = "") -> str:
    """The query over the named views."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    parts = [f"{n} AS ({SQL[n]})" for n in names] + ([extra] if extra else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " if parts else "") + query
