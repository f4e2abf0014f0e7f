"""Queries of dataset quality: duplicates, labels, parsing, leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from skeinwork.functions.annotations import clipped_or_null, group_key, parsed, signature, validated
from skeinwork.operators import audit, neardup, stats
from skeinwork.operators import quality as q
from skeinwork.plans import views as v
from skeinwork.plans.groups import _KEY, _PAIRS
from skeinwork.plans.views import sql, table
from skeinwork.sources.files import imported

def clean_dedup_outcomes(s, d):
    labels = table(s, d, "labels").select("doc_id").distinct()
    marked = q.with_outcome(v.images(s, d)).join(labels.withColumn("l", F.lit(True)), "doc_id", "left")
    return marked.groupBy("outcome").agg(F.count("*").alias("n_images"), F.count("l").alias("n_labelled"))


_OUTCOME = """outcomes AS (SELECT i.*, CASE WHEN g.s > 1 THEN 'conflict' WHEN g.first_name <> i.name THEN 'duplicate' ELSE 'kept' END AS outcome
 FROM images i JOIN (SELECT content_md5, count(DISTINCT signature) AS s, min(name) AS first_name FROM images GROUP BY 1) g USING (content_md5))"""


def dedup_conflict_groups(s, d):
    return q.duplicate_groups(v.images(s, d)).where("n_signatures > 1")


def dedup_survivors(s, d):
    return q.with_outcome(v.images(s, d)).where("outcome = 'kept'").select("doc_id", "name", "split")


def labelled_images_semi(s, d):
    return q.labelled(v.images(s, d), table(s, d, "labels"), "doc_id").select("doc_id", "name")


def missing_labels_anti(s, d):
    return q.missing(v.images(s, d), table(s, d, "labels"), "doc_id").select("split", "doc_id", "name")


def orphan_labels_anti(s, d):
    """Labels without an image, were only images of one language there."""
    return q.orphans(v.images(s, d).where("signature LIKE 'en:%'"), table(s, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


def _lines(s, d):
    return validated(parsed(v.label_rows(s, d).where("trim(raw) <> ''")))


_INT, _NUM = r"^[+-]?[0-9]+(_[0-9]+)*$", r"^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
_PARSED = rf"""p AS (SELECT stem, line_no, regexp_split_to_array(trim(raw), '\s+') AS f FROM lines WHERE trim(raw) <> ''),
n AS (SELECT *, len(f) = 5 AS five, regexp_matches(f[1], '{_INT}') AND len(list_filter(f[2:5], lambda x: NOT (regexp_matches(x, '{_NUM}') OR lower(x) IN ('nan', 'inf', '-inf')))) = 0 AS num FROM p),
c AS (SELECT *, CASE WHEN five AND num THEN TRY_CAST(f[1] AS INT) END AS k, CASE WHEN five AND num THEN list_transform(f[2:5], lambda x: CAST(x AS DOUBLE)) END AS z FROM n),
r AS (SELECT stem, line_no, k, z[1] AS x, z[2] AS y, z[3] AS a, z[4] AS b,
 CASE WHEN NOT five THEN 'field_count' WHEN NOT num THEN 'not_numeric' WHEN k NOT IN (0, 1, 2) THEN 'unsupported_class'
 WHEN len(list_filter(z, lambda u: NOT isfinite(u))) > 0 THEN 'not_finite' END AS bad FROM c),
t AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN NOT (a > 0 AND a <= 1 + 1e-5::DOUBLE AND b > 0 AND b <= 1 + 1e-5::DOUBLE) THEN 'size_out_of_range'
 WHEN NOT (x >= -1e-5::DOUBLE AND x <= 1 + 1e-5::DOUBLE AND y >= -1e-5::DOUBLE AND y <= 1 + 1e-5::DOUBLE) THEN 'centre_out_of_range'
 WHEN x - a / 2 < -1e-5::DOUBLE OR y - b / 2 < -1e-5::DOUBLE OR x + a / 2 > 1 + 1e-5::DOUBLE OR y + b / 2 > 1 + 1e-5::DOUBLE THEN 'corners_out_of_bounds' END AS reason,
 x - a / 2 < 0 OR y - b / 2 < 0 OR x + a / 2 > 1 OR y + b / 2 > 1 AS over FROM r),
u AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN over THEN 'clipped' ELSE 'valid' END AS status,
 greatest(0, x - a / 2) AS l, greatest(0, y - b / 2) AS o, least(1, x + a / 2) AS rr, least(1, y + b / 2) AS bb FROM t)"""


def label_parse_status(s, d):
    return _lines(s, d).select("stem", "line_no", "status", "reason")


def label_reason_counts(s, d):
    return _lines(s, d).groupBy("status", "reason").agg(F.count("*").alias("n_lines"))


def label_corrected_boxes(s, d):
    return _lines(s, d).where("status <> 'rejected'").select("stem", "line_no", "class_id", "xc", "yc", "w", "h", "status")


def label_signatures(s, d):
    return signature(v.label_rows(s, d)).select("stem", F.md5(F.concat_ws("|", "signature").cast("binary")).alias("signature_md5"), F.size("signature").cast("long").alias("n_lines"))


def label_clipped_unconditionally(s, d):
    p = parsed(v.label_rows(s, d).where("trim(raw) <> ''")).where("reason is null")
    return p.select("stem", "line_no", clipped_or_null(*(F.col(c) for c in ("xc", "yc", "w", "h"))).alias("b")).where("b is not null").select("stem", "line_no", "b.*")


def leakage_by_hash(s, d):
    return q.leaking(v.images(s, d), "content_md5")


def split_overlap_counts(s, d):
    return q.split_overlaps(v.images(s, d), "content_md5")


def leakage_by_group(s, d):
    keyed = v.filenames(s, d).select("doc_id", group_key(F.col("filename")).alias("capture_group"))
    return q.leaking(v.images(s, d).select("doc_id", "split").join(keyed, "doc_id"), "capture_group")


def processed_dataset_errors(s, d):
    """The gate of processed data over label lines as boxes: images are those of customers, labels their files."""
    written = parsed(v.label_rows(s, d).where("trim(raw) <> ''"))
    before = written.select("stem", "line_no", *(F.col(c).alias(f"__{c}") for c in ("xc", "yc", "w", "h")))
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("xc", "yc", "w", "h")))
    lines = validated(written).join(before, ["stem", "line_no"]).withColumn("changed", changed).withColumn("split", F.lit("train"))
    images = table(s, d, "customer").select(F.lit("train").alias("split"), F.concat(F.lit("img_"), F.col("c_custkey").cast("string")).alias("stem"), (F.col("c_acctbal") >= 0).alias("ok"))
    labels = lines.select("split", "stem").distinct()
    e = q.structural_errors(images, labels, lines.select("split", "stem", "line_no", "status", "changed"))
    return e.groupBy("error").agg(F.count("*").alias("n_errors"))


def _split_lines(s, d):
    """Label lines with the split of their image."""
    k = F.regexp_extract("stem", "[0-9]+", 0).cast("long") % 20
    return v.label_rows(s, d).where("trim(raw) <> ''").withColumn("split", F.when(k < 14, "train").when(k < 17, "val").otherwise("test"))


def dataset_audit(s, d):
    """Customers as images and label files of orders; three in a row have one digest, groups are a nation's segments."""
    k = F.col("c_custkey") % 20
    split = F.when(k < 14, "train").when(k < 17, "val").otherwise("test")
    images = table(s, d, "customer").select(split.alias("split"), F.concat(F.lit("img_"), F.col("c_custkey").cast("string")).alias("stem"), F.floor(F.col("c_custkey") / 3).cast("string").alias("digest"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("group_key"))
    lines = _split_lines(s, d)
    return audit.audit(lines, images, lines.select("split", "stem").distinct())


def audited_classes(s, d):
    return audit.class_distribution(_split_lines(s, d))


def label_line_faults(s, d):
    return audit.line_faults(_split_lines(s, d)).select("stem", "line_no", *audit.COUNTERS, "class_id")


#: Letters of a short item's words that anchor it.
EDGE = 4


def passages(documents, benchmark):
    """doc_id, item_id where the whole item stands in the document, whatever stands around it. Candidates come from an equality
    join of anchors; the text decides. The anchor of an item of three words and more is up to three of its inner words, which
    the document must hold as words; of two words the letters on both sides of their space; of one word its first letters."""
    words = lambda c: F.split(c, " ")
    item = benchmark.where("text is not null").select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    length = lambda i: F.least(F.length(F.get("w", F.lit(i))), F.lit(EDGE))
    shape = F.when(F.size("w") > 2, F.struct(F.lit(3).alias("n"), F.least(F.size("w") - 2, F.lit(3)).alias("a"), F.lit(0).alias("b")))
    shape = shape.when(F.size("w") == 2, F.struct(F.lit(2).alias("n"), length(0).alias("a"), length(1).alias("b"))).otherwise(F.struct(F.lit(1).alias("n"), length(0).alias("a"), F.lit(0).alias("b")))
    item = item.withColumn("shape", shape)
    shapes = [r[0] for r in item.select("shape").distinct().collect()]  # some 30 at most
    left, right = (lambda x, n: F.substring(x, 1, n)), (lambda x, n: F.substring(x, -n, n) if n else F.lit(""))

    def own(n, a, b):
        """The anchor of an item of this shape."""
        if n == 3:
            return F.xxhash64(*(F.get("w", F.lit(1 + j)) for j in range(a)))
        if n == 2:
            return F.xxhash64(F.lit(100 * a + b), right(F.get("w", F.lit(0)), a), left(F.get("w", F.lit(1)), b))
        return F.xxhash64(F.lit(-1 - a), left(F.get("w", F.lit(0)), a))

    def held(n, a, b):
        """All anchors of this shape that a document of the words w holds."""
        none = F.array().cast("array<bigint>")
        if n == 3:
            at = lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(a)))
            return F.when(F.size("w") >= a + 2, F.transform(F.sequence(F.lit(1), F.size("w") - 1 - a), at)).otherwise(none)
        if n == 2:
            fits = lambda i: (F.length(F.get("w", i)) >= a) & (F.length(F.get("w", i + 1)) >= b)
            at = lambda i: F.xxhash64(F.lit(100 * a + b), right(F.get("w", i), a), left(F.get("w", i + 1), b))
            return F.when(F.size("w") > 1, F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 2), fits), at)).otherwise(none)
        long_enough = F.filter(F.array_distinct("w"), lambda x: F.length(x) >= a)
        grams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - a + 1), lambda j: F.xxhash64(F.lit(-1 - a), F.substr(x, j, F.lit(a))))
        return F.flatten(F.transform(long_enough, grams)) if a else F.array(F.xxhash64(F.lit(-1), F.lit("")))

    of_shape = lambda k: (F.col("shape.n") == k[0]) & (F.col("shape.a") == k[1]) & (F.col("shape.b") == k[2])
    if not shapes:
        return documents.select("doc_id").join(item.select("item_id"), F.lit(False))
    anchored = item.select("item_id", "passage", F.coalesce(*(F.when(of_shape(k), own(*k)) for k in shapes)).alias("anchor"))
    d = documents.withColumn("w", words(F.col("text"))).where("text is not null")
    # anchors alone go through the join; then the candidates' texts are looked at
    d = d.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.array_distinct(F.concat(*(held(*k) for k in shapes)))).alias("anchor"))
    pairs = d.join(anchored, "anchor").select(F.col("doc_id").alias("d"), "key", "item_id", "passage").distinct()
    texts = documents.select("doc_id", F.xxhash64("text").alias("k"), "text")
    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    return texts.join(pairs, same).where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id").distinct()


def splits_without_images(s, d):
    """Splits without an image, were there only those of the first 17 of every 20."""
    return q.empty_splits(v.images(s, d).where("split <> 'test'"))


def near_duplicates_across_splits(s, d):
    """Near labels whose groups went to different splits, were groups not merged: a label is its own group."""
    near = neardup.hamming_pairs(v.phashes(s, d), "vec_id", 18, "label").withColumnsRenamed({"label_a": "group_a", "label_b": "group_b"})
    groups = v.phashes(s, d).select("label").distinct()
    k = F.col("label") % 3
    placed = groups.select(F.col("label").alias("group_root"), F.when(k == 0, "train").when(k == 1, "val").otherwise("test").alias("split"))
    return q.near_duplicate_report(near, groups.select(F.col("label").alias("group_key"), F.col("label").alias("group_root")), placed).select("vec_id_a", "vec_id_b", "distance", "group_a", "group_b", "split_a", "split_b")


def image_import(s, d):
    """Documents as images of two source splits without repeated content: how many were found, kept and repeats."""
    i = v.images(s, d).select(F.concat(F.col("name")).alias("name"), F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.lit("jpg").alias("ext"), "content_md5", "doc_id")
    return imported({"train": i.where("doc_id % 3 <> 0").drop("doc_id"), "valid": i.where("doc_id % 3 = 0").drop("doc_id")})[1]


def pixel_statistics(s, d):
    """Orders as images' pixel statistics."""
    o = F.col("o_orderkey")
    return stats.pixel_statistics(v.table(s, d, "orders").select((o % 256).alias("mean"), (o % 64).alias("std"), (o % 100).alias("low"), (100 + o % 155).alias("high")))


def dataset_integrity(s, d):
    """Errors of the gate with leakage by digest, stem and group, by kind."""
    k = F.col("c_custkey") % 20
    split = F.when(k < 14, "train").when(k < 17, "val").otherwise("test")
    images = table(s, d, "customer").select(split.alias("split"), F.concat(F.lit("img_"), F.col("c_custkey").cast("string")).alias("stem"), (F.col("c_acctbal") >= 0).alias("ok"), F.floor(F.col("c_custkey") / 3).cast("string").alias("digest"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("group_key"))
    lines = validated(parsed(_split_lines(s, d)))
    e = q.integrity_errors(images, lines.select("split", "stem").distinct(), lines.select("split", "stem", "line_no", "status", F.lit(False).alias("changed")))
    return e.groupBy("error").agg(F.count("*").alias("n_errors"))


def last_errors(s, d):
    """The last label lines that don't parse, in the order of their files, as the tail of a log shows them."""
    bad = _lines(s, d).where("status = 'rejected'").select("stem", "line_no", "reason")
    return q.tail(bad, ["stem", "line_no"], 20)


def eval_leakage_passages(s, d):
    return passages(table(s, d, "documents"), table(s, d, "benchmark"))


_FAULTS = r"""sp AS (SELECT *, regexp_split_to_array(trim(raw), '\s+') AS f, CAST(substr(stem, 5) AS BIGINT) % 20 AS k20 FROM lines WHERE trim(raw) <> ''),
nu AS (SELECT stem, line_no, CASE WHEN k20 < 14 THEN 'train' WHEN k20 < 17 THEN 'val' ELSE 'test' END AS split, len(f) = 5 AS five, TRY_CAST(f[1] AS INT) AS c, list_transform(f[2:5], lambda x: TRY_CAST(x AS DOUBLE)) AS z FROM sp),
rd AS (SELECT *, five AND c IS NOT NULL AND len(list_filter(z, lambda x: x IS NULL)) = 0 AS ok FROM nu),
fl AS (SELECT stem, line_no, split, ok AND c NOT IN (0, 1, 2) AS invalid_class_ids, ok AND len(list_filter(z, lambda x: isnan(x) OR x < 0 OR x > 1)) > 0 AS out_of_bounds_coords,
 ok AND len(list_filter(z[3:4], lambda x: NOT isnan(x) AND x <= 0)) > 0 AS non_positive_wh, five AND (NOT ok OR len(list_filter(z, lambda x: NOT isfinite(x))) > 0) AS nan_inf_values, NOT five AS malformed_lines,
 CASE WHEN ok AND c IN (0, 1, 2) THEN c END AS class_id FROM rd),
im AS (SELECT concat('img_', CAST(c_custkey AS STRING)) AS stem, CASE WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 17 THEN 'val' ELSE 'test' END AS split, c_custkey // 3 AS dg, concat(c_nationkey, '-', c_mktsegment) AS gk FROM customer)"""

QUERIES = {
    "clean_dedup_outcomes": (clean_dedup_outcomes, sql("SELECT outcome, count(*) AS n_images, count(l.doc_id) AS n_labelled FROM outcomes LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY outcome", "images", extra=_OUTCOME)),
    "dedup_conflict_groups": (dedup_conflict_groups, sql("SELECT content_md5, count(*) AS n_images, count(DISTINCT signature) AS n_signatures, min(name) AS first_name FROM images GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT signature) > 1", "images")),
    "dedup_survivors": (dedup_survivors, sql("SELECT doc_id, name, split FROM outcomes WHERE outcome = 'kept'", "images", extra=_OUTCOME)),
    "labelled_images_semi": (labelled_images_semi, sql("SELECT doc_id, name FROM images WHERE doc_id IN (SELECT doc_id FROM labels)", "images")),
    "missing_labels_anti": (missing_labels_anti, sql("SELECT split, doc_id, name FROM images WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = images.doc_id)", "images")),
    "orphan_labels_anti": (orphan_labels_anti, sql("SELECT doc_id, quality, toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM images i WHERE l.doc_id = i.doc_id AND signature LIKE 'en:%')", "images")),
    "label_parse_status": (label_parse_status, sql("SELECT stem, line_no, status, reason FROM u", "lines", extra=_PARSED)),
    "label_reason_counts": (label_reason_counts, sql("SELECT status, reason, count(*) AS n_lines FROM u GROUP BY ALL", "lines", extra=_PARSED)),
    "label_corrected_boxes": (label_corrected_boxes, sql("""SELECT stem, line_no, k AS class_id, CASE WHEN over THEN (l + rr) / 2 ELSE greatest(0, least(1, x)) END AS xc,
 CASE WHEN over THEN (o + bb) / 2 ELSE greatest(0, least(1, y)) END AS yc, CASE WHEN over THEN rr - l ELSE least(1, a) END AS w, CASE WHEN over THEN bb - o ELSE least(1, b) END AS h, status
 FROM u WHERE status <> 'rejected'""", "lines", extra=_PARSED)),
    "label_signatures": (label_signatures, sql("SELECT stem, md5(string_agg(trim(raw), '|' ORDER BY trim(raw))) AS signature_md5, count(*) AS n_lines FROM lines WHERE trim(raw) <> '' GROUP BY stem", "lines")),
    "label_clipped_unconditionally": (label_clipped_unconditionally, sql("SELECT stem, line_no, (l + rr) / 2 AS xc, (o + bb) / 2 AS yc, rr - l AS w, bb - o AS h FROM u WHERE bad IS NULL AND rr > l AND bb > o", "lines", extra=_PARSED)),
    "leakage_by_hash": (leakage_by_hash, sql("SELECT content_md5, count(*) AS n_rows, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM images GROUP BY 1 HAVING count(DISTINCT split) > 1", "images")),
    "split_overlap_counts": (split_overlap_counts, sql("""SELECT a.split AS split_a, b.split AS split_b, (SELECT count(*) FROM (SELECT content_md5 FROM images WHERE split = a.split INTERSECT SELECT content_md5 FROM images WHERE split = b.split)) AS n_keys
 FROM splits a JOIN splits b ON a.ord < b.ord""", "images", "splits")),
    "leakage_by_group": (leakage_by_group, sql("SELECT capture_group, count(*) AS n_rows, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM keys JOIN images USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1", "images", "files", extra=_KEY)),
    "processed_dataset_errors": (processed_dataset_errors, sql("""SELECT error, count(*) AS n_errors FROM (
 SELECT 'invalid_box' AS error FROM u WHERE status <> 'valid'
 UNION ALL SELECT 'unreadable_image' FROM customer WHERE c_acctbal < 0
 UNION ALL SELECT 'missing_label' FROM customer WHERE concat('img_', CAST(c_custkey AS STRING)) NOT IN (SELECT stem FROM u)
 UNION ALL SELECT 'orphan_label' FROM (SELECT DISTINCT stem FROM u) WHERE stem NOT IN (SELECT concat('img_', CAST(c_custkey AS STRING)) FROM customer)) GROUP BY error""", "lines", extra=_PARSED)),
    "dataset_audit": (dataset_audit, sql("""SELECT *, invalid_class_ids + out_of_bounds_coords + non_positive_wh + nan_inf_values + malformed_lines + stem_overlaps + digest_overlaps + group_key_overlaps = 0 AS is_valid FROM (
 SELECT (SELECT count(*) FROM fl WHERE invalid_class_ids) AS invalid_class_ids, (SELECT count(*) FROM fl WHERE out_of_bounds_coords) AS out_of_bounds_coords, (SELECT count(*) FROM fl WHERE non_positive_wh) AS non_positive_wh,
 (SELECT count(*) FROM fl WHERE nan_inf_values) AS nan_inf_values, (SELECT count(*) FROM fl WHERE malformed_lines) AS malformed_lines, (SELECT count(class_id) FROM fl) AS total_valid_objects,
 (SELECT count(*) FROM im WHERE stem NOT IN (SELECT stem FROM fl)) AS missing_labels, (SELECT count(DISTINCT stem) FROM fl WHERE stem NOT IN (SELECT stem FROM im)) AS missing_images,
 0::BIGINT AS stem_overlaps, (SELECT count(*) FROM (SELECT dg FROM im GROUP BY dg HAVING count(DISTINCT split) > 1)) AS digest_overlaps, (SELECT count(*) FROM (SELECT gk FROM im GROUP BY gk HAVING count(DISTINCT split) > 1)) AS group_key_overlaps)""", "lines", extra=_FAULTS)),
    "audited_classes": (audited_classes, sql("SELECT split, count_if(class_id = 0)::BIGINT AS pothole, count_if(class_id = 1)::BIGINT AS crack, count_if(class_id = 2)::BIGINT AS manhole, count(class_id) AS total_objects FROM fl GROUP BY split", "lines", extra=_FAULTS)),
    "label_line_faults": (label_line_faults, sql("SELECT stem, line_no, invalid_class_ids, out_of_bounds_coords, non_positive_wh, nan_inf_values, malformed_lines, class_id FROM fl", "lines", extra=_FAULTS)),
    "splits_without_images": (splits_without_images, "SELECT 'test' AS split, 2 AS ord WHERE (SELECT count(*) FROM documents WHERE doc_id % 20 < 14) > 0"),
    "near_duplicates_across_splits": (near_duplicates_across_splits, sql("""SELECT vec_id_a, vec_id_b, distance, la AS group_a, lb AS group_b, CASE la % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split_a, CASE lb % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split_b
 FROM pairs WHERE la % 3 <> lb % 3""", "phash", extra=_PAIRS)),
    "image_import": (image_import, sql("""SELECT source_split, count(*) AS n_found, count_if(k = 1)::BIGINT AS n_kept, count_if(k > 1)::BIGINT AS n_repeated FROM (
 SELECT CASE WHEN doc_id % 3 = 0 THEN 'valid' ELSE 'train' END AS source_split, row_number() OVER (PARTITION BY content_md5 ORDER BY doc_id % 3 = 0, name) AS k FROM images) GROUP BY 1""", "images")),
    "pixel_statistics": (pixel_statistics, "SELECT avg(o_orderkey % 256) AS mean, avg(o_orderkey % 64) AS std, min(o_orderkey % 100) AS low, max(100 + o_orderkey % 155) AS high FROM orders"),
    "dataset_integrity": (dataset_integrity, sql("""SELECT error, count(*) AS n_errors FROM (
 SELECT 'invalid_box' AS error FROM u WHERE status <> 'valid' UNION ALL SELECT 'unreadable_image' FROM customer WHERE c_acctbal < 0
 UNION ALL SELECT 'missing_label' FROM im WHERE stem NOT IN (SELECT stem FROM u) UNION ALL SELECT 'orphan_label' FROM (SELECT DISTINCT stem FROM u) WHERE stem NOT IN (SELECT stem FROM im)
 UNION ALL SELECT 'leakage_by_digest' FROM im GROUP BY dg HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'leakage_by_group_key' FROM im GROUP BY gk HAVING count(DISTINCT split) > 1) GROUP BY error""", "lines", extra=_PARSED + ", " + _FAULTS[_FAULTS.index("im AS"):])),
    "last_errors": (last_errors, sql("SELECT stem, line_no, reason FROM u WHERE status = 'rejected' ORDER BY stem DESC, line_no DESC LIMIT 20", "lines", extra=_PARSED)),
    "eval_leakage_passages": (eval_leakage_passages, "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
}
