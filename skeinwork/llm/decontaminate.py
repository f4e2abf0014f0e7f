"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark window (13 words of an item, or all words of a shorter item) is a set of word shingles. To contain the
window a document must contain all of them, so the necessary prefix of the window in any global order is one shingle:
the rarest, by how often the documents hold it.

1. the benchmark's shingles are counted over all documents; a window with a shingle that no document holds is out,
2. each window keeps its rarest shingle and that shingle's offset, its anchor; documents are scanned again for anchors alone,
3. positional and length bounds drop those too near either end of the document,
4. the window's words are compared with the document's words there.

The benchmark side is broadcast only below `broadcast_bytes`, by its measured size: then the texts are never shuffled, and an
anchor is compared in the document's own row. Above that the same joins are sort-merge joins, which adaptive execution splits
where a key is hot: all documents' shingles go through as one long each (twice: counts, anchors), candidates as positions, and
the texts once, to their candidates, so that what is shuffled stays in proportion to the input.

Defined cases: a null or empty text has no words, hits nothing and is clean; very long texts are split into words one at a
time; null item texts and items without words
are ignored; an item with a null id marks words but isn't listed; repeated items count once; repeated document rows each
give their row; columns other than doc_id, text, item_id are ignored, whatever their names; an empty benchmark leaves
every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import ascii_lower, checkpointed, columns, own_name

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE, BROADCAST_BYTES = 13, 3, 32 << 20
MOST_BROADCAST = 200_000  # rows of two longs


def words(text):
    """The array of words of a text, A-Z lower-cased; empty for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id string, win array<string>, len: distinct windows of each item."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct().withColumn("len", F.size("win"))


def shingle_hashes(w, k: int):
    """Hashes of the k-word shingles of an array of words, by position."""
    last = F.size(w) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, key, n_words, n_hit, items (sorted distinct item ids as strings)."""
    win = checkpointed(windows(benchmark, window).withColumn("wid", F.xxhash64("item_id", "win")))
    stats = win.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "win"))).alias("b"), F.collect_set(F.least(F.col("len"), F.lit(shingle))).alias("k")).first()
    small = (stats["b"] or 0) + 64 * shingle * window * stats["n"] <= broadcast_bytes
    near = F.broadcast if small else (lambda d: d)
    docs = documents.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text"))
    counts = docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))

    # every shingle of every window, with its offset in the window
    parts = [
        win.where(F.least(F.col("len"), F.lit(shingle)) == k).select("wid", F.posexplode(shingle_hashes(F.col("win"), k)).alias("off", "sh"))
        for k in sorted(stats["k"])
    ]
    if not parts:
        return counts.select("doc_id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    vocabulary = own.select("sh").distinct()
    widths = sorted(stats["k"])
    split = docs.select("doc_id", "key", words(F.col("text")).alias("w"))

    # counts first: hashes alone meet the vocabulary
    held = reduce(DataFrame.unionByName, (split.select(F.explode(shingle_hashes(F.col("w"), k)).alias("sh")).join(near(vocabulary), "sh") for k in widths))
    seen = checkpointed(held.groupBy("sh").agg(F.count("*").alias("df")))
    ranked = own.join(near(seen), "sh", "left")
    prefix = ranked.groupBy("wid").agg(F.count("*").alias("n_sh"), F.count("df").alias("n_seen"), F.min(F.struct("df", "off", "sh")).alias("r")).where("n_sh = n_seen")
    anchors = checkpointed(prefix.join(win, "wid").select(F.col("r.sh").alias("sh"), F.col("r.off").alias("off"), "win", "len", "item_id"))

    # then the positions of anchors alone
    start, end = F.col("pos") - F.col("off"), F.col("pos") - F.col("off") + F.col("len")
    same = F.slice("w", F.col("s") + 1, F.col("len")) == F.col("win")
    candidates = []
    for k in widths:
        at = split.select("doc_id", "key", *(["w"] if small else []), F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "sh"))
        own_anchors = anchors.where(F.least(F.col("len"), F.lit(shingle)) == k)
        met = at.join(near(own_anchors), "sh").withColumn("s", start).where((F.col("s") >= 0) & (end <= F.col("n")))
        candidates.append(met.where(same).drop("w") if small else met)
    found = reduce(DataFrame.unionByName, candidates).select("doc_id", "key", "s", "len", "win", "item_id")
    if not small:  # the texts come to their candidates once
        to = found.distinct().withColumnsRenamed({"doc_id": "d", "key": "k"})
        found = split.join(to, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).where(same)
    found = found.select("doc_id", "key", F.struct("s", (F.col("s") + F.col("len")).alias("e")).alias("span"), "item_id")
    per_doc = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    union = F.aggregate(
        "spans",
        none,
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).cast("long").alias("hit"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["hit"],
    )
    marked = per_doc.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), union.alias("n_hit"), "items")
    joined = counts.join(marked, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit, n_words):
    """The rule: some word is hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `documents` that aren't contaminated, with their columns as they were."""
    found = contamination(documents, benchmark, **how).where(is_contaminated(F.col("n_hit"), F.col("n_words")))
    doc, own, key = (own_name(documents, c) for c in ("unclean", "unclean_key", "text_key"))
    bad = checkpointed(found.select(F.col("doc_id").alias(doc), F.col("key").alias(own)).distinct())
    if bad.count() <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    kept = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    return kept.join(bad, (F.col(key) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti").select(*columns(documents))


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    c = contamination(documents, benchmark)
    return c.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + 12) AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
f AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
