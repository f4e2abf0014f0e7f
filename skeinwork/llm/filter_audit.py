"""Audit of how five filters interact, over all orders in which they could run.

A document's failures are five bits. A table of 32 masks by 120 orders, made once, holds the step at which an order removes
a document with these failures (0: never). mapInArrow looks up a batch's masks there, and np.bincount counts the part,
order and step of every document, once for all and once for each label; the partial arrays are summed. All other figures
of the report follow from these sums: a filter's failures are what it removes when it stands first, those of it alone what
it removes when it stands last.

Failures of a text (words are maximal runs without white space, case-sensitive): A under 200 words; B distinct words under
half of all; C more than 2 of 100 characters in A-Z; D any of `#$%&*|`; E the text is that of a smaller doc_id, table-wide,
removed or not. Texts are compared by SHA-256.

Scale: one pass over the texts writes some 60 bytes a row (a checkpoint). Those meet the smallest doc_id of their digest in
a join of repeated digests only (a checkpoint, too), and the labels by doc_id: equality joins whose large partitions Spark splits, so a group
that holds a third of all rows is many tasks. What the tasks add up is 720 places a part, summed by partial aggregation.

Defined cases: a null text is empty, a null source the part named ''; a row without a doc_id neither is nor has a smaller
one, so that it never fails E, and has no label; rows that repeat a doc_id are compared by that doc_id, hence not with each
other; several labels of a doc_id count as the largest; words of very long texts are held one text at a time; an empty table
has no parts and gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import UPPER, checkpointed
from skeinwork.llm.mixing import WORD_GAP

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
PLACES = len(ORDERS) * (STEPS + 1)
#: Parts whose sums a task holds before it hands them on (each 3 * PLACES longs).
HELD_PARTS = 2000


def first_failures() -> np.ndarray:
    """By mask and order: the step that removes a document with these failures, 0 if none does."""
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    fails = np.arange(1 << STEPS)[:, None, None] >> order & 1 == 1
    return np.where(fails.any(2), fails.argmax(2) + 1, 0)


def text_failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, digest and the failures A to D (bits 0 to 3) of each row."""
    text = F.col("text")
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    size = F.length(text).cast("long")
    capitals = size - F.length(F.translate(text, UPPER, "")).cast("long")
    failed = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * size, text.rlike(r"[#$%&*|]")]
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failed)), F.lit(0))
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all five failures, good, toxic of each row."""
    rows = checkpointed(text_failures(documents))
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    repeated = checkpointed(repeated)  # both sides of the join are plain shuffles then, whose large partitions Spark splits
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    judged = rows.join(repeated, "digest", "left").select("doc_id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    return judged.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


SUMS = "part string, place int, removed long, good long, toxic long"
_SUMS = pa.schema([("part", pa.string()), ("place", pa.int32()), ("removed", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])


def removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the rows by part and place (order * 6 + step; step 0 is what stays to the end)."""
    place = first_failures() + (STEPS + 1) * np.arange(len(ORDERS))
    held: dict[str, np.ndarray] = {}

    def sums() -> Iterator[pa.RecordBatch]:
        for part, found in held.items():
            at = np.flatnonzero(found[0])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in found)], schema=_SUMS)
        held.clear()

    for whole in batches:
        for b in (whole.slice(k, HELD_PARTS) for k in range(0, len(whole), HELD_PARTS)):
            parts = b.column("part").dictionary_encode()
            names = parts.dictionary.to_pylist()
            flat = parts.indices.to_numpy().astype(np.int64)[:, None] * PLACES + place[b.column("mask").to_numpy()]
            kinds = [slice(None), *(b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))]
            counts = np.stack([np.bincount(flat[rows].ravel(), minlength=len(names) * PLACES) for rows in kinds]).reshape(3, len(names), PLACES)
            for k, name in enumerate(names):
                if name in held:
                    held[name] += counts[:, k]
                else:
                    held[name] = counts[:, k].copy()
            if len(held) > HELD_PARTS:
                yield from sums()
    yield from sums()


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(table: pa.Table) -> pa.Table:
    """All orders and steps of one part, from its sums."""
    counts = np.zeros((3, PLACES), np.int64)
    at = table.column("place").to_numpy()
    for k, c in enumerate(("removed", "good", "toxic")):
        counts[k, at] = table.column(c).to_numpy()
    removed, good, toxic = counts.reshape(3, len(ORDERS), STEPS + 1)
    total, steps = removed[0].sum(), removed[:, 1:]
    filters = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    fails = np.array([steps[filters[:, 0] == f, 0][0] for f in range(STEPS)])
    alone = np.array([steps[filters[:, -1] == f, -1][0] for f in range(STEPS)])
    shapley = np.array([steps[filters == f].sum() for f in range(STEPS)])
    columns = [total - np.cumsum(steps, 1), steps, fails[filters] - steps, alone[filters], good[:, 1:], toxic[:, 1:], shapley[filters]]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    n = len(ORDERS) * STEPS
    return pa.table(
        {
            "part": pa.array([table.column("part")[0].as_py()] * n, pa.string()),
            "filter_order": pa.array(np.repeat(ORDERS, STEPS).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))),
            **{name: pa.array(c.ravel()) for name, c in zip(names, columns, strict=True)},
        }
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: see REPORT. The part is the source."""
    summed = failures(documents, labels).mapInArrow(removals, SUMS).groupBy("part", "place").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))
    return summed.groupBy("part").applyInArrow(report, REPORT)


digest = audit

ORACLE_SQL = f"""
WITH judged AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
  FROM documents d),
firsts AS (SELECT t, min(doc_id) AS first FROM judged GROUP BY t),
failed AS (
  SELECT part, good, toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > first, false)] AS f
  FROM judged JOIN firsts USING (t)),
masks AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failed GROUP BY part, f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS o
  FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (
  SELECT part, filter_order, o, f, n, n_good, n_toxic, coalesce(list_position([f[o[1]], f[o[2]], f[o[3]], f[o[4]], f[o[5]]], true), 0) AS gone
  FROM masks, orders),
rows AS (
  SELECT part, filter_order, s AS step, o[s] AS k,
    coalesce(sum(n) FILTER (gone = 0 OR gone > s), 0) AS kept,
    coalesce(sum(n) FILTER (gone = s), 0) AS removed,
    coalesce(sum(n) FILTER (f[o[s]] AND gone < s), 0) AS redundant,
    coalesce(sum(n) FILTER (f[o[s]] AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (gone = s), 0) AS good_lost,
    coalesce(sum(n_toxic) FILTER (gone = s), 0) AS toxic_lost
  FROM steps, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
  GROUP BY part, filter_order, s, o[s])
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM rows
"""
