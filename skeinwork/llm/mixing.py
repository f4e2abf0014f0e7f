"""Mixing sources to target weights by temperature, in DataFrame functions only.

Each source's share of all tokens p is raised to an exponent a between 0 (all sources alike) and 1 (as they come) and
normalised. The exponent is bisected on a grid of millionths: the largest whose weights have the target entropy, unless a
source would then be repeated more often than the limit, in which case the smallest that keeps the limit. The sums over
sources that the bisection needs depend on token totals only, so sources of equal total are counted together: at most
about sqrt(2 * tokens) totals, however many sources there are.

Each source gets its weight's part of the token budget as blocks of whole permutations: every epoch deals the source's
documents to blocks by a hash of seed, epoch and document, orders each block by that hash, and lays block after block.
Full epochs hold every document; the last takes documents in that order as long as they fit wholly before the budget's
end. Running sums go within blocks of about `block_rows` documents and over block totals, so that no task reads a source.

Defined cases: a null source is the source named ''; null or empty texts have no tokens and come along in every epoch of
their source that reaches them; sources without tokens get nothing; rows equal in doc_id, source and text are one unit
that comes together; ties of the hash go by doc_id and text hash; units without a doc_id are dealt by their text hash; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import checkpointed, columns, own_name, range_hash

ENTROPY, REPEATS, BLOCK_ROWS, SEED, GRID = 0.95, 4.0, 1000, 7, 1_000_000
MOST_BROADCAST = 200_000
WORD_GAP = r"[\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_GAP), "")), F.lit(0)).cast("long")


def _units(documents: DataFrame) -> DataFrame:
    named = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("key"), n_words(F.coalesce("text", F.lit(""))).alias("n"))
    return named.groupBy("doc_id", "source", "key").agg(F.sum("n").alias("n_tokens"))


def _exponent(totals: DataFrame, entropy: float, repeats: float, budget: int | None) -> tuple[float, float, int, int]:
    """The exponent, its normaliser, all tokens and the budget. totals: a row per source with `total` > 0."""
    alike = totals.groupBy("total").agg(F.count("*").cast("double").alias("k"))
    packed = alike.agg(F.sort_array(F.collect_list(F.struct("total", "k"))).alias("h"), F.sum(F.col("total") * F.col("k")).alias("all"), F.sum("k").alias("sources"), F.min("total").alias("least"))
    total = F.col("all")

    def summed(value):
        return F.aggregate("h", F.lit(0.0), lambda s, x: s + x["k"] * value(x["total"] / total))

    def norm(a):
        return summed(lambda p: F.pow(p, a))

    def has_entropy(g):
        a = g / F.lit(float(GRID))
        z = norm(a)
        return F.log(z) - a * summed(lambda p: F.pow(p, a) * F.log(p)) / z >= F.lit(entropy) * F.log("sources")

    def has_limit(g):
        a = g / F.lit(float(GRID))
        spent = total if budget is None else F.lit(float(budget))
        return spent / total * F.pow(F.col("least") / total, a - 1.0) / norm(a) <= F.lit(float(repeats))

    def bisected(ok, largest: bool):
        """The largest (smallest) grid point of 0..GRID that is ok; 0 (GRID) is taken to be ok."""
        def step(s, _):
            mid = F.floor((s["lo"] + s["hi"] + (1 if largest else 0)) / F.lit(2)).cast("long")
            good = ok(mid)
            if largest:
                return F.struct(F.when(good, mid).otherwise(s["lo"]).alias("lo"), F.when(good, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))
            return F.struct(F.when(good, s["lo"]).otherwise(F.least(mid + 1, s["hi"])).alias("lo"), F.when(good, mid).otherwise(s["hi"]).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.struct(F.lit(0).cast("long").alias("lo"), F.lit(GRID).cast("long").alias("hi")), step, lambda s: s["lo"] if largest else s["hi"])

    chosen = packed.withColumn("g", F.greatest(bisected(has_entropy, True), bisected(has_limit, False)))
    row = chosen.select((F.col("g") / F.lit(float(GRID))).alias("a"), norm(F.col("g") / F.lit(float(GRID))).alias("z"), F.col("all").cast("long").alias("all")).first()
    if row is None or row["all"] is None:
        return 1.0, 1.0, 0, 0
    return row["a"], row["z"], row["all"], row["all"] if budget is None else budget


def weights(units: DataFrame, entropy: float, repeats: float, budget: int | None, block_rows: int) -> DataFrame:
    """source, total, weight, target (tokens), full (epochs), rest (tokens of the last epoch), blocks."""
    totals = checkpointed(units.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("units")).where("total > 0"))
    a, z, all_tokens, spent = _exponent(totals, entropy, repeats, budget)
    w = F.pow(F.col("total") / F.lit(float(max(all_tokens, 1))), F.lit(a)) / F.lit(z)
    t = totals.withColumn("weight", w).withColumn("target", F.round(F.col("weight") * F.lit(float(spent))).cast("long"))
    full = F.floor(F.col("target") / F.col("total")).cast("long")
    return t.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("total")).withColumn("blocks", F.ceil(F.col("units") / F.lit(block_rows)).cast("long"))


def _dealt(seed, epoch, doc_id, key):
    """The hash, 0 to 2**60, that deals a unit in an epoch: of its doc_id, or of its text where that is null."""
    digest = F.md5(F.concat_ws(":", seed, epoch, F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), key.cast("string")))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(documents: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """A row per unit and epoch of the mixture: where it stands in its source's stream, and in the whole (0 to 1).

    entropy: wished part of the most that so many sources allow. repeats: epochs of a source at most. budget: tokens, by
    default as many as there are (the proportional mixture is then one epoch)."""
    units = checkpointed(_units(documents))
    plan = weights(units, entropy, repeats, budget, block_rows)
    # by count: a row per source, some 100 bytes
    near = F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan
    dealt = units.join(near, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "full"))).where("epoch < full or rest > 0")
    dealt = dealt.withColumn("h", _dealt(F.lit(str(seed)), F.col("epoch"), F.col("doc_id"), F.col("key")))
    dealt = dealt.withColumn("block", F.shiftright(F.shiftright("h", 30) * F.col("blocks"), 30))
    dealt = dealt.repartition("source", "epoch", "block")  # else the join's partitioning by source would do, hot sources with it
    inside = Window.partitionBy("source", "epoch", "block").orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("sum")).withColumn("behind", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    laid = dealt.withColumn("end", F.sum("n_tokens").over(inside)).join(blocks, ["source", "epoch", "block"]).withColumn("end", F.col("end") + F.col("behind"))
    taken = laid.where("epoch < full or end <= rest").withColumn("start", F.col("epoch") * F.col("total") + F.col("end") - F.col("n_tokens"))
    return taken.select("doc_id", "key", "source", "epoch", "block", "n_tokens", "start", (F.col("start") / F.col("target")).alias("position"))


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The rows of `documents`, each as often as the mixture has it; laid() finds the mixture's order again."""
    doc, source, key, times, copy = (own_name(documents, c) for c in ("unit", "unit_source", "unit_key", "times", "copy"))
    units = mix(documents, **how).groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("key").alias(key)).agg(F.count("*").cast("int").alias(times))
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)) & (F.coalesce("source", F.lit("")) == F.col(source))
    return documents.join(units, on).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*columns(documents))


def laid(mixture: DataFrame, place: str = "place", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The rows of a mixture with their place in it, from 0 to 1, as a column; and the rows' keys: at (the place), hash
    (common.range_hash) and bytes, which are found without moving texts.

    The copies of a unit are its epochs, and within an epoch blocks and their documents lie in the order of the same hash
    that mix() deals them by, so (epoch, hash) is each source's stream of block permutations. Streams of all sources are
    laid over each other, each stretched over the whole."""
    source, key = F.coalesce("source", F.lit("")), F.xxhash64("text")
    units = mixture.select("doc_id", source.alias("s"), key.alias("k"), range_hash().alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    units = checkpointed(units.groupBy("doc_id", "s", "k", "hash").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n")))
    at = lambda epoch, doc, k: epoch + _dealt(F.lit(str(seed)), epoch, doc, k) / F.lit(float(1 << 60))
    ends = checkpointed(units.groupBy("s").agg(F.max(at(F.col("n") - 1, F.col("doc_id"), F.col("k"))).alias("last")))
    near = F.broadcast if ends.count() <= MOST_BROADCAST else (lambda d: d)  # a row per source
    over = lambda x, last: F.when(last > 0, x / last).otherwise(F.lit(0.0))
    each = units.join(near(ends), "s").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    keys = each.select(over(at(F.col("epoch"), F.col("doc_id"), F.col("k")), F.col("last")).alias("at"), "hash", "bytes")

    named, k, epoch, last = (own_name(mixture, c) for c in ("unit_source", "unit_key", "epoch", "last"))
    copies = Window.partitionBy("doc_id", named, k).orderBy(F.lit(0))
    rows = mixture.withColumn(named, source).withColumn(k, key).withColumn(epoch, (F.row_number().over(copies) - 1).cast("long"))
    rows = rows.join(near(ends.select(F.col("s").alias(named), F.col("last").alias(last))), named)
    others = [c for c in mixture.columns if c.lower() != place.lower()]
    return rows.select(*columns(mixture, others), over(at(F.col(epoch), F.col("doc_id"), F.col(k)), F.col(last)).alias(place)), keys


def digest(documents: DataFrame) -> DataFrame:
    return mix(documents).drop("key")


ORACLE_SQL = rf"""
WITH RECURSIVE units AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
  FROM documents GROUP BY ALL),
totals AS (SELECT source, sum(n_tokens) AS total, count(*) AS units FROM units GROUP BY source HAVING sum(n_tokens) > 0),
base AS (SELECT CAST(sum(total) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, CAST(min(total) AS DOUBLE) AS least FROM totals),
upper(i, lo, hi) AS (
  SELECT 0, 0, {GRID} UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE greatest(mid - 1, lo) END FROM (
    SELECT i, lo, hi, mid, (SELECT ln(sum(pow(total / n, mid / {GRID}.0))) - mid / {GRID}.0 * sum(pow(total / n, mid / {GRID}.0) * ln(total / n)) / sum(pow(total / n, mid / {GRID}.0)) >= {ENTROPY} * ln(any_value(k)) FROM totals, base) AS ok
    FROM (SELECT i, lo, hi, (lo + hi + 1) // 2 AS mid FROM upper WHERE i < 21))),
lower(i, lo, hi) AS (
  SELECT 0, 0, {GRID} UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE least(mid + 1, hi) END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, (SELECT pow(any_value(least) / any_value(n), mid / {GRID}.0 - 1) / sum(pow(total / n, mid / {GRID}.0)) <= {REPEATS} FROM totals, base) AS ok
    FROM (SELECT i, lo, hi, (lo + hi) // 2 AS mid FROM lower WHERE i < 21))),
a AS (SELECT greatest((SELECT lo FROM upper WHERE i = 21), (SELECT hi FROM lower WHERE i = 21)) / {GRID}.0 AS a),
w AS (SELECT source, total, units, CAST(round(pow(total / n, a) / (SELECT sum(pow(total / n, a)) FROM totals, base, a) * n) AS BIGINT) AS target FROM totals, base, a),
plan AS (SELECT source, CAST(total AS BIGINT) AS total, target, CAST(target // total AS BIGINT) AS epochs, CAST(target - total * (target // total) AS BIGINT) AS rest,
         CAST(ceil(units / {BLOCK_ROWS}.0) AS BIGINT) AS blocks FROM w),
dealt AS (SELECT *, CAST(concat('0x', substr(md5(concat('{SEED}:', epoch, ':', doc_id)), 1, 15)) AS BIGINT) AS h
          FROM (SELECT *, unnest(generate_series(0, epochs)) AS epoch FROM units JOIN plan USING (source)) WHERE epoch < epochs OR rest > 0),
placed AS (SELECT *, ((h >> 30) * blocks) >> 30 AS block FROM dealt),
laid AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block, h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM placed)
SELECT doc_id, source, epoch, block, n_tokens, epoch * total + e - n_tokens AS start, (epoch * total + e - n_tokens) / CAST(target AS DOUBLE) AS position
FROM laid WHERE epoch < epochs OR e <= rest
"""
