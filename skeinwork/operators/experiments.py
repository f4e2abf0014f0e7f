"""Experiments side by side: fairness and review gates, leaders, trade-offs, upserts, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators import ordered
from skeinwork.schema import RESULT_COLUMNS


def preprocessing_label(denoise: Column, contrast: Column, brightness: Column) -> Column:
    """Names of the stages that are on, joined in order; raw without any."""
    on = F.concat_ws("+", *(F.when(on, F.lit(n)) for n, on in (("denoise", denoise), ("contrast", contrast), ("brightness", brightness))))
    return F.coalesce(F.nullif(on, F.lit("")), F.lit("raw"))


def result_row(runs: DataFrame) -> DataFrame:
    """The flat result of each run, in the order of RESULT_COLUMNS; latencies in milliseconds with three decimals.

    runs: experiment, the three stages as booleans, the settings, the metrics, and preprocessing_ms, inference_ms, total_ms."""
    d = runs.withColumn("preprocessing", preprocessing_label(F.col("denoise"), F.col("contrast"), F.col("brightness")))
    return d.select(*(F.round(F.col(c).cast("double"), 3).alias(c) if c.endswith("_ms") else F.col(c) for c in RESULT_COLUMNS))


def fraction_problem(fraction: Column, debug: Column) -> Column:
    """Why a training fraction is refused, or null: it must be over 0 and at most 1, and less than 1 only for debugging."""
    x = finite(fraction.cast("string"))
    wrong = x.isNull() | (x <= 0) | (x > 1)
    return F.when(wrong, "out_of_range").when((x < 1) & ~F.coalesce(debug, F.lit(False)), "not_debug")


def config_differences(trained: DataFrame, dataset: DataFrame) -> DataFrame:
    """name, trained, dataset: settings that differ between what a model was trained with and its dataset's manifest.

    Both: name, value (canonical JSON text). A setting that one side lacks differs, too."""
    a, b = trained.select("name", F.col("value").alias("trained")), dataset.select("name", F.col("value").alias("dataset"))
    return a.join(b, "name", "full_outer").where(~F.col("trained").eqNullSafe(F.col("dataset")))


def fair_problems(rows: DataFrame, columns: list[str], metrics: list[str], order: str, expected: DataFrame | None = None) -> DataFrame:
    """experiment, problem of result rows that may not be compared: settings unlike the first row's, fractions other than 1,
    metrics that aren't finite, and (experiment null) other than exactly one raw row. If `expected` is given and the rows
    aren't its experiments, each once, that is all that is told."""
    differ = unfair(rows, columns, order).select("experiment", F.concat(F.lit("differs:"), "differs").alias("problem"))
    part = rows.where(~finite(F.col("fraction").cast("string")).eqNullSafe(F.lit(1.0))).select("experiment", F.lit("fraction").alias("problem"))
    bad = not_finite(rows, metrics).select("experiment", F.concat(F.lit("not_finite:"), "column").alias("problem"))
    raw = rows.agg(F.count_if(F.col("preprocessing") == "raw").alias("n")).where("n <> 1").select(F.lit(None).cast("string").alias("experiment"), F.concat(F.lit("raw_rows:"), F.col("n").cast("string")).alias("problem"))
    found = differ.unionByName(part).unionByName(bad).unionByName(raw)
    return found if expected is None else _only_if_whole(found, expected_problems(rows, expected))


def finite(value: Column) -> Column:
    """A text as a finite number, or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def not_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """experiment, column of values that aren't finite numbers."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("string")).alias("x")) for c in columns))
    return rows.select("experiment", F.inline(cells)).where("x is null").select("experiment", "column")


def unfair(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """experiment and its settings that differ from the first row's. The reference is one row, so it is broadcast."""
    first = rows.orderBy(order).limit(1).select(*(F.col(c).alias(f"ref_{c}") for c in columns))
    differ = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"ref_{c}")), F.lit(c)) for c in columns)))
    return rows.join(F.broadcast(first), F.lit(True)).withColumn("differs", F.concat_ws(",", differ)).where("differs <> ''").select("experiment", "differs")


def expected_problems(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """experiment, problem: expected ones that are missing, unexpected ones, and repeated ones."""
    n = rows.groupBy("experiment").agg(F.count("*").alias("n"))
    d = n.join(expected.select("experiment", F.lit(True).alias("wanted")), "experiment", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return d.withColumn("problem", problem).where("problem is not null").select("experiment", "problem")


def review_reasons(reviews: DataFrame, expected: DataFrame, least: int = 10) -> DataFrame:
    """experiment, reason: why a visual review doesn't count. It must be complete, of enough images, with all fields. If the
    reviewed experiments aren't the expected ones, each once, that is all that is told."""
    fields = ("bbox_alignment", "texture_preservation", "representative_failures", "reviewer")
    complete = F.coalesce(F.upper("status") == "COMPLETE", F.lit(False))
    n = F.col("reviewed_images").cast("string").try_cast("int")
    reasons = F.when(~complete, F.array(F.lit("not_complete"))).otherwise(
        F.array_compact(F.array(
            F.when(n.isNull(), F.lit("invalid_reviewed_images")).when(n < least, F.lit("too_few_images")),
            *(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"missing_{c}")) for c in fields),
        ))
    )
    whole = expected_problems(reviews, expected).withColumnRenamed("problem", "reason")
    return _only_if_whole(reviews.select("experiment", F.explode(reasons).alias("reason")), whole)


def _only_if_whole(own: DataFrame, whole: DataFrame) -> DataFrame:
    """The rows of `whole`, and those of `own` only if there are none."""
    none = F.broadcast(whole.agg(F.count("*").alias("__n")).where("__n = 0"))  # one row or none
    return whole.unionByName(own.join(none, F.lit(True)).drop("__n"))


def conclusion(reasons: DataFrame) -> DataFrame:
    """BLOCKED with the number of reasons, or READY. There is never a single winner."""
    n = reasons.agg(F.count("*").alias("n_reasons"))
    return n.select(F.when(F.col("n_reasons") > 0, "BLOCKED").otherwise("READY").alias("status"), F.lit(None).cast("string").alias("winner"), "n_reasons")


def leaders(rows: DataFrame, highest: list[str], lowest: list[str], order: str) -> DataFrame:
    """metric, experiment, value of the best row of each metric; equal values go to the first row in order."""
    metrics = [*((m, 1) for m in highest), *((m, -1) for m in lowest)]
    # the smallest (value, order) of each metric, all by one aggregate
    key = lambda m, sign: F.struct((F.col(m) * F.lit(-sign)).alias("v"), F.col(order).alias("o"), F.col("experiment").alias("e"), F.col(m).cast("double").alias("x"))
    best = rows.agg(*(F.min(key(m, sign)).alias(f"k{i}") for i, (m, sign) in enumerate(metrics)))
    named = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"k{i}.e").alias("experiment"), F.col(f"k{i}.x").alias("value")) for i, (m, _) in enumerate(metrics)))
    return best.select(F.inline(named))


def pareto(rows: DataFrame, score: str, cost: str) -> DataFrame:
    """Rows that no other row beats in one and equals or beats in the other; equal rows don't beat each other.

    A row stays if it has the best score of its cost and more than every smaller cost. Costs, not rows, are sorted, and the
    best score before a cost is the best of the partitions before its own and of its own up to it."""
    best = rows.groupBy(cost).agg(F.max(score).alias("__best"))
    parts = ordered.others(ordered.sorted_parts(best, cost), "__best", F.max, [], "__before")
    stays = parts.where("__before is null or __best > __before").select(F.col(cost).alias("__cost"), "__best")
    return rows.join(stays, (F.col(cost) == F.col("__cost")) & (F.col(score) == F.col("__best")), "left_semi")


def deltas(rows: DataFrame, columns: list[str], raw: str = "raw") -> DataFrame:
    """Each row's difference from the raw row; other than exactly one raw row is an error."""
    base = rows.where(F.col("preprocessing") == raw).agg(F.count("*").alias("__n"), *(F.first(c).alias(f"raw_{c}") for c in columns))
    one = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("raw rows: "), F.col("__n").cast("string"))).cast("boolean"))
    return rows.join(F.broadcast(base), F.lit(True)).where(one).select("experiment", *((F.col(c) - F.col(f"raw_{c}")).alias(f"{c}_delta") for c in columns))


def analysis(rows: DataFrame, reasons: DataFrame, highest: list[str], cost: str, score: str, order: str) -> DataFrame:
    """section, experiment, name, value: what may be said of the experiments. With any reason (experiment, reason) the status
    is BLOCKED and the reasons are all; READY has the leader of each metric and of the cost, the frontier of score against
    cost, and each row's metrics with their differences from the raw row. There is never a single winner."""
    state = reasons.agg(F.count("*").alias("__n"))
    nothing = lambda kind: F.lit(None).cast(kind)
    status = state.select(F.lit("status").alias("section"), nothing("string").alias("experiment"), F.when(F.col("__n") > 0, "BLOCKED").otherwise("READY").alias("name"), F.col("__n").cast("double").alias("value"))
    why = reasons.select(F.lit("reason").alias("section"), "experiment", F.col("reason").alias("name"), nothing("double").alias("value"))
    ready = F.broadcast(state.where("__n = 0"))  # one row or none
    first = leaders(rows, highest, [cost], order).select(F.lit("leader").alias("section"), "experiment", F.col("metric").alias("name"), "value")
    front = pareto(rows, score, cost).select(F.lit("frontier").alias("section"), "experiment", nothing("string").alias("name"), nothing("double").alias("value"))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in [*highest, cost]))
    own = rows.select(F.lit("metric").alias("section"), "experiment", F.inline(cells))
    base = rows.where("preprocessing = 'raw'").agg(F.count("*").alias("__raws"), *(F.first(c).cast("double").alias(f"raw_{c}") for c in highest))
    change = F.array(*(F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double") - F.col(f"raw_{c}"), 6).alias("value")) for c in highest))
    against = rows.join(F.broadcast(base.where("__raws = 1")), F.lit(True)).select(F.lit("delta").alias("section"), "experiment", F.inline(change))
    said = first.unionByName(front).unionByName(own).unionByName(against).join(ready, F.lit(True)).drop("__n")
    return status.unionByName(why).unionByName(said)


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows as they are, with their own columns kept, and those of `new` whose experiment isn't there."""
    return existing.unionByName(new.join(existing, "experiment", "left_anti"), allowMissingColumns=True)


def latency_after_warmup(samples: DataFrame, warmup: int = 5) -> DataFrame:
    """Mean of `ms` by experiment without the first samples, unless that leaves none. samples: experiment, position, ms."""
    w = Window.partitionBy("experiment").orderBy("position")
    d = samples.withColumn("k", F.row_number().over(w)).withColumn("warm", F.col("k") > warmup)
    s = d.groupBy("experiment").agg(F.avg(F.when(F.col("warm"), F.col("ms"))).alias("warm"), F.avg("ms").alias("every"), F.count_if("warm").alias("n_warm"), F.count("*").alias("n"))
    return s.select("experiment", F.when(F.col("n_warm") > 0, F.col("n_warm")).otherwise(F.col("n")).alias("n_samples"), F.coalesce("warm", "every").alias("mean_ms"))


def flat_metrics(metrics: DataFrame) -> DataFrame:
    """experiment and overall.* with mAP50 of each class as columns. metrics: experiment, overall struct, per_class array."""
    by_name = F.map_from_entries(F.transform("per_class", lambda c: F.struct(c["class_name"], c["mAP50"])))
    return metrics.select("experiment", "overall.*", *(by_name[c].alias(f"{c}_mAP50") for c in ("pothole", "crack", "manhole")))


def run_states(files: DataFrame) -> DataFrame:
    """State of training runs by the files they have (run, file): complete, resumable or empty."""
    has = lambda n: F.bool_or(F.col("file") == n)
    d = files.groupBy("run").agg(has("best.pt").alias("best"), has("last.pt").alias("last"), has("experiment_config.yaml").alias("contract"))
    state = F.when(F.col("best") & F.col("last") & F.col("contract"), "complete").when(F.col("last"), "resumable").otherwise("empty")
    return d.select("run", state.alias("state"))


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest row of each key; ties go to the greatest remaining columns."""
    rest = [c for c in rows.columns if c not in keys and c != time]
    return rows.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("r")).select(*keys, "r.*")
