"""Queries that compare experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import experiments as e
from skeinwork.operators import matching, settings
from skeinwork.plans import views as v
from skeinwork.plans.boxes import greedy_match_counts, _GREEDY
from skeinwork.plans.views import sql
from skeinwork.schema import METRIC_COLUMNS

SETTINGS = ["epochs", "imgsz"]


def _settings(s, d):
    """Results with training settings, of which brands with a 3 in their name have a wrong one."""
    r = v.results(s, d)
    return r.withColumn("epochs", F.when(F.col("experiment").contains("3"), 4).otherwise(10)).withColumn("imgsz", F.when(F.col("experiment").contains("5"), 320).otherwise(640))


def pareto_frontier(s, d):
    return e.pareto(v.results(s, d), "score", "latency_units").select("experiment", "score", "latency_units")


def metric_leaders(s, d):
    return e.leaders(v.results(s, d), ["score", "n"], ["latency_units"], "experiment")


def delta_vs_reference(s, d):
    return e.deltas(v.results(s, d), ["score", "latency_units"])


def unfair_rows(s, d):
    return e.unfair(_settings(s, d), SETTINGS, "experiment")


def missing_experiments_upsert(s, d):
    """A table that has brands below Brand#2 with notes, and the others added without."""
    old = v.results(s, d).where("experiment < 'Brand#2'").select("experiment", "score", F.lit("kept").alias("notes"))
    return e.upserted(old, v.results(s, d).select("experiment", "score"))


def _reviews(s, d):
    r = v.results(s, d)
    k = F.col("n") % 5
    return r.select(
        "experiment", F.when(k == 0, "open").when(k == 1, "complete").otherwise("COMPLETE").alias("status"), F.when(k == 2, "7").when(k == 3, "many").otherwise("12").alias("reviewed_images"),
        F.when(k == 4, " ").otherwise("good").alias("bbox_alignment"), F.lit("good").alias("texture_preservation"), F.lit("none").alias("representative_failures"), F.when(k == 1, None).otherwise("x").alias("reviewer"),
    )


def review_gate_reasons(s, d):
    return e.review_reasons(_reviews(s, d), v.results(s, d))


def review_gate_missing(s, d):
    """Reviews of all brands but one: that is all that is told."""
    return e.review_reasons(_reviews(s, d).where("experiment <> 'Brand#7'"), v.results(s, d))


def review_conclusion(s, d):
    return e.conclusion(review_gate_reasons(s, d)).select("status", "n_reasons")


def experiment_analysis(s, d):
    """All brands with complete reviews: what is READY says."""
    r = v.results(s, d)
    good = r.select("experiment", F.lit("complete").alias("status"), F.lit("10").alias("reviewed_images"), *(F.lit("good").alias(c) for c in ("bbox_alignment", "texture_preservation", "representative_failures", "reviewer")))
    return e.analysis(r, e.review_reasons(good, r), ["score", "n"], "latency_units", "score", "experiment")


def experiment_analysis_blocked(s, d):
    return e.analysis(v.results(s, d), review_gate_reasons(s, d), ["score", "n"], "latency_units", "score", "experiment")


def _contract(s, d, manifest):
    """Parts as settings: nested, with a list. The manifest has other numbers, lists, key orders and lacks some keys."""
    p = v.table(s, d, "part")
    size = F.when(F.lit(manifest) & (F.col("p_size") % 4 == 0), F.col("p_size") + 1).otherwise(F.col("p_size"))
    resize = F.struct(F.lit("letterbox").alias("mode"), size.alias("size")) if not manifest else F.struct((size * 1.0).cast("double").alias("size"), F.lit("letterbox").alias("mode"))
    gamma = F.when(F.lit(not manifest) | (F.col("p_partkey") % 5 != 0), F.lit(0.9))  # to_json leaves nulls out
    steps = F.array(F.lit("raw"), F.when(F.lit(manifest) & (F.col("p_partkey") % 3 == 0), "median").otherwise("gaussian"))
    return p.select(F.col("p_partkey").alias("part"), F.to_json(F.struct(steps.alias("steps"), F.struct(gamma.alias("gamma"), resize.alias("resize")).alias("contrast"))).alias("settings"))


def contract_differences(s, d):
    return settings.differences(_contract(s, d, False), _contract(s, d, True), "part", "settings").withColumnRenamed("key", "part")


def flat_metrics(s, d):
    """Brands' nested metrics as rows."""
    r = v.results(s, d)
    each = F.array(*(F.struct(F.lit(c).alias("class_name"), (F.col("score") + k).cast("double").alias("mAP50")) for k, c in enumerate(("manhole", "pothole", "crack"))))
    return e.flat_metrics(r.select("experiment", F.struct("score", "n").alias("overall"), each.alias("per_class")))


def run_states(s, d):
    """Customers as training runs, orders as the files they have."""
    names = F.array(F.lit("best.pt"), F.lit("last.pt"), F.lit("experiment_config.yaml"), F.lit("log.txt"))
    return e.run_states(v.table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("file")))


def latest_orders(s, d):
    """Each customer's newest order; those of one day by the greatest key."""
    return e.latest(v.table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderdate")


def latency_after_warmup(s, d):
    return e.latency_after_warmup(v.frames(s, d).select(F.col("stream_id").alias("experiment"), F.col("frame").alias("position"), F.col("conf_pct").alias("ms")))


def suite_row_pooled(s, d):
    """Frames as videos, all classes together: those with ground truth are scored."""
    c = greedy_match_counts(s, d).groupBy("frame_id").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    videos = c.select((F.col("tp") + F.col("fn") > 0).alias("scored"), F.lit(1).alias("frames"), "tp", "fp", "fn", (F.col("tp") > 1).cast("int").alias("confirmed"), (F.col("tp") <= 1).cast("int").alias("unconfirmed"), (F.col("frame_id") % 50).alias("ms"))
    return matching.pooled_suite_row(videos)


def _runs(s, d):
    """Results as runs of a training program: stages by brand, some with a fraction, one with a metric that isn't a number."""
    r, n = v.results(s, d), F.col("n")
    return r.select(
        "experiment", (n % 2 == 1).alias("denoise"), (n % 3 == 1).alias("contrast"), (n % 5 == 1).alias("brightness"), F.lit(10).alias("epochs"), F.lit(16).alias("batch"), F.lit(640).alias("imgsz"),
        F.when(n % 4 == 0, 0.5).when(n % 7 == 0, 1.5).otherwise(1.0).alias("fraction"), F.lit(42).alias("seed"), *(F.col("score").cast("double").alias(c) for c in METRIC_COLUMNS),
        *((F.col("latency_units") / k).alias(c) for k, c in ((7.0, "preprocessing_ms"), (3.0, "inference_ms"), (1.7, "total_ms"))), (n % 8 == 0).alias("debug"),
    )


def result_rows(s, d):
    return e.result_row(_runs(s, d)).select("experiment", "preprocessing", "fraction", "recall", "preprocessing_ms", "inference_ms", "total_ms")


def fraction_problems(s, d):
    return _runs(s, d).select("experiment", e.fraction_problem(F.col("fraction"), F.col("debug")).alias("problem")).where("problem is not null")


def fair_result_problems(s, d):
    rows = e.result_row(_runs(s, d)).withColumn("recall", F.when(F.col("experiment").contains("4"), float("nan")).otherwise(F.col("recall")))
    rows = rows.withColumn("epochs", F.when(F.col("experiment").contains("3"), 4).otherwise(F.col("epochs")))
    return e.fair_problems(rows, ["epochs", "imgsz"], ["recall", "precision"], "experiment")


def config_differences(s, d):
    """Brands' settings as trained, against a manifest that lacks some and has others."""
    r = v.results(s, d)
    trained = r.select(F.col("experiment").alias("name"), F.col("n").cast("string").alias("value"))
    manifest = r.where("n % 3 <> 0").select(F.col("experiment").alias("name"), F.when(F.col("n") % 3 == 1, F.col("n")).otherwise(F.col("n") + 1).cast("string").alias("value"))
    return e.config_differences(trained, manifest)


_RUNS = """runs AS (SELECT experiment, score, latency_units, n, CASE WHEN n % 4 = 0 THEN 0.5::DOUBLE WHEN n % 7 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS fraction, n % 8 = 0 AS debug,
 CASE WHEN n % 2 <> 1 AND n % 3 <> 1 AND n % 5 <> 1 THEN 'raw' ELSE concat_ws('+', CASE WHEN n % 2 = 1 THEN 'denoise' END, CASE WHEN n % 3 = 1 THEN 'contrast' END, CASE WHEN n % 5 = 1 THEN 'brightness' END) END AS preprocessing,
 min(experiment) OVER () AS ref FROM results)"""

_REVIEWS = """rv AS (SELECT experiment, CASE n % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'complete' ELSE 'COMPLETE' END AS status, CASE n % 5 WHEN 2 THEN '7' WHEN 3 THEN 'many' ELSE '12' END AS k,
 CASE n % 5 WHEN 4 THEN ' ' ELSE 'good' END AS box, CASE n % 5 WHEN 1 THEN '' ELSE 'x' END AS who FROM results),
why AS (SELECT experiment, 'not_complete' AS reason FROM rv WHERE upper(status) <> 'COMPLETE'
 UNION ALL SELECT experiment, CASE WHEN TRY_CAST(k AS INT) IS NULL THEN 'invalid_reviewed_images' ELSE 'too_few_images' END FROM rv WHERE upper(status) = 'COMPLETE' AND (TRY_CAST(k AS INT) IS NULL OR TRY_CAST(k AS INT) < 10)
 UNION ALL SELECT experiment, 'missing_bbox_alignment' FROM rv WHERE upper(status) = 'COMPLETE' AND trim(box) = '' UNION ALL SELECT experiment, 'missing_reviewer' FROM rv WHERE upper(status) = 'COMPLETE' AND who = '')"""

_OTHER = """, other AS (SELECT experiment, CASE WHEN n IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' ELSE 'repeated' END AS reason
 FROM (SELECT experiment, count(*) AS n FROM rv GROUP BY 1) FULL JOIN (SELECT experiment, 1 AS wanted FROM results) USING (experiment) WHERE n IS NULL OR wanted IS NULL OR n > 1)"""

QUERIES = {
    "result_rows": (result_rows, sql("SELECT experiment, preprocessing, fraction, CAST(score AS DOUBLE) AS recall, round(latency_units / 7.0::DOUBLE, 3) AS preprocessing_ms, round(latency_units / 3.0::DOUBLE, 3) AS inference_ms, round(latency_units / 1.7::DOUBLE, 3) AS total_ms FROM runs", "results", extra=_RUNS)),
    "fraction_problems": (fraction_problems, sql("SELECT * FROM (SELECT experiment, CASE WHEN fraction <= 0 OR fraction > 1 THEN 'out_of_range' WHEN fraction < 1 AND NOT debug THEN 'not_debug' END AS problem FROM runs) WHERE problem IS NOT NULL", "results", extra=_RUNS)),
    "fair_result_problems": (fair_result_problems, sql("""SELECT experiment, 'differs:epochs' AS problem FROM runs WHERE contains(experiment, '3') <> contains(ref, '3')
 UNION ALL SELECT experiment, 'fraction' FROM runs WHERE fraction <> 1 UNION ALL SELECT experiment, 'not_finite:recall' FROM runs WHERE contains(experiment, '4')
 UNION ALL SELECT NULL, concat('raw_rows:', count_if(preprocessing = 'raw')::BIGINT) FROM runs HAVING count_if(preprocessing = 'raw') <> 1""", "results", extra=_RUNS)),
    "config_differences": (config_differences, sql("SELECT experiment AS name, CAST(n AS STRING) AS trained, CASE n % 3 WHEN 2 THEN CAST(n + 1 AS STRING) END AS dataset FROM results WHERE n % 3 <> 1", "results")),
    "pareto_frontier": (pareto_frontier, sql("SELECT experiment, score, latency_units FROM results c WHERE NOT EXISTS (SELECT 1 FROM results o WHERE o.score >= c.score AND o.latency_units <= c.latency_units AND (o.score > c.score OR o.latency_units < c.latency_units))", "results")),
    "metric_leaders": (metric_leaders, sql("""SELECT metric, experiment, CAST(x AS DOUBLE) AS value FROM (
 SELECT metric, experiment, x, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'latency_units' THEN x ELSE -x END, experiment) AS k FROM (
 SELECT 'score' AS metric, experiment, score AS x FROM results UNION ALL SELECT 'n', experiment, n FROM results UNION ALL SELECT 'latency_units', experiment, latency_units FROM results)) WHERE k = 1""", "results")),
    "delta_vs_reference": (delta_vs_reference, sql("SELECT r.experiment, r.score - b.score AS score_delta, r.latency_units - b.latency_units AS latency_units_delta FROM results r, (SELECT * FROM results WHERE preprocessing = 'raw') b", "results")),
    "unfair_rows": (unfair_rows, sql("""SELECT experiment, concat_ws(',', CASE WHEN e <> re THEN 'epochs' END, CASE WHEN i <> ri THEN 'imgsz' END) AS differs FROM (
 SELECT *, first_value(e) OVER (ORDER BY experiment) AS re, first_value(i) OVER (ORDER BY experiment) AS ri FROM (SELECT experiment, CASE WHEN contains(experiment, '3') THEN 4 ELSE 10 END AS e, CASE WHEN contains(experiment, '5') THEN 320 ELSE 640 END AS i FROM results)) WHERE e <> re OR i <> ri""", "results")),
    "missing_experiments_upsert": (missing_experiments_upsert, sql("SELECT experiment, score, CASE WHEN experiment < 'Brand#2' THEN 'kept' END AS notes FROM results", "results")),
    "review_gate_reasons": (review_gate_reasons, sql("SELECT experiment, reason FROM other UNION ALL SELECT experiment, reason FROM why WHERE NOT EXISTS (SELECT 1 FROM other)", "results", extra=_REVIEWS + _OTHER)),
    "review_gate_missing": (review_gate_missing, sql("SELECT experiment, 'missing' AS reason FROM results WHERE experiment = 'Brand#7'", "results")),
    "review_conclusion": (review_conclusion, sql("SELECT CASE WHEN count(*) > 0 THEN 'BLOCKED' ELSE 'READY' END AS status, count(*) AS n_reasons FROM why", "results", extra=_REVIEWS)),
    "experiment_analysis": (experiment_analysis, sql("""SELECT 'status' AS section, NULL AS experiment, 'READY' AS name, 0.0::DOUBLE AS value
 UNION ALL SELECT 'leader', experiment, name, CAST(x AS DOUBLE) FROM (SELECT name, experiment, x, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = 'latency_units' THEN x ELSE -x END, experiment) AS k FROM cells) WHERE k = 1
 UNION ALL SELECT 'frontier', experiment, NULL, NULL FROM results c WHERE NOT EXISTS (SELECT 1 FROM results o WHERE o.score >= c.score AND o.latency_units <= c.latency_units AND (o.score > c.score OR o.latency_units < c.latency_units))
 UNION ALL SELECT 'metric', experiment, name, CAST(x AS DOUBLE) FROM cells
 UNION ALL SELECT 'delta', a.experiment, a.name, CAST(a.x - b.x AS DOUBLE) FROM cells a JOIN cells b USING (name) WHERE name <> 'latency_units' AND b.experiment = (SELECT min(experiment) FROM results)""", "results",
 extra="cells AS (SELECT experiment, 'score' AS name, score AS x FROM results UNION ALL SELECT experiment, 'n', n FROM results UNION ALL SELECT experiment, 'latency_units', latency_units FROM results)")),
    "experiment_analysis_blocked": (experiment_analysis_blocked, sql("SELECT 'status' AS section, NULL AS experiment, CASE WHEN count(*) > 0 THEN 'BLOCKED' ELSE 'READY' END AS name, count(*)::DOUBLE AS value FROM why UNION ALL SELECT 'reason', experiment, reason, NULL FROM why", "results", extra=_REVIEWS)),
    "contract_differences": (contract_differences, """SELECT p_partkey AS part, '$.contrast.resize.size' AS path, concat(p_size, '.0') AS trained, concat(p_size + 1, '.0') AS dataset FROM part WHERE p_size % 4 = 0
 UNION ALL SELECT p_partkey, '$.contrast.gamma', '0.9', NULL FROM part WHERE p_partkey % 5 = 0
 UNION ALL SELECT p_partkey, '$.steps[1]', '"gaussian"', '"median"' FROM part WHERE p_partkey % 3 = 0"""),
    "flat_metrics": (flat_metrics, sql("SELECT experiment, score, n, (score + 1)::DOUBLE AS pothole_mAP50, (score + 2)::DOUBLE AS crack_mAP50, score::DOUBLE AS manhole_mAP50 FROM results", "results")),
    "run_states": (run_states, """SELECT run, CASE WHEN b AND l AND c THEN 'complete' WHEN l THEN 'resumable' ELSE 'empty' END AS state FROM (
 SELECT o_custkey AS run, bool_or(o_orderkey % 4 = 0) AS b, bool_or(o_orderkey % 4 = 1) AS l, bool_or(o_orderkey % 4 = 2) AS c FROM orders GROUP BY 1)"""),
    "latest_orders": (latest_orders, "SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderpriority DESC) = 1"),
    "latency_after_warmup": (latency_after_warmup, sql("""SELECT stream_id AS experiment, CASE WHEN max(c) > 5 THEN count_if(k > 5) ELSE count(*) END::BIGINT AS n_samples, CASE WHEN max(c) > 5 THEN avg(CASE WHEN k > 5 THEN conf_pct END) ELSE avg(conf_pct) END AS mean_ms
 FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame) AS k, count(*) OVER (PARTITION BY stream_id) AS c FROM frames) GROUP BY stream_id""", "frames")),
    "suite_row_pooled": (suite_row_pooled, sql("""SELECT videos, frames, tp, fp, fn, confirmed, unconfirmed, mean_ms, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM (
 SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM (
 SELECT count(*) AS videos, count(*) AS frames, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count_if(tp > 1)::BIGINT AS confirmed, count_if(tp <= 1)::BIGINT AS unconfirmed, avg(frame_id % 50) AS mean_ms FROM (SELECT frame_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts GROUP BY frame_id) WHERE tp + fn > 0))""", "pred", "classes", recursive=True, extra=_GREEDY)),
}
