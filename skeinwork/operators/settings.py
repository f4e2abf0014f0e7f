"""Nested settings compared path by path, as Spark's variant has them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KIND = "schema_of_variant(v)"


def paths(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value: every leaf of a JSON text, objects by name and lists by position; empty ones are leaves.

    Numbers are compared as numbers (1 is 1.0), all else as JSON. A level of nesting is a step; keys in any order give the
    same paths."""
    level = documents.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.parse_json(F.col(text)).alias("v"))
    leaves = []
    while True:
        nested = F.expr(f"({_KIND} LIKE 'OBJECT<%' AND {_KIND} <> 'OBJECT<>') OR ({_KIND} LIKE 'ARRAY<%' AND to_json(v) <> '[]')")
        number = F.expr(f"{_KIND} LIKE 'DECIMAL%' OR {_KIND} IN ('BIGINT', 'DOUBLE', 'FLOAT')")
        shown = F.when(number, F.expr("variant_get(v, '$', 'double')").cast("string")).otherwise(F.to_json("v"))
        leaves.append(level.where(~nested).select("key", "path", shown.alias("value")))
        inner = level.where(nested)
        if not inner.limit(1).count():
            break
        level = documents.sparkSession.sql("SELECT d.key, d.path, t.pos, t.key AS name, t.value AS v FROM {d} d, LATERAL variant_explode(d.v) t", d=inner)
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("name")))
        level = level.select("key", F.concat("path", step).alias("path"), "v")
    return reduce(DataFrame.unionByName, leaves)


def differences(trained: DataFrame, dataset: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, trained, dataset: leaves that differ between what a model was trained with and its dataset's manifest; what
    one side lacks differs, too. Without a row here the two contracts agree."""
    a, b = paths(trained, key, text).withColumnRenamed("value", "trained"), paths(dataset, key, text).withColumnRenamed("value", "dataset")
    return a.join(b, ["key", "path"], "full_outer").where(~F.col("trained").eqNullSafe(F.col("dataset")))


def class_map_problems(documents: DataFrame, key: str, text: str, names: dict[int, str]) -> DataFrame:
    """key, path, found, wanted: classes of a model's settings (an object `classes` of id and name) unlike the names given."""
    spark = documents.sparkSession
    found = paths(documents, key, text).where("path like '$.classes.%'").withColumnRenamed("value", "found")
    wanted = spark.createDataFrame([(f"$.classes.{i}", f'"{n}"') for i, n in names.items()], "path string, wanted string")
    every = documents.select(F.col(key).alias("key")).join(F.broadcast(wanted), F.lit(True))  # a row per document and class
    return every.join(found, ["key", "path"], "full_outer").where(~F.col("found").eqNullSafe(F.col("wanted")))
