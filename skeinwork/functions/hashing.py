"""Digests and perceptual hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_bits(values: Column, first: int, last: int) -> tuple[Column, Column]:
    """Two 32-bit halves of the 64 bits value > median of values[first..last] (1-based), first value highest.

    The median of an even number is the mean of the two in the middle."""
    n = last - first + 1
    middle = F.sort_array(F.slice(F.transform(values, lambda x: x.cast("double")), first, n))
    median = (F.get(middle, F.lit((n - 1) // 2)) + F.get(middle, F.lit(n // 2))) / 2

    def half(start: int) -> Column:
        part = F.slice(values, start, 32)
        bits = lambda m: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x.cast("double") > m, F.lit(1)).otherwise(F.lit(0)).cast("long")))
        return F.get(F.transform(F.array(median), bits), F.lit(0))  # as a variable: the values are sorted once, not for each of them

    return half(1), half(33)


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def source_fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a tree of files (path, content): of the digests of its folders, each of its files' names and SHA-256 in
    order, so no row holds more than one folder's files or all folders. Caches are left out, and so is the `path:` line of
    text configurations, which says where the tree lies."""
    config = F.col("path").rlike(r"\.ya?ml$")
    content = F.when(config, F.regexp_replace(F.col("content").cast("string"), r"(?m)^path:[^\n]*\n?", "").cast("binary")).otherwise(F.col("content"))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    each = files.where(~F.col("path").rlike(r"\.cache$")).select(F.regexp_replace("path", r"[^/]*$", "").alias("folder"), F.concat_ws("\x00", name, F.sha2(content, 256)).alias("file"))
    digest = lambda c: F.sha2(F.concat_ws("\x01", F.sort_array(F.collect_list(c))), 256)
    folders = each.groupBy("folder").agg(digest("file").alias("sha"))
    return folders.agg(digest(F.concat_ws("\x00", "folder", "sha")).alias("fingerprint"))


def config_version(config: dict, fingerprint: str, seed: int) -> str:
    """Ten hexadecimal digits of what a materialised dataset depends on."""
    text = json.dumps({"config": config, "source": fingerprint, "seed": seed}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:10]
