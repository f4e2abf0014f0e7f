"""Queries of capture groups and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions.annotations import group_key
from skeinwork.operators import neardup, splitting
from skeinwork.plans import views as v
from skeinwork.plans.views import sql
from skeinwork.session import checkpointed
from skeinwork.sources.pixels import inspected

_KEY = r"""keys AS (SELECT doc_id, filename, CASE WHEN regexp_matches(st, '^rh_(train|valid)_.+$') THEN concat('rh_', regexp_replace(regexp_extract(st, '^rh_(?:train|valid)_(.+)$', 1), '(_aug_.+|_augmented)$', ''))
 WHEN regexp_matches(st, '^(?i:vlcsnap)[-_][0-9]{4}-[0-9]{2}-[0-9]{2}[-_][0-9]{2}[hH]') THEN concat('session_', regexp_extract(st, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))
 WHEN regexp_matches(st, '^[0-9]{8}([_-]|$)') THEN concat('session_', st[1:4], '-', st[5:6], '-', st[7:8]) WHEN regexp_matches(st, '^(?i:vlcsnap)-[0-9]+') THEN 'vlcsnap_unsequenced' ELSE concat('file_', st) END AS capture_group
 FROM (SELECT *, regexp_replace(filename, '\.[^.]*$', '') AS st FROM files))"""


def group_keys(s, d):
    return v.filenames(s, d).select("doc_id", "filename", group_key(F.col("filename")).alias("capture_group"))


def groups_by_session(s, d):
    return group_keys(s, d).groupBy("capture_group").agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_doc"))


def group_assignment(s, d):
    rows = group_keys(s, d).select(F.col("capture_group").alias("group_key"), F.col("doc_id").alias("image"), (F.col("doc_id") % 3).alias("class_id"))
    return splitting.assign(splitting.group_vectors(rows))


def phash_bits(s, d):
    return v.phashes(s, d)


def phash_pairs(s, d):
    """Signatures of different labels within 18 bits; the random signatures of this table have none within 8."""
    return neardup.hamming_pairs(v.phashes(s, d), "vec_id", 18, "label").select("vec_id_a", "vec_id_b", "distance")


def near_dup_components(s, d):
    """Labels that near signatures connect, with the smallest label of each component as root."""
    p = neardup.hamming_pairs(v.phashes(s, d), "vec_id", 18, "label")
    edges = p.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    return neardup.components(v.phashes(s, d).select(F.col("label").alias("node")), edges)


def _pictures(s, d):
    """Embeddings as PNG files of 16 by 16 grey squares of four pixels, rows filtered in turn; every ninth has lost its end,
    every eleventh a bit."""
    import numpy as np
    import pandas as pd

    from skeinwork.sources.pixels import png_bytes

    def draw(batches):
        for pdf in batches:
            files = []
            for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                x = np.resize(np.asarray(e, float), 256).reshape(16, 16)
                grey = np.clip(np.rint(128 + 100 * x), 0, 255).astype(np.uint8).repeat(2, 0).repeat(2, 1)
                b = png_bytes(grey[:, :, None], [i % 5, 4, 3, 1, 2])
                files.append(b[: len(b) // 2] if i % 9 == 5 else b[:60] + bytes([b[60] ^ 1]) + b[61:] if i % 11 == 7 else b)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "content": files})

    rows = v.table(s, d, "embeddings").select("vec_id", "embedding")
    n = 4 * s.sparkContext.defaultParallelism  # a file of one row group would be drawn and read by one task
    return rows.repartition(n, "vec_id").mapInPandas(draw, "vec_id long, content binary")


def picture_hashes(s, d):
    """Pictures' verdicts and hashes, from their bytes."""
    return inspected(_pictures(s, d), "vec_id")


def picture_near_duplicates(s, d):
    """Whole pictures' groups by hashes within ten bits: each with the smallest of its group."""
    whole = checkpointed(picture_hashes(s, d).where("ok").select("vec_id", "sig_hi", "sig_lo"))
    return neardup.near_components(whole, "vec_id", 10)


def banded_hamming_pairs(s, d):
    return neardup.hamming_pairs(v.planted_signatures(s, d), "sig_id", 8)


_PAIRS = "pairs AS (SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, CAST(bit_count(xor(a.sig_hi, b.sig_hi)) + bit_count(xor(a.sig_lo, b.sig_lo)) AS INT) AS distance, a.label AS la, b.label AS lb FROM phash a JOIN phash b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE bit_count(xor(a.sig_hi, b.sig_hi)) + bit_count(xor(a.sig_lo, b.sig_lo)) <= 18)"
_CLOSURE = _PAIRS + ", ed AS (SELECT la AS a, lb AS b FROM pairs UNION SELECT lb, la FROM pairs), reach(node, to_) AS (SELECT DISTINCT label, label FROM phash UNION SELECT r.node, e.b FROM reach r JOIN ed e ON r.to_ = e.a)"

QUERIES = {
    "group_keys": (group_keys, sql("SELECT doc_id, filename, capture_group FROM keys", "files", extra=_KEY)),
    "groups_by_session": (groups_by_session, sql("SELECT capture_group, count(*) AS n_files, min(doc_id) AS first_doc FROM keys GROUP BY 1", "files", extra=_KEY)),
    "group_assignment": (group_assignment, None),
    "phash_bits": (phash_bits, sql("SELECT vec_id, label, sig_hi, sig_lo FROM phash", "phash")),
    "phash_pairs": (phash_pairs, sql("SELECT vec_id_a, vec_id_b, distance FROM pairs", "phash", extra=_PAIRS)),
    "near_dup_components": (near_dup_components, sql("SELECT node, min(to_) AS root FROM reach GROUP BY node", "phash", recursive=True, extra=_CLOSURE)),
    "picture_hashes": (picture_hashes, None),
    "picture_near_duplicates": (picture_near_duplicates, None),
    "banded_hamming_pairs": (banded_hamming_pairs, sql("SELECT a.sig_id AS sig_id_a, b.sig_id AS sig_id_b, CAST(bit_count(xor(a.sig_hi, b.sig_hi)) + bit_count(xor(a.sig_lo, b.sig_lo)) AS INT) AS distance FROM sigs a JOIN sigs b ON a.sig_id < b.sig_id WHERE bit_count(xor(a.sig_hi, b.sig_hi)) + bit_count(xor(a.sig_lo, b.sig_lo)) <= 8", "sigs")),
}
