"""The pipeline against plain versions of its decisions."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline as cp  # noqa: E402
from skeinwork.llm import mixing  # noqa: E402
from skeinwork.llm.common import range_hash  # noqa: E402
from skeinwork.llm.queries import byte_bpe_path  # noqa: E402
from tests.llm.conftest import ODD  # noqa: E402
from tests.llm.test_dedup import _components, _sets  # noqa: E402
from tests.llm.test_mixing_and_benchmark import _expected  # noqa: E402


def test_stages_and_contract():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert cp.ORACLE_SQL is None


def test_decisions_take_effect(spark, small, small_docs, tmp_path):
    docs, kept = small_docs, []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, small)
        assert k == len(cp.STAGES) - 1 or out.columns == small_docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([(r["doc_id"], r["text"] if "text" in r else None) for r in docs.collect()])
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    lettered = {i for i, t in rows if any(c.isalpha() for c in t or "")}
    assert {i for i, _ in kept[0]} <= lettered
    assert len(kept[0]) > 0.98 * len(lettered)
    few = sorted(lettered, key=lambda i: len(dict(rows)[i]))[:60]  # the shortest are the hardest
    assert {i for i, _ in kept[0]} & set(few) == _called(small_docs.collect(), few)
    alone = {i for i, _, c in _components(_sets(kept[0], 5), 8, 10) if i == c}
    assert {i for i, _ in kept[1]} == alone
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {i for i, _ in kept[2]} == {r[0] for r in _expected(kept[1], items) if not r[5]}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    times = db.execute(f"SELECT doc_id, count(*) FROM ({mixing.ORACLE_SQL}) GROUP BY 1").fetchall()
    assert Counter(i for i, _ in kept[3]) == dict(times)
    model = tokenizers.Tokenizer.from_file(byte_bpe_path())
    source = {r["doc_id"]: r["source"] for r in small_docs.collect()}
    want, at = [], 0
    ties = {r[0]: r[1] for r in small_docs.select("doc_id", range_hash()).collect()}
    for i in _in_order([i for i, _ in kept[3]], source, ties):
        ids = np.array(model.encode(dict(kept[3])[i], add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want
    again = cp.run(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == want


def _called(docs, few):
    """Those of a few documents that plain PPM calls with at least half of the posterior."""
    counts = Counter()
    for r in docs:
        if r["text"] is not None and r["lang"] is not None:
            b = r["text"].encode()
            counts.update((r["lang"], b[i : i + d]) for d in range(1, 6) for i in range(len(b) - d + 1))
    trees = {}
    for (lang, gram), n in counts.items():
        trees.setdefault(lang, {}).setdefault(gram[:-1], {})[gram[-1]] = n
    out = set()
    for r in docs:
        if r["doc_id"] in few:
            b, bits = r["text"].encode(), []
            for tree in trees.values():
                total = 0.0
                for i, x in enumerate(b):
                    for k in range(min(4, i), -1, -1):
                        c = tree.get(b[i - k : i])
                        if c:
                            n, d = sum(c.values()), len(c)
                            total += math.log2((n + d) / c.get(x, d))
                            if x in c:
                                break
                    else:
                        total += 8
                bits.append(total)
            if 1 / sum(2.0 ** max(-1000.0, min(bits) - x) for x in bits) >= 0.5:
                out.add(r["doc_id"])
    return out


def _in_order(ids, source, ties):
    """The copies of documents, one of each in an epoch, by the hash of seed, epoch and doc_id; sources over each other."""
    at = []
    for i, n in Counter(ids).items():
        at += [(e + int(hashlib.md5(f"7:{e}:{i}".encode()).hexdigest()[:15], 16) / 2.0**60, i) for e in range(n)]
    end = {}
    for x, i in at:
        end[source[i]] = max(x, end.get(source[i], 0))
    return [i for _, _, i in sorted((x / end[source[i]], ties[i], i) for x, i in at)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows_and_keep_columns(spark, small, odd, nothing, stage):
    """Null, empty, repeated and very long texts, null and repeated doc_ids, clashing columns; and no rows at all."""
    from pyspark.sql import functions as F

    name, run = cp.STAGES[stage]
    docs = odd
    for c in ("__key", "__text", "__letter", "__d", "__n", "language", "sure", "unit", "times", "copy", "place", "text_key", "unclean", "unit_source", "epoch", "hash", "at", "range"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = run(spark, docs, small)
    assert run(spark, docs.where("false"), small).count() == 0
    if name == "token_ids":
        assert got.count() == len(ODD)
        assert {r["n_tokens"] for r in got.collect() if r["doc_id"] in (1, 2)} == {1}
        return
    assert got.columns == docs.columns
    rows = got.collect()
    assert {(r["__key"], r["copy"], r["place"], r["times"]) for r in rows} == {("mine",) * 4}
    ids = Counter(r["doc_id"] for r in rows)
    if name == "language_id":
        assert not set(ids) & {1, 2, 3, 4}
    if name == "near_duplicates":
        assert ids == Counter([1, 2, 3, 4, 5, 6, 6, 8, 9, 10, 10, None])
    if name == "decontamination":
        assert ids == Counter(i for i, _ in ODD)
    if name == "mixing":
        assert set(ids) <= {i for i, _ in ODD}
        assert sum(len((r["text"] or "").split()) for r in rows) <= sum(len((t or "").split()) for _, t in ODD)
