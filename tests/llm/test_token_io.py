from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from skeinwork.llm import token_io  # noqa: E402
from skeinwork.llm.common import slices, utf8  # noqa: E402
from skeinwork.llm.perfect_hash import PerfectHash, packed, unpacked  # noqa: E402
from skeinwork.llm.queries import byte_bpe_path, queries  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return tokenizers.Tokenizer.from_file(byte_bpe_path())


def _expected(model, rows):
    out, at = [], 0
    for i, t in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_tokenizer(spark, small, model, texts):
    got = queries()["op1_token_ids"](spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == _expected(model, texts.items())


def test_chunks_are_tokenized_as_whole_texts(model):
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "23", "'s", "n't", "'", ".", ",", " x", "\x1c", "\x85", "日本", "😀", "<|endoftext|>", "-", "\r\n", "\xa0", " ", "　", "à", "​", " ", "©"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(5000)]
    e = token_io.Encoder(byte_bpe_path(), np.dtype("<u2"), most=200)  # so small that it is emptied again and again
    got = []
    for _, _, part, o in slices(*utf8(pa.array(texts)), 4000):
        ids, n = e.encode(part, o, 2)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [x.ids + [2] for x in model.encode_batch(texts, add_special_tokens=False)]


def test_store_gives_back_every_document(spark, small_docs, model, texts, tmp_path):
    manifest = token_io.write(small_docs, str(tmp_path / "s"), byte_bpe_path(), shard_bytes=100_000).collect()
    assert len(manifest) > 3
    store = token_io.Store(str(tmp_path / "s"), manifest)
    for i in (0, 57, 199):
        assert store.get(i).tolist() == model.encode(texts[i], add_special_tokens=False).ids + [2]
    assert [store.get(i) for i in (-1, 200, 10**12)] == [None] * 3
    got = token_io.read(spark, str(tmp_path / "s"), manifest).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == _expected(model, texts.items())
    left = tmp_path / "s" / "shard-000001-of-a-lost-attempt.ids"
    left.write_bytes(b"x")
    token_io.clean(str(tmp_path / "s"), manifest)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == sorted(m["file"] + kind for m in manifest for kind in (".ids", ".idx"))


def test_store_in_another_order(spark, small_docs, model, texts, tmp_path):
    from pyspark.sql import functions as F

    placed = small_docs.withColumn("place", F.pmod(F.col("doc_id") * 0.377317, F.lit(1.0)))
    manifest = token_io.write(placed, str(tmp_path / "s"), byte_bpe_path(), shard_bytes=100_000, order="place").collect()
    assert len(manifest) > 3
    got = [r["doc_id"] for r in token_io.read(spark, str(tmp_path / "s"), manifest).orderBy("start").collect()]
    assert got == [r["doc_id"] for r in placed.orderBy("place").collect()]
    store = token_io.Store(str(tmp_path / "s"), manifest)
    for i in (0, 57, 199):
        assert store.get(i).tolist() == model.encode(texts[i], add_special_tokens=False).ids + [2]


def test_rows_of_a_repeated_doc_id_spread(spark, documents, model):
    rows = [(4, f"text number {k} " * 40) for k in range(300)] + [(None, f"another {k}" * 30) for k in range(100)] + [(9, "last"), (-1, "first")]
    manifest = None
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        manifest = token_io.write(documents(rows), d, byte_bpe_path(), shard_bytes=20_000).collect()
        assert max(m["n_rows"] for m in manifest) < 120
        got = token_io.read(spark, d, manifest).orderBy("start").collect()
    want = Counter((i, zlib.crc32(np.array(model.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_very_long_texts_are_encoded_in_pieces(model):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdefé日") for _ in range(rnd.randrange(1, 9))) for _ in range(4000)) + "x" * 3000
    e = token_io.Encoder(byte_bpe_path(), np.dtype("<u2"))
    found = list(e.pieces(*utf8(pa.array([text])), 2, 500))
    assert len(found) > 20
    assert np.concatenate([ids for ids, _ in found]).tolist() == model.encode(text, add_special_tokens=False).ids + [2]
    assert [len(ids) for ids, _ in found] == [n for _, n in found]


def test_odd_documents(odd, model):
    from tests.llm.conftest import ODD as rows

    got = token_io.tokenize(odd, byte_bpe_path()).orderBy("start").collect()
    want = sorted((i is not None, i or 0, len(model.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == want
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert got[0]["doc_id"] is None


def test_empty_table(nothing):
    assert token_io.tokenize(nothing, byte_bpe_path()).count() == 0


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 50_000))
    h = PerfectHash.build(keys)
    h = PerfectHash(*(unpacked(packed(h.arrays()))[k] for k in ("words", "starts", "prints")))
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    assert (h.lookup(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert PerfectHash.build(np.empty(0, np.int64)).lookup(np.array([5])).tolist() == [-1]
    with pytest.raises(ValueError, match="repeat"):
        PerfectHash.build(np.array([1, 1]))
