"""Language identification and quality."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import language_id as li
from skeinwork.llm import quality as q
from skeinwork.llm.common import utf8
from skeinwork.llm.queries import queries


def _bits(counts, order, text, lang):
    """Code length by walking contexts from the longest, symbol by symbol."""
    tree = defaultdict(Counter)
    for (la, gram), n in counts.items():
        if la == lang:
            tree[gram[:-1]][gram[-1]] = n
    b, bits = text.encode(), 0.0
    for i, x in enumerate(b):
        for k in range(min(order, i), -1, -1):
            c = tree.get(b[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                if c[x]:
                    bits += math.log2((n + d) / c[x])
                    break
                bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    order, train = 3, {"en": ["the cat sat on the mat", "a hat"], "fr": ["le chat était là", "la", "aaaa"]}
    counts = Counter((la, t.encode()[i : i + d]) for la, ts in train.items() for t in ts for d in range(1, order + 2) for i in range(len(t.encode()) - d + 1))
    m = li.Model.from_counts(pa.Table.from_pylist([{"lang": la, "depth": len(g), "gram": int.from_bytes(g, "big"), "n": n} for (la, g), n in counts.items()]), order)
    texts = ["the chat", "", "zzz", "là la là", "\0", "日本", "a", "the cat sat on the mat"]
    got = m.code_lengths(*utf8(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [_bits(counts, order, t, la) for la in m.langs], rtol=1e-5)


def test_code_lengths_of_a_very_long_text_in_pieces(small_docs):
    models = li.train(small_docs)
    (m,) = (models._model(f) for f in models.files)
    data, offs = utf8(pa.array(["the quick brown fox é über la maison " * 300]))
    assert np.allclose(m.long_lengths(data, 700), m.code_lengths(data, offs), rtol=1e-6)
    assert np.allclose(models.lengths(data, offs), m.code_lengths(data, offs), rtol=1e-6)


def test_any_number_of_languages_in_groups(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for k in range(40):
        words = ["".join(rnd.choice(list("abcdefghijklmnopé"), 4)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rnd.choice(words, 25)), f"l{k:02d}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (li.train(docs, together=n) for n in (40, 7))
    assert (len(one.files), len(many.files)) == (1, 6)
    assert one.langs == many.langs == sorted({r[2] for r in rows})
    data, offs = utf8(pa.array([r[1] for r in rows[::11]] + ["", "zzz"]))
    assert np.allclose(one.lengths(data, offs), many.lengths(data, offs), rtol=1e-6)
    got = {r["doc_id"]: r["lang_pred"] for r in li.predict(docs, many).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.99


@pytest.mark.parametrize("seed", range(6))
def test_rows_laid_over_each_other(seed):
    rnd = np.random.default_rng(seed)
    n, width = int(rnd.integers(1, 300)), int(rnd.integers(2, 60))
    pairs = sorted({(int(rnd.integers(1, n + 1)), int(rnd.integers(1, width))) for _ in range(int(rnd.integers(1, 3 * n + 2)))})
    parent, symbol = np.array(pairs).T
    base, owner, entry = li.displaced(parent, symbol, n + 1, width)
    want = {p: k for k, p in enumerate(pairs)}
    for p in range(1, n + 1):
        for x in range(width):
            slot = base[p] + x
            assert (int(entry[slot]) if owner[slot] == p else None) == want.get((p, x))


def test_languages_of_held_out_documents(spark, small, texts, small_docs):
    got = {r["doc_id"]: r for r in queries()["op4_language_id"](spark, small).collect()}
    lang = {r["doc_id"]: r["lang"] for r in small_docs.collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_documents(odd, nothing, small_docs):
    m = li.train(small_docs)
    got = li.predict(odd, m).collect()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert li.predict(nothing, m).count() == 0
    empty = li.train(nothing)
    assert {r["lang_pred"] for r in li.predict(odd, empty).collect()} == {"und"}


def test_training_bound_holds_by_language(small_docs):
    n = {r["lang"]: r["count"] for r in li.training_rows(small_docs.select("doc_id", "text", "lang"), 5).groupBy("lang").count().collect()}
    assert all(v < 20 for v in n.values())
    assert set(li.train(small_docs.select("doc_id", "text", "lang"), rows_per_language=50).langs) == {"en", "fr", "de", "es"}


def test_quality_of_held_out_documents(spark, small):
    sf = small.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries()["op5_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    held = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.\nOne two two.\n", "", "###$$$ A|B", "ééé 12", " "]
    every = q.features(*utf8(pa.array(texts)))
    for t, row in zip(texts, every, strict=True):
        assert np.allclose(q.features(*utf8(pa.array([t])))[0], row)
    f = dict(zip(q.FEATURES, every[0], strict=True))
    assert (f["distinct_words"], f["top_word"]) == (3 / 6, 2 / 6)
    assert f["twin_words"] == 0
    assert f["repeated_lines"] == 12 / 26


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = q.AdditiveModel(x[:2000], y[:2000])
    assert np.mean((m.scores(x[2000:]) > 0.5) == y[2000:]) > 0.9
    alone = q.AdditiveModel(x[:2000], y[:2000], pairs=0)
    assert np.mean((alone.scores(x[2000:]) > 0.5) == y[2000:]) < 0.6


def test_quality_of_odd_documents(spark, odd, nothing, small_docs):
    labels = spark.createDataFrame([(0, 1), (5, 0), (0, 1), (8, 1), (None, 1), (9, None), (999, 0)], "doc_id long, quality int")
    m = q.train(small_docs, labels)
    got = q.predict(odd, m).collect()
    assert len(got) == 13
    assert all(0 <= r["score"] <= 1 for r in got)
    assert q.predict(nothing, m).count() == 0
    assert {r["score"] for r in q.predict(odd, q.train(small_docs, labels.where("false"))).collect()} == {0.5}
