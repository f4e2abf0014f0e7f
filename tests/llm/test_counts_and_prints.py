"""Token counts and fingerprints."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import pyarrow as pa
import pytest

from skeinwork.llm import fingerprints as fp
from skeinwork.llm.common import utf8
from skeinwork.llm.queries import byte_ranks_path, queries
from skeinwork.llm.token_counts import UnigramCounter, count_tokens, piece_score, read_ranks

PRETOKENS = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= [^\x20\x09-\x0D])|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(byte_ranks_path())


def _plain(ranks, token):
    """Fewest tokens of the best segmentation, by the textbook recurrence."""
    best = [(0, 0)]
    for e in range(1, len(token) + 1):
        best.append(max((best[s][0] + piece_score(ranks[token[s:e]]), best[s][1] - 1) for s in range(max(0, e - 128), e) if token[s:e] in ranks))
    return -best[-1][1]


def test_counts_equal_the_plain_recurrence(ranks):
    c, rnd = UnigramCounter(ranks, most=50), random.Random(4)
    parts = [" ", "a", "the", "\n", "ing", "é", "  ", "zq", "x" * 80, ".", "0", "\0", " Is"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(300)]
    pre, tok = c.texts(*utf8(pa.array(texts)))
    for t, p, n in zip(texts, pre, tok, strict=True):
        words = PRETOKENS.findall(t.encode())
        assert (p, n) == (len(words), sum(_plain(ranks, w) for w in words)), t


def test_counts_of_long_pretokens(ranks, monkeypatch):
    """Texts without spaces, runs of one mark and random letters, of 50 kB and more, against the plain recurrence."""
    rnd = random.Random(6)
    han = "".join(chr(rnd.randrange(0x4E00, 0x4F00)) for _ in range(17_000))
    mixed = "".join(rnd.choice(["的", "我们", "a", "0x", "==", "日本", "é"]) for _ in range(3000))
    texts = [han, "=" * 3000, "".join(rnd.choice("0123456789abcdef") for _ in range(3000)), mixed, "x" * 65]
    monkeypatch.setattr("skeinwork.llm.token_counts.WINDOW", 1000)
    c = UnigramCounter(ranks)
    pre, tok = c.texts(*utf8(pa.array(texts)))
    assert pre.tolist() == [1] * 5
    assert tok.tolist() == [_plain(ranks, t.encode()) for t in texts]
    whole = " ".join(texts)
    assert [x.tolist() for x in c.texts(*utf8(pa.array([whole])))] == [x.tolist() for x in c.texts(*utf8(pa.array([whole])), most=4000)]


def test_query_counts_whole_texts(spark, small, ranks, texts):
    got = {r["doc_id"]: r for r in queries()["op2_token_counts"](spark, small).collect()}
    assert len(got) == len(texts)
    known = {}
    for i in (0, 5, 77):
        words = PRETOKENS.findall(texts[i].encode())
        want = sum(known.setdefault(w, _plain(ranks, w)) for w in words)
        assert (got[i]["n_bytes"], got[i]["n_pretokens"], got[i]["n_tokens"]) == (len(texts[i].encode()), len(words), want)


def test_counts_of_odd_documents(odd, nothing):
    got = count_tokens(odd, byte_ranks_path()).collect()
    assert len(got) == 13
    assert {(r["n_bytes"], r["n_pretokens"], r["n_tokens"]) for r in got if r["doc_id"] in (1, 2)} == {(0, 0, 0)}
    assert next(r for r in got if r["doc_id"] == 9)["n_pretokens"] == 1
    assert "text" not in got[0].asDict()
    assert "position" in got[0].asDict()
    assert count_tokens(nothing, byte_ranks_path()).count() == 0


def _mixed(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


GEAR = [(_mixed(((k + 1) * 0x9E3779B97F4A7C15 + (1 << 44)) & (1 << 64) - 1) | 1) >> 32 for k in range(256)]


def _plain_print(text):
    """The chunks of a text, byte by byte: a set of byte strings."""
    b, out, p = text.encode(), set(), 0
    while p < len(b):
        end = min(len(b), p + 80)
        for q in range(p + 7, min(len(b), p + 80)):  # a chunk has 8 bytes at least
            h = sum(GEAR[x] << 4 * (7 - k) for k, x in enumerate(b[q - 7 : q + 1])) & 0xFFFFFFFF
            n = q - p + 1
            if h >> (32 - (6 if n < 28 else 3)) == 0:
                end = q + 1
                break
        out.add(b[p:end])
        p = end
    return out


def _plain_likeness(a, b):
    if not a:
        return float(not b)
    return sum(map(len, a & b)) / sum(map(len, a))


def _expected(rows):
    """Rows of compare_neighbours, by one loop over (doc_id, text) in order: without the prints themselves."""
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + following[:n]
        a, b, c = map(_plain_print, (t, following, e))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), _plain_likeness(a, c), _plain_likeness(a, b), len(a), len(c)))
    return out


def _row(r):
    return (r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], *(len(base64.b64decode(r[c])) // 8 for c in ("fingerprint", "edited_fingerprint")))


@pytest.mark.parametrize("settings", [{}, {"spark.sql.exchange.reuse": "false"}, {"spark.sql.adaptive.enabled": "false"}])
@pytest.mark.parametrize("range_bytes", [20_000, 1 << 30])
def test_neighbours_meet_across_ranges(spark, small_docs, texts, range_bytes, settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = [_row(r) for r in fp.compare_neighbours(small_docs, range_bytes).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == _expected([(i, t or "") for i, t in texts.items()])


def test_neighbours_of_repeated_doc_ids(documents):
    """Hundreds of rows of one doc_id and without one lie in several ranges and still follow each other once round."""
    rows = [(4, f"text {k} " * 40) for k in range(200)] + [(None, f"none {k} " * 30) for k in range(90)] + [(2**60 + 1, "a"), (2**60, "b"), (-5, "c")]
    whole = sorted(_row(r) for r in fp.compare_neighbours(documents(rows).where("doc_id is not null"), 1 << 30).collect())
    assert sorted(_row(r) for r in fp.compare_neighbours(documents(rows).where("doc_id is not null"), 5000).collect()) == whole
    got = sorted((_row(r) for r in fp.compare_neighbours(documents(rows), 5000).collect()), key=str)
    assert got == sorted((_row(r) for r in fp.compare_neighbours(documents(rows), 1 << 30).collect()), key=str)
    assert len(got) == len(rows)


def test_prints_of_a_very_long_text_are_those_of_the_whole():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh é") for _ in range(9000)) + "x" * 3000
    data, offs = utf8(pa.array([text]))
    assert (fp.fingerprints(data, offs, 500)[0] == fp.fingerprints(data, offs)[0]).all()
    assert len(fp.fingerprints(data, offs)[0]) == len(_plain_print(text))


def test_prints_are_shift_resistant():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    a, b, c = fp._of([text, "some new words in front " + text, "".join(rnd.choice("ijklmnop ") for _ in range(5000))])
    assert fp.containment(a, b) > 0.97
    assert fp.containment(a, c) == 0
    assert fp.weight(a) == 5000
    assert (fp._of(["q", text])[1] == a).all()


def test_prints_of_odd_documents(odd, nothing, documents):
    got = fp.compare_neighbours(odd).collect()
    assert len(got) == 13
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["n_chars"], first["fingerprint"], first["near_edited"], first["near_next"]) == (0, "", 1.0, 1.0)
    assert fp.compare_neighbours(nothing).count() == 0
    alone = fp.compare_neighbours(documents([(4, "just this one text")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(4, 1.0)]
