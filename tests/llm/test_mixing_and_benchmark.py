"""Mixing, decontamination and personal data."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from skeinwork.llm import decontaminate, mixing, pii
from skeinwork.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


@pytest.mark.parametrize("name", ["op10_decontamination", "op8_mixing"])
def test_same_rows_as_sql(spark, small, tmp_path, name):
    queries()[name](spark, small).write.parquet(str(tmp_path / "got"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    db.execute(f"CREATE TABLE want AS {oracle_sql()[name]}")
    cols = ", ".join(sorted(r[0] for r in db.execute("DESCRIBE want").fetchall()))
    n, = db.execute("SELECT count(*) FROM want").fetchall()[0]
    assert db.execute(f"SELECT count(*) FROM '{tmp_path}/got/*.parquet'").fetchall()[0][0] == n > 0
    assert db.execute(f"SELECT count(*) FROM (SELECT {cols} FROM '{tmp_path}/got/*.parquet' EXCEPT ALL SELECT {cols} FROM want)").fetchall()[0][0] == 0


def _mix_docs(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 7), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture_keeps_entropy_budget_and_limit(spark):
    d = _mix_docs(spark, {"big": 900, "mid": 90, "small": 9, None: 3})
    total = Counter()
    for r in d.collect():
        total[r["source"] or ""] += len(r["text"].split())
    for entropy, repeats in ((0.5, 100.0), (0.9, 100.0), (0.99, 3.0)):
        got = mixing.mix(d, entropy, repeats, block_rows=20).collect()
        tokens, budget = Counter(), sum(total.values())
        for r in got:
            tokens[r["source"]] += r["n_tokens"]
        weights = [n / sum(tokens.values()) for n in tokens.values()]
        h = -sum(w * math.log(w) for w in weights)
        assert sum(tokens.values()) <= budget + 4
        assert sum(tokens.values()) > budget - 4 * 7 * 4
        worst = max(tokens[s] / total[s] for s in total)
        assert worst < repeats + 0.4
        assert h >= entropy * math.log(4) - 0.05 or abs(worst - repeats) < 0.5
        # whole epochs are whole permutations, starts are running sums
        by = defaultdict(list)
        for r in got:
            by[r["source"]].append(r)
        for source, rows in by.items():
            rows.sort(key=lambda r: (r["start"], r["n_tokens"]))
            assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
            n = len({r["doc_id"] for r in d.collect() if (r["source"] or "") == source})
            last = max(r["epoch"] for r in rows)
            assert all(len({r["doc_id"] for r in rows if r["epoch"] == e}) == n for e in range(last))


def test_mixture_is_the_same_again_and_differs_by_epoch(spark):
    d = _mix_docs(spark, {"a": 200, "b": 5})
    one, two = (sorted(map(tuple, mixing.mix(x, 1.0, 50.0).collect())) for x in (d, d.repartition(7)))
    assert one == two
    b = [r for r in one if r[2] == "b"]
    orders = {e: tuple(r[0] for r in sorted(b, key=lambda r: r[6]) if r[3] == e) for e in range(2)}
    assert sorted(orders[0]) == sorted(orders[1])


def test_mixture_of_odd_documents(odd, nothing):
    got = mixing.mix(odd).collect()
    assert {r["doc_id"] for r in got} >= {5, 8, 10}
    again = mixing.mixed(odd)
    assert again.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in again.collect()).count("6") == 2
    assert mixing.mix(nothing).count() == 0


def _expected(rows, items):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(i)
    sizes, out = {len(w) for w in wins}, []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = wins.get(tuple(w[k : k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_windows_of_all_sizes(spark, documents, broadcast_bytes):
    rnd = random.Random(11)
    words = [f"W{k}" for k in range(12)] + ["É", "über", "7"]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 13, 14, 30, 0, 13])] + [(4, None), (None, "w1 W2 w3 w4 w5"), (0, "W1"), (8, "w1-w2,W3")]
    rows = []
    for i in range(60):
        t = [rnd.choice(words) for _ in range(rnd.randrange(50))]
        if rnd.random() < 0.6:
            part = (rnd.choice(items)[1] or "").split()
            t[rnd.randrange(len(t) + 1) : 0] = part
        rows.append((i, rnd.choice((" ", "; ", "\n")).join(t)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    c = decontaminate.contamination(documents(rows), bench, broadcast_bytes=broadcast_bytes)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in c.collect()), key=str)
    assert got == _expected(rows, items)


def test_benchmark_and_odd_documents(spark, odd, nothing):
    from tests.llm.conftest import ODD

    items = [(1, "twice over and long enough to be more than fifty bytes"), (2, "Ab ab ab"), (3, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.digest(odd, bench).collect()), key=str) == _expected(ODD, items)
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "9", "10", "10", "None"])
    assert decontaminate.digest(nothing, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.where("false")).count() == 13


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    parts = ["1", "23", ".", "@", "a", "+", "-", " ", "(", ")", "_", "4111111111111111", "255", "é", "\n", "c.d", "@e.f"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(22)))
        assert pii.base_spans(t) == _base(t), t


def test_long_runs_are_searched_in_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000, "a" * 100_000 + "@" + "b" * 100_000):
        pii.base_spans(t)


def test_query_keeps_base_spans(spark, small, texts):
    got = {r["doc_id"]: r for r in queries()["op9_pii"](spark, small).collect()}
    for i, t in texts.items():
        base = _base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[i]["spans"].split(","))


@pytest.fixture(scope="module")
def field(spark, small):
    return pii.train(spark.read.parquet(small.replace("0.001", "0.1") + "/documents.parquet"))


def _planted(rnd, kind):
    n = rnd.randrange
    if kind == "email":
        return f"{rnd.choice(['joe', 'anna.b', 'x.y'])}{n(1, 99)}@mail{n(1, 9)}.example.com"
    if kind == "ip":
        return ".".join(str(n(1, 255)) for _ in range(4))
    if kind == "phone":
        return f"+1 ({n(100, 999)}) 555-{n(1000, 9999)}"
    body = "4" + "".join(str(n(10)) for _ in range(14))
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_field_finds_spellings_that_the_patterns_miss(field, texts, kind):
    """Whole spans, of numbers and names never seen, in the words of documents; nine in ten of each kind at least."""
    rnd, hits, n = random.Random(kind), 0, 0
    plain = [t for t in texts.values() if t and len(t) > 500 and not pii.zones(t)]
    for way in pii.SPELLINGS[kind]:
        for _ in range(40):
            t, span = rnd.choice(plain), way(_planted(rnd, kind))
            p = t.index(" ", rnd.randrange(400))
            text = f"{t[:p]} {span}{t[p:]}"
            assert not any(s < p + 1 + len(span) and p + 1 < e and (s, e) == (p + 1, p + 1 + len(span)) for _, s, e in pii.base_spans(text))
            hits += (kind, p + 1, p + 1 + len(span)) in pii.find(text, field)[1]
            n += 1
    assert hits >= 0.9 * n


def test_field_leaves_numbers(field):
    found = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t, field)[1]]
    assert found("please call (017) 555-7713 now") == [("phone", "(017) 555-7713")]
    for t in ("version 2.0 of 2024-01-05 10:30", "pages 100-200, 300-400 and 1999-2004", "order 1234567", "id 4111111111111112 here"):
        assert found(t) == []


def _segmentations(pieces, spans, at=0):
    """All ways to give each piece to no span or to one."""
    if at == pieces:
        yield []
        return
    for rest in _segmentations(pieces, spans, at + 1):
        yield rest
    for c, (i, j, *_) in enumerate(spans):
        if i == at:
            for rest in _segmentations(pieces, spans, j):
                yield [c, *rest]


def test_sums_and_best_equal_all_segmentations():
    rnd = random.Random(3)
    texts = ["call 12 34.56 +78 (90) 12 34 now", "a@b.cd at x dot y 1.2.3.4", "4111 1111 1111 1111", "plain words only", "1 at 2 dot 3 dot 4"]
    found = [pii.candidates(t, 0, len(t)) for t in texts]
    spans = [(z, i, j) for z, (_, c) in enumerate(found) for i, j, _ in c]
    scores = np.array([rnd.uniform(-2, 2) for _ in spans])
    total, chance = pii.Lattice(np.array(spans), len(texts), max(len(p) for p, _ in found)).sums(scores)
    at = 0
    for z, (pieces, c) in enumerate(found):
        own = scores[at : at + len(c)]
        ways = list(_segmentations(len(pieces), c))
        weights = [math.exp(sum(own[k] for k in w)) for w in ways]
        assert math.isclose(total[z], math.log(sum(weights)), abs_tol=1e-9)
        for k in range(len(c)):
            assert math.isclose(chance[at + k], sum(x for x, w in zip(weights, ways) if k in w) / sum(weights), abs_tol=1e-9)
        at += len(c)
        weights_of = {}
        for i, j, kind in c:
            for f in pii.features(texts[z], pieces[i][0], pieces[j - 1][1], kind):
                weights_of.setdefault(f, rnd.uniform(-1, 1.2))
        f = pii.SemiMarkovField(weights_of)
        value = lambda w: sum(f.score(pii.features(texts[z], pieces[c[k][0]][0], pieces[c[k][1] - 1][1], c[k][2])) for k in w)  # noqa: E731, B023
        got = f.best(texts[z], 0, len(texts[z]))
        score = sum(f.score(pii.features(texts[z], s, e, kind)) for kind, s, e in got)
        assert math.isclose(score, max(map(value, ways)), abs_tol=1e-9)


def test_zones_of_a_dense_text_all_teach():
    text = " ".join(f"joe{k}@mail.example.com, +1 ({100 + k}) 555-{1000 + k};" for k in range(60)) + " words " * 100 + "129.38.82.17 end"
    own = pii._labelled(text)
    assert sum(len(spans) for _, spans in own) == len(pii.base_spans(text)) == 121
    assert all(len(t) < 3 * pii.ZONE_CHARS for t, _ in own)
    assert all(pii.base_spans(t[s:e])[0][0] == k for t, spans in own for k, s, e in spans)


def test_personal_data_of_odd_documents(odd, nothing):
    field = pii.train(odd)
    got = pii.detect(odd, field).collect()
    assert len(got) == 13
    assert {r["spans"] for r in got} == {""}
    assert pii.detect(nothing, pii.train(nothing)).count() == 0
