"""Line removal, phrase mining and the filter audit: SQL on the given tables, brute force on odd ones."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import filter_audit, line_dedup, phrases
from skeinwork.llm.queries import oracle_sql, queries
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_phrases", "op13_filter_audit"])
def test_same_rows_as_sql(spark, small, tmp_path, name):
    queries()[name](spark, small).write.parquet(str(tmp_path / "got"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    db.execute(f"CREATE TABLE want AS {oracle_sql()[name]}")
    got = f"SELECT * FROM '{tmp_path}/got/*.parquet'"
    columns = sorted(r[0] for r in db.execute("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in db.execute(f"DESCRIBE {got}").fetchall())
    cols = ", ".join(f'"{c}"' for c in columns)
    for a, b in ((got, "SELECT * FROM want"), ("SELECT * FROM want", got)):
        assert db.execute(f"SELECT {cols} FROM ({a}) EXCEPT ALL SELECT {cols} FROM ({b})").fetchall() == []
    assert db.execute("SELECT count(*) FROM want").fetchall()[0][0] > 0 or name == "op12_phrases"


# lines


def _kept_lines(rows, chars=20, least=3):
    docs = sorted({(i, t or "") for i, t in rows}, key=str)
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc in docs:
        for line in doc[1].split("\n"):
            holders[key(line)].add(doc)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            k = key(line)
            ids = [j for j, _ in holders[k] if j is not None]
            if not (len(k) >= chars and len(holders[k]) >= least and ids and (i is None or i < max(ids))):
                kept.append(line)
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


LINES = [*ODD, (20, "a line of twenty chars\nX"), (21, "\t A LINE of twenty chars\r\nY\n"), (22, "a line of twenty chars"), (22, "a line of twenty chars"), (None, "a line of twenty chars"),
         (23, "é" * 19 + "\n" + "ü" * 20), (24, "ü" * 20 + "\n" + "é" * 19), (25, "Ü" * 20 + "\n" + "é" * 19 + "\nü" + "ü" * 19), (26, "ü" * 20), (None, "no id holds this line at all"),
         (None, "no id holds this line at all\n1"), (None, "no id holds this line at all\n2"), (27, "\n\n"), (30, "twice in one document!!\ntwice in one document!!"), (31, "twice in one document!!")]


def test_lines_of_odd_texts(documents):
    got = line_dedup.without_repeats(documents(LINES), with_text=True).collect()
    assert sorted(map(tuple, got), key=str) == _kept_lines(LINES)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_over_many_blocks(documents, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(line_dedup, "sizes", lambda d: 9)
    pool = [f"line number {k} of the pool, {'x' * rnd.randrange(0, 9)}" for k in range(25)]
    rows = [(rnd.choice([i, i, i, None]), "\n".join(rnd.choice(pool).upper() if rnd.random() < 0.2 else rnd.choice(pool) for _ in range(rnd.randrange(0, 9)))) for i in range(90)]
    got = line_dedup.without_repeats(documents(rows), chars=26, least=4, with_text=True).collect()
    assert sorted(map(tuple, got), key=str) == _kept_lines(rows, 26, 4)


def test_no_lines(nothing):
    assert line_dedup.without_repeats(nothing).collect() == []


def test_line_index_knows_its_keys_and_no_others():
    rng = np.random.default_rng(5)
    key = rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    key[2000:3000, 0] = key[1000:2000, 0]  # 64 bits alone don't tell them apart
    told = [k.tobytes() + np.arange(len(k)).astype(np.int64).tobytes() + np.full(len(k), 2, np.uint32).tobytes() for k in (key[:2500], key[1500:3000])]
    index = line_dedup.LineIndex.unpack(line_dedup.LineIndex.build(told).pack())
    documents, last = index.probe(key)
    assert documents.tolist() == [2] * 1500 + [4] * 1000 + [2] * 500 + [0] * 1000
    assert last[:3000].tolist() == [*range(2500), *range(1000, 1500)]


# phrases


def _phrases(rows, least, longest, first):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    lost = {(lang, p[i : i + m]) for (lang, p), a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * f[lang, p[i : i + m]]}
    by = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in lost:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, own in by.items() for r, (s, a, p, x, y) in enumerate(sorted(own)[:first], 1)}


def _speech(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "é", "日本", "ß", "n b", "x"] + [f"w{k}" for k in range(12)]
    fixed = ["new york city hall is", "of the people", "日本 é ß"]
    rows = []
    for _ in range(150):
        text = "".join(rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) + rnd.choice([" ", " ", "\t ", ", ", ".", "\n", "  "]) for _ in range(rnd.randrange(0, 40)))
        rows.append((rnd.choice(["en", "en", "de", None, "und", "a b"]), text))
    return rows + [("en", None), (None, ""), ("fr", "only once here")]


@pytest.mark.parametrize("split, task_rows, blocks", [(1 << 20, 1 << 20, 1), (60, 300, 7), (0, 50, 4)])
def test_phrases_at_any_split(spark, monkeypatch, split, task_rows, blocks):
    monkeypatch.setattr(phrases, "sizes", lambda d: blocks)
    rows = _speech(blocks)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("block", F.lit(1)).withColumn("a", F.lit("x"))
    got = phrases.collocations(docs, 4, 5, 40, split, task_rows).collect()
    want = _phrases(rows, 4, 5, 40)
    assert len(want) > 60
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_phrases_of_odd_texts_and_none(documents, nothing):
    rows = [*ODD, *((100 + k, "a very long text of the same words " * 30) for k in range(5))]
    got = phrases.collocations(documents(rows)).collect()
    assert {tuple(r) for r in got} == _phrases([(None if t is None else "en", t) for _, t in rows], 100, 5, 2000)
    assert phrases.collocations(nothing).collect() == []


def test_numbers_as_planes():
    for ids in ([], [0], [5, 0, 255], [1 << 42, 3], [65536]):
        assert phrases.unpack(phrases.pack(np.array(ids, np.int64))).tolist() == ids


# audit


def _audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        words = re.findall("[^ \t\n\x0b\x0c\r]+", t)
        fails = "".join(k for k, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t]), strict=True) if bad)
        parts[source or ""].append((fails, i in good, i in toxic))
    out = set()
    for part, docs in parts.items():
        removed = {}
        for o in map("".join, permutations("ABCDE")):
            for k in range(5):
                removed[o, k] = [d for d in docs if o[k] in d[0] and not set(o[:k]) & set(d[0])]
        for (o, k), gone in removed.items():
            kept = len(docs) - sum(len(removed[o, j]) for j in range(k + 1))
            fails = sum(o[k] in d[0] for d in docs)
            shapley = sum(len(x) for (p, j), x in removed.items() if p[j] == o[k])
            out.add((part, o, k + 1, kept, len(gone), fails - len(gone), sum(d[0] == o[k] for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley))
    return out


def test_audit_of_odd_texts(spark, nothing):
    rnd = random.Random(4)
    many = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \n ", many, many + " #", "A" + many, "ABCDEF " + many, "a b " * 150, "a b $" * 150, many + "\x1c\x85 é 日本", "x" * 70_000]
    rows = [(rnd.choice([*range(60), None]), rnd.choice(texts), rnd.choice(["s", None, "", "t|"])) for _ in range(150)]
    labels = [(rnd.choice([*range(60), None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit(1)).withColumn("good", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("digest", F.lit(1))
    got = filter_audit.audit(docs, marks).collect()
    assert {tuple(r) for r in got} == _audit(rows, labels) and len(got) == 600 * len({s or "" for _, _, s in rows})
    assert filter_audit.audit(nothing, marks).collect() == []
    assert filter_audit.audit(docs, marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_many_parts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    rows = [(i, "a b " * (i % 7) * 40, f"s{i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = filter_audit.audit(docs, spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in got} == _audit(rows, [(3, 1, 1)])


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and not table[0].any()
    assert table[0b10001][filter_audit.ORDERS.index("BCDEA")] == 4
