"""Suffix-array removal and the n-gram join, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skeinwork.llm import blocks, ngram_join, suffix_dedup, suffix_sort
from skeinwork.llm.queries import queries
from skeinwork.llm.suffix_sort import common_prefixes, suffix_array


@pytest.mark.parametrize("rows", [1 << 16, 7])
def test_suffixes_are_sorted(monkeypatch, rows):
    monkeypatch.setattr(suffix_sort, "ROWS", rows)
    rnd = random.Random(3)
    for _ in range(200):
        letters = rnd.choice([b"a", b"ab", b"abc\0", bytes(range(256))])
        text = bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 300)))
        if rnd.random() < 0.4:
            text += text[: len(text) // 2] + b"a" * 70 + text
        x = np.frombuffer(text + b"\0", np.uint8)
        marked = np.array([rnd.random() < 0.6 for _ in x])
        marked[-1] = False
        order = suffix_array(x, marked)
        assert sorted(order) == np.flatnonzero(marked).tolist()
        keys = [(text + bytes(60))[i : i + 56] for i in order]
        assert keys == sorted(keys)
        want = [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(keys, keys[1:])]
        assert common_prefixes(order, x, 50)[1:].tolist() == want


def _removed(rows, length=50):
    """doc_id, bytes, removed, runs, digest of what is left; rows in doc_id order, null last."""
    seen, out = set(), []
    for group in _by_id(rows):
        new = set()
        for i, t in group:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                gone[p : p + length] |= w in seen
                new.add(w)
            out.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        seen |= new
    return sorted(out, key=str)


def _by_id(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[float("inf") if i is None else i].append((i, t))
    return [by[k] for k in sorted(by)]


def test_removal_query(spark, small, texts):
    got = sorted((tuple(r) for r in queries()["op6_suffix_dedup"](spark, small).collect()), key=str)
    assert got == _removed(texts.items())


def test_removal_over_many_small_blocks(documents, monkeypatch):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcde") for _ in range(5)) for _ in range(50)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    rows = []
    for i in range(120):
        own = " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))
        rows.append((i, rnd.choice([own, passage[rnd.randrange(50) :] + own, own + passage[: rnd.randrange(120)], "=" * rnd.randrange(300), passage])))
    rows += [(None, passage + "!"), (5, passage), (5, "z" * 60)]
    rows += [(2**63 - 1, passage + "??"), (2**63 - 1, "x" + passage + "??"), (-3, passage[10:])]
    monkeypatch.setattr(suffix_dedup, "sizes", lambda d: 13)
    for length in (50, 16, 90):
        got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(documents(rows), length).collect()), key=str)
        assert got == _removed(rows, length)


def test_removal_from_very_long_texts(documents, monkeypatch):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcd ") for _ in range(9000))
    rows = [(1, long), (2, long[4000:] + "!" + long[:3000]), (3, "x" * 5000 + long[100:300]), (4, "x" * 400)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(documents(rows)).collect()), key=str)
    assert got == _removed(rows)


def test_removal_of_odd_documents(odd, nothing):
    from tests.llm.conftest import ODD

    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(odd).collect()), key=str)
    assert got == _removed(ODD)
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(odd, with_text=True).collect()}
    assert kept[7] == b""
    assert kept[5] == b"Word"


def _sets(rows, width):
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def _components(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        common = Counter(j for t in sets[i] for j in held[t])
        for j, n in common.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for t in sets[i]:
            held[t].append(i)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def test_join_query(spark, small, texts):
    got = {tuple(r) for r in queries()["op7_ngram_join"](spark, small).collect()}
    assert got == _components(_sets(texts.items(), 3), 90, 100)


def _copies(n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(5, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rnd.choice(base)) if rnd.random() < 0.8 else [rnd.choice(words) for _ in range(rnd.randrange(1, 60))]
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t) if rnd.random() < 0.9 else " ".join(t).upper()))
    return rows


@pytest.mark.parametrize(("width", "num", "den", "rare", "spread"), [(3, 9, 10, 0.5, 64), (2, 8, 10, 0.0, 3), (5, 8, 10, 0.9, 3), (1, 1, 2, 0.0, 64)])
def test_join_of_many_copies(documents, monkeypatch, width, num, den, rare, spread):
    rows = _copies(300, width)
    monkeypatch.setattr(ngram_join, "sizes", lambda d: 9)
    got = {tuple(r) for r in ngram_join.near_duplicates(documents(rows), width, num, den, rare, spread).collect()}
    assert got == _components(_sets(rows, width), num, den)


@pytest.mark.parametrize("most", [0, 100])
def test_rows_of_hubs(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", most)
    rows = spark.createDataFrame([(i, i % 7, i, 0) for i in range(300)] + [(5, 5, 5, 0)] * 2, "a long, b long, ca long, cb long")
    got = ngram_join._of_hubs(rows, spark.createDataFrame([(2,), (5,), (9,)], "b long"))
    assert sorted(got.columns) == sorted(rows.columns)
    assert sorted(r["a"] for r in got.collect()) == sorted([*(i for i in range(300) if i % 7 in (2, 5)), 5, 5])


@pytest.mark.parametrize(("num", "den"), [(8, 10), (9, 10), (1, 2)])
def test_two_linked_sets_have_a_key_in_common(num, den):
    """For sets of all sizes, classes at random: linked ones share a rare token or a combination, and keys stay few."""
    rnd = np.random.default_rng(5)
    for n in [*range(1, 12), *rnd.integers(12, 1500, 40).tolist()]:
        pool = np.unique(rnd.integers(1, 1 << 62, 2 * n + 4).astype(np.uint64))
        rnd.shuffle(pool)
        class_of = dict(zip(pool.tolist(), np.where(rnd.random(len(pool)) < rnd.choice([0.02, 0.4, 1.0]), 130 + rnd.integers(0, 3, len(pool)), rnd.integers(1, 3, len(pool))).tolist(), strict=True))
        a = pool[:n]
        for gone in range(n - -(-n * num // den) + 1):
            left = n - gone  # tokens that both have; the second set's own ones as many as the link allows
            more = rnd.integers(0, max(0, left * den // num - n) + 1)
            b = np.concatenate((a[gone:], pool[n : n + more]))
            if left * den < num * (n + more) or not left:
                continue
            tokens = np.concatenate((np.sort(a), np.sort(b)))
            size = np.array([len(a), len(b)])
            class_ = np.array([class_of[t] for t in tokens.tolist()], np.uint8)
            alone = np.isin(tokens, a[: rnd.integers(0, gone + 1)])  # tokens of the first set only
            held = size - np.array([alone.sum(), 0])
            key, of, combined, _ = ngram_join.prefix_keys(tokens[~alone], class_[~alone], held, size, num, den)
            assert set(key[of == 0].tolist()) & set(key[of == 1].tolist())
            assert len(key) <= 14 * size.sum() + 20


def test_frequent_comes_from_the_data():
    assert ngram_join.first_frequent(np.array([], np.int64), 0.25) == 1
    holders = np.array([2] * 50 + [3] * 20 + [10] * 10 + [500])
    assert ngram_join.first_frequent(holders, 0.0) == 3
    assert ngram_join.first_frequent(holders, 0.25) == 11
    assert ngram_join.first_frequent(np.concatenate((holders, [500, 500, 500])), 0.05) == 4


def test_counts_of_tokens_are_whole():
    low, count = np.arange(5, dtype=np.uint32), np.array([1, 254, 255, 256, 70_000])
    got = ngram_join._uncounted(ngram_join._counted(low, count))
    assert got[0].tolist() == low.tolist()
    assert got[1].tolist() == count.tolist()


def test_rows_of_one_document_have_all_its_links(documents, monkeypatch):
    """Two texts of one doc_id, each with a copy elsewhere, over several blocks."""
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice("abcdefghij") * 3 + str(rnd.randrange(99)) for _ in range(40))
    one, two, other = text(), text(), text()
    rows = [(10, one), (10, two), (20, one), (30, two + " z"), (40, other), (5, two), (None, one), (None, other)]
    for n in (1, 7, 50):
        monkeypatch.setattr(ngram_join, "sizes", lambda d, n=n: n)
        got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(documents(rows), 3, 8, 10).collect()}
        assert got == {(10, 5), (20, 5), (30, 5), (5, 5), (40, 40), (None, None)}


def test_join_of_odd_documents(odd, nothing):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd, 3, 9, 10).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (7, 13, 6), (6, 13, 6), (9, 1, 9)} <= got
    assert (8, 1, 8) in got
    assert {c for i, _, c in got if i is None} == {None}
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(odd).collect())
    assert kept == sorted(["1", "2", "3", "4", "5", "6", "6", "8", "9", "10", "10", "None"])


def test_components_need_no_order(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in blocks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got}
    assert {x for e in edges for x in e if e[0] != e[1]} <= set(got)
