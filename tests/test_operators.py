from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import audit, experiments, neardup, precision, quality, sampling, settings, signatures, splitting, stats, tracking
from skeinwork.plans import quality as quality_plans
from skeinwork.schema import SPLITS


def test_duplicates_and_conflicts(spark):
    rows = [(f"u{i}.jpg", f"m{i}", "a") for i in range(3)] + [("c1.jpg", "mc", "a"), ("c2.jpg", "mc", "b"), ("same_b.jpg", "ms", "a"), ("same_a.jpg", "ms", "a")]
    got = {r["name"]: r["outcome"] for r in quality.with_outcome(spark.createDataFrame(rows, "name string, content_md5 string, signature string")).collect()}
    assert got == {"u0.jpg": "kept", "u1.jpg": "kept", "u2.jpg": "kept", "c1.jpg": "conflict", "c2.jpg": "conflict", "same_a.jpg": "kept", "same_b.jpg": "duplicate"}


def test_integrity_gate_names_each_fault(spark):
    images = spark.createDataFrame(
        [("train", "a", True, "d1", "g1"), ("val", "b", True, "d1", "g2"), ("val", "c", False, "d3", "g1"), ("test", "a", True, "d4", "g4")], "split string, stem string, ok boolean, digest string, group_key string"
    )
    labels = spark.createDataFrame([("train", "a"), ("val", "b"), ("val", "c"), ("test", "x")], "split string, stem string")
    boxes = spark.createDataFrame([("val", "b", 1, "clipped", False), ("val", "c", 1, "valid", False)], "split string, stem string, line_no int, status string, changed boolean")
    got = {(r["item"], r["error"]) for r in quality.integrity_errors(images, labels, boxes).collect()}
    assert got == {("a", "missing_label"), ("x", "orphan_label"), ("c", "unreadable_image"), ("b:1", "invalid_box"), ("d1", "leakage_by_digest"), ("a", "leakage_by_stem"), ("g1", "leakage_by_group_key")}


def test_audit_counts_one_line_twice_and_bears_missing_files(spark):
    lines = ["0 0.5 0.5 0.2 0.2", "0 nan 0.5 0.2 0.2", "1 0.5 0.5 -inf 0.2", "9 0.5 0.5 0.2 0.2", "1 1.5 0.5 0 0.2", "1 x 0.5 0.2 0.2", "1 0.5 0.5 0.2", "2 0.95 0.5 0.2 0.2", "2 0.5 0.5 1.000005 0.2", "+1 1_0e-1 .5 0.2 1."]
    d = spark.createDataFrame([("train", x) for x in lines], "split string, raw string")
    images = spark.createDataFrame([("train", "a", "d1", "g1"), ("val", "b", "d2", "g2")], "split string, stem string, digest string, group_key string")
    labels = spark.createDataFrame([("train", "a"), ("val", "c")], "split string, stem string")
    r = audit.audit(d, images, labels).first().asDict()
    # nan is out of bounds, too; so is an infinity, which is a size of no extent here; a corner over the edge is none
    assert [r[c] for c in audit.COUNTERS] == [1, 4, 2, 3, 1]
    assert (r["total_valid_objects"], r["missing_labels"], r["missing_images"], r["is_valid"]) == (7, 1, 1, False)
    good = d.where("raw like '0 0.5%' or raw like '2 0.95%'")
    assert audit.audit(good, images, labels).first()["is_valid"] is True  # missing files are told only
    leaky = images.withColumn("digest", F.lit("same"))
    r = audit.audit(good, leaky, labels).first()
    assert (r["digest_overlaps"], r["is_valid"]) == (1, False)


def _plain_ap(points, n):
    """Area under the envelope: at each confidence the best precision at that recall or more."""
    curve, tp, seen = [], 0, 0
    for c in sorted({c for c, _ in points}, reverse=True):
        own = [t for x, t in points if x == c]
        tp, seen = tp + sum(own), seen + len(own)
        curve.append((sum(own), tp / seen))
    return sum(t * max(p for _, p in curve[k:]) for k, (t, _) in enumerate(curve)) / n


def test_average_precision_against_a_plain_loop(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(2), rnd.choice([rnd.random(), 0.5, 0.25]), int(rnd.random() < 0.6)) for _ in range(400)]
    points = spark.createDataFrame(rows, "class_id int, confidence double, tp long").repartition(5)
    n = {0: 200, 1: 150}
    got = precision.curve(points, spark.createDataFrame(list(n.items()), "class_id int, n long")).groupBy("class_id").agg(F.sum(F.col("tp") * F.col("envelope")).alias("area"))
    for r in got.collect():
        assert r["area"] / n[r["class_id"]] == pytest.approx(_plain_ap([(c, t) for k, c, t in rows if k == r["class_id"]], n[r["class_id"]]))
    none = spark.createDataFrame([], "frame_id long, pred_id long, class_id int, x1 int, y1 int, x2 int, y2 int, confidence double")
    gt = spark.createDataFrame([(1, 1, 0, 0, 0, 9, 9)], "frame_id long, box_id long, class_id int, x1 int, y1 int, x2 int, y2 int")
    assert {r["class_name"]: (r["n_gt"], r["ap"]) for r in precision.average_precision(gt, none).collect()} == {"pothole": (1, 0.0), "crack": (0, None), "manhole": (0, None)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof_against_a_plain_loop(spark, width):
    rnd = random.Random(width)
    left = [(rnd.randrange(3), rnd.randrange(200), k) for k in range(150)]
    right = [(rnd.randrange(4), rnd.randrange(200), rnd.choice([None, rnd.randrange(9)]), rnd.choice("xy")) for _ in range(40)]
    a, b = spark.createDataFrame(left, "s long, t int, k long").repartition(4), spark.createDataFrame(right, "s long, t int, v int, w string")
    got = {tuple(r) for r in tracking.asof(a, b, "s", "t", ["v", "w"], width).select("s", "t", "k", "v", "w").collect()}
    want = set()
    for s, t, k in left:
        before = [(u, -1 if v is None else v, w) for x, u, v, w in right if x == s and u <= t]
        at = max(before, default=None)
        want.add((s, t, k, None if at is None or at[1] == -1 else at[1], at and at[2]))
    assert got == want


def test_nested_settings_by_path(spark):
    a = ['{"a": {"b": [1, {"c": null}], "d": "1"}, "e": [], "f": true}', '{"x": 1}', "[1, [2]]"]
    b = ['{"e": [], "f": true, "a": {"d": 1, "b": [1.0, {"c": null}, 3]}}', '{"x": 1.0}', "[[2], 1]"]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "k int, j string")
    got = {tuple(r) for r in settings.differences(frame(a), frame(b), "k", "j").collect()}
    assert got == {(0, "$.a.d", '"1"', "1.0"), (0, "$.a.b[2]", None, "3.0"), (2, "$[0]", "1.0", None), (2, "$[0][0]", None, "2.0"), (2, "$[1]", None, "1.0"), (2, "$[1][0]", "2.0", None)}
    names = spark.createDataFrame([("m", '{"classes": {"0": "pothole", "1": "crock", "7": "x"}}')], "k string, j string")
    assert {tuple(r) for r in settings.class_map_problems(names, "k", "j", {0: "pothole", 1: "crack", 2: "manhole"}).collect()} == {
        ("m", "$.classes.1", '"crack"', '"crock"'), ("m", "$.classes.2", '"manhole"', None), ("m", "$.classes.7", None, '"x"'),
    }


def test_one_raw_row_or_none_is_told(spark):
    d = spark.createDataFrame([("a", "raw", 3.0), ("b", "x", 4.0)], "experiment string, preprocessing string, m double")
    assert {tuple(r) for r in experiments.deltas(d, ["m"]).collect()} == {("a", 0.0), ("b", 1.0)}
    for bad in (d.where("experiment = 'b'"), d.unionByName(d)):
        with pytest.raises(Exception, match="raw rows"):
            experiments.deltas(bad, ["m"]).collect()


def test_pareto_over_many_partitions(spark):
    rnd = random.Random(8)
    rows = [(str(i), rnd.randrange(60), rnd.randrange(60)) for i in range(300)]
    d = spark.createDataFrame(rows, "experiment string, score int, cost int").repartition(7)
    want = {e for e, s, c in rows if not any(x >= s and y <= c and (x > s or y < c) for _, x, y in rows)}
    assert {r["experiment"] for r in experiments.pareto(d, "score", "cost").collect()} == want


def test_warnings_of_balance(spark):
    sized = spark.createDataFrame([(320, c, float(a)) for c, a in [(0, 10), (0, 5000), (1, 10), (2, 5000), (2, 5000)]] + [(640, 2, 1.0)], "imgsz int, class_id int, area double")
    boxes = spark.createDataFrame([(0, "train")] * 4 + [(1, "train")] * 2 + [(2, "val")], "class_id int, split string")
    got = {r["code"]: (r["severity"], r["value"]) for r in stats.balance_warnings(sized, boxes).collect()}
    assert got == {"MANY_SMALL_OBJECTS_AT_320": ("HIGH", 0.4), "MANY_SMALL_POTHOLE_AT_320": ("HIGH", 0.5), "MANY_SMALL_CRACK_AT_320": ("HIGH", 1.0), "CLASS_IMBALANCE": ("HIGH", 2.0)}


def test_empty_split_and_cross_split_report(spark):
    rows = spark.createDataFrame([("train",), ("val",)], "split string")
    assert [r["split"] for r in quality.empty_splits(rows).collect()] == ["test"]
    matches = spark.createDataFrame([("a", "b", 3), ("a", "c", 2)], "group_a string, group_b string, distance int")
    roots = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "a")], "group_key string, group_root string")
    placed = spark.createDataFrame([("a", "train"), ("b", "val")], "group_root string, split string")
    assert [(r["group_a"], r["group_b"]) for r in quality.near_duplicate_report(matches, roots, placed).collect()] == [("a", "b")]


@pytest.mark.parametrize("n_bands", [1, 2, 3, 5, 9])
def test_hamming_pairs_are_all_pairs(spark, n_bands):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    sig = []
    for b in base:
        for k in (0, 1, 3, 4, 5):
            x = b
            for bit in rnd.sample(range(64), k):
                x ^= 1 << bit
            sig.append(x)
    d = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in enumerate(sig)], "id long, sig_hi long, sig_lo long")
    want = {(i, j, (sig[i] ^ sig[j]).bit_count()) for i, j in product(range(len(sig)), repeat=2) if i < j and (sig[i] ^ sig[j]).bit_count() <= 4}
    assert {tuple(r) for r in neardup.hamming_pairs(d, "id", 4, n_bands=n_bands if n_bands <= 5 else None).collect()} == want


@pytest.mark.parametrize(("n_bands", "width"), [(1, 0), (2, 5), (3, 8), (5, 3), (5, 12), (9, 7)])
def test_hamming_pairs_by_parts_and_tiles(spark, monkeypatch, n_bands, width):
    """Copies, groups, missing signatures; parts cut into tiles, several blocks of a pair of tiles."""
    monkeypatch.setattr(neardup, "TILE", 40)
    monkeypatch.setattr(neardup, "CELLS", 64)
    monkeypatch.setattr(neardup, "_tile", lambda n: 60)
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(12)]
    sig = [base[0]] * 70 + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(7))) for b in base for _ in range(12)]
    rows = [(1000 - i, x >> 32, x & 0xFFFFFFFF, f"g{i % 5}") for i, x in enumerate(sig)]
    want = Counter((min(i, j), max(i, j), n) for (i, a, b, g), (j, c, d, h) in combinations(rows, 2) if g != h and (n := (a ^ c).bit_count() + (b ^ d).bit_count()) <= 8)
    d = spark.createDataFrame([*rows, (5, None, None, "g"), (None, base[0] >> 32, base[0] & 0xFFFFFFFF, "h")], "id long, sig_hi long, sig_lo long, g string")
    got = neardup.hamming_pairs(d, "id", 8, "g", n_bands=n_bands, width=width)
    assert Counter((r["id_a"], r["id_b"], r["distance"]) for r in got.collect()) == want
    assert all(r["g_a"] == f"g{(1000 - r['id_a']) % 5}" and r["g_b"] == f"g{(1000 - r['id_b']) % 5}" for r in got.collect())


def test_hamming_pairs_deal_few_rows_at_any_size():
    """A row goes to tens of parts, not to the hundreds of flips that the bands allow."""
    for n in (10**6, 10**7, 5 * 10**7):
        bands = neardup.bands_for(n, 8)
        assert sum((b + 1) / 2 for b in bands.balls(bands.high)) < 100
        assert bands.work(n) < 2e-3 * n


@pytest.mark.parametrize("tile", [40, 1 << 19])
def test_hamming_pairs_by_equal_bands(spark, monkeypatch, tile):
    """A row is dealt once for each of distance + 1 bands; copies, groups, missing signatures, parts cut into tiles."""
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(signatures, "TILE", tile)
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(12)]
    sig = [base[0]] * 70 + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(7))) for b in base for _ in range(12)]
    rows = [(1000 - i, x >> 32, x & 0xFFFFFFFF, f"g{i % 5}") for i, x in enumerate(sig)]
    d = spark.createDataFrame([*rows, (5, None, None, "g"), (None, base[0] >> 32, base[0] & 0xFFFFFFFF, "h")], "id long, sig_hi long, sig_lo long, g string")
    for group in ("g", None):
        want = Counter((min(i, j), max(i, j), n) for (i, a, b, g), (j, c, d, h) in combinations(rows, 2) if (g != h or not group) and (n := (a ^ c).bit_count() + (b ^ d).bit_count()) <= 8)
        got = neardup.hamming_pairs(d, "id", 8, group).collect()
        assert Counter((r["id_a"], r["id_b"], r["distance"]) for r in got) == want
        assert all(r[f"g_{s}"] == f"g{(1000 - r[f'id_{s}']) % 5}" for r in got for s in "ab" if group)
    told = neardup._told(d, ["id"]).withColumn("mix", F.xxhash64("id"))
    how, n = signatures.deal(told, 8)
    assert n == len(rows) and (how.most > 1) == (tile == 40)
    if tile > 40:
        assert signatures.dealt_out(told, ["id"], how).agg(F.sum(F.size("id"))).first()[0] == 9 * n


def test_near_pairs_by_flips_are_all_pairs(monkeypatch):
    """Whole parts by flips of their other bits, pairs that an earlier band has left out, each pair once."""
    monkeypatch.setattr(signatures, "FLIP", 0)
    monkeypatch.setattr(signatures, "COMPARED", 1e-3)
    signatures.bands_within.cache_clear()
    rng = np.random.default_rng(5)
    sig = np.repeat(rng.integers(0, 1 << 63, 20, dtype=np.uint64), 12)
    for _ in range(7):
        sig = sig ^ (np.uint64(1) << rng.integers(0, 64, len(sig), dtype=np.uint64))
    want = Counter((i, j, n) for i, j in combinations(range(len(sig)), 2) if (n := int(sig[i] ^ sig[j]).bit_count()) <= 8)
    how, got = signatures.Deal(8, 4), Counter()
    for band in range(9):
        part = how.parts(band, sig)
        for value in set(part.tolist()):
            at = np.flatnonzero(part == value)
            some = how.turned(band, sig[at])
            assert signatures.bands_within(len(at), len(at), True, 8, 60)
            got.update((int(at[min(i, j)]), int(at[max(i, j)]), int(n)) for p, q, d in signatures.pairs(some, None, 8, 60, how.before(band)) for i, j, n in zip(p, q, d))
    signatures.bands_within.cache_clear()
    assert got == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(139, 200), (5, 5)]
    nodes = spark.range(0, 210).withColumnRenamed("id", "node")
    got = {r["node"]: r["root"] for r in neardup.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == 100 for i in (*range(100, 140), 200))
    assert got[50] == 50


def test_group_assignment_balances_and_repeats():
    groups = {f"g{i:03d}": [1 + i % 4, *((1 + i % 4) * (i % 3 == c) for c in range(3))] for i in range(300)}
    a = splitting.assignment(groups)
    assert a == splitting.assignment(dict(reversed(groups.items())))
    total = sum(v[0] for v in groups.values())
    for s, want in splitting.RATIOS.items():
        assert abs(sum(groups[k][0] for k in groups if a[k] == s) / total - want) < 0.02


def test_few_groups_are_searched_exhaustively():
    groups = {"a": [70, 7, 7, 7], "b": [15, 1, 1, 1], "c": [15, 2, 2, 2]}
    a = splitting.assignment(groups)
    assert set(a.values()) == set(SPLITS)
    assert a["a"] == "train"
    with pytest.raises(ValueError, match="few"):
        splitting.assignment({"a": [1, 0, 0, 0], "b": [1, 0, 0, 0]})


def test_imbalance_ignores_classes_that_do_not_occur(spark):
    d = spark.createDataFrame([(0, "train")] * 6 + [(1, "train")] * 2 + [(1, "val")], "class_id int, split string")
    got = {r["class_name"]: r for r in stats.class_imbalance(d).collect()}
    assert got["crack"]["train_ratio"] == 3.0
    assert got["manhole"]["objects"] == 0
    assert got["pothole"]["level"] == "HIGH"


def test_fairness_and_review_gates(spark):
    rows = spark.createDataFrame([("A", 10, 1.0), ("B", 4, 1.0)], "experiment string, epochs int, fraction double")
    assert [tuple(r) for r in experiments.unfair(rows, ["epochs", "fraction"], "experiment").collect()] == [("B", "epochs")]
    expected = spark.createDataFrame([("A",), ("B",), ("C",)], "experiment string")
    assert {tuple(r) for r in experiments.expected_problems(rows.unionByName(rows.where("experiment = 'A'")), expected).collect()} == {("A", "repeated"), ("C", "missing")}
    texts = spark.createDataFrame([("A", "nan"), ("B", "1.5"), ("C", "x")], "experiment string, m string")
    assert {r["experiment"] for r in experiments.not_finite(texts, ["m"]).collect()} == {"A", "C"}


def test_pareto_keeps_equal_rows(spark):
    d = spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("c", 6, 2), ("d", 5, 2), ("e", 4, 1)], "experiment string, score int, cost int")
    assert sorted(r["experiment"] for r in experiments.pareto(d, "score", "cost").collect()) == ["a", "b", "c"]


def test_leaders_take_the_first_of_equal_rows(spark):
    d = spark.createDataFrame([("b", 3.0, 9.0), ("a", 3.0, 8.0)], "experiment string, m double, ms double").withColumn("row", F.when(F.col("experiment") == "b", 0).otherwise(1))
    got = {r["metric"]: r["experiment"] for r in experiments.leaders(d, ["m"], ["ms"], "row").collect()}
    assert got == {"m": "b", "ms": "a"}


def test_upsert_keeps_unknown_columns(spark):
    old = spark.createDataFrame([("A", "done", "mine")], "experiment string, status string, extra string")
    new = spark.createDataFrame([("A", "PENDING"), ("B", "PENDING")], "experiment string, status string")
    assert {tuple(r) for r in experiments.upserted(old, new).collect()} == {("A", "done", "mine"), ("B", "PENDING", None)}


def test_warmup_is_kept_where_nothing_else_is(spark):
    rows = [("long", i, float(i)) for i in range(8)] + [("short", i, 1.0) for i in range(3)]
    got = {r["experiment"]: (r["n_samples"], r["mean_ms"]) for r in experiments.latency_after_warmup(spark.createDataFrame(rows, "experiment string, position int, ms double")).collect()}
    assert got == {"long": (3, 6.0), "short": (3, 1.0)}


def test_preprocessing_labels(spark):
    d = spark.createDataFrame([(True, False, True), (False, False, False)], "a boolean, b boolean, c boolean")
    got = [r[0] for r in d.select(experiments.preprocessing_label(*(F.col(c) for c in "abc"))).collect()]
    assert got == ["denoise+brightness", "raw"]


def test_run_states_and_latest(spark):
    files = spark.createDataFrame([("r1", f) for f in ("best.pt", "last.pt", "experiment_config.yaml")] + [("r2", "last.pt"), ("r3", "x")], "run string, file string")
    assert {tuple(r) for r in experiments.run_states(files).collect()} == {("r1", "complete"), ("r2", "resumable"), ("r3", "empty")}
    d = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, t int, v string")
    assert experiments.latest(d, ["k"], "t").first()["v"] == "new"


def test_samples_repeat_and_quotas_hold(spark):
    d = spark.range(100).select(F.col("id"), F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("split"))
    a, b = ([r["id"] for r in sampling.seeded(d, "id", 10, 3).collect()] for _ in range(2))
    assert a == b == sorted(a)
    assert len(set(a)) == 10
    got = sampling.quotas(d, "id", {"train": 3, "val": 2}).collect()
    assert sorted((r["split"], r["id"]) for r in got) == [("train", 0), ("train", 2), ("train", 4), ("val", 1), ("val", 3)]


def test_passages_of_any_number_of_words(spark):
    texts = ["ab cd ef gh ij kl", "ab cd ef gh", "b c", "xab cdx", "", None, "cd ef", "a  b", "ab", "x ab cd ef y", "cd ef gh ij", "lengthy words here", "x engthy word"]
    items = ["ab cd ef gh ij", "b cd ef g", "ab cd ef", "b cd e", "ab cd", "b c", "b", "zz", "", " ", "  ", None, "cd ef", "b cd", "engthy", "engthy word", "lengthy wordx", " words", "here ", "thyy"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [tuple(r) for r in quality_plans.passages(documents, benchmark).collect()]
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(items) if t is not None and p is not None and p in t}
    assert len(got) == len(want)
    assert set(got) == want
    assert quality_plans.passages(documents, benchmark.where("false")).collect() == []


def _plain_assignment(groups):
    """The rule group by group: what a group adds to a split, and a move, worked out anew each time in whole fractions."""
    ratios = {k: Fraction(str(r)) for k, r in splitting.RATIOS.items()}
    total = [sum(v[i] for v in groups.values()) for i in range(4)]
    target = {s: [t * ratios[s] for t in total] for s in SPLITS}
    # distances in units of the target, over a common denominator
    whole = math.lcm(*(math.lcm(max(t, 1).numerator, t.denominator) ** 2 for row in target.values() for t in row))
    part = {s: [int(whole / Fraction(max(t, 1)) ** 2) for t in target[s]] for s in SPLITS}
    held = {s: [0] * 4 for s in SPLITS}

    def added(s, counts, v):
        return sum(p * (100 * ((c + x) ** 2 - c * c) - int(200 * x * t)) for p, c, x, t in zip(part[s], counts, v, target[s], strict=True))

    own, place = Counter(tuple(v) for v in groups.values()), {}
    order = sorted(own, key=lambda v: (-v[0], -sum(v[1:]), v))
    for v in order:
        place[v] = [0, 0, 0]
        for _ in range(own[v]):
            k = min(range(3), key=lambda k: (added(SPLITS[k], held[SPLITS[k]], v), k))
            held[SPLITS[k]] = [a + b for a, b in zip(held[SPLITS[k]], v, strict=True)]
            place[v][k] += 1
    for _ in range(splitting.ROUNDS):
        moved = False
        for v in order:
            for source, there in enumerate(list(place[v])):
                for _ in range(there):
                    left = [a - b for a, b in zip(held[SPLITS[source]], v, strict=True)]
                    saved = added(SPLITS[source], left, v)
                    gain, to = min((added(SPLITS[k], held[SPLITS[k]], v) - saved, k) for k in range(3) if k != source)
                    if gain >= -whole * 100 * Fraction(1, 10**12):
                        break
                    held[SPLITS[source]], held[SPLITS[to]], moved = left, [a + b for a, b in zip(held[SPLITS[to]], v, strict=True)], True
                    place[v][source] -= 1
                    place[v][to] += 1
        if not moved:
            break
    out, left = {}, {v: [s for s, n in zip(SPLITS, place[v], strict=True) for _ in range(n)] for v in own}
    for k in sorted(groups):
        out[k] = left[tuple(groups[k])].pop(0)
    return out


def test_registered_groups_are_assigned_as_one_by_one(spark, small):
    from skeinwork.plans import groups as plans

    keyed = plans.group_keys(spark, small).collect()
    groups = {}
    for r in keyed:
        v = groups.setdefault(r["capture_group"], [0, 0, 0, 0])
        v[0] += 1
        v[1 + r["doc_id"] % 3] += 1
    got = {r["group_key"]: r["split"] for r in plans.group_assignment(spark, small).collect()}
    assert got == _plain_assignment(groups)


def test_no_groups(spark):
    assert splitting.assign(spark.createDataFrame([], "group_key string, images long, c0 long, c1 long, c2 long")).collect() == []


def _error(groups, place):
    score, total = 0.0, [sum(v[i] for v in groups.values()) for i in range(4)]
    for s, i in itertools.product(SPLITS, range(4)):
        t = total[i] * splitting.RATIOS[s]
        score += ((sum(v[i] for k, v in groups.items() if place[k] == s) - t) / max(t, 1)) ** 2
    return score


@pytest.mark.parametrize(("n", "most"), [(100_000, 2), (400, 1), (300, 40), (40, 9), (7, 3)])
def test_any_number_of_groups_is_assigned_as_one_by_one(spark, monkeypatch, n, most):
    monkeypatch.setattr(splitting, "CHUNK", 64)
    monkeypatch.setattr(splitting, "LOOK", 4)
    rnd = random.Random(n)
    groups = {f"g{i}": [rnd.randint(1, most), *(rnd.randint(0, most) for _ in range(3))] for i in range(n)}
    rows = spark.createDataFrame([(k, *v) for k, v in groups.items()], "group_key string, images long, c0 long, c1 long, c2 long").repartition(3)
    got = {r["group_key"]: r["split"] for r in splitting.assign(rows).collect()}
    assert got == splitting.assignment(groups)
    if n > splitting.EXHAUSTIVE:
        assert got == _plain_assignment(groups)
    else:  # no way to use every split makes less error
        ways = [dict(zip(groups, way, strict=True)) for way in itertools.product(SPLITS, repeat=n) if set(way) == set(SPLITS)]
        assert set(got.values()) == set(SPLITS)
        assert _error(groups, got) <= min(_error(groups, w) for w in ways) + 1e-9


def test_mask_boxes_equal_the_kernel(spark):
    import numpy as np

    from skeinwork.functions.kernels import mask_boxes
    from skeinwork.operators import masks

    rnd = np.random.default_rng(4)
    pictures = []
    for k in range(6):
        m = np.zeros((40, 50), int)
        for _ in range(9):
            y, x, h, w = rnd.integers(0, 34), rnd.integers(0, 44), rnd.integers(2, 14), rnd.integers(2, 14)
            m[y : y + h, x : x + w] = 200 if rnd.random() < 0.8 else 0
        pictures.append(m)
    pictures += [np.zeros((5, 5), int), np.full((9, 12), 255)]
    rows = [(k, y, row.tolist()) for k, m in enumerate(pictures) for y, row in enumerate(m)]
    got = masks.mask_boxes(spark.createDataFrame(rows, "mask_id long, y int, grey array<int>").repartition(5), 127, 20)
    assert {(r["mask_id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got.collect()} == {(k, *b[1:]) for k, m in enumerate(pictures) for b in mask_boxes(m.astype(np.uint8), threshold=127, least=20)}


def test_mask_boxes_shuffle_bits_once(spark):
    """One exchange of packed rows whatever the masks: no rounds of joins; masks that cross batches stay whole."""
    from skeinwork.operators import masks

    rows = spark.range(0, 60000).selectExpr("id div 3000 as mask_id", "cast(id % 3000 as int) as y", "array(0, 0, 200, 200, 200, 200, 200, 200, 0, 0, 0) as grey")
    found = masks.mask_boxes(rows, 127, 30)
    assert sorted(tuple(r) for r in found.collect()) == [(k, 2, 0, 8, 3000, 18000) for k in range(20)]
    plan = masks.mask_boxes(rows, 127, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_registered_masks_equal_the_kernel(spark, small):
    import numpy as np

    from skeinwork.functions.kernels import mask_boxes
    from skeinwork.plans import registry
    from skeinwork.plans.views import gt_boxes

    by = {}
    for r in gt_boxes(spark, small).collect():
        m = by.setdefault(r["frame_id"], np.zeros((80, 80), np.uint8))
        m[r["y1"] // 8 : r["y2"] // 8, r["x1"] // 8 : r["x2"] // 8] = 200
    got = {(r["mask_id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in registry.queries()["mask_boxes"](spark, small).collect()}
    assert got == {(k, *b[1:]) for k, m in by.items() for b in mask_boxes(m, threshold=127, least=30)}


def test_other_experiments_than_expected_are_all_that_is_told(spark):
    rows = spark.createDataFrame([("a", "raw", 1.0, 5), ("b", "x", 0.5, 6)], "experiment string, preprocessing string, fraction double, epochs int")
    same, other = rows.select("experiment"), spark.createDataFrame([("a",), ("c",)], "experiment string")
    told = lambda expected: {tuple(r) for r in experiments.fair_problems(rows, ["epochs"], ["fraction"], "experiment", expected).collect()}
    assert told(same) == {("b", "differs:epochs"), ("b", "fraction")}
    assert told(other) == {("b", "unexpected"), ("c", "missing")}
    reviews = rows.select("experiment", F.lit("open").alias("status"), *(F.lit("x").alias(c) for c in ("reviewed_images", "bbox_alignment", "texture_preservation", "representative_failures", "reviewer")))
    assert {tuple(r) for r in experiments.review_reasons(reviews, same).collect()} == {("a", "not_complete"), ("b", "not_complete")}
    assert {tuple(r) for r in experiments.review_reasons(reviews, other).collect()} == {("b", "unexpected"), ("c", "missing")}


def test_unknown_classes_are_errors(spark):
    from skeinwork.functions.geometry import in_frame

    d = spark.createDataFrame([(0, 0.5, 0.5, 0.2, 0.2), (2, 0.95, 0.5, 0.2, 0.2)], "c int, x double, y double, w double, h double")
    cols = [F.col(c) for c in "xywh"]
    assert [r["c"] for r in d.where(in_frame(*cols, F.col("c"))).collect()] == [0]
    for bad in (F.lit(7), F.lit(0.5), F.lit(None).cast("int")):
        with pytest.raises(Exception, match="unsupported class_id"):
            d.where(in_frame(*cols, bad)).collect()
