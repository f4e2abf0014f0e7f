from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import hashing, kernels
from skeinwork.sources import files, sinks


def png(w: int, h: int, kind: int = 2) -> bytes:
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(w: int, h: int) -> bytes:
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes(9)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "images" / "train"
    d.mkdir(parents=True)
    for name, content in {"b.JPG": jpeg(50, 100), "a.png": png(4, 3), "c.jpeg": b"broken", "d.png": png(0, 3), "e.png": png(2, 2, 4), "notes.txt": b"x", "v.mp4": b"v"}.items():
        (d / name).write_bytes(content)
    return str(tmp_path / "images")


def test_scan_probe_and_leftovers(spark, folder):
    rows = files.probed(files.scan(spark, folder)).orderBy("name").collect()
    assert [(r["name"], r["ok"], r["height"], r["width"], r["channels"], r["reason"]) for r in rows] == [
        ("a.png", True, 3, 4, 3, None), ("b.JPG", True, 100, 50, 3, None), ("c.jpeg", False, None, None, None, "not_an_image"), ("d.png", False, 3, 0, 3, "empty"), ("e.png", False, 2, 2, 2, "channels"),
    ]
    assert [r["name"] for r in files.scan(spark, folder, first=2).select("name").collect()] == ["a.png", "b.JPG"]
    assert {r["path"].rsplit("/")[-1] for r in files.unsupported(spark, folder).collect()} == {"notes.txt", "v.mp4"}
    assert [r["name"] for r in files.videos(spark, folder).select("name").collect()] == ["v.mp4"]
    assert [files.source_kind(spark, x) for x in ("0", "x/y.MOV", "z.png", folder + "/train")] == ["webcam", "video", "image", "image"]


def test_labels_and_companions(spark, tmp_path):
    (tmp_path / "one.txt").write_text("0 0.5 0.5 0.2 0.2\n\nbad line\n")
    from skeinwork.functions.annotations import label_lines

    lines = label_lines(files.label_files(spark, str(tmp_path)))
    assert [(r["stem"], r["line_no"]) for r in lines.orderBy("line_no").collect()] == [("one", 1), ("one", 3)]
    assert files.lenient_boxes(lines).count() == 1
    d = spark.createDataFrame([("/images/x/Images/train/a.b.jpg",), ("/other/a.jpg",)], "path string")
    assert [r[0] for r in d.select(files.companion(F.col("path"), "images", "labels", "txt")).collect()] == ["/images/x/labels/train/a.b.txt", None]


def test_import_keeps_the_first_of_each_content(spark):
    part = lambda *r: spark.createDataFrame(list(r), "name string, stem string, ext string, content_md5 string")
    kept, counters = files.imported({"train": part(("2.jpg", "2", "jpg", "m"), ("1.jpg", "1", "jpg", "m")), "valid": part(("0.jpg", "0", "jpg", "m"), ("9.jpg", "9", "jpg", "n"))})
    assert {r["new_name"] for r in kept.collect()} == {"rh_train_1.jpg", "rh_valid_9.jpg"}
    assert {(r["source_split"], r["n_found"], r["n_kept"], r["n_repeated"]) for r in counters.collect()} == {("train", 2, 1, 1), ("valid", 2, 1, 1)}


def test_reports_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("A", "x")], "experiment string, status string")
    sinks.write_csv(d, str(tmp_path / "r"))
    got = files.csv_rows(spark, str(tmp_path / "r"), ("experiment", "reviewer"))
    assert got.columns == ["experiment", "reviewer", "status"]
    assert not sinks.upsert_csv(spark, got, d.select("experiment"), str(tmp_path / "r"))
    more = spark.createDataFrame([("A",), ("B",)], "experiment string")
    assert sinks.upsert_csv(spark, spark.createDataFrame(got.collect(), got.schema), more, str(tmp_path / "r"))
    assert files.csv_rows(spark, str(tmp_path / "r"), ("experiment",)).count() == 2
    assert files.json_document(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "m.json").write_text('{"per_class": [{"class_id": 0, "mAP50": 0.5}]}')
    assert files.per_class(files.json_document(spark, str(tmp_path / "m.json"))).first()["mAP50"] == 0.5
    assert sinks.markdown(d, "T").splitlines()[2:] == ["| experiment | status |", "|-|-|", "| A | x |"]


def test_versions_appear_whole(spark, tmp_path):
    path = str(tmp_path / "v")
    sinks.replace_version(spark.range(3), path)
    sinks.replace_version(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="boom"):
        sinks.replace_version(spark.range(2).select(F.raise_error(F.lit("boom")).cast("string").alias("x")), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["v"]


def test_only_inner_folders_may_be_reset():
    assert sinks.may_reset("/a/b/c", "/a/b")
    assert not any(sinks.may_reset(p, "/a/b") for p in ("/a/b", "/a", "/a/b/../c", "/a/bc"))


def test_fingerprints_follow_content_and_config(spark):
    d = lambda x: spark.createDataFrame([("p/a", bytearray(b"1")), ("p/b", bytearray(x)), ("p/z.cache", bytearray(x))], "path string, content binary")
    one, two = (hashing.source_fingerprint(d(x)).first()[0] for x in (b"2", b"3"))
    assert one != two
    assert hashing.config_version({"a": 1, "b": 2}, one, 42) == hashing.config_version({"b": 2, "a": 1}, one, 42)
    assert len(hashing.config_version({}, one, 1)) == 10


def test_suite_and_dataset_checks():
    assert files.check_dataset_config({"names": ["pothole", "crack", "manhole"], "train": "x", "val": "y", "test": "z"}) == []
    assert files.check_dataset_config({"names": {0: "pothole"}, "train": "x"}) == ["class map differs", "no path for val", "no path for test"]
    assert files.check_suite({"name": "s", "training": {"e": 1}, "experiments": [{"name": "A"}, {"name": "A"}]}) == ["repeated A"]


def test_mask_parts_touch_at_corners():
    mask = np.zeros((100, 100), np.uint8)
    mask[10:40, 10:30] = mask[60:90, 50:95] = 255
    mask[50, 5] = 255
    assert sorted(kernels.mask_boxes(mask, 50)) == [(0, 10, 10, 30, 40), (0, 50, 60, 95, 90)]
    mask[40:50, 30:40] = 255
    assert sorted(kernels.mask_boxes(mask, 50))[0] == (0, 10, 10, 40, 50)


def test_kernels_keep_flat_images_and_shapes():
    flat = np.full((36, 64, 3), 90, np.uint8)
    for f in (kernels.gaussian_blur, kernels.median_blur, lambda i: kernels.brightness(i, 1.0), lambda i: kernels.resized(i, 64, 36)):
        assert np.array_equal(f(flat), flat)
    box = kernels.letterboxed(flat, 64, 64)
    assert box.shape == (64, 64, 3)
    assert (box[:14] == kernels.PAD).all()
    assert (box[14:50] == 90).all()
    assert kernels.longest_side(flat, 32).shape == (18, 32, 3)
    assert kernels.longest_side(flat, 640) is flat
    assert kernels.brightness(flat, 1.5).max() == 135
    assert kernels.clahe(flat).shape == flat.shape
    out = kernels.process(flat, {"resize": {"target_size": (32, 32)}, "denoise": {"enabled": True, "method": "median"}})
    assert out.dtype == np.float32
    assert abs(out[16, 16, 0] - 90 / 255) < 1e-6
    with pytest.raises(ValueError, match="unknown"):
        kernels.process(flat, {"contrast": {"enabled": True, "method": "x"}})


def test_block_of_gradient_and_its_shift_agree():
    g = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8)
    a, b = kernels.dct_block(g), kernels.dct_block(g + 3)
    assert np.allclose(a.ravel()[1:], b.ravel()[1:], atol=1e-3)


def test_image_rows_go_through_the_stages(spark):
    d = spark.createDataFrame([("a", 4, 6, 3, bytearray(bytes(72)))], "name string, height int, width int, channels int, data binary")
    r = kernels.process_rows(d, {"resize": {"target_size": (8, 8)}, "normalize": {"enabled": False}}).first()
    assert (r["height"], r["width"], r["kind"], len(r["data"])) == (8, 8, "uint8", 192)


def test_augmentation_depends_on_the_image_alone():
    from skeinwork.functions import augment as a

    image = np.arange(40 * 60 * 3, dtype=np.uint32).reshape(40, 60, 3).astype(np.uint8)
    boxes = [(0, 0.5, 0.5, 0.4, 0.4), (2, 0.1, 0.1, 0.19, 0.19)]
    every = {"enabled": True, **{k: {"prob": 1.0} for k in ("flip", "translate", "scale", "rotation", "light", "gamma", "blur_noise")}}
    one, two, other = (a.augmented(n, image, boxes, every) for n in ("x.jpg", "x.jpg", "y.jpg"))
    assert np.array_equal(one[0], two[0])
    assert one[1] == two[1] != other[1]
    assert a.augmented("x", image, boxes, every, split="val")[1] == boxes
    flipped, moved = a.augmented("x", image, boxes, {"enabled": True, "flip": {"prob": 1.0}})
    assert np.array_equal(flipped, image[:, ::-1])
    assert moved == [(0, 0.5, 0.5, 0.4, 0.4), (2, 0.9, 0.1, 0.19, 0.19)]
    with pytest.raises(ValueError, match="rotation"):
        a.augmented("x", image, boxes, {"enabled": True, "rotation": {"prob": 1.0, "range": 30.0}})
    with pytest.raises(ValueError, match="class"):
        a.kept([(7, 0.5, 0.5, 0.1, 0.1)])


class _Failing:
    """A file system whose renames into one place fail, by exception or by false."""

    def __init__(self, fs, target, raises):
        self.fs, self.target, self.raises, self.left = fs, target, raises, 1

    def exists(self, p):
        return self.fs.exists(p)

    def delete(self, p, deep):
        return self.fs.delete(p, deep)

    def rename(self, a, b):
        if b.toString() == self.target.toString() and self.left:
            self.left -= 1
            if self.raises:
                raise OSError("no")
            return False
        return self.fs.rename(a, b)


@pytest.mark.parametrize("raises", [True, False])
def test_a_failed_replacement_keeps_the_old_version(spark, tmp_path, raises):
    from skeinwork.sources import sinks

    path = f"file://{tmp_path}/table"
    sinks.replace_version(spark.range(3), path)

    def swap(fs, new, target, name):
        sinks._swap(_Failing(fs, target, raises), new, target, name)

    with pytest.raises(OSError):
        sinks._replaced(spark, path, lambda beside: spark.range(9).write.parquet(beside), swap)
    assert spark.read.parquet(path).count() == 3
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["table"]
    sinks.replace_version(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["table"]


def test_upserts_write_new_columns_too(spark, tmp_path):
    from skeinwork.sources import sinks

    path = f"file://{tmp_path}/results"
    old = spark.createDataFrame([("a", "1")], "experiment string, score string")
    assert sinks.upsert_csv(spark, old, spark.createDataFrame([("a", "7")], "experiment string, score string"), path) is False
    assert sinks.upsert_csv(spark, old, spark.createDataFrame([("b", "2", "x")], "experiment string, score string, notes string"), path)
    now = spark.read.option("header", True).csv(path)
    assert sorted(map(tuple, now.select("experiment", "score", "notes").collect())) == [("a", "1", None), ("b", "2", "x")]
    now = spark.createDataFrame(now.collect(), now.schema)
    assert sinks.upsert_csv(spark, now, spark.createDataFrame([("a", "9", "y", "z")], "experiment string, score string, notes string, more string"), path)
    assert "more" in spark.read.option("header", True).csv(path).columns


def test_fingerprint_leaves_out_caches_and_where_the_tree_lies(spark):
    from skeinwork.functions.hashing import source_fingerprint

    def of(*files):
        return source_fingerprint(spark.createDataFrame([(p, c.encode()) for p, c in files], "path string, content binary")).first()[0]

    base = of(("a/x.txt", "1"), ("a/y.txt", "2"), ("data.yaml", "path: /here\nnames: 3\n"))
    assert base == of(("data.yaml", "path: /there\nnames: 3\n"), ("a/y.txt", "2"), ("a/x.txt", "1"), ("a/labels.cache", "z"))
    assert base != of(("a/x.txt", "1"), ("b/y.txt", "2"), ("data.yaml", "path: /here\nnames: 3\n"))
    assert base != of(("a/x.txt", "1"), ("a/y.txt", "3"), ("data.yaml", "path: /here\nnames: 3\n"))
    assert base != of(("a/x.txt", "1"), ("a/y.txt", "2"), ("data.yaml", "path: /here\nnames: 4\n"))
