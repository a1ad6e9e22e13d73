"""Listings, sniffing, dates and pictures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.sources import files as fs
from twinweave.sources import images


def png(path, px):
    h, w = px.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in px))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    ramp = np.tile(np.linspace(0, 255, 64), (64, 1))
    png(tmp_path / "up.png", ramp)
    png(tmp_path / "down.png", ramp[:, ::-1])
    png(tmp_path / "up2.png", np.clip(ramp + 3, 0, 255))
    png(tmp_path / "tiny.png", ramp[:8, :8])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.tmp").write_bytes(b"1234")
    return str(tmp_path)


def test_listing_and_heads(spark, folder):
    rows = {r["path"].rsplit("/", 1)[-1]: r["size"] for r in fs.listing(spark, folder).collect()}
    assert set(rows) == {"up.png", "down.png", "up2.png", "tiny.png", "x.tmp"} and rows["x.tmp"] == 4
    kinds = {r[0].rsplit("/", 1)[-1]: r[1] for r in fs.heads(spark, folder).select("path", fs.sniffed(F.col("head"))).collect()}
    assert kinds["up.png"] == "png" and kinds["x.tmp"] is None


def test_image_hashes(spark, folder):
    got = {r["id"].rsplit("/", 1)[-1]: r for r in images.image_hashes(images.read_images(spark, folder)).collect()}
    assert got["up.png"]["dhash"] == 0 and got["down.png"]["dhash"] == -1
    assert got["up.png"]["dhash"] == got["up2.png"]["dhash"] and got["tiny.png"]["dhash"] is None
    assert got["up.png"]["phash"] >= 0


def test_visual_differences(spark, folder):
    img = images.read_images(spark, folder).withColumn("id", F.substring_index("id", "/", -1))
    pairs = spark.createDataFrame([("up.png", "up2.png"), ("up.png", "down.png"), ("up.png", "up.png")], "a string, b string")
    got = {r["b"]: r for r in images.overall_difference(images.visual_differences(pairs, img, with_map=True)).collect()}
    assert got["up.png"]["verdict"] == "identical" and got["up.png"]["ssim"] == pytest.approx(1) and len(got["up.png"]["map"]) == 256 * 256
    assert got["up2.png"]["is_duplicate"] and got["down.png"]["ssim"] < 0 and got["down.png"]["score"] > got["up2.png"]["score"]


def test_small_pictures_stay_small(spark):
    rng = np.random.default_rng(1)
    rows = [(i, w, h, c, rng.bytes(w * h * c)) for i, (w, h, c) in enumerate([(32, 40, 3), (300, 200, 1), (600, 500, 3), (700, 520, 4)])]
    img = spark.createDataFrame(rows, "id long, width int, height int, n_channels int, data binary")
    kept = {r["id"]: r for r in images.reduced(img).collect()}
    square = 256 * 256 * 3 * 4
    assert [len(kept[i]["data"]) for i in range(4)] == [32 * 40 * 3, 300 * 200, square, square]
    pairs = spark.createDataFrame([(0, 2), (1, 3), (2, 3), (1, 1)], "a long, b long")
    got = {(r["a"], r["b"]): r for r in images.visual_differences(pairs, img, with_map=True).collect()}

    def planes(i):
        _, w, h, c, data = rows[i]
        px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
        return np.stack([images.resample(px[:, :, k if c > 1 else 0], 256, 256) for k in range(3)]).astype(np.float32).astype(float)

    assert set(got) == {(0, 2), (1, 3), (2, 3), (1, 1)}
    for (a, b), r in got.items():
        apart = np.sqrt(((planes(a) - planes(b)) ** 2).sum(0))
        bins = [np.histogramdd(planes(i).reshape(3, -1).T, bins=16, range=[(0, 256)] * 3)[0] / 65536 for i in (a, b)]
        assert r["mean_difference"] == pytest.approx(apart.mean()) and r["max_difference"] == pytest.approx(apart.max())
        assert r["histogram_distance"] == pytest.approx(np.abs(bins[0] - bins[1]).sum()) and len(r["map"]) == 65536


def test_grid_hash(spark):
    rng = np.random.default_rng(0)
    g = rng.random((8, 9))
    want = int("".join("1" if g[i, j] > g[i, j + 1] else "0" for i in range(8) for j in range(8)), 2)
    got = spark.createDataFrame([(g.ravel().tolist(),)], "g array<double>").select(images.grid_hash(F.col("g"))).first()[0]
    assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("d,want", [(0.0, [0.0]), (0.04, [0.0]), (0.5, [0.0, 0.4]), (1.5, [0.0, 0.5]), (2.0, [0.0, 1.0]), (10.0, [0.0, 5.0, 9.0])])
def test_sample_times(spark, d, want):
    assert spark.range(1).select(images.sample_times(F.lit(d))).first()[0] == pytest.approx(want)


def test_exclude_rules(spark):
    paths = ["/a/.hidden", "/a/b.app", "/x/Dropbox/f.jpg", "/System/x", "/a/tmpfile", "/a/ok.jpg", "/a/f.cache", "/a/Lightbox/q.jpg"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").filter(~fs.excluded()).collect()]
    assert got == ["/a/ok.jpg"]
    one = spark.createDataFrame([("/a/ok.jpg",), ("/a/okxjpg",)], "path string")
    assert one.filter(fs.Exclude("glob", "*.jpg").matches()).count() == 2
    assert one.filter(fs.Exclude("glob", "*.jpg").matches(strict_glob=True)).count() == 1


def test_dates(spark):
    df = spark.createDataFrame([("2024:01:02 03:04:05",), ("2024-01-02T03:04:05Z",), ("no",)], "s string")
    assert [r[0] for r in df.select(fs.parse_exif_date(F.col("s"))).collect()] == [1704164645, 1704164645, None]


def test_rules_of_a_table(spark):
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    paths = [*{"/" + text(rng.randrange(12)) for _ in range(150)}, None, ""]
    rules = [(rng.choice(["prefix", "suffix", "contains"]), text(rng.randrange(4, 8))) for _ in range(12)] + [("prefix", None), ("glob", "aa")]
    test = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__}
    want = [p for p in paths if p is None or not any(t is not None and k in test and test[k](p, t) for k, t in rules)]
    got = fs.excluded_by_table(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rules, "kind string, text string"))
    assert sorted((r["path"] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert fs.excluded_by_table(got, spark.createDataFrame([], "kind string, text string")).count() == len(want)
    assert fs.excluded_by_table(got, spark.createDataFrame([("suffix", "")], "kind string, text string")).count() == 1
