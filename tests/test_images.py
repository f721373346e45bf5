"""Image kernels by hand values, and sources over a small tree of files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import images
from cohortloom.sources import tables


def test_padding():
    x = np.full((100, 80), 90, np.uint8)
    x[:7], x[95:], x[:, :1] = 3, 10, 0
    assert images.padding_bounds(x) == (7, 95, 0, 80)
    x[:40] = 3
    assert images.padding_bounds(x)[0] == 20
    x[:40] = 13
    assert images.padding_bounds(x)[0] == 0
    spots = np.full((100, 100), 90, np.uint8)
    spots[:5] = 0
    spots[:5, :3] = 25  # three of a hundred are not dark
    assert images.padding_bounds(spots) == (0, 100, 0, 100)
    spots[:5, 2] = 0
    assert images.padding_bounds(spots) == (5, 100, 0, 100)
    assert images.padding_bounds(np.zeros((9, 9), np.uint8)) == (0, 9, 0, 9)


def test_shrink():
    x = np.arange(64.0).reshape(8, 8)
    assert np.allclose(images.shrink(x, 4, 2), x.reshape(4, 2, 2, 4).mean((1, 3)))
    assert images.shrink(x, 3, 3).mean() == pytest.approx(x.mean()) and np.allclose(images.shrink(x, 8, 8), x)


def test_hash():
    rng = np.random.default_rng(0)
    x = rng.random((64, 64)) * 255
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    whole = np.cos(np.pi * (2 * n + 1) * k / 64) * np.where(k == 0, math.sqrt(1 / 32), 0.25)
    v = (whole @ x.reshape(32, 2, 32, 2).mean((1, 3)) @ whole.T)[:8, :8].ravel()
    want = "".join("1" if b > np.median(v[1:]) else "0" for b in v)
    assert images.perceptual_hash(x) == f"{int(want, 2):016x}"


def test_quality_metrics():
    flat = images.quality_metrics(np.full((60, 60), 100, np.uint8))
    assert flat["sharpness"] == 0 and flat["dynamic_range"] == pytest.approx(0, abs=1e-9) and flat["noise_ratio"] == pytest.approx(0, abs=1e-9)
    stripes = np.tile(np.repeat([40, 200], 16), (128, 4)).astype(np.uint8)
    got = images.quality_metrics(stripes)
    # the cubic kernel overshoots at edges by an eighth of the step at most, on both sides
    assert got["sharpness"] > 100 and 100 < got["dynamic_range"] <= 160 * 1.25 and got["noise_ratio"] < 0.05
    large = images.quality_metrics(np.tile(np.repeat([40, 200], 64), (512, 4)).astype(np.uint8))  # shrunk by area: no overshoot
    assert large["sharpness"] > 100 and 100 < large["dynamic_range"] <= 160 and large["noise_ratio"] < 0.05


def test_repair_and_prediction():
    p = np.full((64, 64), 0.05)
    p[20:40, 20:40] = 0.62
    assert images.predict(p, 0.9, 0.5, 0.5)["method"] == "none"
    empty = images.predict(p, 0.1, 0.5, 0.5)
    assert empty["method"] == "presence_head_empty" and not empty["mask"].any() and empty["valid"]
    q = p.copy()
    q[30, 30] = 0.81  # a certain pixel
    assert images.predict(q, 0.1, 0.5, 0.5)["method"] == "none"
    low = images.predict(p, 0.9, 0.5, 0.75)  # nothing over 0.75; the first cut under 0.62 that is valid wins, and the lowest of equal ones
    assert low["method"] == "photometric_tta+adaptive_threshold_with_fold_prior" and low["threshold"] == pytest.approx(0.55) and low["mask"].sum() == 400
    none = images.predict(np.full((64, 64), 0.01), 0.9, 0.5, 0.5)
    assert none["method"] == "photometric_tta+unresolved" and none["reason"] == "area_too_small;low_peak_probability"
    prior = {"n": 5, "area_ratio": (400 / 4096, 0.001), "centroid_x": (0.9, 0.01), "centroid_y": (29.5 / 63, 0.01), "aspect": (1.0, 0.01)}
    assert images.prior_deviation(p > 0.5, prior) == pytest.approx(abs(29.5 / 63 - 0.9) / 0.01) and images.prior_deviation(p > 0.5, prior | {"n": 4}) == 0.0
    assert images.mask_reason(0.7, 0.9, 0.4, 6.0) == "area_too_large;touches_boundary;geometry_outlier"


def test_uncertainty():
    p, o = np.full((10, 10), 0.5), np.full((10, 10), 0.54)
    apart, entropy, u = images.uncertainty(p, o, 0.6, 0.5, 1.1, True)
    assert apart == pytest.approx(0.04) and entropy == pytest.approx(1.0)
    assert u == pytest.approx(0.35 + 0.35 * 0.5 + 0.2 * 0.8 + 0.1 * 0.2)
    assert images.uncertainty(p, o + 0.3, 0.5, 0.5, 9, False)[2] == 1.0
    p = np.zeros(100)
    p[:10] = 0.5
    assert images.uncertainty(p, p, 1.0, 0.5, 0, True)[1] == pytest.approx(1.0)


def test_limits():
    x, m = np.linspace(0, 1, 101).reshape(1, -1), np.ones((1, 101), bool)
    assert images.histogram_limits(x, m) == (round(0.01 * 255) / 255, round(0.99 * 255) / 255)
    assert images.histogram_limits(x, np.arange(101)[None] < 63) is None and images.histogram_limits(x * 0 + 0.5, m) is None
    near = 100 / 255 + np.tile([0, 2 / 255], 50)[None]
    a, b = images.histogram_limits(near, np.ones((1, 100), bool))
    assert b - a == pytest.approx(2 / 255)
    assert images.region_normalise(near, np.ones((1, 100), bool)).max() == pytest.approx(0.25)


def test_masks():
    mask = np.zeros((256, 256), bool)
    mask[:10, :20] = True
    assert (images.unpack(images.pack(mask)) == mask).all()
    f = images.mask_features(mask)
    assert f["area_ratio"] == 200 / 65536 and f["boundary_touch_fraction"] == pytest.approx((2 * 20 + 2 * 8) / 200)
    assert math.isnan(images.mask_features(mask & False)["centroid_x"])
    with pytest.raises(ValueError):
        images.unpack(b"12")


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(1)
    for name in ("Normal", "Sick"):
        for subject in ("Directory_1", "Directory_2"):
            for file in ("series a/img2.png", "series a/img10.png", "img1.png"):
                path = root / "deep" / "data" / name / subject / file
                path.parent.mkdir(parents=True, exist_ok=True)
                tables.write_png(spark, str(path), rng.integers(0, 256, (40, 50)))
    tables.write_png(spark, str(root / "masks" / "m1.png"), np.repeat([[0, 127, 128, 255]], 4, 0))
    (root / "masks" / "notes.txt").write_text("x")
    return str(root)


def test_catalogue(spark, tree):
    assert tables.find_root(spark, ["/nowhere", tree], ["Normal", "Sick"]) == f"{tree}/deep/data"
    assert tables.find_root(spark, [tree], ["Normal", "Other"]) is None
    rows = tables.scan_catalogue(spark, f"{tree}/deep/data", {"Normal": 0, "Sick": 1}).collect()
    assert len(rows) == 12 and len({r.token for r in rows}) == len({(r.subject, r.series, r.path.split("/")[-1]) for r in rows})
    assert {r.series for r in rows} == {"root", "series a"} and {r.label for r in rows} == {0, 1}
    assert tables.newest(spark, f"{tree}/deep") is not None


def test_image_reads(spark, tree):
    from pyspark.sql import SparkSession

    assert isinstance(spark, SparkSession)
    quality = tables.read_quality(spark, f"{tree}/deep").collect()
    assert len(quality) == 12 and all(len(r.perceptual_hash) == 16 and r.sharpness > 0 for r in quality)
    masks = [r for r in tables.read_masks(spark, f"{tree}/masks").collect() if r.area is not None]
    assert len(masks) == 1 and masks[0].area == 0.5 and len(masks[0].packed) == 8192


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("image_token,note\nt1,é\nt2,\n")
    got = tables.read_csv(spark, path, "image_token string, note string").collect()
    assert [tuple(r) for r in got] == [("t1", "é"), ("t2", None)]
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    assert tables.write_json(spark, f"{tmp_path}/x.json", {"a": [1]}) and not tables.write_json(spark, f"{tmp_path}/x.json", {"a": [1]})
    assert tables.read_json(spark, f"{tmp_path}/x.json") == {"a": [1]} and tables.read_json(spark, f"{tmp_path}/y.json", 3) == 3
    bank = spark.createDataFrame([("old", 1), ("M1", 2)], "mode string, v int")
    tables.write_bank(bank, f"{tmp_path}/bank")
    assert sorted((r.mode, r.v) for r in tables.read_bank(spark, f"{tmp_path}/bank", {"old": "B0"}).collect()) == [("B0", 1), ("M1", 2)]
    assert tables.workspace("/w/")["masks"] == "/w/manual_masks"
    inside = spark.createDataFrame([("/in/a",), ("/input/a",), ("/in",)], "p string").select(tables.is_read_only(F.col("p"), ("/in/",)).alias("r"))
    assert [r.r for r in inside.collect()] == [True, False, False]


def test_merge_and_removals(spark):
    items = spark.createDataFrame([("t1", "p1"), ("t2", "p2"), ("t3", "p3")], "token string, path string")
    small = spark.createDataFrame([("t1", "p1", 9.0)], "token string, path string, v double")
    large = spark.createDataFrame([("t1", "p9", 1.0), ("old", "p2", 2.0)], "token string, path string, v double")
    got = {r.token: r.v for r in tables.merge_predictions(items, [small, large], "token", "path").collect()}
    assert got == {"t1": 1.0, "t2": 2.0, "t3": None}
    with pytest.raises(ValueError):
        tables.merge_predictions(items, [large.unionByName(large)], "token")
    files = spark.createDataFrame([(p,) for p in ("/w/a", "/w/a/x", "/w/ab", "/w/c", "/w/c/d", "/w/c/d/e", "/w/k/l", "/w/k")], "path string")
    contract = spark.createDataFrame([("/w/a",), ("/w/k/l",)], "path string")
    assert sorted(r.path for r in tables.planned_removals(spark, files, contract).collect()) == ["/w/ab", "/w/c"]


def test_unchanged_images_are_left_alone(spark, tmp_path):
    import os

    from cohortloom.sources import tables

    path, x = str(tmp_path / "m.png"), np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert tables.write_png(spark, path, x)
    os.utime(path, (1, 1))
    assert not tables.write_png(spark, path, x) and os.path.getmtime(path) == 1
    assert tables.write_png(spark, path, x.T) and os.path.getmtime(path) > 1
    assert tables.write_text(spark, str(tmp_path / "t.json"), "a") and tables.write_text(spark, str(tmp_path / "t.json"), "b")
    assert tables.read_text(spark, str(tmp_path / "t.json")) == "b" and not [p for p in os.listdir(tmp_path) if p.endswith(".part")]


def test_cubic_kernel_and_views(spark, tmp_path):
    from cohortloom.functions import images
    from cohortloom.sources import tables

    rng = np.random.default_rng(6)
    flat = np.full((7, 5), 0.4)
    assert np.allclose(images.enlarge(flat, 20, 13), 0.4)  # weights sum to one
    line = np.arange(12.0)[None, :].repeat(3, 0)
    grown = images.enlarge(line, 3, 24)
    assert np.allclose(grown[:, 4:-4], (np.arange(24) + 0.5)[None, 4:-4] / 2 - 0.5, atol=0.05)  # a ramp stays one
    x = rng.random((1, 9))
    a, d = -0.75, 0.25  # the second new pixel lies a quarter after the first old one
    near, far = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1, lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    assert images.enlarge(x, 1, 18)[0, 1] == pytest.approx(x[0, 0] * near(d) + x[0, 1] * near(1 - d) + x[0, 2] * far(2 - d) + x[0, 0] * far(1 + d))
    for h, w in ((300, 500), (60, 100), (240, 180), (500, 20)):
        picture = rng.random((h, w))
        out, inside = images.canvas(picture)
        assert out.shape == (256, 256) and inside.any(0).sum() == (240 if w > h else max(1, round(w * 240 / h))) and inside.any(1).sum() == (240 if h >= w else max(1, round(h * 240 / w)))
        assert (out[~inside] == 0).all() and 0 <= out.min() and out.max() <= 1
    assert np.array_equal(images.canvas(picture := rng.random((240, 180)))[0][8:248, 38:218], picture)  # of the right size: as it is
    pixels = rng.integers(0, 256, (90, 70)).astype(np.uint8)
    tables.write_png(spark, f"{tmp_path}/v.png", pixels)
    r = tables.read_views(spark, str(tmp_path)).first()
    for got, want, kind in zip((r.robust, r.raw, r.content), images.classifier_views(pixels), (np.float32, np.float32, np.uint8), strict=True):
        assert np.allclose(np.frombuffer(got, kind).reshape(224, 224), want, atol=1e-6)
