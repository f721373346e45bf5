"""The mask stage against its kernels one by one, priors against numpy, stacks against a plain join on a tree of PNG files."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import images
from cohortloom.operators import cohort, masks
from cohortloom.sources import tables

SIDE = 32


def blob(rng, peak=0.95, wide=None):
    y, x = np.mgrid[:SIDE, :SIDE]
    cy, cx = rng.uniform(8, SIDE - 8, 2)
    r = wide or rng.uniform(2, 9)
    p = peak * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * r * r)) + rng.normal(0, 0.03, (SIDE, SIDE))
    return np.clip(p, 0, 1).astype(np.float32)


def plain_prior(numbers, fold):
    rows = [n for f, n in numbers if f != fold]
    out = {"n": len(rows)}
    for k in images.PRIOR_FEATURES:
        v = np.array([n[k] for n in rows])
        out[k] = (float(np.median(v)), max(1e-3, 1.4826 * float(np.median(np.abs(v - np.median(v))))))
    return out


def test_stage_like_its_kernels(spark):
    rng = np.random.default_rng(7)
    truth = [(k, k % 3, images.candidate_mask(blob(rng, wide=5), 0.4)) for k in range(24)]
    targets = spark.createDataFrame([(k, f, bytearray(images.pack(m))) for k, f, m in truth], "item long, fold int, packed binary")
    numbers = masks.mask_numbers(targets, "item", "packed", SIDE)
    features = [(f, images.mask_features(m)) for _, f, m in truth]
    got = {r.item: r for r in numbers.collect()}
    assert all(got[k].area_ratio == pytest.approx(features[k][1]["area_ratio"]) and got[k].aspect == pytest.approx(features[k][1]["aspect"]) for k in got)
    priors = masks.fold_priors(numbers.join(targets.select("item", "fold"), "item"), "fold", 3)
    for r in priors.collect():
        want = plain_prior(features, r.fold)
        assert r.n == want["n"] and all((r.prior[k].centre, r.prior[k].scale) == pytest.approx(want[k]) for k in images.PRIOR_FEATURES)
    maps = [(k, k % 3, blob(rng, peak=float(rng.choice([0.1, 0.45, 0.7, 0.95])), wide=float(rng.choice([1, 4, 14]))), float(rng.random())) for k in range(60)]
    other = {k: np.clip(p + rng.normal(0, 0.05, p.shape), 0, 1).astype(np.float32) for k, _, p, _ in maps}
    df = spark.createDataFrame([(k, f, bytearray(p.tobytes()), bytearray(other[k].tobytes()), q) for k, f, p, q in maps], "item long, fold int, probability binary, other binary, presence double").repartition(4)
    cuts = {0: (0.35, 0.5), 1: (0.5, 0.4), 2: (0.65, 0.6)}
    settings = spark.createDataFrame([(f, *c) for f, c in cuts.items()], "fold int, threshold double, presence_threshold double")
    found = {r.item: r for r in masks.predict_masks(df, settings, priors, SIDE).collect()}
    assert len(found) == 60
    for k, f, p, q in maps:
        r, prior = found[k], plain_prior(features, f)
        want = images.predict(p.astype(float), q, cuts[f][1], cuts[f][0], prior)
        shape = images.mask_features(want["mask"])
        assert (images.unpack(r.packed, SIDE) == want["mask"]).all()
        assert (r.valid_final, r.reason_final, r.repair_method, r.threshold_used) == (int(want["valid"]), want["reason"], want["method"], want["threshold"])
        assert (r.area_ratio, r.prior_deviation) == pytest.approx((shape["area_ratio"], want["deviation"])) and r.heart_present == int(want["mask"].any())
        assert r.centroid_x == (pytest.approx(shape["centroid_x"]) if want["mask"].any() else None)
        assert (r.tta_disagreement, r.mean_entropy, r.uncertainty_score) == pytest.approx(images.uncertainty(p.astype(float), other[k].astype(float), q, cuts[f][1], want["deviation"], want["valid"]))
        assert r.valid_initial == int(r.reason_initial == "") and (r.repair_method == "none") <= r.valid_initial
    assert len({r.repair_method for r in found.values()}) >= 3
    with pytest.raises(ValueError, match="no settings"):
        masks.predict_masks(df, settings.where("fold > 0"), priors, SIDE)
    with pytest.raises(Exception, match="a map has"):
        masks.predict_masks(df.withColumn("other", F.lit(None).cast("binary")), settings, priors, SIDE).collect()


def test_regions_like_the_kernels(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(6):
        image, content = rng.integers(0, 256, (SIDE, SIDE)).astype(np.uint8), np.zeros((SIDE, SIDE), np.uint8)
        content[3:-3] = 1
        rows.append((k, image, content, images.candidate_mask(blob(rng), 0.4) if k else np.zeros((SIDE, SIDE), bool)))
    df = spark.createDataFrame([(k, bytearray(i.tobytes()), bytearray(c.tobytes()), bytearray(images.pack(m))) for k, i, c, m in rows], "item long, image binary, content binary, packed binary")
    got = {(r.item, r.region): np.frombuffer(r.pixels, np.float32).reshape(SIDE, SIDE) for r in masks.region_images(df, SIDE, 5).collect()}
    assert len(got) == 12
    for k, i, c, m in rows:
        for name, part in zip(("attention", "attention_complement"), images.support(m, c > 0, 5), strict=True):
            assert np.allclose(got[k, name], images.region_normalise(i / 255, part), atol=1e-6)


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_stacks_like_a_plain_join_on_a_tree_of_images(spark, tmp_path, chunk):
    rng = np.random.default_rng(4)
    lengths, pixels = {"a": 1, "b": 2, "c": 13, "d": 6}, {}
    for s, n in lengths.items():
        for i in range(n):
            pixels[s, i] = rng.integers(0, 256, (4, 4)).astype(np.uint8)
            tables.write_png(spark, f"{tmp_path}/{s}/img{i}.png", pixels[s, i])
    name = F.regexp_extract("image.origin", r"([a-d])/img(\d+)\.png", 1)
    index = F.regexp_extract("image.origin", r"([a-d])/img(\d+)\.png", 2).cast("int")
    read = tables.read_images(spark, str(tmp_path)).select(name.alias("s"), index.alias("i"), F.col("image.data").alias("pixels")).withColumn("item", F.concat_ws("-", "s", "i"))
    got = {r.item: r for r in masks.neighbour_stacks(read.select("item", "s", "i"), read, "item", ["s"], ["i"], chunk=chunk).collect()}
    assert len(got) == sum(lengths.values())
    for (s, i), own in pixels.items():
        before, after = pixels.get((s, i - 1), own), pixels.get((s, i + 1), own)
        want = images.stack(before, own, after)
        assert (np.frombuffer(got[f"{s}-{i}"].stack, np.uint8).reshape(3, 4, 4) == want).all()
        assert got[f"{s}-{i}"].previous == f"{s}-{i - 1 if i else 0}"


def test_numbers_follow_the_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(rng.integers(0, 5))) for k in rng.permutation(500)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    got = {r.k: r.n for r in cohort.numbered(df, [-F.col("v"), "k"], "n").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert cohort.numbered(df.limit(0), ["k"], "n").count() == 0
