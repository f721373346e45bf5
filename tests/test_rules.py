"""Hand values of audits, splits, weights, sequences, metrics and folds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import audit, cohort, metrics, modeling, relations, robust
from cohortloom.plans.store import StageStore, fingerprint, same_rows
from cohortloom.streaming.pooling import streaming_series_mean

NAN, INF = math.nan, math.inf


def test_quality_audit(spark):
    rows = [("a", 1, 10.0, 0.1, 50.0), ("a", 2, NAN, 0.1, 50.0), ("a", 3, 10.0, None, 50.0), ("a", 4, 10.0, 0.1, INF), ("a", 5, 3.9, 0.31, 11.9), ("a", 6, None, INF, NAN), ("b", 7, 4.0, 0.30, 12.0)]
    got = audit.quality_audit(spark.createDataFrame(rows, "s string, k int, sharp double, noise double, wide double"), "s", "sharp", "noise", "wide")
    why = {r.k: r.quality_reason for r in got.collect()}
    # four finite values: the limits are the fixed ones
    assert why == {1: "", 2: "blurred", 3: "noisy", 4: "low_dynamic_range", 5: "low_dynamic_range;blurred;noisy", 6: "low_dynamic_range;blurred;noisy", 7: ""}
    many = spark.createDataFrame([("a", float(v), v / 100) for v in range(1, 101)], "s string, sharp double, noise double")
    t = audit.quality_thresholds(many, "s", "sharp", "noise").first()
    assert t.blur_threshold == 4.0 and t.noise_threshold == 0.30
    t = audit.quality_thresholds(many.withColumn("sharp", F.col("sharp") * 10).withColumn("noise", F.col("noise") / 10), "s", "sharp", "noise").first()
    assert t.blur_threshold == pytest.approx(np.quantile(np.arange(10, 1001, 10), 0.03)) and t.noise_threshold == pytest.approx(np.quantile(np.arange(1, 101) / 1000, 0.97))


def test_target_audit(spark):
    items = spark.createDataFrame([(k, 0 if k in (4, 9) else None if k == 10 else 1, "noisy" if k == 4 else None) for k in range(1, 13)], "k int, quality_valid int, quality_reason string")
    marks = [(1, "heart_present", 0.2, True), (2, "HEART_PRESENT", None, False), (3, " ", 0.2, True), (4, "heart_present", 0.0001, True), (5, "no_heart_visible", None, False), (6, "NO_HEART_VISIBLE", 0.3, True), (7, "no_heart_visible", None, True), (8, None, 0.0, True), (9, "unusable", 0.2, True), (10, "HEART_PRESENT", 0.5, True), (11, "odd", 0.2, True), (12, "heart_present", 0.99, True), (99, "heart_present", 0.2, True)]
    got = {r.k: (r.target, r.status, r.reason) for r in audit.target_audit(items, spark.createDataFrame(marks, "k int, target_type string, mask_area double, mask_found boolean"), "k").collect()}
    assert got == {
        1: ("HEART_PRESENT", "ACCEPTED", ""), 2: ("HEART_PRESENT", "REJECTED", "missing"), 3: ("HEART_PRESENT", "ACCEPTED", ""), 4: ("HEART_PRESENT", "REJECTED", "empty_or_nearly_empty;noisy"), 5: ("NO_HEART_VISIBLE", "ACCEPTED", ""),
        6: ("NO_HEART_VISIBLE", "REJECTED", "no_heart_annotation_has_nonempty_mask"), 7: ("NO_HEART_VISIBLE", "REJECTED", "unreadable_negative_mask"), 8: ("UNLABELED_EMPTY", "REJECTED", "empty_mask_without_explicit_no_heart_label"), 9: ("UNUSABLE", "EXCLUDED", "explicitly_unusable"),
        10: ("HEART_PRESENT", "REJECTED", "quality_invalid"), 11: ("ODD", "REJECTED", "empty_mask_without_explicit_no_heart_label"), 12: ("HEART_PRESENT", "REJECTED", "nearly_full"), 99: ("HEART_PRESENT", "REJECTED", "token_absent_from_dataset"),
    }


def test_gates(spark):
    rows = [(k, f"s{k % 6}", k % 5, "ACCEPTED", "HEART_PRESENT") for k in range(30)]
    good = spark.createDataFrame(rows, "k int, s string, fold int, status string, target string")
    audit.require_targets(good, "s", "fold", positives=30)
    for bad in (good.where("fold <> 3"), good.where("s <> 's1'"), good.limit(0)):
        with pytest.raises(ValueError):
            audit.require_targets(bad, "s", "fold", positives=3)


def test_coverage():
    labelled = {f"p{k}": {1} if k < 6 else {0, 1} if k < 8 else {0} for k in range(9)}
    for fold in range(40):
        for picked in ({"p0"}, {"p8"}, {"p6", "p7", "p8"}, {"p0", "p1"}, {f"p{k}" for k in range(6)}):
            got = cohort.repair_coverage(picked, labelled, fold)
            for c in (0, 1):
                have = {s for s, own in labelled.items() if c in own}
                assert got & have and have - got
            assert got == cohort.repair_coverage(picked, labelled, fold)
    assert cohort.repair_coverage({"p1"}, {"p1": {1}, "p2": {1}, "p3": {0}}, 0) == {"p1"}
    assert cohort.repair_coverage({"a"}, {"a": {1}}, 0) == {"a"}


def test_fold_parts(spark):
    rows = [(f"p{k}", k % 2, int(j % 3 > 0)) for k in range(12) for j in range(4)]
    got = cohort.fold_parts(spark.createDataFrame(rows, "s string, y int, present int"), "s", "y", "present").collect()
    assert len(got) == 60
    for fold in range(5):
        parts = {r.s: r.part for r in got if r.fold == fold}
        assert set(parts.values()) == {"train", "validation", "test"} and len(parts) == 12
    assert all(sum(r.part == "test" for r in got if r.s == s) == 1 for s in {r.s for r in got})


def test_weights(spark):
    both = spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 1, 1), ("a", "y", 2, 0), ("b", "x", 1, 1)], "s string, q string, c int, present int")
    w = sorted(round(r.weight, 6) for r in cohort.sampling_weights(both, "s", "q", "c", "present").collect())
    assert w == [round(x, 6) for x in (0.7 * 0.25 / 1.5, 0.7 * 0.25 / 1.5, 0.3, 0.7 * 1 / 1.5)]
    one = cohort.sampling_weights(both.where("present = 1"), "s", "q", "c", "present").agg(F.sum("weight")).first()[0]
    assert one == pytest.approx(1.0)


def test_queue(spark):
    rows = [("a", "x", k, float(-(k % 3)), 0.0) for k in range(7)] + [("a", "y", 10, 5.0, 0.0), ("b", "x", 20, 0.0, 0.5), ("b", "x", 21, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "s string, q string, k int, first double, peak double")
    got = [tuple(r) for r in cohort.round_robin(df, "s", "q", "k", 3, 5, first_by=["first", "peak"]).collect()]
    assert [(r[0], r[3]) for r in got] == [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)]
    assert got[0][2] in (2, 5) and got[2][2] == 10 and [g[2] for g in got if g[0] == "b"] == [21, 20]


def test_review_scopes(spark):
    rows = [(1, "", 1, 0, True, 0.0, 0.9, 0.5, 0.3, "missing", 0), (2, "", 1, 1, True, 0.18, 0.9, 0.5, 0.3, "empty_or_nearly_empty", 1), (3, "", 1, 1, True, 0.0, 0.64, 0.5, 0.3, "missing", 0x7F), (4, "", 0, 0, True, 0.9, 0.5, 0.5, 0.3, "", None), (5, "X", 1, 0, True, 0.9, 0.5, 0.5, 0.3, "missing", -(2**63)), (6, "", 1, 0, False, 0.9, 0.5, 0.5, 0.3, "", 3), (7, "", 1, 1, True, 0.0, None, None, None, "missing", 0x3F)]
    df = spark.createDataFrame([(*r, "s", "q") for r in rows], "k int, target string, quality_valid int, valid int, available boolean, uncertainty double, presence double, presence_threshold double, peak double, mask_reason string, phash long, s string, q string")
    seen = df.where("k = -1").select("k")
    of = lambda scope: [r.k for r in audit.review_queue(df, seen, scope, "s", "q", "k").orderBy("queue_position").collect()]
    assert sorted(of("invalid")) == [1, 4] and of("uncertain")[0] == 2 and sorted(of("uncertain")) == [1, 2, 3] and of("empty") == [2]
    assert of("manual") == [2, 4] and of("all") == [1, 2, 3, 4, 7]
    # hashes of 2 (1), 5 (the top bit) and 6 (3) are annotated; 0x7f is six bits from 1, 0x3f four from 3
    assert of("novel") == []
    far = df.withColumn("phash", F.when(F.col("k") == 3, F.lit(0xFF)).otherwise(F.col("phash")))
    assert [r.k for r in audit.review_queue(far, seen, "novel", "s", "q", "k").collect()] == []
    far = df.withColumn("phash", F.when(F.col("k") == 3, F.lit(0x3FF)).otherwise(F.col("phash")))
    assert [r.k for r in audit.review_queue(far, seen, "novel", "s", "q", "k").collect()] == [3]
    assert {r.reason: r.n for r in audit.novel_exclusions(df, df.where("k = 1").select("k"), "k").collect()} == {"already_annotated": 3, "already_reviewed_this_round": 1, "similar_to_annotated": 2}
    with pytest.raises(ValueError):
        audit.in_scope(df, "other")


def test_inconsistency(spark):
    rows = [("g", 1, 1, 0.2, 0.5, 0.5, 0.1), ("g", 2, 1, 0.3, 0.6, 0.5, 0.95), ("g", 3, 0, 0.0, None, None, 0.1), ("g", 4, 0, 0.0, None, NAN, 0.1), ("h", 1, 1, 0.001, 0.5, 0.5, 0.0), ("h", 2, 1, 0.002, None, 0.5, 0.0), ("i", 1, 1, 0.1, 0.1, 0.1, 0.3), ("j", 1, None, None, 0.0, 0.0, 0.0), ("j", 2, 1, 0.005, 0.0, 0.5, 0.0)]
    got = robust.sequence_inconsistency(spark.createDataFrame(rows, "g string, k int, p int, a double, x double, y double, u double"), ["g"], ["k"], "p", "a", "x", "y", "u")
    v = {(r.g, r.k): (round(r.inconsistency, 9), round(r.uncertainty, 9)) for r in got.collect()}
    one = 0.55 * 0.1 / 0.25 + 0.45 * 0.1 / 0.25
    assert v["g", 1] == (round(one, 9), round(0.1 + 0.2 * one, 9)) and v["g", 2] == (round((one + 1) / 2, 9), 1.0)
    assert v["g", 3] == (0.5, 0.2) and v["g", 4] == (0.0, 0.1) and v["i", 1] == (0.0, 0.3)
    assert v["h", 1][0] == round(0.55 * 0.001 / 0.01 + 0.45, 9) and v["j", 1][0] == round(0.55 * 0.005 / 0.01 + 0.45, 9)


def test_robust(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, NAN, INF, 100.0)] + [("b", 5.0)] * 3 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.caliper for r in robust.caliper(df, ["g"], "v").collect()}
    m, mad, q = 2.5, 1.0, np.quantile([1, 2, 3, 100], 0.9)
    assert got["a"] == pytest.approx(max(m, min(m + 2.5 * 1.4826 * mad, q))) and got["b"] == 5.0 and got["c"] is None
    clamp = spark.createDataFrame([(None, 2.0), (1.0, None), (1.0, 0.5), (1.0, 1.1), (1.0, 3.0)], "c double, w double").select(robust.extended_caliper(F.col("c"), F.col("w")).alias("x"))
    assert [r.x for r in clamp.collect()] == [2.0, 1.0, 1.0, 1.1, 1.18]
    stats = {r.g: (r.centre, r.scale) for r in robust.median_mad(df, ["g"], "v").collect()}
    assert stats["a"] == (2.5, 1.4826) and stats["b"] == (5.0, 1e-3)


def test_calibration(spark):
    rows = [("a", 1, 50, 100, 0.2, 1, 0.4), ("a", 1, 0, 60, 0.2, 0, 0.4), ("b", 0, 0, 0, 0.05, 1, 0.4), ("b", 0, 0, 0, 0.5, 0, 0.4), ("a", 1, 50, 100, 0.2, 1, 0.6), ("b", 0, 0, 0, 0.0, 1, 0.6)]
    df = spark.createDataFrame(rows, "s string, present int, both int, total int, share double, valid int, threshold double")
    tried = df.withColumn("q", metrics.target_quality(F.col("present"), F.col("both"), F.col("total"), F.col("share")))
    low = tried.where("threshold = 0.4")
    got = metrics.grid_search(low, "threshold", "s", "present", "q", "valid").first()
    assert got.mean_quality == pytest.approx(((1 + 1e-6 / 60) / 2 + 0.5 / 2) / 2, abs=1e-6) and got.invalid_rate == 0.5 and got.score == pytest.approx(got.mean_quality - 0.1)
    assert metrics.grid_search(tried, "threshold", "s", "present", "q", "valid").first().threshold == 0.6
    # ties go to the threshold nearest to a half, then the smaller
    tie = spark.createDataFrame([("a", 1, 1.0, 1, t) for t in (0.2, 0.4, 0.6)], "s string, present int, q double, valid int, threshold double")
    assert metrics.grid_search(tie, "threshold", "s", "present", "q", "valid").first().threshold == 0.4
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert metrics.presence_threshold(one, (0.1,), "y", "p").first().threshold == 0.5


def test_metrics(spark):
    s = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.5), ("m", 1, 0.9), ("m", 0, 0.1), ("one", 1, 0.3)], "g string, y int, p double")
    auc = {r.g: r.auc for r in metrics.roc_auc(s, ["g"], "y", "p").collect()}
    assert auc == {"m": 0.875, "one": None}


def test_inner_folds():
    rng = np.random.default_rng(0)
    y = np.array([1] * 4 + [0] * 9)
    names = [f"p{k}" for k in range(13)]
    folds = modeling.inner_folds(names, y)
    assert all(abs((y[folds == f] == 1).sum() - 4 / 3) < 1 and (y[folds == f] == 0).sum() == 3 for f in range(3))
    assert modeling.inner_folds(names, np.array([1] + [0] * 12)) is None
    x = rng.normal(size=(13, 3)) + y[:, None]
    c, cut = modeling.select(x, y, names)
    best = []
    for value in modeling.C_GRID:
        s = np.array([modeling.Classifier(x[folds != folds[k]], y[folds != folds[k]], value).score(x[k : k + 1])[0] for k in range(13)])
        best.append((round(modeling.auc(y, s), 12), -abs(math.log10(value)), value, s))
    top = max(best, key=lambda b: b[:2])
    assert c == top[2] and cut == pytest.approx(modeling.youden(y, top[3]), abs=1e-9)
    assert modeling.select(x, np.array([1] + [0] * 12), names) == (1.0, 0.5)


def test_relations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, w double")
    assert relations.complete_join(a, b, "k").count() == 2
    for bad in (b.where("k = 1"), b.unionByName(b)):
        with pytest.raises(ValueError):
            relations.complete_join(a, bad, "k")
    with pytest.raises(ValueError):
        relations.folds_of(a, spark.createDataFrame([(1, 0)], "k int, fold int"), "k")
    items = spark.createDataFrame([(1, 0), (2, 1)], "k int, fold int")
    assert relations.combined_parts({0: b, 1: b}, items, "k").count() == 2
    with pytest.raises(ValueError):
        relations.combined_parts({0: b}, items, "k")
    text = spark.createDataFrame([(0.1,), (2.0,), (-0.0,), (1e-13,), (NAN,), (None,), (INF,), (123456.5,)], "v double").select(relations.number_text(F.col("v")).alias("t"))
    assert [r.t for r in text.collect()] == ["0.1", "2", "-0", "1e-13", "nan", "nan", "nan", "123456.5"]


def test_store(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert fingerprint(t) == fingerprint(t.select("v", "k").orderBy(F.desc("k"))) != fingerprint(t.where("k = 1"))
    assert fingerprint(t) != fingerprint(t.unionByName(t))
    store, built = StageStore(spark, str(tmp_path)), []
    build = lambda: built.append(1) or t
    for force, n in ((False, 1), (False, 1), (True, 2)):
        assert same_rows(store.get("s", {"t": t}, build, force=force), t) and len(built) == n
    store.get("s", {"t": t.where("k = 1")}, build)
    store.get("s", {"t": t.where("k = 1")}, build, {"p": 2})
    assert len(built) == 4 and store.status("s")["rows"] == 2 and store.status("none") is None
    store.append("log", t)
    store.append("log", t)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 5.0)], "t string, k string, v double").selectExpr("timestamp(t) AS t", "k", "v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming_series_mean(stream, "t", ["k"], "v").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.total, r.n) for r in spark.table("means").collect()) == [("a", 3.0, 2), ("b", 5.0, 1)]
