"""Evaluation of modes against plain numpy, and the rules of flags, feature banks and texts of numbers."""

import hashlib
import random

import numpy as np
import pytest

from cohortloom.operators import metrics, pooling, relations


def auc(label, score):
    pos, neg = [s for y, s in zip(label, score, strict=True) if y == 1], [s for y, s in zip(label, score, strict=True) if y == 0]
    if not pos or not neg:
        return None
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def plain_resamples(rows, n):
    """Of rows (subject, label, *scores): for each draw the AUC of each score."""
    rows = sorted(rows)
    out = []
    for d in range(n):
        at = [int(hashlib.sha256(f"bootstrap|{d}|{k}".encode()).hexdigest()[:12], 16) % len(rows) for k in range(len(rows))]
        some = [rows[i] for i in at]
        out.append([auc([r[1] for r in some], [r[j] for r in some]) for j in range(2, len(rows[0]))])
    return out


def scores(n_subjects=18, seed=1):
    rng = random.Random(seed)
    rows = []
    for k, (mode, _, flag) in enumerate(pooling.MODES):
        some = range(n_subjects) if not flag else range(k % 3, n_subjects - k % 2)
        for s in some:
            x = round(rng.random() * 0.7 + 0.3 * (s % 2), 1)
            rows.append((mode, f"p{s:02d}", s % 2, x, int(x > 0.5)))
    return rows


SCHEMA = "mode string, subject string, label int, score double, predicted int"


def test_comparisons_and_metrics_like_plain_numpy(spark):
    rows = scores()
    each, compared = metrics.evaluate_modes(spark.createDataFrame(rows, SCHEMA), n=260)
    compared = compared.orderBy("position").collect()
    assert [(r.first, r.second, r.comparison) for r in compared] == [*metrics.COMPARISONS] and len(compared) == 12
    by = {m: {r[1]: r for r in rows if r[0] == m} for m, _, _ in pooling.MODES}
    for r in compared:
        a, b = by[r.first], by[r.second]
        both = [(s, a[s][2], a[s][3], b[s][3]) for s in sorted(a.keys() & b.keys())]
        y = [x[1] for x in both]
        assert r.subjects == len(both)
        assert r.auc_difference == pytest.approx(auc(y, [x[2] for x in both]) - auc(y, [x[3] for x in both]), abs=1e-12)
        drawn = [x - z for x, z in plain_resamples(both, 260) if x is not None]
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975])), abs=1e-12)
    got = each.collect()
    assert [r.place for r in got] == [*range(1, 12)] and [r.auc for r in got] == sorted((r.auc for r in got), reverse=True)
    for r in got:
        own = sorted(by[r.mode].values(), key=lambda x: x[1])
        y, s, hat = ([x[k] for x in own] for k in (2, 3, 4))
        assert r.subjects == len(own) and r.auc == pytest.approx(auc(y, s))
        assert r.brier == pytest.approx(np.mean([(a - b) ** 2 for a, b in zip(s, y, strict=True)]))
        assert r.sensitivity == pytest.approx(np.mean([h for h, v in zip(hat, y, strict=True) if v])) and r.specificity == pytest.approx(np.mean([1 - h for h, v in zip(hat, y, strict=True) if not v]))
        drawn = [x for (x,) in plain_resamples([x[1:4] for x in own], 260) if x is not None]
        assert (r.auc_ci_low, r.auc_ci_high) == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975])), abs=1e-12)
    assert {r.mode: r.experiment_group for r in got} == {m: "primary" if k < 7 else "mask_validation" for k, (m, _, _) in enumerate(pooling.MODES)}
    assert {r.mode: r.cohort for r in got}["B1_MATCHED_FULL_IMAGE"] == "cross_class_matched_same_slices"


def test_few_subjects_and_missing_modes(spark):
    rows = [(m, f"p{s}", s % 2, s / 4, 0) for m in ("M1_MANUAL_ROI", "AU3_ATTENTION_ROI_MANUAL_SUBSET") for s in range(3)] + [("C1_ATTENTION_COMPLEMENT", f"p{s}", 1, s / 9, 0) for s in range(6)] + [("AU1_ATTENTION_ROI", f"p{s}", 1, s / 8, 0) for s in range(6)]
    got = {r.position: r for r in metrics.compare_modes(spark.createDataFrame(rows, SCHEMA), n=50).collect()}
    assert len(got) == 12
    assert (got[10].subjects, got[10].auc_difference, got[10].ci_low) == (3, None, None)  # fewer than four
    assert (got[2].subjects, got[2].auc_difference, got[2].ci_high) == (6, None, None)  # one class
    assert (got[0].subjects, got[0].auc_difference) == (0, None)  # a mode that isn't there


@pytest.mark.parametrize("odd,message", [((("X", "p1", 1, 0.5, 1), ("X", "p2", 1, 0.5, 1)), "one class"), ((("X", "p1", 1, None, 1), ("X", "p2", 0, 0.5, 1)), "missing"), ((("X", "p1", 1, float("nan"), 1), ("X", "p2", 0, 0.5, 0)), "missing"), ((("X", "p1", 1, 0.1, -1), ("X", "p2", 0, 0.5, 0)), "missing")])
def test_incomplete_predictions_raise(spark, odd, message):
    with pytest.raises(ValueError, match=message):
        metrics.mode_metrics(spark.createDataFrame([*odd], SCHEMA), n=20)


FLAGS = "item long, quality_valid int, valid int, present int, area double, has_mask boolean, manual boolean, selected boolean"


def test_flags_by_their_rules(spark):
    rows = [(1, 1, 1, 1, 0.003, True, True, True), (2, 1, 1, None, 0.5, True, None, True), (3, 1, 1, 0, 0.5, True, True, True), (4, 1, 1, 1, 0.0029, True, False, True), (5, 1, 1, 1, None, True, None, None), (6, None, 1, 1, 0.5, True, None, True), (7, 1, None, 1, 0.5, True, None, True), (8, 1, 1, 1, float("nan"), True, True, True)]
    got = {r.item: (r.keep_attention, r.keep_manual_matched, r.keep_cross_class_matched) for r in pooling.keep_flags(spark.createDataFrame(rows, FLAGS)).collect()}
    no = (False, False, False)
    assert got == {1: (True, True, True), 2: (True, False, True), 3: (False, True, False), 4: no, 5: no, 6: no, 7: no, 8: (False, True, False)}
    for mask in (False, None):
        with pytest.raises(ValueError, match="mask"):
            pooling.keep_flags(spark.createDataFrame([*rows, (9, 1, 1, 1, 0.5, mask, False, False)], FLAGS))


def test_feature_bank_raises_instead_of_leaving_out(spark):
    members = spark.createDataFrame([(1, "p", "s", 0, "m", "full"), (2, "p", "s", 0, "m", "full"), (3, "q", "s", 1, "m", "full")], "item long, subject string, series string, label int, mode string, region string")
    vectors = [(1, "full", [1.0]), (2, "full", [3.0]), (3, "full", [5.0]), (4, "full", [9.0])]
    v = lambda rows: spark.createDataFrame(rows, "item long, region string, x array<double>")
    bank = lambda m, x: {r.subject: (r.label, r.x) for r in pooling.feature_bank(m, v(x), "item", "subject", "series", "label", "x").collect()}
    assert bank(members, vectors) == {"p": (0, [2.0]), "q": (1, [5.0])}
    for odd in (vectors[1:], [(1, "full", None), *vectors[1:]], [vectors[0], *vectors]):
        with pytest.raises(ValueError, match="vector"):
            bank(members, odd)
    with pytest.raises(ValueError, match="two labels"):
        bank(members.unionByName(members.where("item = 3").selectExpr("4L AS item", "subject", "series", "0 AS label", "mode", "region")), vectors)


def test_feature_bank_with_odd_rows(spark):
    """Means of means by position; an item of two modes, one listed twice, vectors of unlike lengths, null components, null and empty keys."""
    rows = [(1, "p", "s", 0, "m", "full"), (1, "p", "s", 0, "n", "full"), (1, "p", "s", 0, "m", "part"), (2, "p", "s", None, "m", "full"), (3, "p", "t", 0, "m", "full"), (3, "p", "t", 0, "m", "full"), (4, "q", None, 1, "m", "full"), (5, "q", None, 1, "m", "full")]
    rows += [(1, None, "s", 0, "m", "full"), (6, "r", "s", 1, "m", "full"), (7, "u", "s", None, "m", "full")]
    members = spark.createDataFrame(rows, "item long, subject string, series string, label int, mode string, region string")
    told = [(1, "full", [1.0, 2.0]), (1, "part", [4.0, None]), (2, "full", [4.0]), (3, "full", [9.0, 0.0]), (4, "full", [None]), (5, "full", [None]), (6, "full", []), (7, "full", [7.0]), (8, "full", [1.0]), (None, "full", [2.0]), (None, "full", [3.0]), (1, None, [5.0])]
    vectors = spark.createDataFrame(told, "item long, region string, x array<double>")
    got = {(r.mode, r.subject): (r.label, r.x) for r in pooling.feature_bank(members, vectors, "item", "subject", "series", "label", "x").collect()}
    assert got == {("m", "p"): (0, [6.0, 1.0]), ("n", "p"): (0, [1.0, 2.0]), ("m", "q"): (1, [None]), ("m", "u"): (None, [7.0])}
    for odd in ((9, "w", "s", 1, "m", "full"), (1, "w", "s", 1, "m", None), (None, "w", "s", 1, "m", "full")):
        more = members.unionByName(spark.createDataFrame([odd, odd], members.schema))
        with pytest.raises(ValueError, match="w in m: 2 items without one vector"):
            pooling.feature_bank(more, vectors, "item", "subject", "series", "label", "x")


def test_targets_of_no_meaning_are_unlabelled(spark):
    rows = spark.createDataFrame([(k,) for k in range(7)], "item long")
    told = spark.createDataFrame([(0, " none"), (1, "NaN"), (2, "UNLABELED"), (3, ""), (4, None), (5, " heart_present ")], "item long, target_type string")
    masks = spark.createDataFrame([], "item long, area double")
    got = {r.item: r.target for r in relations.with_annotations(rows, told, masks, "item").collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: "", 5: "HEART_PRESENT", 6: ""}


def test_number_texts_like_twelve_significant_digits(spark):
    rng = random.Random(9)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randrange(-20, 20) for _ in range(400)] + [float(rng.randrange(10**6)) / 10 ** rng.randrange(6) for _ in range(200)]
    values += [0.0, -0.0, 1.0, 100.0, 1e12, 1e11, 999999999999.5, 1.5e-7, 1e-13, 1e-4, 0.00012, 123456789012345.0, 1e300, 2.0**0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(relations.number_text(df.v).alias("t")).collect()] == [format(v, ".12g") for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r.t for r in odd.select(relations.number_text(odd.v).alias("t")).collect()] == ["nan"] * 4


def test_a_draw_holds_few_bytes_a_subject():
    """Beside its arrays a task holds one draw: some tens of bytes a subject, not all draws of its block."""
    import tracemalloc

    m = 200_000
    order = metrics._Falling(np.arange(m) % 2, np.arange(m) % 1000 / 1000)
    tracemalloc.start()
    for draw in range(2):
        order.auc(np.bincount(metrics._places("bootstrap", draw, m) % m, minlength=m))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * m
    assert metrics._places("s", 3, 70_000)[[0, 69_999]].tolist() == [int(hashlib.sha256(f"s|3|{k}".encode()).hexdigest()[:12], 16) for k in (0, 69_999)]
