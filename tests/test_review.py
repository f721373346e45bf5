"""Review actions by hand, and weighted draws against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest

from cohortloom.operators import review, sampling

LOG = "at long, turn long, review_round int, item string, action string, drawn_area double, auto_area double, queue_position long, queue_size long"


def log_of(spark, rows):
    return spark.createDataFrame([(t, k, r, i, a, d, m, k, 9) for k, (t, r, i, a, d, m) in enumerate(rows)], LOG)


def test_actions_by_hand(spark):
    rows = [
        (1, 1, "a", "save_manual_heart_present", 0.2, 0.3), (2, 1, "a", "skip", None, None),
        (1, 1, "b", "accept_auto_and_save", None, 0.3), (3, 1, "b", "mark_unusable", None, None),
        (1, 1, "c", "mark_no_heart_visible", 0.9, 0.9), (2, 2, "d", "mark_unusable", None, None), (1, 1, "d", "save_manual_heart_present", 0.2, None),
        (1, 1, "e", "save_manual_heart_present", 0.2, None), (2, 1, "e", "delete_manual_and_annotation", None, None),
        (1, 1, "f", "skip", None, None), (1, 2, "g", "save_manual_heart_present", 0.0004, 0.5), (1, 2, "h", "accept_auto_and_save", 0.5, 0.0), (1, 2, "i", "paint", 0.5, 0.5), (1, 1, None, "skip", None, None),
        (1, 1, "j", "delete_manual_and_annotation", None, None), (5, 1, "k", "mark_unusable", None, None), (5, 1, "k", "accept_auto_and_save", None, 0.0005),
    ]
    log = log_of(spark, rows)
    before = spark.createDataFrame([("f", "UNUSABLE", "old", 0.0), ("j", "HEART_PRESENT", "old", 1.0), ("z", "HEART_PRESENT", "old", 0.5), ("a", "UNUSABLE", "old", 0.0)], "item string, target_type string, source string, sample_weight double")
    got = {r.item: tuple(r)[1:] for r in review.states(log, before).collect()}
    assert got == {
        "a": ("HEART_PRESENT", "human_drawn_or_corrected", 1.0, "drawn", 0.2, 1, 1), "b": ("UNUSABLE", "human_unusable", 0.0, "none", None, 2, 0), "c": ("NO_HEART_VISIBLE", "human_no_heart_visible", 0.90, "empty", 0.0, 1, 0),
        "d": ("UNUSABLE", "human_unusable", 0.0, "none", None, 2, 0), "e": (None, None, None, "none", None, 2, 0), "f": ("UNUSABLE", "old", 0.0, None, None, 0, 1), "j": (None, None, None, "none", None, 1, 0),
        "k": ("HEART_PRESENT", "human_confirmed_auto", 0.72, "automatic", 0.0005, 2, 0), "z": ("HEART_PRESENT", "old", 0.5, None, None, 0, 0),
    }
    assert {r.item: r.problem for r in review.checked(log).where("problem <> ''").collect()} == {"g": "mask_is_empty", "h": "automatic_mask_is_empty", "i": "unknown_action", None: "no_item"}
    assert {r.item for r in review.annotations_after(log, before).collect()} == {"a", "b", "c", "d", "f", "k", "z"}
    assert {r.item for r in review.masks_to_delete(log).collect()} == {"b", "d", "e", "j"}
    queue = spark.createDataFrame([(x,) for x in "abdfgiz"], "item string")
    assert {r.item for r in review.pending(queue, log, 1).collect()} == {"g", "i", "z"}
    assert {r.item for r in review.pending(queue, log, 2).collect()} == set("abfgiz")
    told = {(r.item, r.action): r.mask_area_ratio for r in review.history(log).collect()}
    assert told["a", "save_manual_heart_present"] == 0.2 and told["c", "mark_no_heart_visible"] == 0.0 and told["a", "skip"] is None and len(told) == 13


def test_no_actions(spark):
    log = log_of(spark, [(1, 1, "a", "skip", None, None)]).limit(0)
    assert review.states(log).count() == 0 and review.pending(spark.range(2).selectExpr("CAST(id AS string) AS item"), log, 1).count() == 2


def plain_draws(rows, n, seed):
    some = sorted((k, w) for k, w in rows if k is not None and w is not None and math.isfinite(w) and w > 0)
    each, most = sampling.UNITS >> (len(some) - 1).bit_length(), max(w for _, w in some)
    units = [(k, math.floor(w / most * each)) for k, w in some]
    total, out = sum(u for _, u in units), []
    for draw in range(n):
        at = int(hashlib.sha256(f"{seed}|draw|{draw}".encode()).hexdigest()[:15], 16) * total >> 60
        for k, u in units:
            if at < u:
                out.append((draw, k))
                break
            at -= u
    return out


@pytest.mark.parametrize("n,seed", [(400, 42), (7, 1), (3000, 5)])
def test_draws_like_brute_force(spark, n, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([0.0, None, float("nan"), -1.0, rng.random(), rng.paretovariate(0.4)])) for k in range(500)] + [(None, 3.0)]
    rows.append((999, 0.7 * sum(w for k, w in rows if k is not None and w and w > 0)))  # a row of nearly half the weight
    df = spark.createDataFrame(rows, "item long, w double").repartition(5)
    assert sorted(map(tuple, sampling.weighted_draws(df, "item", "w", n, seed).collect())) == plain_draws(rows, n, seed)


def test_shares_are_those_of_the_weights(spark):
    rows = [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    got = Counter(r.item for r in sampling.weighted_draws(spark.createDataFrame(rows, "item long, w double"), "item", "w", 20_000).collect())
    assert all(abs(got[k] / 20_000 - w / 10) < 0.012 for k, w in rows)
    with pytest.raises(ValueError, match="positive weight"):
        sampling.weighted_draws(spark.createDataFrame([(1, 0.0)], "item long, w double"), "item", "w", 3)
