"""Metrics of binary classifiers as grouped and windowed aggregates, and bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.clean import clean_double


def _by_score(rows: DataFrame, by: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg): a row for each distinct score."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))


def _down(by: list[str]):
    return Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def roc_auc(rows: DataFrame, by: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve; ties count half; null with one class."""
    s = _by_score(rows, by, label, score, weight).withColumn("_pos", F.sum("pos").over(_down(by)))
    wins = F.sum(F.col("neg") * (F.col("_pos") - F.col("pos") / 2))
    return s.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Sum of precision times gain of recall, by falling distinct scores."""
    s = _by_score(rows, by, label, score).withColumns({"_pos": F.sum("pos").over(_down(by)), "_all": F.sum(F.col("pos") + F.col("neg")).over(_down(by))})
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("_pos") / F.col("_all")), F.sum("pos")).alias("average_precision"))


def youden_threshold(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """The largest score at which tpr - fpr is largest."""
    every = Window.partitionBy(*by)
    s = _by_score(rows, by, label, score)
    s = s.withColumns({"tpr": F.try_divide(F.sum("pos").over(_down(by)), F.sum("pos").over(every)), "fpr": F.try_divide(F.sum("neg").over(_down(by)), F.sum("neg").over(every))})
    s = s.withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return s.groupBy(*by).agg(F.max_by("score", F.struct("j", "score")).alias("threshold"), F.max("j").alias("youden"))


def confusion_metrics(rows: DataFrame, by: list[str], label: str, score: str, threshold: float) -> DataFrame:
    """Brier score, accuracy, sensitivity, specificity (0 where a class is absent)."""
    y, hat = F.col(label), (F.col(score) >= threshold).cast("int")
    share = lambda hit, among: F.count_if(hit) / F.greatest(F.count_if(among), F.lit(1))
    return rows.groupBy(*by).agg(
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg((hat == y).cast("double")).alias("accuracy"),
        share((hat == 1) & (y == 1), y == 1).alias("sensitivity"), share((hat == 0) & (y == 0), y == 0).alias("specificity"),
    )


def balanced_accuracy(rows: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    """Mean over the classes that occur of the share predicted right."""
    return rows.groupBy(*by, label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("_r")).groupBy(*by).agg(F.avg("_r").alias("balanced_accuracy"))


def subject_balanced_mean(rows: DataFrame, by: list[str], subject: str, value: str) -> DataFrame:
    """Mean over subjects of their means of finite values."""
    return rows.groupBy(*by, subject).agg(F.avg(clean_double(F.col(value))).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"), F.count("_m").alias("subjects"))


def overlap(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Dice, IoU, precision and recall of counts; two empty sets agree."""
    none = lambda d: d == 0
    return {
        "dice": F.when(none(tp + fp + fn), 1.0).otherwise(2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))),
        "iou": F.when(none(tp + fp + fn), 1.0).otherwise(tp / F.greatest(tp + fp + fn, F.lit(1))),
        "precision": F.when(none(tp + fp), F.when(none(fn), 1.0).otherwise(0.0)).otherwise(tp / F.greatest(tp + fp, F.lit(1))),
        "recall": F.when(none(tp + fn), 1.0).otherwise(tp / F.greatest(tp + fn, F.lit(1))),
    }


#: Fixed values of the calibration.
THRESHOLDS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
SMOOTHING, EMPTY_AREA, INVALID_PENALTY, EMPTY_PREDICTION, CERTAIN_PIXEL = 1e-6, 0.10, 0.20, 0.003, 0.80


def target_quality(present: Column, overlap_pixels: Column, both_pixels: Column, predicted_share: Column) -> Column:
    """How good a mask is: smoothed Dice of a present target, of an absent one 1 less its area over a tenth."""
    return F.when(present == 1, (2 * overlap_pixels + SMOOTHING) / (both_pixels + SMOOTHING)).otherwise(1 - F.least(F.lit(1.0), predicted_share / EMPTY_AREA))


def grid_search(tried: DataFrame, threshold: str, subject: str, present: str, quality: str, valid: str) -> DataFrame:
    """(threshold, score, mean_quality, invalid_rate) of the best: subject-balanced quality less the penalty for the share of present targets with invalid masks.

    tried: a row for each target and threshold. Ties go to the threshold nearest to a half, then the smaller.
    """
    n = F.sum((F.col(present) == 1).cast("long"))
    parts = tried.groupBy(threshold, subject).agg(F.avg(quality).alias("_q"), F.sum(((F.col(present) == 1) & (F.col(valid) != 1)).cast("long")).alias("_bad"), n.alias("_n"))
    one = parts.groupBy(threshold).agg(F.avg("_q").alias("mean_quality"), (F.sum("_bad") / F.greatest(F.lit(1), F.sum("_n"))).alias("invalid_rate"))
    one = one.withColumn("score", F.col("mean_quality") - INVALID_PENALTY * F.col("invalid_rate"))
    best = F.struct(F.round("score", 12), -F.abs(F.col(threshold) - 0.5), -F.col(threshold))
    return one.agg(F.max_by(F.struct(F.col(threshold).alias("threshold"), "score", "mean_quality", "invalid_rate"), best).alias("b")).select("b.*")


def presence_threshold(rows: DataFrame, grid: tuple[float, ...], present: str, probability: str) -> DataFrame:
    """(threshold, balanced_accuracy): the best of the grid, if it is better than 0.5; 0.5 with one class alone."""
    both = rows.agg(F.count_distinct(present).alias("_classes"))
    tried = rows.withColumn("threshold", F.explode(F.array(F.lit(0.5), *map(F.lit, grid)))).withColumn("_hat", (F.col(probability) >= F.col("threshold")).cast("int"))
    each = balanced_accuracy(tried, ["threshold"], present, "_hat").join(F.broadcast(both)).where("_classes = 2 OR threshold = 0.5")
    best = F.struct(F.round("balanced_accuracy", 12), -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    return each.agg(F.max_by("threshold", best).alias("threshold"), F.max_by("balanced_accuracy", best).alias("balanced_accuracy"))


def presence_decision(probability: Column, threshold: Column, peak: Column) -> Column:
    """1 if the presence head says so, or a pixel is certain."""
    return ((probability >= threshold) | (peak >= CERTAIN_PIXEL)).cast("int")


def segmentation_summary(rows: DataFrame, subject: str) -> DataFrame:
    """One row over evaluated targets. Columns used: present, dice, iou, precision, recall, predicted_area, false_positive_area.

    Means are balanced over subjects and null without rows.
    """
    good = F.col("present") == 1
    per = rows.groupBy(subject).agg(
        F.count("*").alias("_n"), F.count_if(good).alias("_p"), F.avg("dice").alias("dice_all"), *[F.avg(F.when(good, F.col(c))).alias(c) for c in ("dice", "iou", "precision", "recall")],
        F.sum(F.when(~good, (F.col("predicted_area") < EMPTY_PREDICTION).cast("double"))).alias("_e"), F.sum(F.when(~good, F.col("false_positive_area"))).alias("_f"),
    )
    negative = F.sum("_n") - F.sum("_p")
    return per.agg(
        F.sum("_n").alias("targets"), F.sum("_p").alias("positives"), negative.alias("negatives"), F.avg("dice_all").alias("dice_all"), *[F.avg(c).alias(f"{c}_positive") for c in ("dice", "iou", "precision", "recall")],
        F.try_divide(F.sum("_e"), negative).alias("empty_prediction_rate"), F.try_divide(F.sum("_f"), negative).alias("mean_false_positive_area"),
    )


def prediction_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counters of predictions. Columns used: valid_initial, valid_final, present, repair, uncertainty."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("predictions"), F.count_if(F.col("valid_initial") == 1).alias("initially_valid"), F.count_if(F.col("valid_final") == 1).alias("finally_valid"), F.count_if(F.col("present") == 0).alias("empty"),
        F.count_if(F.col("repair") != "none").alias("repaired"), F.count_if(F.col("uncertainty") >= 0.18).alias("uncertain"),
    )


#: Draws of a task, which share the arrays of all units; hashes that are made at once.
DRAWS, HASHES = 125, 1 << 16


class _Falling:
    """The subjects of a unit by falling score: what each draw's AUC needs, sorted once."""

    def __init__(self, label: np.ndarray, score: np.ndarray) -> None:
        self.order = np.argsort(-score, kind="stable").astype(np.int32)
        fallen = score[self.order]
        self.starts = np.flatnonzero(np.r_[True, fallen[1:] != fallen[:-1]]).astype(np.int32)
        self.is_pos, self.is_neg = (label[self.order] == c for c in (1, 0))

    def auc(self, times: np.ndarray | None = None) -> float:
        """Each subject counts so many times, or once. NaN where a class is absent."""
        each = np.ones(len(self.order)) if times is None else times[self.order].astype(float)
        pos, neg = (np.add.reduceat(each * which, self.starts) for which in (self.is_pos, self.is_neg))
        both = pos.sum() * neg.sum()
        return float((neg * (np.cumsum(pos) - pos / 2)).sum() / both) if both > 0 else float("nan")


def _places(salt: str, draw: int, m: int) -> np.ndarray:
    """Of the places of a draw the first 48 bits of a hash of (salt, draw, place): the rank that the place takes, modulo the subjects. They serve all units, whatever their size."""
    out, start, powers = np.empty(m, np.int64), f"{salt}|{draw}|".encode(), 1 << np.arange(40, -1, -8)
    for at in range(0, m, HASHES):
        raw = b"".join([hashlib.sha256(b"%b%d" % (start, k)).digest()[:6] for k in range(at, min(m, at + HASHES))])
        out[at : at + HASHES] = np.frombuffer(raw, np.uint8).reshape(-1, 6) @ powers
    return out


def resampled_aucs(units: DataFrame, n: int = 2000, salt: str = "bootstrap") -> DataFrame:
    """unit, subjects, auc_0, auc_1, and ends (ci_low, ci_high, resamples) of auc_0 and of the difference auc_0 - auc_1.

    units: unit, subject, label, score_0, score_1; subjects are the statistical units, one row each. Subjects of a unit are resampled n times, by their rank. A unit's rows meet
    as arrays (20 bytes a subject); its draws are dealt out in blocks, whose draws are made one after the other, so a task holds the arrays and one draw. Each draw's hashes serve all units. Draws of one class alone don't count.
    """
    row = F.struct("subject", F.col("label").cast("int").alias("label"), F.col("score_0").cast("double").alias("score_0"), F.col("score_1").cast("double").alias("score_1"))
    arrays = units.groupBy("unit").agg(F.array_sort(F.collect_list(row)).alias("x")).select("unit", *[F.col(f"x.{c}").alias(c) for c in ("label", "score_0", "score_1")])
    tasks = arrays.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(DRAWS))))
    blocks = -(-n // DRAWS)
    tasks = tasks.repartition(blocks, "first").sortWithinPartitions("first")
    kind, arrow = units.schema["unit"].dataType.simpleString(), to_arrow_type(units.schema["unit"].dataType)

    def drawn_of(first: int, some: list) -> pa.RecordBatch:
        """A block's draws of some units (unit, size, and both scores' order); the whole, each subject once, comes with the first block."""
        found = [(unit, -1, m, a.auc(), b.auc()) for unit, m, a, b in some] if first == 0 else []
        for draw in range(first, min(n, first + DRAWS)):
            ranks = _places(salt, draw, max(m for _, m, _, _ in some))
            for unit, m, a, b in some:
                times = np.bincount(ranks[:m] % m, minlength=m)
                x = a.auc(times)
                found.append((unit, draw, m, x, x if b is a else b.auc(times)))
        unit, draws, sizes, x, y = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(unit, arrow), pa.array(draws, pa.int32()), pa.array(sizes, pa.int64()), pa.array(np.array(x), from_pandas=True), pa.array(np.array(y), from_pandas=True)], names=["unit", "draw", "subjects", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, at = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                first = batch["first"][k].as_py()
                if some and first != at:
                    yield drawn_of(at, some)
                    some = []
                at = first
                label, *scores = (batch[c][k].values.to_numpy(zero_copy_only=False) for c in ("label", "score_0", "score_1"))
                one = _Falling(label, scores[0])
                some.append((batch["unit"][k].as_py(), len(label), one, one if np.array_equal(*scores) else _Falling(label, scores[1])))
        if some:
            yield drawn_of(at, some)

    each = tasks.mapInArrow(run, f"unit {kind}, draw int, subjects long, x double, y double").withColumn("d", F.col("x") - F.col("y"))
    whole, drawn = F.col("draw") < 0, F.col("draw") >= 0
    ends = lambda c: F.struct(F.percentile(F.when(drawn, F.col(c)), F.lit(0.025)).alias("ci_low"), F.percentile(F.when(drawn, F.col(c)), F.lit(0.975)).alias("ci_high"), F.count(F.when(drawn, F.col(c))).alias("resamples"))
    return each.groupBy("unit").agg(F.max("subjects").alias("subjects"), F.max(F.when(whole, F.col("x"))).alias("auc_0"), F.max(F.when(whole, F.col("y"))).alias("auc_1"), ends("x").alias("own"), ends("d").alias("difference"))


def bootstrap_auc(rows: DataFrame, subject: str, label: str, score: str, n: int = 2000) -> DataFrame:
    """One row: auc, ci_low, ci_high over n resamples of subjects; resamples of one class don't count."""
    unit = rows.select(F.lit(0).alias("unit"), F.col(subject).alias("subject"), F.col(label).alias("label"), F.col(score).alias("score_0"), F.col(score).alias("score_1"))
    return resampled_aucs(unit, n).select(F.col("auc_0").alias("auc"), "own.*")


#: The comparisons of modes, first less second, in order, each with its question.
COMPARISONS = (
    ("AU1_ATTENTION_ROI", "B2_ATTENTION_ELIGIBLE_FULL_IMAGE", "same_attention_eligible_slices_roi_vs_full_image"),
    ("B2_ATTENTION_ELIGIBLE_FULL_IMAGE", "C1_ATTENTION_COMPLEMENT", "same_attention_eligible_slices_full_image_vs_complement"),
    ("AU1_ATTENTION_ROI", "C1_ATTENTION_COMPLEMENT", "same_attention_eligible_slices_roi_vs_complement"),
    ("B2_ATTENTION_ELIGIBLE_FULL_IMAGE", "B0_FULL_IMAGE", "attention_eligible_selection_effect_on_full_image"),
    ("AU2_MATCHED_ATTENTION_ROI", "B1_MATCHED_FULL_IMAGE", "cross_class_matched_roi_vs_full_image"),
    ("AU2_MATCHED_ATTENTION_ROI", "C2_MATCHED_ATTENTION_COMPLEMENT", "cross_class_matched_roi_vs_complement"),
    ("B1_MATCHED_FULL_IMAGE", "C2_MATCHED_ATTENTION_COMPLEMENT", "cross_class_matched_full_image_vs_complement"),
    ("B0_FULL_IMAGE", "B1_MATCHED_FULL_IMAGE", "all_slices_vs_cross_class_matched_full_image"),
    ("AU1_ATTENTION_ROI", "AU2_MATCHED_ATTENTION_ROI", "attention_eligible_vs_cross_class_matched_roi"),
    ("C1_ATTENTION_COMPLEMENT", "C2_MATCHED_ATTENTION_COMPLEMENT", "attention_eligible_vs_cross_class_matched_complement"),
    ("M1_MANUAL_ROI", "AU3_ATTENTION_ROI_MANUAL_SUBSET", "manual_vs_attention_roi_same_images"),
    ("C3_MANUAL_COMPLEMENT", "C4_ATTENTION_COMPLEMENT_MANUAL_SUBSET", "manual_vs_attention_complement_same_images"),
)


def compare_modes(scores: DataFrame, comparisons: Sequence[tuple[str, str, str]] = COMPARISONS, n: int = 2000, subject: str = "subject", label: str = "label", score: str = "score") -> DataFrame:
    """position, comparison, first, second, subjects, auc_difference, ci_low, ci_high: a row for each comparison, also where the modes share no subject.

    Both modes of a comparison are resampled together, on the subjects that they share with the same label; null with fewer than four of them or one class alone.
    """
    told = scores.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(comparisons)], "position int, first string, second string, comparison string")
    side = lambda k, m: scores.select(F.col("mode").alias(m), F.col(subject).alias("subject"), F.col(label).alias("label"), F.col(score).alias(f"score_{k}"))
    pairs = F.broadcast(told).join(side(0, "first"), "first").join(side(1, "second"), ["second", "subject", "label"])
    found = resampled_aucs(pairs.select(F.col("position").alias("unit"), "subject", "label", "score_0", "score_1"), n)
    out = told.join(found, F.col("position") == F.col("unit"), "left")
    told_by = F.when(F.col("subjects") >= 4, F.col("auc_0") - F.col("auc_1"))
    at = lambda c: F.when(told_by.isNotNull(), F.col(f"difference.{c}")).alias(c)
    return out.select("position", "comparison", "first", "second", F.coalesce("subjects", F.lit(0).cast("long")).alias("subjects"), told_by.alias("auc_difference"), at("ci_low"), at("ci_high"))


def hit_rates(scores: DataFrame) -> DataFrame:
    """mode, subjects, brier, accuracy, sensitivity, specificity (0 where a class is absent) of all modes in one pass. scores: mode, subject, label, score, predicted."""
    hit, apart = F.col("predicted") == F.col("label"), F.col("score") - F.col("label")
    share = lambda c: F.count_if(hit & (F.col("label") == c)) / F.greatest(F.lit(1), F.count_if(F.col("label") == c))
    return scores.groupBy("mode").agg(F.count_distinct("subject").alias("subjects"), F.avg(apart * apart).alias("brier"), F.avg(hit.cast("double")).alias("accuracy"), share(1).alias("sensitivity"), share(0).alias("specificity"))


def mode_metrics(scores: DataFrame, n: int = 2000) -> DataFrame:
    """A row a mode: place (from 1, by falling AUC), mode, experiment_group, cohort, subjects, auc and its interval, average_precision, brier, accuracy, sensitivity, specificity.

    scores: mode, subject, label, score, predicted, out of fold. Raises where a score or a prediction is missing or a mode has one class alone.
    """
    from .pooling import cohort_of, is_primary

    odd = scores.groupBy("mode").agg(F.count_distinct("label").alias("classes"), F.count_if(clean_double(F.col("score")).isNull() | F.col("predicted").isNull() | ~F.col("predicted").isin(0, 1)).alias("open"))
    bad = odd.where("classes < 2 OR open > 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].mode}: " + (f"{bad[0].open} predictions are missing" if bad[0].open else "one class is missing"))
    each = hit_rates(scores).drop("subjects")
    drawn = resampled_aucs(scores.select(F.col("mode").alias("unit"), "subject", "label", F.col("score").alias("score_0"), F.col("score").alias("score_1")), n)
    aucs = drawn.select(F.col("unit").alias("mode"), "subjects", F.col("auc_0").alias("auc"), F.col("own.ci_low").alias("auc_ci_low"), F.col("own.ci_high").alias("auc_ci_high"))
    out = aucs.join(average_precision(scores, ["mode"], "label", "score"), "mode").join(each, "mode")
    place = F.row_number().over(Window.orderBy(F.col("auc").desc(), "mode"))  # a row a mode, so one task does
    columns = ["subjects", "auc", "auc_ci_low", "auc_ci_high", "average_precision", "brier", "accuracy", "sensitivity", "specificity"]
    return out.select(place.alias("place"), "mode", F.when(is_primary(F.col("mode")), "primary").otherwise("mask_validation").alias("experiment_group"), cohort_of(F.col("mode")).alias("cohort"), *columns).orderBy("place")


def evaluate_modes(scores: DataFrame, n: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(metrics a mode by falling AUC, the comparisons of COMPARISONS) of out-of-fold scores: see ``mode_metrics`` and ``compare_modes``."""
    return mode_metrics(scores, n), compare_modes(scores, COMPARISONS, n)


def paired_auc_difference(rows: DataFrame, mode: str, first: str, second: str, subject: str, label: str, score: str, n: int = 2000) -> DataFrame:
    """One row: the difference of two modes' AUC on shared subjects and its interval, over shared resamples; null with fewer than four subjects."""
    named = rows.select(F.col(mode).alias("mode"), F.col(subject).alias("subject"), F.col(label).alias("label"), F.col(score).alias("score"))
    return compare_modes(named, [(first, second, "")], n).select("subjects", "auc_difference", "ci_low", "ci_high")
