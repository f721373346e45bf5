"""Quality and target audits with reason codes, and keyed annotation tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import clean_double, normal_target, reasons
from .cohort import round_robin
from .neighbours import hamming_anti
from .quantiles import exact_quantiles, has_large_groups
from .robust import beside

#: Fixed values of the audits.
LOW_RANGE, BLUR_FLOOR, NOISE_CEILING, LOW_Q, HIGH_Q, MIN_VALUES = 12.0, 4.0, 0.30, 0.03, 0.97, 5
MASK_EMPTY, MASK_FULL = 0.0005, 0.98
WEIGHT_ABSENT, WEIGHT_AUTO, WEIGHT_MANUAL = 0.90, 0.72, 1.0


def quality_thresholds(items: DataFrame, subject: str, sharpness: str, noise: str) -> DataFrame:
    """blur and noise limits of each subject, from its own quantiles if it has enough finite values."""
    if has_large_groups(items, [subject]):
        of = lambda name, q: exact_quantiles(items, [subject], name, [q])
        told = lambda bound, pick, q, n: F.when(F.col(n) >= MIN_VALUES, pick(F.lit(bound), F.get(q, F.lit(0)))).otherwise(F.lit(bound))
        counts = items.groupBy(subject).agg(F.count("*").alias("n"))
        blur, noisy = of(sharpness, LOW_Q).select(subject, F.col("n").alias("_n0"), F.col("q").alias("_q0")), of(noise, HIGH_Q).select(subject, F.col("n").alias("_n1"), F.col("q").alias("_q1"))
        every = beside(beside(counts, blur, [subject]), noisy, [subject])
        return every.select(subject, told(BLUR_FLOOR, F.greatest, "_q0", "_n0").alias("blur_threshold"), told(NOISE_CEILING, F.least, "_q1", "_n1").alias("noise_threshold"), "n")

    def limit(name: str, q: float, bound: float, pick) -> Column:
        v = clean_double(F.col(name))
        return F.when(F.count(v) >= MIN_VALUES, pick(F.lit(bound), F.percentile(v, F.lit(q)))).otherwise(F.lit(bound))

    return items.groupBy(subject).agg(limit(sharpness, LOW_Q, BLUR_FLOOR, F.greatest).alias("blur_threshold"), limit(noise, HIGH_Q, NOISE_CEILING, F.least).alias("noise_threshold"), F.count("*").alias("n"))


def quality_audit(items: DataFrame, subject: str, sharpness: str, noise: str, spread: str) -> DataFrame:
    """Adds the thresholds, quality_reason and quality_valid."""
    joined = items.join(quality_thresholds(items, subject, sharpness, noise).drop("n"), subject)
    wide = clean_double(F.col(spread))
    sharp, loud = clean_double(F.col(sharpness)), clean_double(F.col(noise))
    why = reasons(("low_dynamic_range", wide.isNull() | (wide < LOW_RANGE)), ("blurred", sharp.isNull() | (sharp < F.col("blur_threshold"))), ("noisy", loud.isNull() | (loud > F.col("noise_threshold"))))
    return joined.withColumn("quality_reason", why).withColumn("quality_valid", (F.col("quality_reason") == "").cast("int"))


def mask_reason(found: Column, area: Column) -> Column:
    """Why a mask can't be used: missing, unreadable, empty_or_nearly_empty or nearly_full; '' if it can."""
    return F.when(~found, "missing").when(area.isNull(), "unreadable").when(area < MASK_EMPTY, "empty_or_nearly_empty").when(area > MASK_FULL, "nearly_full").otherwise("")


def default_weight(target: Column, source: Column) -> Column:
    return F.when(target == "NO_HEART_VISIBLE", WEIGHT_ABSENT).when(F.contains(F.lower(source), F.lit("auto")), WEIGHT_AUTO).otherwise(WEIGHT_MANUAL)


def all_marks(annotations: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """key, target_type, mask_area, found of every item that has an annotation or a mask file, for ``target_audit``. masks: key, area (null: unreadable)."""
    told = annotations.select(key, "target_type")
    there = masks.select(key, F.col("area").alias("mask_area"), F.lit(True).alias("found"))
    return told.join(there, key, "full").select(key, "target_type", "mask_area", F.coalesce("found", F.lit(False)).alias("found"))


def target_audit(items: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """ACCEPTED, EXCLUDED or REJECTED for every key of marks.

    items: key, quality_valid, and quality_reason if there is one. marks: key, target_type, mask_area (null: no readable mask), and
    mask_found if masks may be there unread. A mask without a target counts as present if it can be used. A negative target
    without a mask has an empty one. Unusable targets are excluded, keys of no item rejected; others are accepted without reasons.
    """
    own_reason = F.col("quality_reason") if "quality_reason" in items.columns else F.lit(None).cast("string")
    found = F.col("mask_found") if "mask_found" in marks.columns else F.col("mask_area").isNotNull()
    left = marks.select(key, normal_target(F.col("target_type")).alias("told"), clean_double(F.col("mask_area")).alias("mask_area"), F.coalesce(found, F.lit(False)).alias("found"))
    right = items.select(key, "quality_valid", own_reason.alias("quality_reason"), F.lit(True).alias("_item"))
    out = left.join(right, key, "left").withColumn("mask", mask_reason(F.col("found"), F.col("mask_area")))
    target = F.when(F.col("told") != "", F.col("told")).when(F.col("mask") == "", "HEART_PRESENT").otherwise("UNLABELED_EMPTY")
    out = out.withColumn("target", F.when(F.col("_item").isNull(), F.col("told")).otherwise(target))
    is_ = lambda name: F.col("target") == name
    kind = F.when(is_("HEART_PRESENT"), F.col("mask")).when(is_("NO_HEART_VISIBLE"), F.when(F.col("found") & F.col("mask_area").isNull(), "unreadable_negative_mask").when(F.col("mask_area") >= MASK_EMPTY, "no_heart_annotation_has_nonempty_mask").otherwise(""))
    kind = kind.when(is_("UNUSABLE"), "explicitly_unusable").otherwise("empty_mask_without_explicit_no_heart_label")
    poor = F.when(~is_("UNUSABLE") & (F.coalesce("quality_valid", F.lit(0)) != 1), F.coalesce("quality_reason", F.lit("quality_invalid")))
    why = F.when(F.col("_item").isNull(), "token_absent_from_dataset").otherwise(F.concat_ws(";", F.nullif(kind, F.lit("")), poor))
    out = out.withColumn("reason", why)
    status = F.when(F.col("_item").isNull(), "REJECTED").when(is_("UNUSABLE"), "EXCLUDED").when((F.col("reason") == "") & poor.isNull(), "ACCEPTED").otherwise("REJECTED")
    return out.select(key, "target", "quality_valid", "mask_area", status.alias("status"), "reason")


def audit_counters(audited: DataFrame, by: str) -> DataFrame:
    """Rows of each status by a column."""
    return audited.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ACCEPTED", "REJECTED", "EXCLUDED")])


def fold_counters(audited: DataFrame, fold: str, folds: int = 5) -> DataFrame:
    """One row: accepted targets of each fold, present and absent (0 where there are none)."""
    of = lambda k, name: F.count_if((F.col(fold) == k) & (F.col("status") == "ACCEPTED") & (F.col("target") == name))
    return audited.agg(*[of(k, name).alias(f"fold_{k}_{short}") for k in range(folds) for name, short in (("HEART_PRESENT", "present"), ("NO_HEART_VISIBLE", "absent"))])


def integrity(audited: DataFrame, subject: str, fold: str, folds: int = 5) -> DataFrame:
    """One row: accepted present targets, folds that have one, subjects that have one. See ``require_targets``."""
    good = audited.where("status = 'ACCEPTED' AND target = 'HEART_PRESENT'")
    return good.agg(F.count("*").alias("positives"), F.count_distinct(F.when(F.col(fold).between(0, folds - 1), F.col(fold))).alias("folds"), F.count_distinct(subject).alias("subjects"))


def require_targets(audited: DataFrame, subject: str, fold: str, folds: int = 5, positives: int = 800, subjects: int = 6) -> None:
    """Raises unless there are enough accepted present targets, in every fold, of enough subjects."""
    require(integrity(audited, subject, fold, folds), positives=F.first("positives") >= positives, folds=F.first("folds") == folds, subjects=F.first("subjects") >= subjects)


def reason_counts(audited: DataFrame) -> DataFrame:
    return audited.where("reason <> ''").select(F.explode(F.split("reason", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def require(table: DataFrame, **conditions: Column) -> None:
    """Raises if an aggregate condition fails over the table: the gates of a stage."""
    row = table.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()]).first()
    if failed := [n for n in conditions if not row[n]]:
        raise ValueError(f"failed: {', '.join(failed)}")


def latest(log: DataFrame, key: str, time: str, action: str | None = None, delete: str = "delete") -> DataFrame:
    """The last state of each key of an event log; deleted keys go."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc(), F.xxhash64(*log.columns))
    last = log.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")
    return last.where(F.col(action) != delete) if action else last


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those of the same key; columns of either side stay."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def import_counters(masks: DataFrame, items: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """One row: masks, those of no item, those labelled already."""
    known = masks.select(key).join(items.select(key, F.lit(1).alias("_i")).distinct(), key, "left").join(labelled.select(key, F.lit(1).alias("_l")).distinct(), key, "left")
    return known.agg(F.count("*").alias("masks"), F.count_if(F.col("_i").isNull()).alias("absent"), F.count_if(F.col("_l").isNotNull()).alias("already_labelled"))


#: Fixed values of the review scopes.
UNCERTAIN, NEAR_THRESHOLD, NOVEL_RADIUS, LEAST_PER_SUBJECT = 0.18, 0.15, 6, 10
SCOPES = ("invalid", "uncertain", "empty", "novel", "manual", "all")


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    """The rows of a review scope, with review_priority (smaller comes first).

    Columns used: target ('' if unlabelled), quality_valid, valid (of the automatic mask), available (it is there), uncertainty, presence,
    presence_threshold, peak, mask_reason (of the manual mask; 'missing' without one), phash (signed long; novel alone).
    Only unlabelled rows with an automatic mask are in a scope. ``novel`` are those farther than six bits from every annotated hash.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    valid, doubt = F.coalesce("valid", F.lit(1)), clean_double(F.col("uncertainty"), 0.0)
    has_mask, good = F.col("mask_reason") != "missing", F.coalesce("quality_valid", F.lit(0)) == 1
    near = F.coalesce(F.abs(clean_double(F.col("presence")) - clean_double(F.col("presence_threshold"), 0.5)) <= NEAR_THRESHOLD, F.lit(False))
    tests = {
        "invalid": (valid == 0, clean_double(F.col("peak"), 0.0)),
        "uncertain": (good & ((doubt >= UNCERTAIN) | near | (valid != 1)), -doubt),
        "empty": (F.col("mask_reason") == "empty_or_nearly_empty", -doubt),
        "novel": (~has_mask & good, -doubt),
        "manual": (has_mask, F.lit(0.0)),
        "all": (F.lit(True), F.lit(0.0)),
    }
    test, priority = tests[scope]
    out = rows.where((F.col("target") == "") & F.coalesce("available", F.lit(False)) & test).withColumn("review_priority", priority)
    if scope != "novel":
        return out
    known = rows.where((F.col("target") != "") | has_mask).where("phash is not null")
    if not known.limit(1).count():
        raise ValueError("the novel scope needs an annotated row")
    return hamming_anti(out.where("phash is not null"), known, "phash", NOVEL_RADIUS)


def novel_exclusions(rows: DataFrame, reviewed: DataFrame, item: str) -> DataFrame:
    """(reason, n): why unlabelled rows are not in the novel scope, the first reason of each counting."""
    near = hamming_anti(rows.where("phash is not null"), rows.where("(target <> '' OR mask_reason <> 'missing') AND phash is not null"), "phash", NOVEL_RADIUS).select(item, F.lit(True).alias("_far")).distinct()
    told = rows.where("target = ''").join(reviewed.select(item, F.lit(True).alias("_seen")).distinct(), item, "left").join(near, item, "left")
    why = (
        F.when(F.col("mask_reason") != "missing", "already_annotated").when(F.col("_seen"), "already_reviewed_this_round").when(F.coalesce("quality_valid", F.lit(0)) != 1, "quality_invalid")
        .when(~F.coalesce("available", F.lit(False)), "missing_attention_mask").when(F.col("phash").isNull(), "missing_phash").when(F.col("_far").isNull(), "similar_to_annotated")
    )
    return told.select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def review_queue(rows: DataFrame, reviewed: DataFrame, scope: str, subject: str, series: str, item: str, limit: int = 300, seed: int = 42) -> DataFrame:
    """The queue of a scope with queue_position from 1: rows not reviewed yet, in turns over subjects; in order of their names for manual and all."""
    open_ = in_scope(rows, scope).join(reviewed.select(item).distinct(), item, "left_anti")
    if scope in ("manual", "all"):
        top = open_.select(subject, series, item).orderBy(subject, series, item).limit(limit)
        return top.withColumn("queue_position", F.row_number().over(Window.orderBy(subject, series, item)))
    most = LEAST_PER_SUBJECT
    if scope != "novel":
        most = max(most, math.ceil(limit / max(1, open_.agg(F.count_distinct(subject)).first()[0])))
    peak = clean_double(F.col("peak"), 0.0) if "peak" in rows.columns else F.lit(0.0)
    queue = round_robin(open_.withColumn("_peak", peak), subject, series, item, most, limit, str(seed), ["review_priority", "_peak"])
    return queue.withColumn("queue_position", F.row_number().over(Window.orderBy("turn", subject))).drop("turn")


def unreviewed(rows: DataFrame, history: DataFrame, key: str, round_column: str, review_round: int) -> DataFrame:
    return rows.join(history.where(F.col(round_column) == review_round).select(key), key, "left_anti")
