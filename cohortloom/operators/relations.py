"""Joins between the tables of a cohort: items, audits, predictions, folds and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import normal_target
from .audit import mask_reason
from .metrics import overlap


def complete_join(items: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """items with the columns of cached; raises unless both have the same keys, each once."""
    sides = items.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(cached.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    odd = sides.groupBy(key).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")).where("a <> 1 OR b <> 1").limit(1).collect()
    if odd:
        raise ValueError(f"{key} {odd[0][0]!r} is {odd[0].a} times among the items and {odd[0].b} times in the cache")
    return items.join(cached, key)


def accepted_items(audited: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The accepted rows of an audit with their items; those of no item go."""
    return audited.where("status = 'ACCEPTED'").join(items, key)


def with_annotations(rows: DataFrame, annotations: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """rows with target ('' if unlabelled), and the reason and area of the manual mask. masks: key, area (null: unreadable)."""
    told = rows.join(annotations.select(key, F.col("target_type").alias("_told")), key, "left").join(masks.select(key, F.col("area").alias("mask_area"), F.lit(True).alias("_found")), key, "left")
    reason = mask_reason(F.coalesce("_found", F.lit(False)), F.col("mask_area"))
    return told.withColumns({"target": normal_target(F.col("_told")), "mask_reason": reason}).drop("_told", "_found")


def with_sequence(predictions: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """predictions with sequence and index from the manifest; those that it doesn't know lie in their series and folder at index 0. predictions: key, series, path; manifest: key, sequence, index."""
    known = manifest.select(key, F.nullif(F.col("sequence").cast("string"), F.lit("")).alias("_sequence"), F.col("index").alias("_index"))
    own = F.concat_ws("::", F.coalesce("series", F.lit("")), F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))
    both = predictions.join(known, key, "left")
    return both.withColumns({"sequence": F.coalesce("_sequence", own), "index": F.coalesce("_index", F.lit(0))}).drop("_sequence", "_index")


def evaluated_targets(accepted: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Accepted targets that have a prediction, with Dice, IoU, precision and recall of pixel counts tp, fp and fn of the predictions."""
    both = accepted.join(predictions, key)
    return both.withColumns(overlap(F.col("tp"), F.col("fp"), F.col("fn")))


def folds_of(rows: DataFrame, folds: DataFrame, subject: str) -> DataFrame:
    """rows with the fold of their subject; raises for an unknown subject. folds: a row a subject."""
    unknown = rows.select(subject).distinct().join(folds, subject, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no fold for {subject} {unknown[0][0]!r}")
    return rows.join(folds.select(subject, "fold"), subject)


def flagged(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a boolean column: whether their key is among keys."""
    return rows.join(keys.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def combined_parts(parts: dict[int, DataFrame], items: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """One table of the predictions of all folds, each joined to the items of its fold; raises unless every item has one."""
    every = None
    for k, part in sorted(parts.items()):
        own = part.join(items.where(F.col(fold) == k).select(key, fold), key)
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    odd = items.select(key).join(every.groupBy(key).agg(F.count("*").alias("n")), key, "left").where("n IS NULL OR n <> 1").limit(1).collect()
    if odd:
        raise ValueError(f"{key} {odd[0][0]!r} has {odd[0].n or 0} predictions")
    return every


def mapped(values: Column, key: Column, default: Column) -> Column:
    """A map's value for a key, or the default."""
    return F.coalesce(F.try_element_at(values, key), default)


def number_text(value: Column, digits: int = 12) -> Column:
    """A number's text with so many significant digits, without zeros at the end: equal numbers of any type have one text. Null and what is not finite are "nan".

    Numbers too small to be normal (under 1e-307) keep the digits that tell them apart.
    """
    v = value.cast("double")
    text = F.regexp_replace(F.format_string(f"%.{digits}g", v), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    plain = F.regexp_replace(text, r"\.(e|$)", "$1")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit("nan")).when(v == 0, F.when(F.format_string("%f", v).startswith("-"), F.lit("-0")).otherwise(F.lit("0"))).otherwise(plain)
