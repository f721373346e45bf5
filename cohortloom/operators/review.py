"""The log of review actions as a state machine: what each item's annotation and mask are after it.

Every action but skip sets the whole state of its item, so the fold over a log of any length is the last such action of each item: one grouped maximum, which
is combined before the shuffle, so an item that has a third of all actions costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import clean_double
from .audit import MASK_EMPTY, WEIGHT_ABSENT, WEIGHT_AUTO, WEIGHT_MANUAL

#: Of each action the target, the source and the weight that it writes, and the mask that it leaves (drawn, automatic, empty, none, or as it was).
ACTIONS = {
    "save_manual_heart_present": ("HEART_PRESENT", "human_drawn_or_corrected", WEIGHT_MANUAL, "drawn"),
    "accept_auto_and_save": ("HEART_PRESENT", "human_confirmed_auto", WEIGHT_AUTO, "automatic"),
    "mark_no_heart_visible": ("NO_HEART_VISIBLE", "human_no_heart_visible", WEIGHT_ABSENT, "empty"),
    "mark_unusable": ("UNUSABLE", "human_unusable", 0.0, "none"),
    "delete_manual_and_annotation": (None, None, None, "none"),
    "skip": (None, None, None, "kept"),
}


def _of(action: Column, k: int, kind: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for name, told in ACTIONS.items() for x in (name, told[k])]), action).cast(kind)


def checked(log: DataFrame) -> DataFrame:
    """Adds problem ('' if the action counts): an unknown action, no item, or a mask to be saved that is empty. log: item, action, drawn_area, auto_area (shares of the image)."""
    area = F.when(F.col("action") == "save_manual_heart_present", clean_double(F.col("drawn_area"), 0.0)).when(F.col("action") == "accept_auto_and_save", clean_double(F.col("auto_area"), 0.0))
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    why = F.when(~known, "unknown_action").when(F.col("item").isNull(), "no_item").when(area < MASK_EMPTY, F.when(F.col("action") == "accept_auto_and_save", "automatic_mask_is_empty").otherwise("mask_is_empty"))
    return log.withColumn("problem", F.coalesce(why, F.lit("")))


def history(log: DataFrame) -> DataFrame:
    """The actions that count, with mask_area_ratio: what the saved mask covers, null where none was saved. log also has at and turn (the order), review_round, queue_position, queue_size."""
    mask = _of(F.col("action"), 3, "string")
    area = F.when(mask == "drawn", clean_double(F.col("drawn_area"))).when(mask == "automatic", clean_double(F.col("auto_area"))).when(mask == "empty", F.lit(0.0))
    return checked(log).where("problem = ''").select("at", "turn", "review_round", "action", "item", "queue_position", "queue_size", area.alias("mask_area_ratio"))


def states(log: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """item, target_type, source, sample_weight, mask, mask_area, actions, skips: what the log leaves of each item that has an action or an annotation before.

    mask says what is stored: drawn, automatic, empty, none; null if the item had no action but skips and its annotation is as before. annotations: item, target_type, source, sample_weight.
    A deleted annotation is null, as is that of an item that was only skipped.
    """
    good = history(log)
    sets = F.col("action") != "skip"
    order = F.struct("at", "turn", "action")
    last = F.max_by(F.struct("action", "mask_area_ratio"), F.when(sets, order))
    folded = good.groupBy("item").agg(F.count_if(sets).alias("actions"), F.count_if(~sets).alias("skips"), last.alias("last")).withColumn("last", F.when(F.col("actions") > 0, F.col("last")))
    before = annotations if annotations is not None else folded.select("item").limit(0).selectExpr("item", "CAST(NULL AS string) AS target_type", "CAST(NULL AS string) AS source", "CAST(NULL AS double) AS sample_weight")
    both = before.select("item", *[F.col(c).alias(f"_{c}") for c in ("target_type", "source", "sample_weight")]).join(folded, "item", "full")
    action = F.col("last.action")
    told = lambda k, kind, name: F.when(action.isNotNull(), _of(action, k, kind)).otherwise(F.col(f"_{name}")).alias(name)
    return both.select(
        "item", told(0, "string", "target_type"), told(1, "string", "source"), told(2, "double", "sample_weight"), _of(action, 3, "string").alias("mask"), F.col("last.mask_area_ratio").alias("mask_area"),
        F.coalesce("actions", F.lit(0).cast("long")).alias("actions"), F.coalesce("skips", F.lit(0).cast("long")).alias("skips"),
    )


def annotations_after(log: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """item, target_type, source, sample_weight of the items that are annotated after the log."""
    return states(log, annotations).where("target_type IS NOT NULL").select("item", "target_type", "source", "sample_weight")


def masks_to_delete(log: DataFrame) -> DataFrame:
    """Items whose stored mask goes."""
    return states(log).where("mask = 'none'").select("item")


def pending(queue: DataFrame, log: DataFrame, review_round: int) -> DataFrame:
    """The rows of a queue without an action that counts in this round; a skip counts."""
    done = history(log).where(F.col("review_round") == review_round).select("item").distinct()
    return queue.join(done, "item", "left_anti")
