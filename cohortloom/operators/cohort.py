"""Catalogue, sequences, splits and sampling of a cohort of items."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import hash_order, natural_key
from ..plans.scratch import kept
from ..roles import Roles


def summary(items: DataFrame, r: Roles) -> DataFrame:
    """One row: subjects, items, series and items by class."""
    return items.agg(
        F.count_distinct(r.subject).alias("subjects"), F.count("*").alias("items"), F.count_distinct(r.subject, r.series).alias("series"),
        F.count_if(F.col(r.label) == 0).alias("items_0"), F.count_if(F.col(r.label) == 1).alias("items_1"),
    )


def duplicates(items: DataFrame, key: str) -> DataFrame:
    """Keys met more than once; must be empty."""
    return items.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def mixed_labels(items: DataFrame, r: Roles) -> DataFrame:
    """Subjects with more than one label; must be empty."""
    return items.groupBy(r.subject).agg(F.count_distinct(r.label).alias("labels")).where("labels > 1")


def sequence_neighbours(items: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """Adds position, length, previous and next item (an end's neighbour is itself) and the position between 0 and 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    at, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*group))
    out = items.withColumns({"seq_index": at, "seq_length": n, "prev_item": F.coalesce(F.lag(item).over(w), F.col(item)), "next_item": F.coalesce(F.lead(item).over(w), F.col(item))})
    return out.withColumn("seq_position", relative_position(F.col("seq_index"), F.col("seq_length")))


def relative_position(index: Column, length: Column) -> Column:
    """index / (length - 1), index clipped; a single item is in the middle."""
    clipped = F.least(F.greatest(index, F.lit(0)), length - 1)
    return F.when(length <= 1, F.lit(0.5)).otherwise(clipped / (length - 1))


def hash_folds(subjects: DataFrame, subject: str, label: str, folds: int = 5, salt: str = "42|segmentation-fold") -> DataFrame:
    """A fold for each subject, dealt out within each label in hash order."""
    key = hash_order(salt, F.col(label).cast("string"), F.col(subject).cast("string"))
    w = Window.partitionBy(label).orderBy(key, subject)
    return subjects.select(subject, label).distinct().withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def validation_pick(subjects: DataFrame, subject: str, group: str, share: float = 0.2, salt: str = "42|validation") -> DataFrame:
    """The first round(share) subjects of each group in hash order, one at least and not all."""
    own = subjects.select(subject, group).distinct()
    w = Window.partitionBy(group)
    turn = F.row_number().over(w.orderBy(hash_order(salt, F.col(group).cast("string"), F.col(subject).cast("string")), subject))
    n = F.count("*").over(w)
    take = F.greatest(F.lit(1), F.least(F.bround(n * share).cast("long"), n - 1))
    return own.withColumns({"_turn": turn, "_take": take}).select(subject, group, (F.col("_turn") <= F.col("_take")).alias("validation"))


def repair_coverage(validation: set, labelled: dict, fold: int | str, seed: int = 42) -> set:
    """Moves subjects so that both sides hold each presence class that two subjects have; all choices in hash order.

    validation: subjects; labelled: subject -> set of classes (0, 1) it has, for all subjects. The result is the given set if nothing or everything
    would be in it. A fold's subjects, a few dozen, on the driver.
    """
    chosen, classes = set(validation), (0, 1)
    having = {c: {s for s, own in labelled.items() if c in own} for c in classes}

    def in_order(some: set, salt: str) -> list:
        return sorted(some, key=lambda s: hashlib.sha256(f"{seed}|{fold}|{salt}|{s}".encode()).hexdigest())

    for c in classes:
        if len(having[c]) < 2:
            continue
        if not chosen & having[c]:
            comes = in_order(having[c] - chosen, f"incoming-{c}")[0]
            # who may go: without this class, and not the last inside of one that is there
            covered = [k for k in classes if len(having[k]) >= 2 and chosen & having[k]]
            spare = {s for s in chosen - having[c] if all((chosen - {s}) & having[k] for k in covered)}
            chosen -= set(in_order(spare, f"remove-{c}")[:1])
            chosen.add(comes)
        if having[c] <= chosen:
            goes = in_order(chosen & having[c], f"outgoing-{c}")[-1]
            chosen.remove(goes)
            chosen |= set(in_order(set(labelled) - chosen - {goes}, f"replacement-{c}")[:1])
    return chosen if chosen and len(chosen) < len(labelled) else set(validation)


def fold_parts(items: DataFrame, subject: str, label: str, present: str, folds: int = 5) -> DataFrame:
    """(subject, fold, part) for every fold: test, validation (picked by hash, then repaired) or train. One row a subject and fold; subjects are few."""
    mapped = hash_folds(items, subject, label, folds)
    classes = items.groupBy(subject).agg(F.collect_set(F.coalesce(F.col(present), F.lit(1))).alias("classes")).join(mapped, subject)
    known = {r[subject]: (r.fold, set(r.classes)) for r in classes.select(subject, "fold", "classes").collect()}
    rows = []
    for fold in range(folds):
        rest = {s: c for s, (f, c) in known.items() if f != fold}
        first = sorted(rest, key=lambda s: hashlib.sha256(f"42|validation|{fold}|{s}".encode()).hexdigest())
        picked = repair_coverage(set(first[: max(1, min(round(len(first) * 0.2), len(first) - 1))]), rest, fold) if first else set()
        rows += [(s, fold, "test" if f == fold else "validation" if s in picked else "train") for s, (f, _) in known.items()]
    return items.sparkSession.createDataFrame(rows, f"{subject} {dict(items.dtypes)[subject]}, fold int, part string")


def leaked(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Held-out keys met in training; must be empty."""
    return held_out.select(key).distinct().join(train.select(key), key, "left_semi")


def split_count(subjects: DataFrame, label: str, folds: int) -> DataFrame:
    """One row: the folds that the smaller class allows."""
    return subjects.groupBy(label).agg(F.count("*").alias("n")).agg(F.least(F.lit(folds), F.min("n")).cast("int").alias("splits"))


def sampling_weights(items: DataFrame, subject: str, series: str, cluster: str, present: str, present_mass: float = 0.7) -> DataFrame:
    """Adds weight: even over series, clusters and their members, then fixed masses for the two presence classes."""
    sizes = items.groupBy(subject, series, cluster).agg(F.count("*").alias("_dup"))
    clusters = sizes.groupBy(subject, series).agg(F.count("*").alias("_clusters"))
    series_n = clusters.groupBy(subject).agg(F.count("*").alias("_series"))
    raw = items.join(sizes, [subject, series, cluster]).join(clusters, [subject, series]).join(series_n, subject).withColumn("_raw", F.lit(1.0) / (F.col("_series") * F.col("_clusters") * F.col("_dup")))
    totals = raw.groupBy(present).agg(F.sum("_raw").alias("_total"))
    # with one class alone its weights sum to 1
    totals = totals.withColumn("_classes", F.count("*").over(Window.partitionBy()))
    mass = F.when(F.col("_classes") == 1, F.lit(1.0)).when(F.col(present) == 1, F.lit(present_mass)).otherwise(F.lit(1 - present_mass))
    return raw.join(F.broadcast(totals), present).withColumn("weight", F.col("_raw") / F.col("_total") * mass).select(*items.columns, "weight")


def review_priority(uncertainty: Column, valid: Column, explicit: Column | None = None) -> Column:
    """What a queue is ordered by: the given priority, else the uncertain first, then the invalid."""
    doubt = F.coalesce(uncertainty, F.lit(0.0))
    own = F.when(doubt > 0, -doubt).otherwise(F.coalesce(valid, F.lit(0)).cast("double"))
    return own if explicit is None else F.coalesce(explicit, own)


def round_robin(items: DataFrame, subject: str, series: str, item: str, per_subject: int, limit: int | None = None, seed: str = "42", first_by: list[str] | None = None) -> DataFrame:
    """A queue that takes turns: over series within a subject, at most per_subject, then over subjects.

    Within a series the items come by the columns ``first_by`` (smaller first), then by a hash of seed and item.
    """
    by = first_by or []
    inner = Window.partitionBy(subject, series).orderBy(*by, hash_order(seed, F.col(item).cast("string")), item)
    ranked = items.select(subject, series, item, *by).withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= per_subject)
    outer = Window.partitionBy(subject).orderBy("_turn", series)
    queue = ranked.withColumn("turn", F.row_number().over(outer)).where(F.col("turn") <= per_subject).drop("_turn", *by)
    return queue.orderBy("turn", subject).limit(limit) if limit else queue


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their number (from 1) in this order, without one window over all of them.

    Rows are ranged by the order, counted by range (one number a partition reaches the driver) and numbered from where their range begins. The order should leave no ties.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumns({f"_o{k}": c for k, c in enumerate(columns)})
    by = [f"_o{k}" for k in range(len(columns))]
    ranged = kept(keyed.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("_range").agg(F.count("*")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    begin = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn(name, within).join(begin, "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start", *by)


def natural_order(items: DataFrame, name: str, key: str, turn: str = "turn") -> DataFrame:
    """items with their turn (from 1) by name, in which runs of digits count by value, then by key."""
    return numbered(items, [natural_key(F.col(name)), key], turn)
