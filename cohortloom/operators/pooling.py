"""Two-level pooling of vectors, and the cohorts of feature modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import clean_double
from ..plans.scratch import kept


def hierarchical_mean(rows: DataFrame, by: list[str], subject: str, series: str, vector: str) -> DataFrame:
    """(by, subject, pos, value): the mean over series of the means of their items, element by element."""
    flat = rows.select(*by, subject, series, F.posexplode(vector).alias("pos", "x"))
    inner = flat.groupBy(*by, subject, series, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return inner.groupBy(*by, subject, "pos").agg(F.avg("x").alias("value"))


def pooled_vectors(rows: DataFrame, by: list[str], subject: str, series: str, vector: str) -> DataFrame:
    """(by, subject, x): the same as arrays."""
    long = hierarchical_mean(rows, by, subject, series, vector)
    return long.groupBy(*by, subject).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("x"))


def mode_membership(rows: DataFrame, modes: dict[str, Column]) -> DataFrame:
    """A row for each mode whose test an item passes."""
    tests = F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(t, F.lit(False)).alias("on")) for m, t in modes.items()])
    return rows.withColumn("mode", F.explode(F.transform(F.filter(tests, lambda s: s["on"]), lambda s: s["mode"])))


#: The modes, each with its region and the flag that its items have; the first seven are primary.
MODES = (
    ("B0_FULL_IMAGE", "full", None),
    ("B2_ATTENTION_ELIGIBLE_FULL_IMAGE", "full", "keep_attention"),
    ("AU1_ATTENTION_ROI", "attention", "keep_attention"),
    ("C1_ATTENTION_COMPLEMENT", "attention_complement", "keep_attention"),
    ("B1_MATCHED_FULL_IMAGE", "full", "keep_cross_class_matched"),
    ("AU2_MATCHED_ATTENTION_ROI", "attention", "keep_cross_class_matched"),
    ("C2_MATCHED_ATTENTION_COMPLEMENT", "attention_complement", "keep_cross_class_matched"),
    ("M1_MANUAL_ROI", "manual", "keep_manual_matched"),
    ("C3_MANUAL_COMPLEMENT", "manual_complement", "keep_manual_matched"),
    ("AU3_ATTENTION_ROI_MANUAL_SUBSET", "attention", "keep_manual_matched"),
    ("C4_ATTENTION_COMPLEMENT_MANUAL_SUBSET", "attention_complement", "keep_manual_matched"),
)


#: The cohorts of the modes, by their flag.
COHORTS = {None: "all_dataset_slices", "keep_attention": "attention_eligible_same_slices", "keep_cross_class_matched": "cross_class_matched_same_slices", "keep_manual_matched": "manual_positive_same_slices"}
#: Fixed value: the least share of an image that a region of interest takes.
LEAST_AREA = 0.003


def is_primary(mode: Column) -> Column:
    return mode.isin(*[m for m, _, _ in MODES[:7]])


def cohort_of(mode: Column) -> Column:
    """The cohort of a mode of MODES, else null."""
    names = F.create_map(*[F.lit(x) for m, _, flag in MODES for x in (m, COHORTS[flag])])
    return F.try_element_at(names, mode)


def keep_flags(rows: DataFrame) -> DataFrame:
    """Adds the flags of MODES. Columns used: quality_valid, valid, present (1 unless it says otherwise), area (0 unless told), has_mask, manual (an accepted positive mask), selected (matched; this needs the attention flag).

    Raises where an item has no predicted mask: its modes would be left out in silence.
    """
    missing = rows.where(~F.coalesce(F.col("has_mask").cast("boolean"), F.lit(False))).limit(1).count()
    if missing:
        raise ValueError("an item has no predicted mask")
    on = lambda c, other=False: F.coalesce(F.col(c).cast("boolean"), F.lit(other))
    attention = on("quality_valid") & on("valid") & on("present", True) & (clean_double(F.col("area"), 0.0) >= LEAST_AREA)
    return rows.withColumns({"keep_attention": attention, "keep_manual_matched": on("manual"), "keep_cross_class_matched": on("selected") & attention})


def feature_modes(rows: DataFrame) -> DataFrame:
    """A row for each mode of an item, with mode, region and primary."""
    tests = [F.struct(F.lit(m).alias("mode"), F.lit(r).alias("region"), F.lit(k < 7).alias("primary"), (F.col(flag) if flag else F.lit(True)).alias("on")) for k, (m, r, flag) in enumerate(MODES)]
    out = rows.withColumn("_m", F.explode(F.filter(F.array(*tests), lambda t: t["on"])))
    return out.select(*rows.columns, "_m.mode", "_m.region", "_m.primary")


def feature_bank(members: DataFrame, embeddings: DataFrame, item: str, subject: str, series: str, label: str, vector: str) -> DataFrame:
    """(mode, subject, label, x): pooled vectors of each mode. members: as by feature_modes; embeddings: item, region, vector, one a region, used by all its modes.

    Raises where a member has no vector or more than one, or a subject has two labels in a mode.
    Members meet all vectors of their item at once and go by subject once, before vectors become elements; checks and means are made there in one run, and the bank is kept.
    """
    told = embeddings.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(item, F.struct("region", F.col(vector).alias("x")).alias("_told"))
    # a stated number of parts, which is not made fewer by size: regions and modes may multiply rows after a shuffle
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = told.repartition(parts, item).groupBy(item).agg(F.collect_list("_told").alias("_told"))
    rows = members.select(item, "region", "mode", subject, series, label).repartition(parts, item).join(every, item, "left")
    own = F.transform(F.filter("_told", lambda t: t["region"] == F.col("region")), lambda t: t["x"])
    rows = rows.select("mode", subject, series, label, own.alias("_own")).repartition(subject)
    # an item without a vector stays, with no position, so that it counts
    flat = rows.select("mode", subject, series, label, (F.coalesce(F.size("_own"), F.lit(0)) != 1).alias("_odd"), F.posexplode_outer(F.get("_own", F.lit(0))).alias("pos", "_x"))
    odd = F.col("_odd") & (F.coalesce("pos", F.lit(0)) == 0)
    inner = flat.groupBy("mode", subject, series, "pos").agg(F.avg(F.col("_x").cast("double")).alias("_x"), F.min(label).alias("_least"), F.max(label).alias("_most"), F.count_if(odd).alias("_odd"))
    checks = [F.min("_least").alias("_least"), F.max("_most").alias("_most"), F.sum("_odd").alias("_odd")]
    outer = inner.groupBy("mode", subject, "pos").agg(F.avg("_x").alias("_x"), *checks)
    elements = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "_x"))))
    bank = kept(outer.groupBy("mode", subject).agg(F.transform(elements, lambda e: e["_x"]).alias("x"), *checks))
    bad = bank.where("_least <> _most OR _odd > 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][1]} in {bad[0][0]}: " + (f"{bad[0]._odd} items without one vector" if bad[0]._odd else "two labels"))
    return bank.where(F.col("mode").isNotNull() & F.col(subject).isNotNull() & (F.size("x") > 0)).select("mode", subject, F.col("_least").alias(label), "x")


def mode_counts(members: DataFrame, subject: str, series: str) -> DataFrame:
    return members.groupBy("mode").agg(F.count_distinct(subject).alias("subjects"), F.count("*").alias("items"), F.count_distinct(subject, series).alias("series"))


def cohort_mismatch(members: DataFrame, subject: str, first: str, second: str) -> DataFrame:
    """Subjects of one mode only; must be empty where two modes are compared."""
    a, b = (members.where(F.col("mode") == m).select(subject).distinct() for m in (first, second))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def embed(rows: DataFrame, model, schema: str) -> DataFrame:
    """The boundary to a model: model maps an iterator of pandas frames to one."""
    return rows.mapInPandas(model, schema)
