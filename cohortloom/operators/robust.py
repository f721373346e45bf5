"""Medians, deviations and calipers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import clean_double, median
from ..plans.scratch import kept
from .quantiles import exact_quantiles, has_large_groups

MAD_SCALE = 1.4826


def _on(by: list[str], a: str, b: str) -> Column | list[str]:
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def beside(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of stats (a row a group), also for null keys."""
    return rows.alias("_a").join(stats.alias("_b"), _on(by, "_a", "_b")).select("_a.*", *[F.col(f"_b.{c}").alias(c) for c in stats.columns if c not in by])


def _spread(rows: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """by, n, q (quantiles) and mad (median distance from the first of them) of the finite values of groups of any size."""
    centres = kept(exact_quantiles(rows, by, value, qs))
    away = beside(rows.select(*by, clean_double(F.col(value)).alias("_v")), centres.select(*by, F.get("q", F.lit(0)).alias("_m")), by).withColumn("_away", F.abs(F.col("_v") - F.col("_m")))
    return beside(centres, exact_quantiles(away, by, "_away", [0.5]).select(*by, F.get("q", F.lit(0)).alias("mad")), by)


def median_mad(rows: DataFrame, by: list[str], value: str, floor: float = 1e-3) -> DataFrame:
    """centre and scale = max(floor, 1.4826 * median absolute deviation) of the finite values of each group."""
    if has_large_groups(rows, by):
        q = _spread(rows, by, value, [0.5])
        return q.select(*by, F.get("q", F.lit(0)).alias("centre"), F.greatest(F.lit(floor), MAD_SCALE * F.col("mad")).alias("scale"), "n")
    v = clean_double(F.col(value))
    centres = rows.groupBy(*by).agg(median(v).alias("centre"))
    away = rows.join(centres, by).withColumn("_away", F.abs(v - F.col("centre")))
    scale = F.greatest(F.lit(floor), MAD_SCALE * median(F.col("_away")))
    return away.groupBy(*by).agg(F.first("centre").alias("centre"), scale.alias("scale"), F.count(v).alias("n"))


def standardise(rows: DataFrame, by: list[str], value: str, clip: float = 5.0) -> DataFrame:
    """Adds z: robust score within the group, missing values at the median, clipped."""
    stats = median_mad(rows, by, value)
    z = (F.coalesce(clean_double(F.col(value)), F.col("centre")) - F.col("centre")) / F.col("scale")
    return rows.join(stats.drop("n"), by).withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("centre", "scale")


def _limit(k: float) -> Column:
    limit = F.greatest(F.col("_m"), F.least(F.col("_m") + k * F.greatest(F.lit(1e-9), MAD_SCALE * F.col("_mad")), F.col("_q")))
    return F.when(F.col("_m").isNotNull(), limit)


def caliper(rows: DataFrame, by: list[str], distance: str, k: float = 2.5, q: float = 0.9) -> DataFrame:
    """max(median, min(median + k * 1.4826 * MAD, q-quantile)) of each group; null without finite values."""
    if has_large_groups(rows, by):
        wide = _spread(rows, by, distance, [0.5, q]).select(*by, F.get("q", F.lit(0)).alias("_m"), F.get("q", F.lit(1)).alias("_q"), F.col("mad").alias("_mad"))
        return wide.select(*by, _limit(k).alias("caliper"))
    v = clean_double(F.col(distance))
    centres = rows.groupBy(*by).agg(median(v).alias("_m"), F.percentile(v, F.lit(q)).alias("_q"))
    away = rows.join(centres, by).withColumn("_away", F.abs(v - F.col("_m")))
    spread = away.groupBy(*by).agg(F.first("_m").alias("_m"), F.first("_q").alias("_q"), median(F.col("_away")).alias("_mad"))
    return spread.select(*by, _limit(k).alias("caliper"))


def extended_caliper(core: Column, wide: Column, most: float = 1.18) -> Column:
    """Between core and most * core."""
    return F.when(core.isNull(), wide).otherwise(F.least(F.greatest(F.coalesce(wide, core), core), most * core))


def deviation(features: list[tuple[Column, Column, Column]], n: Column, usable: Column, least: int = 5) -> Column:
    """The largest |x - centre| / scale; 0 with too few prior rows or nothing to compare."""
    scores = [F.abs(x - m) / s for x, m, s in features]
    worst = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when((n >= least) & usable, F.coalesce(worst, F.lit(0.0))).otherwise(0.0)


def sequence_inconsistency(rows: DataFrame, group: list[str], order: list[str], present: str, area: str, x: str, y: str, base: str) -> DataFrame:
    """Adds inconsistency (mean disagreement with the items before and after) and uncertainty = min(1, base + 0.2 * it).

    A change of presence disagrees by 1, two absences by 0; else 0.55 * change of area, over the mean area (0.01 at least), + 0.45 * shift of
    the centre, over 0.25; both at most 1, and the shift is 1 where a centre is missing. A missing presence counts as present, a missing area as 0.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    own = F.struct(F.coalesce(F.col(present), F.lit(1)).alias("p"), clean_double(F.col(area), 0.0).alias("a"), clean_double(F.col(x)).alias("x"), clean_double(F.col(y)).alias("y"))

    def apart(o: Column) -> Column:
        change = F.least(F.lit(1.0), F.abs(own["a"] - o["a"]) / F.greatest(F.lit(0.01), (own["a"] + o["a"]) / 2))
        shift = F.coalesce(F.least(F.lit(1.0), F.hypot(own["x"] - o["x"], own["y"] - o["y"]) / 0.25), F.lit(1.0))
        return F.when(o.isNull(), F.lit(None)).when(own["p"] != o["p"], 1.0).when(own["p"] == 0, 0.0).otherwise(0.55 * change + 0.45 * shift)

    both = rows.withColumns({"_before": F.lag(own).over(w), "_after": F.lead(own).over(w)})
    a, b = apart(F.col("_before")), apart(F.col("_after"))
    mean = F.coalesce((a + b) / 2, a, b, F.lit(0.0))
    return both.withColumn("inconsistency", mean).withColumn("uncertainty", F.least(F.lit(1.0), F.col(base) + 0.2 * F.col("inconsistency"))).drop("_before", "_after")
