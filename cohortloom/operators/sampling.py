"""Weighted sampling with replacement, without bringing the rows together.

Weights become whole units, so sums are exact whatever the order of tasks. Rows are ranged by key; each range sums its units, the ranges' sums (one number a
partition) give where each begins, and a running sum within a range gives every row its interval. A draw is a position in the whole, by a
hash of seed and draw; rows and draws meet by the cell of the whole that they lie in, as many cells as draws, so a row meets the draws of its own cells
only, and a heavy row is split over many cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clean import clean_double
from ..plans.scratch import kept

#: Units of all weights together, about.
UNITS = 1 << 52


def intervals(rows: DataFrame, key: str, weight: str) -> tuple[DataFrame, int]:
    """(key, low, high) of the rows of positive finite weight, in the order of their keys, and the sum of units. Keys must not repeat."""
    some = rows.select(F.col(key).alias("_key"), clean_double(F.col(weight)).alias("_w")).where("_key IS NOT NULL AND _w > 0")
    size = some.agg(F.count("*").alias("n"), F.max("_w").alias("most")).first()
    if not size.n:
        raise ValueError("no row has a positive weight")
    each = UNITS >> (size.n - 1).bit_length()
    if not each:
        raise ValueError("too many rows to tell their weights apart")
    units = some.select("_key", F.floor(F.col("_w") / F.lit(size.most) * F.lit(float(each))).cast("long").alias("_u"))
    ranged = kept(units.repartitionByRange("_key").withColumn("_range", F.spark_partition_id()))
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("_range").agg(F.sum("_u")).collect())  # one number a partition
    starts, total = [], 0
    for part, s in sums:
        starts.append((part, total))
        total += s
    begin = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long"))
    so_far = F.sum("_u").over(Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = ranged.withColumn("high", so_far).join(begin, "_range").withColumn("high", F.col("high") + F.col("_start"))
    return high.select(F.col("_key").alias(key), (F.col("high") - F.col("_u")).alias("low"), "high").where("high > low"), total


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key): n independent draws (from 0), each of a row by its share of all weights; rows of no positive weight are never drawn."""
    known, total = intervals(rows, key, weight)
    sixty = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col("draw").cast("string")), 256), 1, 15), 16, 10).cast("decimal(19,0)")
    at = F.expr(f"CAST((_h * CAST({total} AS decimal(19,0))) div CAST({1 << 60} AS decimal(19,0)) AS long)")
    width = -(-total // n)
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_h", sixty).select("draw", at.alias("at")).withColumn("cell", F.expr(f"at div {width}L"))
    cells = known.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}L"), F.expr(f"(high - 1) div {width}L"))))
    return draws.join(cells, "cell").where("low <= at AND at < high").select("draw", key)
