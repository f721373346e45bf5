"""Exact quantiles in passes against the aggregate and numpy, whatever a buffer may hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import audit, matching, quantiles, robust

QS = [0.0, 0.03, 0.25, 0.5, 0.9, 0.97, 1.0]


def rows_of(seed):
    rng = random.Random(seed)
    rows = [("even", rng.gauss(0, 1)) for _ in range(700)] + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(400)]
    rows += [("ties", float(rng.randrange(3))) for _ in range(500)] + [("one", 7.5)] * 300 + [("two", 1.0)] * 150 + [("two", float(np.nextafter(1.0, 2)))] * 151
    rows += [(None, rng.random()) for _ in range(90)] + [("few", 3.0), ("few", None), ("none", None), ("none", float("nan")), ("odd", float("inf")), ("odd", 2.0), ("odd", 4.0)]
    rows += [("hot", 5.0)] * 800 + [("hot", rng.random() * 10) for _ in range(400)] + [("ends", -1.7e308), ("ends", 1.7e308)] * 30
    return rows


@pytest.mark.parametrize("in_buffer,bins", [(10, 64), (60, 512), (10**6, 64)])
def test_same_as_the_aggregate(spark, in_buffer, bins):
    rows = rows_of(in_buffer)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.n, r.q) for r in quantiles.exact_quantiles(df, ["g"], "v", QS, in_buffer, bins).collect()}
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    want = {r.g: (r.n, r.q) for r in df.groupBy("g").agg(F.count(finite).alias("n"), F.array(*[F.percentile(finite, F.lit(q)) for q in QS]).alias("q")).collect()}
    assert got == want
    some = [v for g, v in rows if g == "even"]
    assert got["even"][1] == pytest.approx(np.quantile(some, QS).tolist())


def test_without_groups_and_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(100)], "v double")
    assert quantiles.exact_quantiles(df, [], "v", [0.5], 7, 5).first().q == [49.5]
    assert quantiles.exact_quantiles(df.limit(0), ["v"], "v", [0.5], 7, 5).count() == 0


def test_what_a_pass_holds_is_bounded(spark):
    """No more rows than steps leave a pass for each target, and few passes are needed."""
    rng = random.Random(1)
    df = spark.createDataFrame([(0, rng.random()) for _ in range(5000)], "_k int, v double")
    values = df.select(F.struct(F.lit(0).alias("_none")).alias("_g"), F.col("v").alias("_v"))
    state = values.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).select(F.struct(F.lit(0).alias("_none")).alias("_g"), F.lit(2500).cast("long").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.lit(5000).cast("long").alias("inside"))
    first = quantiles._narrowed(values, state, 50).collect()
    assert len(first) == 1 and first[0].inside < 700 and first[0].below <= 2500 < first[0].below + first[0].inside
    second = quantiles._narrowed(values, spark.createDataFrame(first, state.schema), 50).first()
    assert second.inside < 40


def test_operators_give_the_same_in_passes(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, f"g{k % 3}" if k % 11 else "lone", rng.choice([rng.gauss(10, 3), None, float("nan"), 12.0]), rng.random()) for k in range(400)]
    df = spark.createDataFrame(rows, "item long, g string, a double, b double")
    items = df.select("item", *[F.col("a").alias(c) if k % 2 else F.col("b").alias(c) for k, c in enumerate(("area", "centroid_x", "centroid_y", "boundary", "position", "log_sharpness", "noise", "spread"))])
    run = lambda: [sorted(map(repr, x.collect())) for x in (robust.median_mad(df, ["g"], "a"), robust.caliper(df, ["g"], "a"), robust.standardise(df, ["g"], "a"), audit.quality_thresholds(df, "g", "a", "b"), matching.descriptor(items))]
    whole = run()
    monkeypatch.setattr(quantiles, "IN_BUFFER", 20)
    assert run() == whole
