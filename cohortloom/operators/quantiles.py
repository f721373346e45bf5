"""Exact quantiles of groups of any size, with bounded state.

The percentile aggregate holds all distinct values of a group in one buffer. Groups of more than ``in_buffer`` values are read in passes instead: each pass counts
the values between a target's bounds in ``bins`` steps, of octaves first and of equal width then (counts are summed before the shuffle), and the step in which the wanted rank lies
gives the next bounds, which are values that occur. When few enough values are left between them, or one value alone, the rank is read there. The bounds
shrink in each pass, so the end is sure; a value that a third of all rows have ends it early. Results are those of the aggregate, bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import clean_double
from ..plans.scratch import kept

#: Values that an aggregate's buffer or a sort may hold for one group; steps of a pass.
IN_BUFFER, BINS = 1 << 20, 4096


def has_large_groups(rows: DataFrame, by: list[str], in_buffer: int | None = None) -> bool:
    """Whether a group has more rows than a buffer may hold."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return bool(counts.where(F.col("n") > (IN_BUFFER if in_buffer is None else in_buffer)).limit(1).count())


def _narrowed(values: DataFrame, state: DataFrame, bins: int) -> DataFrame:
    """The bounds of the step in which each target's rank lies."""
    # octaves while the bounds lie more than one apart, then equal parts of what is left (halves, so that no difference overflows)
    octave = lambda c: F.signum(c) * F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.log2(F.abs(c)) + 1100)
    share = lambda x, lo, hi: (x - lo) / (hi - lo)
    near = (F.signum("lo") == F.signum("hi")) & (F.least(F.abs("lo"), F.abs("hi")) * 2 >= F.greatest(F.abs("lo"), F.abs("hi")))
    part = F.when(near, share(F.col("_v") / 2, F.col("lo") / 2, F.col("hi") / 2)).otherwise(share(octave("_v"), octave("lo"), octave("hi")))
    step = F.least(F.lit(bins - 1), F.floor(part * bins).cast("int"))
    # a few rows a large group are broadcast: a shuffle by group would put each group into one task
    met = values.join(F.broadcast(state), "_g").where(F.col("_v").between(F.col("lo"), F.col("hi")))
    counts = met.groupBy("_g", "rank", "below", step.alias("step")).agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    so_far = F.sum("inside").over(Window.partitionBy("_g", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    found = counts.withColumn("below", F.col("below") + F.coalesce(so_far, F.lit(0)))
    return found.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))).select("_g", "rank", "lo", "hi", "below", "inside")


def exact_quantiles(rows: DataFrame, by: list[str], value: str | Column, qs: list[float], in_buffer: int | None = None, bins: int = BINS) -> DataFrame:
    """by, n (finite values) and q (array, one a quantile, null without values) of every group."""
    most = IN_BUFFER if in_buffer is None else in_buffer
    v = clean_double(F.col(value) if isinstance(value, str) else value)
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_none"))
    values = rows.select(group.alias("_g"), v.alias("_v"))
    sizes = kept(values.groupBy("_g").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    large = sizes.where(F.col("n") > most)
    back = lambda df: df.select(*[F.col(f"_g.{c}").alias(c) for c in by], "n", "q")
    few = values.join(F.broadcast(large.select("_g")), "_g", "left_anti").groupBy("_g").agg(F.count("_v").alias("n"), F.array(*[F.percentile("_v", F.lit(q)) for q in qs]).alias("q"))
    if not large.limit(1).count():
        return back(few)
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    wanted = kept(large.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("at")) for k, p in enumerate(at)])).alias("x")).select("_g", "n", "lo", "hi", "x.k", "x.at"))
    ranks = wanted.select("_g", "lo", "hi", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    state = kept(ranks.select("_g", F.col("rank").cast("long").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    finite = values.where(F.col("_v").isNotNull())
    while True:
        is_open = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
        if not state.where(is_open).limit(1).count():
            break
        state = kept(state.where(~is_open).unionByName(_narrowed(finite, state.where(is_open), bins)))
    place = F.row_number().over(Window.partitionBy("_g", "rank").orderBy("_v"))
    last = finite.join(F.broadcast(state.where("lo < hi")), "_g").where(F.col("_v").between(F.col("lo"), F.col("hi"))).withColumn("place", place)
    read = last.where(F.col("below") + F.col("place") - 1 == F.col("rank")).select("_g", "rank", "_v")
    read = read.unionByName(state.where("lo >= hi").select("_g", "rank", F.col("lo").alias("_v")))
    side = lambda f, name: wanted.select("_g", "k", "at", f("at").cast("long").alias("rank")).join(read, ["_g", "rank"]).select("_g", "k", "at", F.col("rank").alias(f"{name}_rank"), F.col("_v").alias(name))
    both = side(F.floor, "low").join(side(F.ceil, "high").drop("at"), ["_g", "k"])
    mixed = (F.col("high_rank") - F.col("at")) * F.col("low") + (F.col("at") - F.col("low_rank")) * F.col("high")
    told = both.select("_g", "k", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(mixed).alias("x"))
    arrays = told.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("q"))
    return back(few.unionByName(arrays.join(large.select("_g", "n"), "_g").select("_g", "n", "q")))
