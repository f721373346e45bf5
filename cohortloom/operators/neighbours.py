"""Near-duplicate exclusion by banded hashes, and mutual nearest neighbours between classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import clean_double, hamming, hash_order
from ..plans.scratch import kept


#: Hashes of each side that a task compares at most, and numbers that a comparison holds at once.
HASHES, HASHES_AT_ONCE = 1 << 18, 1 << 18


def hamming_anti(rows: DataFrame, known: DataFrame, hash_column: str, radius: int = 6, bits: int = 64) -> DataFrame:
    """Rows farther than radius bits from every known hash (signed longs); rows without a hash stay.

    Two hashes within radius agree in at least two of radius + 2 bands. They meet in a group by each of their bands, in tasks of bounded size, and are compared there, as arrays, if they agree in
    another band after it, so only pairs that agree in about 2 * bits / (radius + 2) bits are, and none becomes a row. Hashes that are known themselves need no search.
    """
    own = rows.select(F.col(hash_column).alias("h")).where("h is not null").distinct()
    other = kept(known.select(F.col(hash_column).alias("h")).where("h is not null").distinct())
    asked = kept(own.join(other, "h", "left_anti"))
    sizes, near = (asked.count(), other.count()), other
    if all(sizes):
        near = near.unionByName(_near_hashes(asked, other, sum(sizes), radius, bits))
    return rows.join(near.select(F.col("h").alias(hash_column)), hash_column, "left_anti")


def _are_near(x: np.ndarray, y: np.ndarray, first: int, cuts: list[int], radius: int) -> np.ndarray:
    """Which of x (unsigned) are within radius bits of one of y that agrees with it in this band and in one after it."""
    near = np.zeros(len(x), bool)
    band = lambda v, k: (v >> np.uint64(cuts[k])) & np.uint64((1 << (cuts[k + 1] - cuts[k])) - 1)
    kind = np.uint16 if max(np.diff(cuts)) <= 8 else np.uint64  # short keys are sorted by digits
    for second in range(first + 1, len(cuts) - 1):
        width = np.uint64(cuts[second + 1] - cuts[second])
        p, q = ((band(v, first) << width | band(v, second)).astype(kind) for v in (x, y))
        left, right = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
        left = left[~near[left]]
        p, q = p[left], q[right]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(p)].astype(int)[: len(starts)]
        los, his = np.searchsorted(q, p[starts], "left"), np.searchsorted(q, p[starts], "right")
        large = (ends - starts) * (his - los) > 4096
        for s, e, lo, hi in zip(starts[large], ends[large], los[large], his[large], strict=True):
            at, there = left[s:e], y[right[lo:hi]]
            for c in range(0, len(there), HASHES_AT_ONCE):
                some = there[c : c + HASHES_AT_ONCE]
                step = max(1, HASHES_AT_ONCE // len(some))
                for r in range(0, len(at), step):
                    i = at[r : r + step]
                    near[i] |= (np.bitwise_count(x[i, None] ^ some) <= radius).any(1)
        # the pairs of many small groups side by side
        n = np.where(large, 0, his - los)
        each, low = np.repeat(n, ends - starts), np.repeat(los, ends - starts)
        done = np.cumsum(each)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + HASHES_AT_ONCE, "right")))
            many = each[at:to]
            i = np.repeat(np.arange(at, to), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]
            hit = np.bitwise_count(x[left[i]] ^ y[right[j]]) <= radius
            near[left[i[hit]]] = True
            at = to
    return near


def _near_hashes(asked: DataFrame, known: DataFrame, total: int, radius: int, bits: int) -> DataFrame:
    """h: the hashes of asked within radius bits of one of known; both distinct, total hashes in all."""
    n = radius + 2
    cuts = [bits * k // n for k in range(n + 1)]
    masks = [(1 << (b - a)) - 1 for a, b in zip(cuts, cuts[1:], strict=False)]
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("h", cuts[k]).bitwiseAND(F.lit(masks[k])).alias("value")) for k in range(n)]))
    # neighbouring values share a group while hashes are few
    values = min(min(masks) + 1, 1 + total // HASHES)
    keyed = lambda df: df.select("h", bands.alias("b")).select("h", F.col("b.band").alias("band"), F.pmod("b.value", F.lit(values)).cast("int").alias("g"))
    count = lambda df, name: keyed(df).groupBy("band", "g").agg(F.ceil(F.count("*") / HASHES).alias(name))
    # a row a group, of which there are few: parts of each side
    parts = F.broadcast(kept(count(asked, "a_parts").join(count(known, "b_parts"), ["band", "g"])))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    of = lambda df, own, every: keyed(df).join(parts, ["band", "g"]).select("band", "g", F.pmod(F.xxhash64("h"), F.col(f"{own}_parts")).alias(own), spread(f"{every}_parts").alias(every), "h")
    cell = ["band", "g", "a", "b"]

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (np.sort(t["h"].to_numpy().view(np.uint64)) for t in (left, right))
        return pa.table({"h": pa.array(x[_are_near(x, y, key[0].as_py(), cuts, radius)].view(np.int64), pa.int64())})

    left, right = of(asked, "a", "b"), of(known, "b", "a").select("h", *cell)
    met = left.select("h", *cell).groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, "h long")
    return met.distinct()


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


#: How far apart a pair may be in sequence position and in area; neighbours each way, and of the core.
POSITION_LIMIT, AREA_LIMIT, NEAREST, CORE = 0.25, 0.20, 12, 5
#: Items of a block at most; a pair of blocks is compared by one call.
BLOCK = 512


def gate(position_a: Column, position_b: Column, area_a: Column, area_b: Column) -> Column:
    """Close enough in sequence position, and in area where both are known."""
    return (F.abs(position_a - position_b) <= POSITION_LIMIT) & F.coalesce(F.abs(area_a - area_b) <= AREA_LIMIT, F.lit(True))


#: Points from which all distances are measured: what they tell bounds how near two blocks can be.
PIVOTS = 24


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for at in range(0, len(x), 64):
        out[at : at + 64] = np.sqrt(((x[at : at + 64, None, :] - y[None, :, :]) ** 2).sum(2))
    return out


def packed_blocks(rows: DataFrame, family: str, item: str, label: str, vector: str) -> DataFrame:
    """side, family, block, items, vectors (flat), lo, hi (least and largest distance from each pivot): blocks of at most BLOCK neighbouring items.

    Items are sorted by their nearest pivot, which a block does not cross, and their distance from it, by a range partitioning, so a family of any size is split.
    """
    kind = dict(rows.dtypes)[item]
    flat = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("side"), F.col(family).cast("long").alias("family"), F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v"))
    flat = kept(flat)
    pivots = np.array([r.v for r in flat.orderBy(F.xxhash64("item"), "item").limit(PIVOTS).collect()], float)  # PIVOTS vectors, whatever the input

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b["v"].to_pylist(), float)
            d = _distances(x, pivots)
            near = d.argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(np.take_along_axis(d, near[:, None], 1)[:, 0] if len(x) else []), pa.array([*d], pa.list_(pa.float64()))], names=[*b.schema.names, "pivot", "away", "d"])

    told = flat.mapInArrow(measure, f"side int, family long, item {kind}, v array<double>, pivot int, away double, d array<double>")
    order = ["side", "family", "pivot", "away", "item"]
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for (side, fam, _), part in pdf.groupby(["side", "family", "pivot"], sort=False):
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at : at + BLOCK]
                    d = np.array(some["d"].tolist())
                    yield pd.DataFrame({"side": [side], "family": [fam], "items": [some["item"].tolist()], "vectors": [np.concatenate(some["v"].tolist())], "lo": [d.min(0)], "hi": [d.max(0)]})

    blocks = ranged.mapInPandas(pack, f"side int, family long, items array<{kind}>, vectors array<double>, lo array<double>, hi array<double>")
    return kept(blocks.withColumn("block", F.xxhash64("side", "family", "items")))


#: Blocks of a side that meet in one task: each block is sent once to such a cell, and an item leaves it with its k nearest there.
CELL = 32
#: Numbers that a comparison holds at once.
AT_ONCE = 1 << 20


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest of y for each of x, ties by row. A product of matrices tells which are near; their distances are those of ``_distances``."""
    rows, cols, dists = [], [], []
    size, far = (y**2).sum(1), min(k, len(y)) - 1
    for at in range(0, len(x), step := max(1, AT_ONCE // max(1, len(y)))):
        own = x[at : at + step]
        square = (own**2).sum(1)
        rough = square[:, None] + size - 2 * own @ y.T
        # off by rounding, and so are distances of nine digits: none of the k nearest lies beyond
        off = 1e-12 * (square + size.max())
        most = (np.sqrt(np.maximum(np.partition(rough, far, 1)[:, far], 0) + off) + 1e-8) ** 2 + off
        i, j = np.nonzero(rough <= most[:, None])
        d = np.concatenate([np.round(np.sqrt(((own[i[c : c + 4096]] - y[j[c : c + 4096]]) ** 2).sum(1)), 9) for c in range(0, len(i), 4096)])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(own)))
        best = np.arange(len(i)) - first[i] < k
        rows.append(i[best] + at)
        cols.append(j[best])
        dists.append(d[best])
    return tuple(map(np.concatenate, (rows, cols, dists)))


def _compared(pairs: DataFrame, blocks: DataFrame, k: int, kind: str) -> DataFrame:
    """(family, own, other, distance, side, block of own): of the pairs of blocks (a of class 1, b of class 0) the k nearest of every item in each cell.

    The blocks of a side of a family are dealt to parts of about CELL; two parts are a cell, to which their blocks go once, whatever the pairs between them.
    """
    parts = F.ceil(F.col("_n") / CELL)
    dealt = blocks.join(F.broadcast(blocks.groupBy("side", "family").agg(F.count("*").alias("_n"))), ["side", "family"]).select("side", "family", "block", F.pmod(F.xxhash64("block"), parts).alias("part"))
    of = lambda c, name: dealt.where(F.col("side") == c).select(F.col("block").alias(name), "family", F.col("part").alias(f"{name}_part"))
    cell = ["family", "a_part", "b_part"]
    met = pairs.join(of(1, "a"), "a").join(of(0, "b").drop("family"), "b").select(*cell, "a", "b")
    sent = met.select(*[F.col(c).alias(f"_{c}") for c in cell], F.explode(F.array("a", "b")).alias("block")).distinct().join(blocks.drop("family", "lo", "hi"), "block")

    def compare(asked: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        known = {r.block: (np.asarray(r.items), np.asarray(r.vectors, float).reshape(len(r.items), -1)) for r in sent.itertuples(index=False)}
        found = []
        for side, own, other in ((1, "a", "b"), (0, "b", "a")):
            for block, others in asked.groupby(own)[other]:
                items, vectors = known[block]
                names = np.concatenate([known[c][0] for c in others])
                order = np.argsort(names, kind="stable")  # ties go by name
                i, j, d = _nearest(vectors, np.concatenate([known[c][1] for c in others])[order], k)
                found.append(pd.DataFrame({"family": int(asked["family"].iloc[0]), "own": items[i], "other": names[order][j], "distance": d, "side": side, "block": block}))
        return pd.concat(found)

    return met.groupBy(*cell).cogroup(sent.groupBy(*[f"_{c}" for c in cell])).applyInPandas(compare, f"family long, own {kind}, other {kind}, distance double, side int, block long")


def nearest_across(rows: DataFrame, family: str, item: str, label: str, vector: str, k: int = NEAREST, counts: list | None = None) -> DataFrame:
    """(family, own, other, distance, side, rank): the k nearest items of the other class for each item; side is the class of own.

    Exact, with blocks skipped by bound. Distances from the pivots bound from below how near two blocks can be (triangle inequality). Each block first meets the
    nearest blocks of the other class that hold k items; the largest kth distance among its items is then its reach, and it meets
    another block only if their bound lies within the reach of either. Vectors without structure (bounds near nothing) are compared in all pairs
    of blocks of a family. ``counts`` gets (compared pairs of items, all of them).
    """
    kind = dict(rows.dtypes)[item]
    blocks = packed_blocks(rows, family, item, label, vector)
    meta = lambda c, name: blocks.where(F.col("side") == c).select("family", F.col("block").alias(name), F.size("items").alias(f"{name}_n"), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
    gap = lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: p - q))
    every = meta(1, "a").join(meta(0, "b"), "family").withColumn("bound", F.greatest(F.lit(0.0), gap("a_lo", "b_hi"), gap("b_lo", "a_hi")))
    every = kept(every.select("family", "a", "b", "a_n", "b_n", "bound"))

    def nearest_blocks(own: str, other: str) -> DataFrame:
        before = F.sum(f"{other}_n").over(Window.partitionBy(own).orderBy("bound", other).rowsBetween(Window.unboundedPreceding, -1))
        return every.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < k).select("a", "b")

    first = kept(nearest_blocks("a", "b").unionByName(nearest_blocks("b", "a")).distinct())
    found = kept(_compared(first, blocks, k, kind))
    ranked = F.row_number().over(Window.partitionBy("side", "family", "own").orderBy("distance", "other"))
    kth = found.withColumn("rank", ranked).where(F.col("rank") <= k).groupBy("block", "own").agg(F.max("distance").alias("kth"), F.count("*").alias("n"))
    reach = kth.groupBy("block").agg(F.max(F.when(F.col("n") >= k, F.col("kth")).otherwise(float("inf"))).alias("reach"))
    of = lambda name: reach.select(F.col("block").alias(name), F.col("reach").alias(f"{name}_reach"))
    # bounds and rounded distances are off by less than 1e-8
    more = every.join(first, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where(F.col("bound") <= F.greatest("a_reach", "b_reach") + 1e-8).select("a", "b")
    more = kept(more)
    if counts is not None:
        n = lambda df: df.agg(F.sum(F.col("a_n").cast("long") * F.col("b_n"))).first()[0] or 0
        counts.append((n(every.join(first.unionByName(more), ["a", "b"], "left_semi")), n(every)))
    both = found.unionByName(_compared(more, blocks, k, kind))
    return both.withColumn("rank", ranked).where(F.col("rank") <= k).drop("block")


def mutual_edges(rows: DataFrame, family: str, item: str, label: str, vector: str, k: int = NEAREST, core: int = CORE, position: str | None = None, area: str | None = None) -> DataFrame:
    """Edges (family, sick, normal, distance, both ranks, reciprocal, is_core, tie) of the k nearest of the other class, each way.

    With position and area only edges that pass the gate stay; ranks are those before the gate.
    """
    near = nearest_across(rows, family, item, label, vector, k)
    pair = lambda c: (F.when(F.col("side") == c, F.col("own")).otherwise(F.col("other")))
    flat = near.select("family", pair(1).alias("sick"), pair(0).alias("normal"), "distance", "side", "rank")
    rank = lambda c: F.max(F.when(F.col("side") == c, F.col("rank")))
    both = flat.groupBy("family", "sick", "normal").agg(F.max("distance").alias("distance"), rank(1).alias("rank_from_sick"), rank(0).alias("rank_from_normal"))
    if position:
        of = lambda name: rows.select(F.col(item).alias(name), F.col(position).alias(f"_p_{name}"), clean_double(F.col(area)).alias(f"_a_{name}"))
        both = both.join(of("sick"), "sick").join(of("normal"), "normal").where(gate(F.col("_p_sick"), F.col("_p_normal"), F.col("_a_sick"), F.col("_a_normal")))
        both = both.select("family", "sick", "normal", "distance", "rank_from_sick", "rank_from_normal")
    mutual = F.col("rank_from_sick").isNotNull() & F.col("rank_from_normal").isNotNull()
    inner = mutual & (F.col("rank_from_sick") <= core) & (F.col("rank_from_normal") <= core)
    tie = hash_order(F.col("family").cast("string"), F.col("sick").cast("string"), F.col("normal").cast("string"))
    return both.withColumn("reciprocal", mutual.cast("int")).withColumn("is_core", F.coalesce(inner, F.lit(False)).cast("int")).withColumn("tie", tie)
