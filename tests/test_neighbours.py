"""Nearest neighbours across classes: pruned blocks give what all pairs give, with fewer comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import neighbours


def plain(rows, k):
    out = set()
    for fam in {r[1] for r in rows}:
        for c in (1, 0):
            own, other = ([r for r in rows if r[1] == fam and r[2] == x] for x in (c, 1 - c))
            for r in own:
                d = sorted((round(float(np.sqrt(((np.array(r[3]) - np.array(s[3])) ** 2).sum())), 9), s[0]) for s in other)
                out |= {(fam, r[0], name, dist, c, i + 1) for i, (dist, name) in enumerate(d[:k])}
    return out


def found(df, k, counts=None):
    return {(r.family, r.own, r.other, r.distance, r.side, r.rank) for r in neighbours.nearest_across(df, "family", "item", "label", "v", k, counts).collect()}


@pytest.mark.parametrize("kind", ["clusters", "flat", "grid"])
def test_like_all_pairs_with_fewer(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 12)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        c = rng.integers(0, 12)
        v = {"clusters": np.eye(12)[c] * 20 + rng.normal(size=12) * 0.3, "flat": rng.normal(size=12), "grid": rng.integers(0, 3, 12).astype(float)}[kind]
        rows.append((int(i * 7 % 1000), int(i % 5 == 0), int(rng.integers(0, 2)), v.tolist()))
    df = spark.createDataFrame(rows, "item long, family long, label int, v array<double>")
    counts = []
    assert found(df, 4, counts) == plain(rows, 4)
    compared, every = counts[0]
    assert every == sum(sum(r[1] == f and r[2] == 1 for r in rows) * sum(r[1] == f and r[2] == 0 for r in rows) for f in (0, 1))
    assert compared <= every and (kind != "clusters" or compared < 0.45 * every)


def test_few_of_many_pairs(spark, monkeypatch):
    """With many small clusters a small share of all pairs is compared."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, 0, i % 2, (rng.integers(0, 40) * 10 + rng.normal(size=3)).tolist()) for i in range(800)]
    counts = []
    assert found(spark.createDataFrame(rows, "item long, family long, label int, v array<double>"), 3, counts) == plain(rows, 3)
    assert counts[0][0] < 0.15 * counts[0][1]


def test_odd_rows(spark):
    schema = "item long, family long, label int, v array<double>"
    assert found(spark.createDataFrame([], schema), 3) == set()
    lone = [(1, 0, 1, [0.0]), (2, 0, 1, [1.0]), (3, 1, 0, [2.0]), (4, 0, None, [0.0])]
    assert found(spark.createDataFrame(lone, schema), 3) == set()
    equal = [(k, 0, k % 2, [1.0, 1.0]) for k in range(30)]  # ties go by name
    assert found(spark.createDataFrame(equal, schema), 3) == plain(equal, 3)


def test_what_leaves_a_cell_is_bounded(spark, monkeypatch):
    """An item leaves each cell with its k nearest and not each pair of blocks, so rows grow with cells; cells of any size give the same."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = [(i, 0, i % 2, rng.normal(size=6).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "item long, family long, label int, v array<double>")
    blocks = neighbours.packed_blocks(df, "family", "item", "label", "v")
    of = lambda c, name: blocks.where(f"side = {c}").select(F.col("block").alias(name))
    pairs = of(1, "a").crossJoin(of(0, "b"))
    n = blocks.where("side = 0").count()
    assert n > 37
    cells = -(-n // neighbours.CELL)
    assert neighbours._compared(pairs, blocks, 4, "bigint").count() <= 600 * 4 * cells < 600 * 4 * n / 8
    want = plain(rows, 4)
    for size in (3, 1000):
        monkeypatch.setattr(neighbours, "CELL", size)
        assert found(df, 4) == want


@pytest.mark.parametrize("most", [1 << 18, 16])
def test_hashes_far_from_all_known(spark, monkeypatch, most):
    """Like all pairs, also where groups are dealt to several tasks; no pair becomes a row."""
    monkeypatch.setattr(neighbours, "HASHES", most)
    rng = np.random.default_rng(7)
    known = rng.integers(-(2**63), 2**63 - 1, 60).tolist() + [0, -1, 1]
    own = rng.integers(-(2**63), 2**63 - 1, 60).tolist() + known[:5] + [None]
    for k, h in enumerate(known * 3):  # 3 to 9 bits away, also one in each of seven bands
        bits = [9 * b for b in range(7)] if k % 4 == 0 else rng.choice(64, 3 + k % 7, replace=False).tolist()
        u = h & (2**64 - 1)
        for b in bits[: 6 if k % 8 else 7]:
            u ^= 1 << b
        own.append(u - 2**64 if u >> 63 else u)
    rows = spark.createDataFrame([(h, k) for k, h in enumerate(own)], "hash long, item long")
    far = neighbours.hamming_anti(rows, spark.createDataFrame([(h,) for h in [*known, None]], "hash long"), "hash")
    want = {k for k, h in enumerate(own) if h is None or all(((h ^ g) & (2**64 - 1)).bit_count() > 6 for g in known)}
    assert {r.item for r in far.collect()} == want and 60 < len(want) < len(own)
    assert "_known" not in far._jdf.queryExecution().executedPlan().toString()
    assert {r.item for r in neighbours.hamming_anti(rows, rows.limit(0), "hash").collect()} == set(range(len(own)))
