"""Hard negatives against brute force: ties, repeated rows, equal and very different norms, small blocks and ranges."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, KEY string, v string"


def brute_force(rows, scale, positives=5, negatives=10, low=30, high=90):
    kept = {(i, label, tuple(math.floor(scale * x) for x in v)) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b) for b in kept if b != a)
        for s, pid, _ in [r for r in ranked if r[2][1] == a[1]][:positives]:
            fit = [(-n, i) for n, i, b in ranked if b[1] != a[1] and low * -s <= 100 * -n <= high * -s]
            out += [(a[0], pid, k + 1, i, -s, n) for k, (n, i) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(df, scale, **options):
    got = hn.hard_negatives(hn.integer_vectors(df, "label", scale), F.col("id") % 100 == 0, **options)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("spread", [0.0, 2.5])
def test_like_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "ROWS", 2)
    monkeypatch.setattr(hn, "BUCKET", 16)
    rng = random.Random(11)
    rows = []
    for i in range(0, 1200, 4):
        far = math.exp(rng.gauss(0, spread))  # norms alike or far apart
        rows.append((i, [far * (rng.random() - 0.2) for _ in range(6)], rng.randrange(3), "k", "x"))
    rows += [(5000 + k, rows[7][1], 1, "k", "x") for k in range(40)]  # one vector many times
    rows += [rows[3], rows[3], (None, [1.0] * 6, 1, "", ""), (7, None, 1, "", ""), (9, [1.0] * 6, None, "", ""), (11, [1.0, None] * 3, 1, "", ""), (13, [1.0, float("nan")] * 3, 1, "", ""), (15, [float("inf")] * 6, 1, "", ""), (700, [0.5] * 4, 2, "", ""), (700, [0.1, 0.2], 2, "", ""), (21, [], 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_force(rows, 16)
    assert len(want) > 100
    assert mined(df, 16, range_rows=60, block_rows=4) == want
    assert mined(df, 16) == want


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty, 256) == []
    lone = spark.createDataFrame([(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 1.0], 2, "", "")], SCHEMA)
    assert mined(lone, 256) == []  # no positive
    pair = spark.createDataFrame([(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 1.0], 1, "", ""), (2, [0.5, 0.0], 3, "", ""), (3, [0.5, 1.0], 2, "", "")], SCHEMA)
    assert mined(pair, 256) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]


def test_labels_of_few_rows_give_fewer_positives(spark):
    rng = random.Random(8)
    labels = [0] * 60 + [1] * 2 + [2] * 4 + [3]
    rows = [(50 * k, [rng.random() for _ in range(5)], label, "", "") for k, label in enumerate(labels)]
    want = brute_force(rows, 64)
    assert len({(r[0], r[1]) for r in want}) > 100
    assert mined(spark.createDataFrame(rows, SCHEMA), 64, range_rows=9, block_rows=100) == want


def table(rows):
    return pa.table({"key": [r[0] for r in rows], "id": [r[0] for r in rows], "label": [r[1] for r in rows], "v": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "norm": [sum(x * x for x in r[2]) for r in rows], "lo": [[hn._LEAST]] * len(rows), "hi": [[hn._MOST]] * len(rows)})


def test_large_components_are_exact_and_too_large_ones_fail():
    rows = [(i, i % 2, [(1 << 26) + i, -(1 << 25) + 3 * i]) for i in range(9)]
    a, w, c, s = next(hn.scan(table(rows[:1]), table(rows), 4, True))
    want = sorted(((-sum(x * y for x, y in zip(rows[0][2], r[2], strict=True)), r[0]) for r in rows if r[1] == 0 and r[0]))[:4]
    assert [(-int(x), int(y)) for x, y in zip(s, c, strict=True)] == want
    with pytest.raises(OverflowError):
        next(hn.scan(table([(0, 0, [1 << 31, 0])]), table([(1, 0, [1 << 31, 1])]), 1, True))


def test_ranges_out_of_reach_are_not_moved(spark):
    """Short rows can't reach the lower limits that the longest ones set."""
    rng = random.Random(3)
    rows = [(i, [(100 if i < 300 else 1) * (rng.random() + 0.5) for _ in range(4)], i % 2, "", "") for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    ranged, bins = hn.by_norm(hn.integer_vectors(df, "label", 16), 100)
    anchors = ranged.where("id = 0").drop("bin")
    windows = anchors.select("key", F.lit(0).alias("w"), F.lit(hn._LEAST).alias("lo"), F.lit(hn._MOST).alias("hi"))
    seen = []
    plain = hn.written
    try:
        hn.written = lambda d, name, **k: (seen.append((name, plain(d, name, **k))), seen[-1][1])[1]
        hn.search(anchors, windows, ranged, bins, 5, True).collect()
    finally:
        hn.written = plain
    asked = [t[0].count() for name, t in seen if name == "asks"]
    assert bins == 12 and asked[0] == 1 and asked[1] <= 4
