"""Greedy choice in rounds against a loop; the matching in rounds against the matching in one task."""

import random
from collections import Counter

import pytest

from cohortloom.operators import limited, matching
from test_matching import SCHEMA, items_of


def loop(rows, before):
    load, out = Counter(before), []
    for name, _, keys in sorted(rows, key=lambda r: r[1]):
        if all(load[k] < most for k, most in keys):
            load.update(k for k, _ in keys)
            out.append(name)
    return sorted(out)


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 3), (3, 8)])
def test_like_a_loop(spark, monkeypatch, seed, most):
    monkeypatch.setattr(limited, "LOOK", 5)
    rng = random.Random(seed)
    turns = rng.sample(range(10_000), 250)
    limit = {k: rng.randint(1, most) for k in range(60)}
    hot = {"hot": 40 * most}  # a key of all rows
    rows = [(f"r{i}", t, [(f"k{k}", limit[k]) for k in rng.sample(range(60), rng.randint(1, 3))] + [*hot.items()]) for i, t in enumerate(turns)]
    before = {"k3": 1, "k5": 9, "hot": 2}
    df = spark.createDataFrame(rows, "row string, turn int, keys array<struct<key:string,most:long>>")
    got = limited.limited_greedy(df, spark.createDataFrame([*before.items()], "key string, used long"))
    assert sorted(r.row for r in got.collect()) == loop(rows, before)


def test_no_rows(spark):
    assert limited.limited_greedy(spark.createDataFrame([], "row string, turn int, keys array<struct<key:string,most:long>>")).count() == 0


def test_a_chain_is_not_written_once_a_row(spark, monkeypatch):
    """Each row shares a key with the one before and the one after it, so nothing but the first open row is sure."""
    real, written = limited.kept, []
    monkeypatch.setattr(limited, "kept", lambda df: (kept := real(df), written.append(kept.count()))[0])
    rows = [(k, k, [(f"k{k}", 1), (f"k{k + 1}", 1)]) for k in range(40)]
    got = limited.limited_greedy(spark.createDataFrame(rows, "row int, turn int, keys array<struct<key:string,most:long>>"))
    assert sorted(r.row for r in got.collect()) == [*range(0, 40, 2)] and sum(written) <= 6 * 40


def test_first_rows_of_a_bounded_number(spark):
    rows = [(k + 7, [("k", 9), (f"o{k % 8}", 1)]) for k in range(30)]
    df = spark.createDataFrame(rows, "place long, keys array<struct<key:string,most:long>>")
    before = spark.createDataFrame([("o1", 1)], "key string, used long")
    take = lambda n: [r.place for r in limited.limited_greedy(df, before, "place", n).orderBy("place").collect()]
    assert take(None) == [7, 9, 10, 11, 12, 13, 14] and take(3) == [7, 9, 10] and not take(0)


def test_matching_in_rounds(spark, monkeypatch):
    rows = items_of(4, 160, 2, 2, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(matching, "ONE_TASK", 0)
    monkeypatch.setattr(matching, "PASSES", 5)
    _, pairs, _ = matching.build_matching(df, check=False)
    rounds = sorted((r.sick, r.normal, r.stage, r.pair_id) for r in pairs.collect())
    monkeypatch.setattr(matching, "ONE_TASK", 1 << 18)
    _, pairs, _ = matching.build_matching(df, check=False)
    assert rounds == sorted((r.sick, r.normal, r.stage, r.pair_id) for r in pairs.collect())
    assert {r[2] for r in rounds} == {"CORE", "EXT"}
