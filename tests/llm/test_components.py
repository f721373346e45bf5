"""Components whose links come in several rounds."""

import random

from cohortloom.llm import components, simhash


def plain(edges):
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {x: top(x) for x in root}


def test_links_that_come_later(spark, monkeypatch):
    """They join parts, and no round meets again what is already in one part."""
    rng, seen, parts, every = random.Random(2), [], None, []
    found = components.connected_components

    def counted(edges):
        seen.append(edges.count())
        return found(edges)

    monkeypatch.setattr(components, "connected_components", counted)
    for n in (60, 30, 10, 0):
        new = [(rng.randrange(120), rng.randrange(120)) for _ in range(n)] + every[:20]
        every += new
        parts = components.joined_components(parts, spark.createDataFrame(new, "u long, v long"))
        got = {r.node: r.component for r in parts.collect()}
        want = {x: c for x, c in plain(every).items() if any(x in e and e[0] != e[1] for e in every)}
        assert got == want
    assert len(seen) == 3 and seen[1] <= 30 and seen[2] <= 10


def test_stars_need_no_round(spark, monkeypatch):
    edges = spark.createDataFrame([(5, 1), (6, 1), (9, 8)], "u long, v long")
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))
    assert {r.node: r.component for r in components.connected_components(edges).collect()} == {1: 1, 5: 1, 6: 1, 8: 8, 9: 8} and not rounds


def test_near_dedup_finds_components_of_new_links_alone(spark, monkeypatch):
    """Of each round, not of all links again; the driver holds the plans of far fewer queries."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    texts = [" ".join(words + [f"end{k}"]) for k in range(8)] + [" ".join(rng.sample(words, 200)) for _ in range(3)]
    asked = []
    found = components.connected_components

    def counted(edges):
        asked.append(edges.count())
        return found(edges)

    monkeypatch.setattr(components, "connected_components", counted)
    monkeypatch.setattr(simhash, "connected_components", counted)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, 8, 9, 10} and sum(asked) <= 28
