"""Near-duplicates of one_of_each against true Jaccard similarities of word shingles."""

import random

from cohortloom.llm import simhash


def jaccard(a, b, shingle=5):
    x, y = ({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(words, n, rng):
    """The words with n runs of five words replaced, far apart."""
    out, step = [*words], len(words) // max(n, 1)
    for k in range(n):
        at = k * step + rng.randrange(5)
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def test_threshold(spark):
    """Pairs below 0.8 stay, however near their sketches are."""
    rng, docs = random.Random(5), []
    for k in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(words, 8 + k % 4, rng)))]
    texts = dict(docs)
    near = {i for i in texts if i % 2 and jaccard(texts[i - 1], texts[i]) >= 0.8}
    assert all(0.65 < jaccard(texts[i - 1], texts[i]) < 0.8 for i in texts if i % 2) and not near
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(texts)


def test_no_link_is_missed(spark, monkeypatch):
    """Pairs and groups of at least 0.8, many of which share a passage with documents that are not similar to them."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, texts = [word() for _ in range(250)], []
    for k in range(150):
        words = [word() for _ in range(60)] + (passage if k % 2 else [word() for _ in range(250)])
        texts += [words] + [edited(words, rng.randrange(1, 9), rng) for _ in range(k % 3)]
    texts = [" ".join(w) for w in texts]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i for i in root if top(i) == i}
    assert 150 <= len(want) < len(texts)
    for hubs in (3, 0):
        monkeypatch.setattr(simhash, "HUB_ROUNDS", hubs, raising=False)
        kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert kept == want


def test_rows_that_share_an_id(spark):
    """A document is not dropped for the id that it shares with a copy."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(200))
    rows = [(1, text), (5, text + " tail"), (5, "something else entirely"), (None, text), (7, None), (8, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_recall_by_band(spark):
    """Of pairs at 0.8 to 0.85, to 0.9 and over it all are linked, each band apart; under 0.8 none."""
    rng, docs, bands = random.Random(11), [], {}
    for k in range(160):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(words, 1 + k % 8, rng)))]
        band = min(int(jaccard(docs[-2][1], docs[-1][1]) * 20) / 20, 0.9)
        bands.setdefault(band if band >= 0.8 else 0, []).append(2 * k + 1)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {0, 0.8, 0.85, 0.9} <= set(bands)
    assert {b: sum(i not in kept for i in ids) / len(ids) for b, ids in bands.items()} == {b: float(b >= 0.8) for b in bands}


def test_sketches_never_rule_out_similar_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 146, 5000):
        for _ in range(40):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = rng.integers(0, n + 1)
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, rng.integers(0, n + 1)).astype(np.uint64)]))
            apart = len(np.setxor1d(x, y))
            differ = sum(int(b).bit_count() for b in (simhash.parity_sketch(np.unique(x)) ^ simhash.parity_sketch(y)).view(np.uint64).tolist())
            assert differ <= apart
            if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
                assert differ <= simhash.most_apart(0.8) * (len(x) + len(y)) + 1e-6


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    """A group whose members are mostly not similar, compared in small blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**9)}" for _ in range(150)]
    texts = [" ".join(edited(base, rng.randrange(1, 12), rng)) for _ in range(160)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i for i in root if top(i) == i}
    assert 10 < len(want) < 150
    monkeypatch.setattr(simhash, "HOT_PAIRS", 20)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    linked = sum(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    last, plain = [], simhash.left_pairs

    def counted(*args):
        pairs = plain(*args)
        last.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "left_pairs", counted)
    for hubs in (2, 0):
        monkeypatch.setattr(simhash, "HUB_ROUNDS", hubs)
        kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert kept == want
    # rounds of closest sketches have linked the group by then
    assert linked > 300 and max(last) < linked / 4


def test_ball_hashing_links_by_itself(spark, monkeypatch):
    """The named method is a step of its own: without the exact search after it, copies with one word changed are still linked, and nothing else."""
    rng, docs = random.Random(3), []
    for k in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(4000)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(words, k % 2, rng) + ["end"]))]
    for name in ("hub_pairs", "closest_pairs", "left_pairs"):
        real = getattr(simhash, name)
        monkeypatch.setattr(simhash, name, lambda *a, real=real: real(*a).limit(0))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept >= {2 * k for k in range(40)} and len(kept) < 50
