"""remove_repeats against every string of every row: shared ids, several lengths, hot samples."""

import random
from hashlib import sha256

import numpy as np
import pytest

from cohortloom.llm import substrings


def brute(rows, length):
    seen, out = {}, []
    for i, text in rows:
        raw = text.encode()
        for k in range(len(raw) - length + 1 if i is not None else 0):
            s = raw[k : k + length]
            seen[s] = min(seen.get(s, i), i)
    for i, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if seen[raw[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        out.append((i, len(raw), int(gone.sum()), spans, sha256(bytes(b for b, g in zip(raw, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [some(120) for _ in range(6)]
    out = []
    for _ in range(120):
        b = rng.choice(base)
        a, n = rng.randrange(len(b) - 150), rng.randrange(30, 400)
        out.append((rng.randrange(90), some(rng.randrange(40)) + b[a : a + n] + some(5)))
    whole = "".join(chr(rng.randrange(97, 123)) for _ in range(400))
    out += [(99, whole), (99, "U" * 90), (100, whole), (150, "q" * 30 + whole[100:250] + "z"), (None, whole), (150, whole), (150, whole)]
    out += [(3, ""), (4, "ab" * 500), (5, "x" + "ab" * 300), (6, "b" * 300), (6, "b" * 300)]
    passage = "THE PASSAGE OF FORTY BYTES THAT ALL HOLD"  # one minimiser in very many contexts
    return out + [(1000 + k, some(6) + passage + some(6)) for k in range(100)]


@pytest.mark.parametrize("length", [32, 50, 100, 200])
@pytest.mark.parametrize("hot", [None, 5])
def test_all_strings(spark, rows, length, hot):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(df, length=length, bucket_bytes=3000, hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_runs_of_bounded_size(spark, rows, monkeypatch):
    """The same with runs of a few segments: workers are started anew with the module's own bound, so it is run here."""
    monkeypatch.setattr(substrings, "RUN", 3)
    import pandas as pd

    group = []

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    known = [(i, k, t) for k, (i, t) in enumerate(rows) if i is not None]
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in known], "turn": [r[1] for r in known], "text": [r[2] for r in known]})
    samples = pa.Table.from_batches(substrings._sampler(50, 4)(iter([batch]))).to_pandas()
    places = pd.concat([substrings._repeated(10**9)(g) for _, g in samples.groupby("bucket")]).groupby(["id", "turn"])["places"].agg(list)
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in known], "turn": [r[1] for r in known], "places": [places.get((r[0], r[1]), []) for r in known], "text": [r[2] for r in known]})

    class Hot:
        value = np.zeros(0, np.int64)

    segments = pa.Table.from_batches(substrings._segmenter(50, 4, Hot)(iter([batch]))).to_pandas()
    spans: dict = {}
    for _, g in segments.groupby("bucket"):
        group.append(substrings._removable(50)(g))
    for r in pd.concat(group).itertuples():
        spans.setdefault((r.id, r.turn), []).append(r.spans)
    got = [(i, len(t.encode()), *substrings._cut(t.encode(), spans.get((i, k), []))[:2]) for i, k, t in known]
    assert sorted(got, key=str) == [w[:4] for w in brute([(i, t) for i, _, t in known], 50)]
