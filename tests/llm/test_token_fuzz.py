"""Token ids against the public library over random texts of every kind of character, and Re-Pair to its end."""

import random
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from cohortloom.llm import token_files
from cohortloom.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


def test_ids_of_random_texts():
    rng, kinds = random.Random(4), defaultdict(list)
    for c in range(sys.maxunicode + 1):
        kinds[unicodedata.category(chr(c))].append(chr(c))
    del kinds["Cs"]
    library, own = Tokenizer.from_file(PATH), token_files.WordEncoder(PATH, max_words=500)
    words = ["İ", "İ.", "İstanbul,", "don't", "I'LL", "we're!!", "one\x1ctwo", "\x1f", "<|endoftext|>", "a<|startoftext|>b.", "é", "́x", "ǅ.", "ß,", "ŉ.", "ſ!", "x²", "½", "ª.", "ﬁ", "中文.", "O'Neill's", "a_b", "_", "...", "Å", "Σας", "naïve?!"]
    texts = ["", *words]
    for _ in range(3000):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            parts.append(rng.choice(words) if kind < 0.3 else "".join(rng.choice("abcÉéñüİ.,!'\"-1") for _ in range(rng.randrange(1, 9))) if kind < 0.7 else "".join(rng.choice(kinds[rng.choice([*kinds])]) for _ in range(rng.randrange(1, 5))))
        texts.append(rng.choice([" ", "  ", "\n", "\t", " ", "　"]).join(parts))
    assert own.by_word and own.direct
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_repair_ends_without_frequent_pairs():
    rng = np.random.default_rng(3)
    cases = [rng.zipf(1.3, 20_000) % 3000, rng.integers(0, 3, 5000), np.full(777, 5), np.tile(rng.integers(0, 80_000, 50), 80), rng.integers(0, 90_000, 150_000), np.repeat(rng.integers(0, 40, 900), rng.integers(1, 9, 900))]
    for ids in cases:
        ids = ids.astype(np.uint32)
        rules, sequence = token_files.repair(ids, 100_000, min_count=4)
        assert (token_files.expand(sequence, rules, 100_000) == ids).all()
        met, last = Counter(), {}
        for k, pair in enumerate(zip(sequence.tolist(), sequence[1:].tolist(), strict=False)):
            if last.get(pair) != k - 1 or pair[0] != pair[1]:
                met[pair] += 1
                last[pair] = k
        assert max(met.values(), default=0) < 4
        used = Counter(sequence.tolist()) + Counter(rules.ravel().tolist())
        assert all(100_000 + k in used for k in range(len(rules)))
    assert len(token_files.repair(cases[3].astype(np.uint32), 100_000)[1]) < 100


def test_many_distinct_ids_get_rules():
    """A shard of over 2**16 distinct ids, as well as one whose rules go beyond 2**16 symbols."""
    wide = np.arange(70_000, dtype=np.uint32)
    rules, sequence = token_files.repair(np.concatenate([wide] * 4), 70_000)
    assert len(rules) >= 69_999 and len(sequence) < 20
    assert (token_files.expand(sequence, rules, 70_000) == np.concatenate([wide] * 4)).all()


def test_odd_rows(spark):
    """Null ids, the smallest id, repeated ids and rows: ids of each text are read back at the place told."""
    rows = [(None, "x y"), (None, None), (-(2**63), "low."), (5, "İ. one\x1ctwo"), (5, "other"), (5, "other"), (7, ""), (2**62, "end " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(token_files.round_trip(df, PATH, shard_tokens=300).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    ids = {t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows}
    assert [r.doc_id for r in got] == [None, None, -(2**63), 5, 5, 5, 7, 2**62]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows)
