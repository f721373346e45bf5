"""The queries that SQL can't express against plain versions of their contracts, on the smallest tables."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from cohortloom.llm import decontaminate
from cohortloom.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(s):
    return sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def test_op1(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_file("word_bpe_49k.json"))
    got, start = by_id(q.op1_token_files(spark, sf)), 0
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array(tokenizer.encode(docs[i], add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2(spark, sf, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    from cohortloom.llm.sentencepiece import decode_documents

    out = q.op2_sentencepiece(spark, sf)
    got = by_id(out)
    library = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_file("piece_bpe_32k.model"))
    assert all(r.round_trip for r in got.values())
    assert {i: library.decode(r.ids) for i, r in got.items()} == docs
    assert {r.doc_id: r.text for r in decode_documents(out, q.tokenizer_file("piece_bpe_32k.model")).collect()} == docs
    assert proto


def test_op4(spark, sf, docs):
    fps = {}
    for i, text in docs.items():
        words = text.encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = by_id(q.op4_simhash(spark, sf))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def brute_repeats(texts, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) by id."""
    seen, out = {}, {}
    for i, text in texts.items():
        raw = text.encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            seen[s] = min(seen.get(s, i), i)
    for i, text in texts.items():
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        out[i] = (len(raw), int(gone.sum()), spans, sha(bytes(b for b, g in zip(raw, gone, strict=False) if not g)))
    return out


def test_op5(spark, sf, docs):
    got = q.op5_repeated_substrings(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_repeats(docs)


def test_op7(spark, sf, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(lower))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got, contaminated = by_id(q.op7_decontaminate(spark, sf)), 0
    for i, text in docs.items():
        w = word.findall(text.translate(lower))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= found
        r = got[i]
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        contaminated += bad
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha(",".join(sorted(items))), bad)
    assert contaminated


def test_op9(spark, sf, docs):
    patterns = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    got = by_id(q.op9_secret_scan(spark, sf))
    for i, text in docs.items():
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, good)) in enumerate(patterns.items()) for m in re.finditer(p, text, re.A | (re.I if kind == "assign" else 0)) if good(m)]
        base = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == kind for s in spans) for kind in patterns]
        assert r.base_sha256 == sha(",".join(base))
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_op10(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = by_id(q.op10_quality(spark, sf))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.score, r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    accuracy = sum(p == y for _, p, y in held) / len(held)
    print("held-out AUC", auc, "accuracy", accuracy)
    assert auc > 0.9 and accuracy > 0.93


def test_items_without_an_id_are_hit_and_not_named(spark):
    words = " ".join(f"word{k}" for k in "abcdefghijklmnop")
    items = spark.createDataFrame([(None, words), (4, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, words), (2, f"so {words} on"), (None, "a short item"), (3, "clean")], "doc_id long, text string")
    for block in (1 << 24, 1):  # one block of patterns, and one each
        got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.find_contamination(docs, items, 13, block).collect()}
        assert got == {1: (16, [], True), 2: (16, [], True), None: (2, ["4"], True), 3: (0, [], False)}
