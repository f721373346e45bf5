"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import components, decontaminate, exact_dedup, licenses, line_dedup, quality, secrets, sentencepiece, simhash, substrings, token_files
from cohortloom.llm.queries import tokenizer_file


def benchmark(spark, texts):
    return spark.createDataFrame(texts, "item_id long, text string")


def test_exact_dedup(odd_docs, no_docs):
    got = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert {r.keep_id for r in got if r.group_size > 1} == {2, 3, 5, None}
    whole = exact_dedup.exact_dedup(odd_docs, keep_columns=True)
    assert whole.columns == odd_docs.columns and whole.count() == len(kept)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_line_dedup(odd_docs, no_docs):
    out = line_dedup.drop_common_lines(odd_docs, min_docs=10)
    got = out.collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id in range(10, 25):
            assert (r.n_lines, r.n_dropped) == (3, 1) and "Common" not in r.text
        if r.doc_id in (1, 2):
            assert (r.n_lines, r.n_dropped, r.text) == (1, 0, "")
    assert line_dedup.drop_common_lines(no_docs).count() == 0


def test_every_line_dropped_and_repeated_rows(spark):
    df = spark.createDataFrame([(7, "A\n a \nb")] * 3 + [(8, "a")], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.drop_common_lines(df, min_docs=4).collect()), key=str)
    assert got == [(7, "b", 3, 2)] * 3 + [(8, "", 1, 1)]


def test_simhash(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = {r.doc_id: r for r in got if r.doc_id in (1, 2, 7)}
    assert all(r.fingerprint == "0" * 16 and r.component_id == 1 for r in zero.values())
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and not {5, 6, 2} & set(ids) and ids.count(None) == 2
    assert simhash.one_of_each(no_docs).count() == 0


def test_ball_hashing_finds_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = set(base.tolist())
    for b in base.tolist():
        for n in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.choice(64, n, replace=False).tolist():
                x ^= simhash._as_long(1 << bit)
            fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.ball_edges(simhash.may_link(df))).collect()}
    linked = lambda a, b: 0 < ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    want = {x: {x} for x in fps}
    for a in fps:
        for b in fps:
            if linked(a, b) and want[a] is not want[b]:
                want[a] |= want[b]
                for c in want[b]:
                    want[c] = want[a]
    assert {x: got.get(x, x) for x in fps} == {x: min(want[x]) for x in fps}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_decontaminate(spark, odd_docs, no_docs):
    items = benchmark(spark, [(1, "A"), (2, None), (None, "beta"), (3, "common line")])
    got = decontaminate.find_contamination(odd_docs, items).collect()
    assert len(got) == odd_docs.count()
    assert all(r["items"] == ["1"] and r.contaminated for r in got if r.doc_id == 3)
    assert all(r["items"] == ["3"] and r.n_hit == 2 for r in got if r.doc_id in range(10, 25))
    blocks = decontaminate.find_contamination(odd_docs, items, block_bytes=1).collect()
    assert Counter(map(str, blocks)) == Counter(map(str, got))
    none = decontaminate.find_contamination(odd_docs, benchmark(spark, []).limit(0)).collect()
    assert len(none) == len(got) and not any(r.n_hit for r in none)
    assert decontaminate.find_contamination(no_docs, items).count() == 0
    kept = decontaminate.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r.contaminated for r in got)


def test_wu_manber_against_find():
    rng = np.random.default_rng(5)
    text = bytes(rng.choice([97, 98, 32], 20_000).astype(np.uint8))
    patterns = list({text[a : a + n] for a, n in zip(rng.integers(0, 19_000, 60).tolist(), rng.integers(3, 70, 60).tolist(), strict=True)})
    want = {(i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i)}
    assert set(decontaminate.WuManber(patterns).search(text, stretch=333)) == want


def test_secrets(odd_docs, no_docs):
    got = {r.doc_id: r for r in secrets.scan_secrets(odd_docs).collect()}
    assert (got[9].n_assign, got[9].n_access) == (1, 1) and got[1].spans == ""
    assert secrets.scan_secrets(no_docs).count() == 0
    text = "host db.example.com user=admin7 password: short1"
    kinds = [k for k, _, _ in secrets.find_secrets(text)[1]]
    assert kinds == ["endpoint", "weak_id", "weak_secret"]
    assert secrets.find_secrets("password: short1")[1] == []
    assert secrets.find_secrets(text.replace(" user", " " * 900 + " user"), reach=50)[1][0][0] == "weak_id"


def test_repeated_substrings(spark, odd_docs, no_docs):
    from test_brute_force import brute_repeats

    got = substrings.remove_repeats(odd_docs).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id is not None}
    assert len(got) == odd_docs.count()
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == brute_repeats(texts)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substrings.remove_repeats(no_docs).count() == 0
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ab"), 400))
    texts = {i: "".join(rng.choice(list("ab\0é"), 30)) + base[a : a + 120] + "ab" * 40 + base[b : b + 70] + "a" * 130 for i, (a, b) in enumerate(rng.integers(0, 300, (60, 2)).tolist())}
    df = spark.createDataFrame([*texts.items(), (7, texts[7]), (99, "one"), (99, "two")], "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(df, bucket_bytes=1000).collect()}
    assert {i: got[i] for i in texts} == brute_repeats(texts)


def test_repeat_groups():
    """All maximal repeats, against their definition."""
    rng = np.random.default_rng(6)
    segments = list({bytes(rng.choice([97, 98], n).astype(np.uint8)) for n in rng.integers(8, 40, 12).tolist()})
    tree = substrings.RepeatGroups(segments, 8)
    got = {(deep, frozenset(zip(tree.segment[a:b].tolist(), tree.offset[a:b].tolist(), strict=True))) for deep, a, b in tree.groups(8)}
    at: dict = {}
    for k, s in enumerate(segments):
        for i in range(len(s)):
            for j in range(i + 8, len(s) + 1):
                at.setdefault(s[i:j], set()).add((k, i))
    want = set()
    for text, found in at.items():
        sides = {segments[k][i - 1] if i else (k,) for k, i in found}
        ends = {segments[k][i + len(text)] if i + len(text) < len(segments[k]) else (k,) for k, i in found}
        if len(found) > 1 and len(sides) > 1 and len(ends) > 1:
            want.add((len(text), frozenset(found)))
    assert got == want


def test_licenses(spark, odd_docs, no_docs):
    texts, notes = licenses.known(spark, licenses.KNOWN_TEXTS), licenses.known(spark, licenses.KNOWN_NOTICES)
    assert licenses.scan_licenses(no_docs, texts, notes).count() == 0
    assert licenses.scan_licenses(odd_docs, texts, notes).count() == odd_docs.count()
    name, text = licenses.KNOWN_TEXTS[0]
    changed = "Copyright (c) 2020 Nobody\n" + text.upper().replace("LICENSE", "LICENCE").replace(",", " ,").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    df = spark.createDataFrame([(1, changed), (2, "prose\n  released under the mit licence\nprose"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, texts, notes).collect()}
    assert got[1].license_id == name and got[2].license_id is None and got[2].notices == "MIT" and got[3].text_digest is None


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 25)] + [(None, 1), (9, None)], "doc_id long, quality int")
    ranker = quality.fit(odd_docs, labels)
    assert quality.score_quality(odd_docs, ranker).count() == odd_docs.count()
    assert quality.score_quality(no_docs, ranker).count() == 0
    assert quality.keep_good(odd_docs, ranker).columns == odd_docs.columns
    none = quality.fit(odd_docs, labels.limit(0))
    assert all(r.score == 1 for r in quality.score_quality(odd_docs, none).collect())


def whole_viterbi(model, text):
    """Without a window: the best path to every boundary, then back from the end."""
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        found = [(j, *model.ids[text[i:j]]) for j in range(i + 1, min(len(text), i + model.max_piece) + 1) if text[i:j] in model.ids]
        if not found or found[0][0] > i + 1:
            found.append((i + 1, -1, model.unknown_score))
        for j, number, score in found:
            if best[j] is None or best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, number)
    out, j = [], len(text)
    while j:
        i, number = back[j]
        out[:0] = [number] if number >= 0 else model.unknown_ids(text[i:j])
        j = i
    return out


@pytest.mark.parametrize("window", [1, 17, 20, None, 10**9])
def test_viterbi_windows_agree(window):
    model = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = "".join(rng.choice(list("abt he er in▁\n日-="), rng.integers(1, 250)))
        assert [i for ids in sentencepiece.viterbi(model, text, window) for i in ids] == whole_viterbi(model, text)


def test_a_text_that_fits_the_window_is_followed_back_once():
    model = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model"))
    for text in ("▁a-b.c", "x日本,y", "\n"):
        assert [*sentencepiece.viterbi(model, text)] == [whole_viterbi(model, text)]
    assert [*sentencepiece.viterbi(model, "")] == []


def test_words_through_the_search(spark, sf):
    """Remembered words give what the search gives for whole texts."""
    model = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model"))
    own = sentencepiece.Encoder(model, max_words=300)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(25).collect()] + ["a" * 900, "x" * 300 + "." * 90, "日本" * 200, "===--- !!! ...", "e\u0301 \u2581 b"]
    for text in texts:
        text = text[:3000]
        marked = ("▁" if model.dummy_prefix else "") + text.replace(" ", "▁")
        assert own.encode(text).tolist() == (whole_viterbi(model, marked) if text else [])


def test_whole_texts_like_the_plain_search(spark, sf):
    """The ids of whole documents, however long."""
    model = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("n_chars")
    some = docs.limit(5).unionByName(docs.orderBy("n_chars", ascending=False).limit(3)).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in some.collect()}
    got = {r.doc_id: r for r in sentencepiece.encode_documents(some, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert max(map(len, texts.values())) > 5_000
    for i, text in texts.items():
        assert got[i].ids == whole_viterbi(model, ("▁" if model.dummy_prefix else "") + text.replace(" ", "▁"))
        assert got[i].n_ids == len(got[i].ids) and got[i].round_trip


@pytest.mark.parametrize("unit", ["a", "-", "=", "ab", "--="])
def test_runs_whose_paths_never_meet(unit):
    """As the plain search, and linear: a megabyte takes about a hundred times what ten kilobytes take."""
    import time

    model = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model"))
    own = sentencepiece.Encoder(model)
    text = unit * (5_000 // len(unit))
    assert own.encode(text).tolist() == whole_viterbi(model, ("▁" if model.dummy_prefix else "") + text)
    long, began = unit * (1_000_000 // len(unit)), time.process_time()
    ids = own.encode(long)
    assert time.process_time() - began < 60 and own.decode(ids) == long


def test_commits_come_early():
    """Ids are given before the text is read to its end."""
    model, read = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model")), []
    chars = (read.append(c) or c for c in "the words of a text▁" * 500)
    next(sentencepiece.viterbi(model, chars))
    assert len(read) <= 8 * model.max_piece


def test_viterbi_against_the_library(spark, sf):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    model = sentencepiece.Model(tokenizer_file("piece_bpe_32k.model"))
    for p in m.pieces:  # so that 32-bit sums are exact
        if p.score < -1e8:
            p.score = -40_000.0
            model.ids[p.piece] = (model.ids[p.piece][0], -40_000.0)
    model.unknown_score = -40_010.0
    model.trie.clear()
    for piece, (number, score) in model.ids.items():
        level, node = model.trie, None
        for char in piece:
            node = level.setdefault(char, [{}, -1, 0.0])
            level = node[0]
        node[1:] = number, score
    other = library.SentencePieceProcessor(model_proto=m.SerializeToString())
    own = sentencepiece.Encoder(model)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(30).collect():
        for at in range(0, len(r.text), 60):
            piece = r.text[at : at + 60]
            assert own.encode(piece).tolist() == other.encode(piece)


def test_sentencepiece(odd_docs, no_docs):
    path = tokenizer_file("piece_bpe_32k.model")
    got = sentencepiece.encode_documents(odd_docs, path).collect()
    assert len(got) == odd_docs.count() and all(r.round_trip for r in got)
    assert all(r.n_ids == 0 for r in got if r.doc_id in (1, 2))
    assert sentencepiece.encode_documents(no_docs, path).count() == 0


def test_token_files(spark, odd_docs, no_docs):
    path = tokenizer_file("word_bpe_49k.json")
    got = sorted(token_files.round_trip(odd_docs, path, shard_tokens=500).collect(), key=lambda r: r.start)
    assert len(got) == odd_docs.count() and [r.doc_id for r in got[:2]] == [None, None]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2))
    assert token_files.round_trip(no_docs, path).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([5]), np.full(999, 7), rng.integers(0, 9, 5000), np.tile(rng.integers(0, 3000, 40), 60)):
        ids = ids.astype(np.uint32)
        rules, sequence = token_files.repair(ids, 5000)
        assert (token_files.expand(sequence, rules, 5000) == ids).all()
    docs = [rng.integers(0, 4, n).astype(np.uint32) for n in (1, 50, 900, 3)]
    shard = token_files.Shard(token_files.pack([1, 2, 3, 4], docs, 10)[0])
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    whole = np.concatenate(docs)
    for a, b in ((0, 0), (0, 954), (3, 4), (100, 777)):
        assert (shard.decode_range(a, b) == whole[a:b]).all()
    assert (token_files.expansion_lengths(shard.rules, 10) == shard.rule_lengths).all()
