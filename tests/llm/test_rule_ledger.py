"""Quality rules: measurements against a plain version, policies and ablations against whole recounts."""

import random
import re

import pytest

from cohortloom.llm import rule_ledger as rl

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered), len(lines), sum(x[0] in "-*•●▪" for x in bare), sum(x.endswith("...") or x[-1] == "…" for x in bare))


def random_text(rng):
    parts = ["a", "b", "é", "one", "#x", "|", "...", "-", " ", "\x1c", "x…", "❤️"]
    return "".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.randrange(60)))


def test_measures_like_the_plain_version():
    rng = random.Random(5)
    for _ in range(400):
        text = random_text(rng)
        assert rl.measures(text) == plain_measures(text), text


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "ghijk" * 4]) for _ in range(300)) for _ in range(20)]
    monkeypatch.setattr(rl, "_PIECE", 7)
    for text in texts:
        assert rl.measures(text) == plain_measures(text)
    assert rl.measures("x" * 100) == plain_measures("x" * 100)


def test_odd_rows(odd_docs, no_docs):
    got = rl.quality_rules(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id in (1, 2, 7):
            assert (r.n_words, r.failures & 1) == (0, 1)
    assert {(r.doc_id, r.n_words) for r in got if r.doc_id == 4} == {(4, 30_000)}
    assert rl.quality_rules(no_docs).count() == 0
    assert rl.ablations(rl.ledger(no_docs)).count() == 0


def test_ablations_are_whole_recounts(spark):
    rng = random.Random(7)
    masks = [rng.randrange(128) for _ in range(300)]
    rows = spark.createDataFrame([(m,) for m in masks], "failures long")
    found = {(r.version, r.rule): r for r in rl.ablations(rows).collect()}

    def kept(p, m):
        failed = {r for r in rl.RULES if m & rl.rule_bit(r)}
        return not failed & set(p.fatal) and len(failed & set(p.counted)) <= p.allowed

    assert len(found) == sum(len({*p.fatal, *p.counted}) for p in rl.POLICIES)
    for p in rl.POLICIES:
        for rule in {*p.fatal, *p.counted}:
            r, bit = found[p.version, rule], rl.rule_bit(rule)
            assert (r.n_texts, r.n_failed) == (300, sum(bool(m & bit) for m in masks))
            assert r.n_kept == sum(kept(p, m) for m in masks)
            assert r.n_kept_without == sum(kept(p, m & ~bit) for m in masks)
    stored = rl.apply_policies(rows, rl.POLICIES).collect()
    assert all(r[f"kept_{p.version}"] == kept(p, r.failures) for r in stored for p in rl.POLICIES)


@pytest.mark.parametrize("text,rule", [("word " * 49, "few_words"), ("a b c " * 20, "repeated_words"), (" ".join("abcdefghijklmnop"[i % 9 :] + str(i) for i in range(60)), "word_length"), (" ".join(f"word{i} |" for i in range(60)), "symbols"), ("\n".join(["same line here"] * 4 + [f"this is line{i} of{i}" for i in range(5)]), "repeated_lines"), ("\n".join(f"- item{i} number{i * 7} here{i * 3}" for i in range(20)), "bullet_lines"), ("\n".join(f"and item{i} so{i * 7} on{i * 3}..." for i in range(20)), "ellipsis_lines")])
def test_each_rule_has_its_bit(spark, text, rule):
    row = rl.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.failures & rl.rule_bit(rule)
