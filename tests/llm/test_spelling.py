"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from cohortloom.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, min_chars=7, min_count=2):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def plain_groups(words, ratio=10):
    form, out = {}, {}
    for w, n in words.items():
        some = [x for x in words if near(w, x)]
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        out[w] = len(some)
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("letters,sizes", [("ab", (4, 7)), ("aé", (7, 10)), ("abcdefgh", (4, 6)), ("aab", (8, 11))])
def test_near_words_like_brute_force(spark, letters, sizes):
    rng = random.Random(letters + str(sizes))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): int(10 ** (3.5 * rng.random())) for _ in range(350)}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = {frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert spelling.near_pairs(df).count() == len(got)
    assert found(spelling.group_variants(df)) == plain_groups(words)


def test_texts_like_brute_force(spark):
    rng = random.Random(2)
    stems = ["Variante", "variantes", "ÉCRITURE", "écriture", "Straßenbahn", "recognise", "recognize", "short", "x×y÷zabc", "İstanbul", "naïveté" * 3]
    rows = [(i if i % 50 else None, " ".join(rng.choice(stems[: 1 + int(rng.paretovariate(0.7)) % len(stems)]) + rng.choice([",", ".", "-x", "1", "\n", ""]) for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(1, None), (2, ""), rows[5], rows[5], (3, "z" * 50_000 + " " + "z" * 50_000), (4, "y" + "z" * 49_999)]
    df = spark.createDataFrame([(i, t, "w", "n") for i, t in rows], "doc_id long, text string, Word string, N string")
    want = plain_groups(plain_words(rows))
    assert any(r[1] for r in want)
    assert found(spelling.spelling_variants(df)) == want


def test_chains_are_followed_to_their_end(spark):
    words = {"aaaaaaa" + "b" * k: 3 * 10**k for k in range(9)}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = found(spelling.group_variants(df))
    assert got == plain_groups(words) and {r[2] for r in got} == {"aaaaaaa" + "b" * 8}


def test_no_rows_and_short_words(spark, no_docs, odd_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    spelling.spelling_variants(odd_docs).collect()
    with pytest.raises(ValueError):
        spelling.spelling_variants(odd_docs, min_chars=3)
