"""Spelling variants: words one inserted, deleted or replaced code point apart, and the usual form of each.

Positional bigrams of each word are ordered by how few words have the bigram (then by bigram, then by position), one order for all words. One edit touches at most two
bigrams, and the others keep their order, so the first untouched one stands among the first three of both words, at most one place further on. Words
meet by an equi-join on those three: the bigram, its position, the length, and, as the edit lies in one of four quarters, all
letters outside of a quarter. So a group holds words that agree in three quarters, not all that share a bigram. Pairs are verified by edit distance.

The bigram counts are broadcast: the alphabet of ``letters`` (26 + 64 code points) bounds them to 8,100 rows whatever the input.

Defined cases: a null text has no words; a null id counts as an empty string; every row counts, also rows that repeat an id or a whole row; words of any
length take part; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, pick, written

#: Runs of these are words. A-Z are lower-cased, so 26 + 64 code points are left.
LETTERS = "A-Za-zÀ-ÿ"
#: Bigrams that one edit touches, and one.
PREFIX = 3
QUARTERS = 4


def seen_words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, altered: int = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: what is read of the texts' runs.

    Where ``altered`` divides the crc32 of "<id>:<run>", the run loses the code point at that number modulo its length.
    """
    rows = pick(docs, _id=id_column, _text=text_column)
    runs = rows.select(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all("_text", F.lit(f"[{LETTERS}]{{{min_chars},}}+"), F.lit(0))).alias("run"))
    low = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % altered == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """word, n, size (code points), bigram, pos (from 1): the three first bigrams of each word in the order of all."""
    size = F.char_length("word")
    bigrams = words.select("word", "n", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.struct(i.alias("pos"), F.substr("word", i, F.lit(2)).alias("bigram")))).alias("x")).select("word", "n", "size", "x.*")
    often = F.broadcast(bigrams.groupBy("bigram").agg(F.count("*").alias("often")))
    ranked = bigrams.join(often, "bigram").groupBy("word", "n", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "bigram", "pos"))), 1, PREFIX).alias("first"))
    return ranked.select("word", "n", "size", F.explode("first").alias("x")).select("word", "n", "size", "x.bigram", "x.pos")


def _keys(bigram: Column, pos: Column, short: Column, longer: bool) -> list[Column]:
    """Keys of a word whose shorter partner (or itself) has so many code points, one a quarter: what stands outside of the quarter."""
    word, out = F.col("word"), []
    for q in range(QUARTERS):
        start, end = (F.floor(short * k / QUARTERS).cast("int") for k in (q, q + 1))
        before, after = F.substr(word, F.lit(1), start), F.right(word, short - end)
        out.append(F.xxhash64(F.lit(longer), F.lit(q), short, bigram, pos, before, after))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: pairs of words exactly one code point apart, each once. Words need four code points or more."""
    first, _ = written(rarest_bigrams(words), "rarest-bigrams")
    bigram, pos, size = F.col("bigram"), F.col("pos"), F.col("size")
    equal = _keys(bigram, pos, size, False)
    asks = first.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(*equal, *_keys(bigram, pos, size, True), *_keys(bigram, pos + 1, size, True))).alias("key"))
    rows = first.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(*equal, *_keys(bigram, pos, size - 1, True))).alias("key"))
    met = asks.join(rows.hint("merge"), "key").where((F.char_length("a") < F.char_length("b")) | ((F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()


def followed(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: forms (word, form) followed to the last, by doubling; no chain has more than ``steps`` forms."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        now, _ = written(now, "roots")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), as the query op13 returns them.

    A word's form is its near word of largest n, the smallest of them in code-point order, if that n is ``ratio`` times its own or more.
    """
    words, _ = written(words, "words")
    pairs, _ = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    usual = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= F.col("n") * ratio, F.lit(False)))
    named = usual.select("word", F.when(F.col("is_form"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"))
    named, _ = written(named, "forms")
    most = named.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(most) / math.log(ratio)) + 1) if ratio > 1 else named.count()
    roots = followed(named.where("form IS NOT NULL").select("word", "form"), steps)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 7, min_count: int = 2, altered: int = 31, ratio: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words of the texts with their forms: see ``seen_words`` and ``group_variants``."""
    if min_chars < PREFIX + 1:
        raise ValueError("words of fewer than four code points may share none of their bigrams")
    return group_variants(seen_words(docs, min_chars, min_count, altered, id_column, text_column), ratio)
