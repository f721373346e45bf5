"""Quality rules as a ledger of failure bits.

Each whole text is measured once; every rule is then decided once from the measurements and stored as one bit of a
long (``failures``, bit k for rule k). A policy is a named version of which bits reject a text: it is applied to a stored ledger
by bit operations, so another version costs no second reading of the texts. Ablations count failures per distinct
mask (one row a task and mask reaches the shuffle, and seven rules make at most 128 masks) and work on those counts alone.

Defined cases: a null or empty text has no words and fails few_words; null ids, repeated ids and repeated rows are measured
row by row; a very long text is split in pieces of a megabyte, so only its word numbers (8 bytes a word) are held whole;
an empty table gives an empty ledger and no ablation rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_SPACE, pick

SYMBOLS = "#*$%&|<>"
#: Lines that begin with one of these count as bullets.
BULLETS = ("-", "*", "•", "●", "▪")
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20

#: Rules in the order of their bits: a condition on the measurements that a text fails by.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "bullet_lines": "100 * n_bullet_lines > 90 * n_lines",
    "ellipsis_lines": "100 * n_ellipsis_lines > 30 * n_lines",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Policy:
    """A version: failing a fatal rule rejects a text, and so does failing more than ``allowed`` of the counted ones."""

    version: str
    fatal: Sequence[str]
    counted: Sequence[str] = ()
    allowed: int = 0


BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(RULES))
LENIENT = Policy("lenient-1", ("few_words", "repeated_words"), tuple(r for r in RULES if r not in BASE.fatal), 1)
POLICIES = (BASE, STRICT, LENIENT)


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of a megabyte or more that end at white space."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + _PIECE) if at + _PIECE < len(data) else None
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    parts = [np.fromiter((number(w, len(known)) for w in piece.split()), np.int64) for piece in _pieces(data)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def repeated_window_words(words: np.ndarray, size: int = 3) -> int:
    """Words that stand in a window of this size that is found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    window = words[:n]
    for k in range(1, size):  # renumbered after each step, so the products stay small
        window = pd.factorize(window * (int(words.max()) + 1) + words[k : n + k])[0]
    again = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : n + k] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES."""
    text = text or ""
    words = word_numbers(text.encode("utf-8", "surrogatepass"))
    lines = [s for line in text.split("\n") if (s := line.strip(ASCII_SPACE))]
    whole = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(whole) - len(set(whole)),
        repeated_window_words(words),
        len(lines),
        sum(s.startswith(BULLETS) for s in lines),
        sum(s.endswith(("...", "…")) for s in lines),
    )


def rule_bit(rule: str) -> int:
    return 1 << [*RULES].index(rule)


def mask_of(rules: Sequence[str]) -> int:
    return sum(map(rule_bit, dict.fromkeys(rules)))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, the measurements (long each) and ``failures`` for every row of docs."""
    rows = pick(docs, _id=id_column, _text=text_column)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = np.array([measures(t.as_py()) for t in piece["_text"]], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([piece["_id"], *map(pa.array, found.T)], names=["_id", *MEASURES])

    measured = rows.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(condition), F.lit(rule_bit(rule))).otherwise(F.lit(0)).cast("long") for rule, condition in RULES.items()]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.select(F.col("_id").alias(id_column), *MEASURES, failures.alias("failures"))


def is_kept(policy: Policy, failures: str | Column = "failures") -> Column:
    """Whether a text of these failure bits passes the policy."""
    bits = F.col(failures) if isinstance(failures, str) else failures
    fatal = bits.bitwiseAND(F.lit(mask_of(policy.fatal)).cast("long"))
    counted = bits.bitwiseAND(F.lit(mask_of(policy.counted)).cast("long"))
    return (fatal == 0) & (F.bit_count(counted) <= policy.allowed)


def apply_policies(rows: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """A ledger with one boolean column ``kept_<version>`` a policy."""
    return rows.select("*", *[is_kept(p).alias(f"kept_{p.version}") for p in policies])


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """version, rule, n_texts, n_failed, n_kept, n_kept_without: what each policy keeps, and would keep without one of its rules.

    n_failed counts texts that fail the rule, whatever else they fail.
    """
    masks = rows.groupBy("failures").agg(F.count("*").alias("n"))
    parts = []
    for p in policies:
        used = list(dict.fromkeys([*p.fatal, *p.counted]))
        each = masks.select("failures", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(rule_bit(r)).cast("long").alias("bit")) for r in used])).alias("x")).select("failures", "n", "x.*")
        without = F.col("failures").bitwiseAND(F.bitwise_not("bit"))
        parts.append(
            each.groupBy("rule").agg(
                F.sum("n").alias("n_texts"),
                F.sum(F.when(F.col("failures").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(is_kept(p), F.col("n")).otherwise(0)).alias("n_kept"),
                F.sum(F.when(is_kept(p, without), F.col("n")).otherwise(0)).alias("n_kept_without"),
            ).select(F.lit(p.version).alias("version"), "*")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality_rules(docs: DataFrame, policy: Policy = STRICT, base: Policy = BASE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ledger with base_failed and kept (false if base_failed, else the policy's verdict)."""
    rows = ledger(docs, id_column, text_column)
    return rows.select("*", (~is_kept(base)).alias("base_failed"), (is_kept(base) & is_kept(policy)).alias("kept"))
