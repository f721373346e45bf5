"""Benchmark decontamination: Wu-Manber search for 13-word windows in whole documents.

A window of a benchmark item becomes the pattern " w1 ... w13 ". Patterns are grouped by
length; a group searches with its shortest length m. A table over blocks of bytes holds how far
a position can be skipped; where it holds 0 the block may end the first m bytes of some
patterns, the bucket of the block's hash gives them, and comparing bytes confirms. Many
stretches of a batch of documents advance side by side, each by its own shift.

Patterns are compiled in blocks of bounded size, each broadcast; more than one block means one
pass over the documents a block, joined by row.

Defined cases: a null text has no words; items without words are
ignored; the words of an item without an id are hit, but nothing names it among the items; null document ids are kept; an empty benchmark hits nothing; rows that repeat each get
a result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick, row_key, text_of, written

#: A-Z to lower case; ASCII bytes that are no word characters to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


@dataclass
class _Group:
    """Patterns whose lengths lie within a factor of two."""

    patterns: list[bytes]
    ids: list[int]
    m: int = 0
    block: int = 0
    bits: int = 0
    shift: np.ndarray = field(default=None)
    buckets: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.m = min(map(len, self.patterns))
        self.block = 8 if self.m >= 16 else 3
        self.bits = 20 if self.block == 8 else 16
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int32)
        for k, pattern in enumerate(self.patterns):
            raw = np.frombuffer(pattern[: self.m] + b"\0" * 8, np.uint8)
            ends = np.arange(self.m - self.block + 1)
            codes = self.codes(_words64(raw), ends)
            np.minimum.at(self.shift, codes, (self.m - self.block - ends).astype(np.int32))
            self.buckets.setdefault(int(codes[-1]), []).append(k)

    def codes(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = words[at]
        if self.block < 8:
            x = x & np.uint64((1 << 8 * self.block) - 1)
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)


def _words64(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, little-endian; raw ends in 8 bytes of padding."""
    return np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,)) if len(raw) > 8 else np.zeros(0, np.uint64)


class WuManber:
    """Finds every occurrence of many byte patterns of at least three bytes."""

    def __init__(self, patterns: list[bytes]) -> None:
        by_length: dict[int, list[int]] = {}
        for k, pattern in enumerate(patterns):
            by_length.setdefault(len(pattern).bit_length(), []).append(k)
        self.groups = [_Group([patterns[k] for k in ks], ks) for _, ks in sorted(by_length.items())]

    def search(self, buffer: bytes, stretch: int = 2048) -> list[tuple[int, int]]:
        """(position, pattern number) of all occurrences, in no order."""
        raw = np.frombuffer(buffer + b"\0" * 8, np.uint8)
        words, found = _words64(raw), []
        for g in self.groups:
            last = len(buffer) - g.m  # of the positions where a pattern can start
            if last < 0:
                continue
            at = np.arange(0, last + 1, stretch)
            end = np.minimum(at + stretch, last + 1)
            while len(at):
                code = g.codes(words, at + (g.m - g.block))
                step = g.shift[code]
                for i in np.flatnonzero(step == 0):
                    p = int(at[i])
                    found += [(p, g.ids[k]) for k in g.buckets.get(int(code[i]), ()) if buffer.startswith(g.patterns[k], p)]
                at = at + np.maximum(step, 1)
                going = at < end
                at, end = at[going], end[going]
        return found


@dataclass
class Patterns:
    """A compiled block of windows, with the items of each."""

    search: WuManber
    n_words: list[int]
    items: list[list[str]]


def compile_blocks(items: Iterable[tuple[object, str | None]], size: int, block_bytes: int) -> Iterator[Patterns]:
    """Blocks of windows whose patterns hold about block_bytes."""
    known: dict[tuple[bytes, ...], dict[str, None]] = {}  # names in order, each once
    held = 0
    for item_id, text in items:
        for window in windows_of(words_of(text), size):
            if window not in known:
                known[window] = {}
                held += sum(map(len, window)) + len(window) + 1
            if item_id is not None:  # its words are hit all the same, there is only no name to tell
                known[window][str(item_id)] = None
        if held >= block_bytes:
            yield _compiled(known)
            known, held = {}, 0
    if known:
        yield _compiled(known)


def _compiled(known: dict[tuple[bytes, ...], dict[str, None]]) -> Patterns:
    return Patterns(WuManber([b" " + b" ".join(w) + b" " for w in known]), [len(w) for w in known], [[*names] for names in known.values()])


def scan_texts(texts: list[str | None], patterns: Patterns, batch_bytes: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For each text: its number of words, the numbers of the words hit, the ids of the items found."""
    batch: list[tuple[int, bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        words = words_of(text)
        batch.append((len(words), b" " + b" ".join(words) + b" "))
        held += len(batch[-1][1]) + 1
        if held >= batch_bytes or k == len(texts) - 1:
            yield from _scan_batch(batch, patterns)
            batch, held = [], 0


def _scan_batch(batch: list[tuple[int, bytes]], patterns: Patterns) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    buffer = b"\n".join(b for _, b in batch)
    starts = np.cumsum([0, *(len(b) + 1 for _, b in batch)])
    hit: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = {}
    if found := patterns.search.search(buffer):
        at, which = np.array(found).T
        spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        doc = np.searchsorted(starts, at, "right") - 1
        first = np.searchsorted(spaces, at) - np.searchsorted(spaces, starts[doc])
        for d, f, w in zip(doc.tolist(), first.tolist(), which.tolist(), strict=True):
            hit.setdefault(d, np.zeros(batch[d][0], bool))[f : f + patterns.n_words[w]] = True
            items.setdefault(d, set()).update(patterns.items[w])
    for d, (n, _) in enumerate(batch):
        yield n, np.flatnonzero(hit[d]) if d in hit else np.zeros(0, np.int64), items.get(d, set())


def is_contaminated(n_words: int, n_hit: int, share: int = 20) -> bool:
    """At least one word in ``share`` hit."""
    return n_hit > 0 and share * n_hit >= n_words


def benchmark_blocks(benchmark: DataFrame, size: int, block_bytes: int, item_column: str, text_column: str) -> list:
    """Broadcast blocks of patterns. The benchmark is the stated query set; it does not grow with the documents."""
    rows = pick(benchmark, item=item_column, text=text_column).toLocalIterator()
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(b) for b in compile_blocks(((r.item, r.text) for r in rows), size, block_bytes)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 1 << 24, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """id, n_words, n_hit, items (sorted array of strings), contaminated for every row."""
    rows = pick(docs, id=id_column, text=text_column).select("id", text_of().alias("text"))
    blocks = benchmark_blocks(benchmark, size, block_bytes, item_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    if len(blocks) <= 1:
        out = rows.mapInArrow(_scanner(blocks[0] if blocks else None, False), f"id {kind}, n_words long, n_hit long, items array<string>")
    else:
        keyed = rows.select(*row_key(F.col("id"), F.col("text")), "id", "text")
        merged = _merged_blocks(keyed, blocks, kind)
        out = merged.select("id", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1), (F.col("n") / len(blocks)).cast("int"))))
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(F.col("id").alias(id_column), "n_words", "n_hit", "items", bad.alias("contaminated"))


def _merged_blocks(keyed: DataFrame, blocks: list, kind: str) -> DataFrame:
    """_k1, _k2, id, n_words, n_hit, items, n (scans) of each distinct row of keyed (_k1, _k2, id, text) over all blocks."""
    every = None
    for b in blocks:
        part = keyed.mapInArrow(_scanner(b, True), f"_k1 long, _k2 long, id {kind}, n_words long, hit array<long>, items array<string>")
        every = part if every is None else every.unionByName(part)
    merged = every.groupBy("_k1", "_k2", "id", "n_words").agg(F.array_distinct(F.flatten(F.collect_set("hit"))).alias("hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("n"))
    return merged.select("_k1", "_k2", "id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.array_sort("items").alias("items"), "n")


def _scanner(block, positions: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = block.value if block else Patterns(WuManber([]), [], [])
        for batch in batches:
            found = [*scan_texts(batch["text"].to_pylist(), patterns)]
            n = pa.array([n for n, _, _ in found], pa.int64())
            items = pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))
            if positions:
                hit = pa.array([h.tolist() for _, h, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["_k1"], batch["_k2"], batch["id"], n, hit, items], names=["_k1", "_k2", "id", "n_words", "hit", "items"])
            else:
                hit = pa.array([len(h) for _, h, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["id"], n, hit, items], names=["id", "n_words", "n_hit", "items"])

    return scan


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 1 << 24, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    One block of patterns at a time is with a task; more than one block is scanned by as many passes, and texts found contaminated are dropped by two hashes of them.
    """
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = text_of(F.col(f"_c{docs.columns.index(text_column)}"))
    blocks = benchmark_blocks(benchmark, size, block_bytes, item_column, text_column)
    if len(blocks) > 1:
        texts = flat.select(text.alias("text")).select(*row_key(F.lit(""), F.col("text")), F.lit(0).alias("id"), "text")
        merged = _merged_blocks(texts, blocks, "int").where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        bad, _ = written(merged.select("_k1", "_k2"), "contaminated")
        keyed = flat.select("*", *row_key(F.lit(""), text))
        return keyed.join(bad, ["_k1", "_k2"], "left_anti").select(*flat.columns).toDF(*docs.columns)
    block = blocks[0] if blocks else None

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        patterns = block.value if block else Patterns(WuManber([]), [], [])
        return pd.Series([not is_contaminated(n, len(hit)) for n, hit, _ in scan_texts(texts.tolist(), patterns)], dtype=bool)

    return flat.where(clean(text)).toDF(*docs.columns)
