"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned by id and a hash of their text, encoded, and cut into shards of about
``shard_tokens`` ids at document ends. Within a shard Re-Pair replaces frequent pairs of neighbouring symbols by new symbols
(rules) until no pair occurs ``min_count`` times without overlap: in a round all pairs that do are counted, and
their occurrences replaced from the left; the next round counts the pairs of new symbols. A shard holds the
rules, the expansion length of each, the compressed sequence and the lengths of its documents,
so a document, or any range of ids, decodes on its own: ``decode_range``
seeks by cumulated expansion lengths and expands only the symbols that it meets.

File format: Parquet files in ascending order of ids (part by part, shard by shard), one row
a shard: part, shard, first_id, last_id, n_docs, n_tokens, payload. The payload is
``RPR2``, five little-endian unsigned 32-bit counts (base, rules, symbols, docs, docs without an id), then rules (2 a rule), expansion lengths, sequence,
document lengths (all unsigned 32-bit), and the ids of the documents (signed 64-bit, those without an id first, as 0), compressed by zstd.

Defined cases: a null or empty text has the end id alone; rows that repeat an id follow each other in
order of a hash of their text; null ids come first; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import os

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import pick, scratch_path, text_of

MAGIC = b"RPR2"


# encoding ------------------------------------------------------------------------------


#: How byte-level tokenizers write the bytes that are no printable Latin-1 characters: from U+0100 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(_HIDDEN)}


#: Letters up to U+017F that are in normal form and have a lower case of one letter, and points that follow words.
_PLAIN = frozenset(chr(c) for c in range(0x180) if chr(c).isalpha() and len(chr(c).lower()) == 1)
_POINTS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder(dict):
    """Ids by a tokenizers file, for tokenizers that treat words between white space apart.

    The library encodes the words; their ids are remembered (2 * max_words of them at most).
    Plain letters go to the library's model alone, and points after a plain letter are tokens apart (but in special tokens, which end in points). It
    holds for tokenizers whose pre-tokenizer drops white space and cuts between letters and points, which is checked on the file and by
    tests over all characters. Texts with U+001C to U+001F, at
    which words are split here but not by tokenizers (they are no Unicode White_Space), are encoded whole.
    """

    def __init__(self, path: str, max_words: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.old: dict[str, bytes] = {}
        self.model, self.direct = self.tokenizer.model, False
        self.by_word = self._whole("one, two  three.\nfour") == [i for w in ("one", ",", "two", "three", ".", "four") for i in self._whole(w)]
        probe = "probe lettersé ßüñ Word"
        self.direct = self.by_word and [i for w in probe.split() for i in self._letters(w)] == self._whole(probe) and self._whole("one!?#%") == self._whole("one") + self._whole("!?#%")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        """Ids of a word of letters up to U+017F, by the library's model."""
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(word)]

    def _ids_of(self, word: str) -> bytes:
        """The ids of a word without points at its end, remembered."""
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self._letters(word) if self.direct and _PLAIN.issuperset(word) else self._whole(word)).tobytes()
        if len(self) >= self.max_words:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of each word; points after a plain letter are looked up apart and the whole is not remembered."""
        out, get = [], self.get
        for word in words:
            ids = get(word)
            if ids is None:
                head = word.rstrip(_POINTS)
                if head and len(head) < len(word) and self.direct and head[-1] in _PLAIN and "|>" not in word:
                    points = word[len(head) :]
                    ids = (get(head) or self._ids_of(head)) + (get(points) or self._ids_of(points))
                else:
                    ids = self._ids_of(word)
            out.append(ids)
        return out

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each): each distinct word is looked up once."""
        words = pc.utf8_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        known = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        store, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        count = sizes[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat((starts[which] - ends[:-1]).astype(np.int32), count)
        place += np.arange(len(place), dtype=np.int32)
        ids = store[place]
        cuts = words.offsets.to_numpy()
        return ids, np.diff(ends[cuts - cuts[0]])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unsigned 32-bit ids of all texts, number of ids of each); a null text is empty."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)) if self.by_word else np.arange(len(texts))
        if not len(odd):
            return self._by_word(texts)
        parts = [np.array(self._whole(t), "<u4") for t in texts.take(pa.array(odd)).to_pylist()]
        if len(odd) < len(texts):
            ids, counts = self._by_word(pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts))
            every = np.split(ids, np.cumsum(counts)[:-1])
            for k, part in zip(odd.tolist(), parts, strict=True):
                every[k] = part
            parts = every
        return np.concatenate(parts).astype("<u4"), np.array([len(x) for x in parts], np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        if not texts:
            return []
        ids, counts = self.encode_all(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1])


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# Re-Pair -------------------------------------------------------------------------------


def _repeats_itself(left: np.ndarray, right: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    """Numbers of the pairs that overlap the same pair before them: in runs of one symbol every second, from the left."""
    same = np.flatnonzero(left == right)
    if not len(same):
        return same
    p = same if at is None else at[same]
    run = np.flatnonzero(np.concatenate([[True], np.diff(p) > 1]))
    first = np.repeat(p[run], np.diff(np.append(run, len(p))))
    return same[(p - first) % 2 == 1]


def _frequent(sequence: np.ndarray, fresh: int, symbols: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, number of the pair at each, pairs) of the pairs that occur min_count times without overlap and have a symbol from ``fresh`` on."""
    left, right, at = sequence[:-1], sequence[1:], None
    if fresh:
        at = np.flatnonzero((left >= fresh) | (right >= fresh))
        left, right = left[at], right[at]
    kind, shift = (np.uint32, 16) if symbols <= 1 << 16 else (np.uint64, 32)
    code = left.astype(kind)
    code <<= kind(shift)
    code |= right
    if len(over := _repeats_itself(left, right, at)):
        code = np.delete(code, over)
        at = np.delete(np.arange(len(sequence) - 1) if at is None else at, over)
    ordered = np.sort(code)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    often = ordered[starts[np.diff(np.append(starts, len(ordered))) >= min_count]]
    pairs = np.stack([often >> kind(shift), often & kind((1 << shift) - 1)], 1).astype(np.uint32)
    # tables of hashed pairs find their places; pairs that lose their slot to another go to the next table
    found, numbers, left_over, turn = [], [], np.arange(len(often)), 0
    while len(left_over):
        turn += 2
        bits, factor = min(len(left_over).bit_length() + 5, 24), np.uint32(0x9E3779B1 * turn + 0x9E3779B1 & 0xFFFFFFFF)
        mixed = (code ^ (code >> kind(15))).astype(np.uint32) if shift == 16 else (code ^ (code >> kind(29))).astype(np.uint32)
        slot = (mixed * factor) >> np.uint32(32 - bits)
        own = often[left_over]
        own_slot = ((own ^ (own >> kind(15 if shift == 16 else 29))).astype(np.uint32) * factor) >> np.uint32(32 - bits)
        table = np.full(1 << bits, -1, np.int32)
        table[own_slot] = left_over
        number = table[slot]
        hit = np.flatnonzero((often[number] == code) & (number >= 0))
        found.append(hit)
        numbers.append(number[hit])
        left_over = left_over[table[own_slot] != left_over]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pairs
    hit, number = np.concatenate(found), np.concatenate(numbers)
    if len(found) > 1:
        order = np.argsort(hit, kind="stable")
        hit, number = hit[order], number[order]
    return hit if at is None else at[hit], number.astype(np.int64), pairs


def _replacements(at: np.ndarray, number: np.ndarray, n: int, length: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers) to replace: of overlapping pairs the more frequent, each pair min_count times or not at all."""
    counts = np.bincount(number, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(n)
    uses, busy, taken = np.zeros(n, np.int64), np.zeros(length + 1, bool), []
    while len(at):
        over = rank[number]
        touch, ahead = at[1:] - at[:-1] == 1, over[1:] > over[:-1]
        loses = np.zeros(len(at), bool)
        loses[1:] = touch & ~ahead
        loses[:-1] |= touch & ahead
        # the first of all ranks wins everywhere, so each turn takes something
        wins = np.flatnonzero(~loses)
        by = number[wins]
        met = uses + np.bincount(by, minlength=n)
        worth = (met >= min_count)[by]
        if not worth.all():
            wins, by = wins[worth], by[worth]
        p = at[wins]
        uses += np.bincount(by, minlength=n)
        busy[p] = True
        busy[p + 1] = True
        taken.append((p, by))
        free = np.flatnonzero(~(busy[at] | busy[at + 1]))
        at, number = at[free], number[free]
        enough = (uses + np.bincount(number, minlength=n) >= min_count)[number]
        at, number = at[enough], number[enough]
    return tuple(np.concatenate(x) for x in zip(*taken, strict=True))


def repair(ids: np.ndarray, base: int, min_count: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule k, a pair of symbols, is symbol base + k. No pair is left that occurs min_count times without overlap.

    Works on the ids that occur, renumbered, so that most pairs are counted as 32-bit numbers.
    """
    present = np.zeros(base, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    number = np.zeros(base, np.uint32)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    sequence, symbols, fresh = number[ids], len(alphabet), 0
    rules: list[np.ndarray] = [np.zeros((0, 2), np.uint32)]
    while len(sequence) > min_count:
        at, which, pairs = _frequent(sequence, fresh, symbols, min_count)
        if not len(at):
            if not fresh:
                break
            fresh = 0  # pairs that lost places to others may be left: count all
            continue
        p, by = _replacements(at, which, len(pairs), len(sequence), min_count)
        used = np.bincount(by, minlength=len(pairs)) > 0
        rules.append(pairs[used])
        sequence[p] = (symbols + np.cumsum(used) - 1)[by].astype(np.uint32)
        keep = np.ones(len(sequence), bool)
        keep[p + 1] = False
        sequence = sequence[keep]
        fresh = symbols
        symbols += int(used.sum())
    # back to ids; rule k of the renumbered symbols becomes base + k
    real = np.concatenate([alphabet, np.arange(base, base + symbols - len(alphabet), dtype=np.uint32)])
    return real[np.concatenate(rules)], real[sequence]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids that each rule stands for; a rule refers to earlier symbols only."""
    lengths = np.zeros(len(rules), np.int64)
    left, right = (rules[:, k].astype(np.int64) - base for k in (0, 1))
    open_ = np.arange(len(rules))
    while len(open_):
        a, b = left[open_], right[open_]
        x, y = (np.where(s < 0, 1, lengths[np.maximum(s, 0)]) for s in (a, b))
        known = (x > 0) & (y > 0)
        lengths[open_[known]] = (x + y)[known]
        open_ = open_[~known]
    return lengths


#: Rules that stand for so many ids at most are written out before a sequence is expanded.
_SHORT = 32


def _unfolded(symbols: np.ndarray, rules: np.ndarray, base: int, high: np.ndarray) -> np.ndarray:
    """symbols with those at ``high`` replaced by their pairs."""
    size = np.ones(len(symbols), np.int64)
    size[high] = 2
    at = np.cumsum(size) - size
    new = np.empty(len(symbols) + len(high), np.uint32)
    new[at] = symbols
    pair = rules[symbols[high] - base]
    new[at[high]], new[at[high] + 1] = pair[:, 0], pair[:, 1]
    return new


def expand(sequence: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that a sequence of symbols stands for; lengths: those of the rules' expansions."""
    lengths = (expansion_lengths(rules, base) if lengths is None else lengths).astype(np.int64)
    size = np.concatenate([np.ones(base, np.int64), lengths])
    out = sequence.astype(np.uint32)
    if (lengths > _SHORT).any():
        while len(high := np.flatnonzero(size[out] > _SHORT)):
            out = _unfolded(out, rules, base, high)
    # all ids, and the short rules that occur written out, side by side
    occurs = np.zeros(len(size), bool)
    occurs[out] = True
    met = np.flatnonzero(occurs[base:]) + base
    store = met.astype(np.uint32)
    while len(high := np.flatnonzero(store >= base)):
        store = _unfolded(store, rules, base, high)
    start = np.arange(len(size))
    start[met] = base + np.cumsum(size[met]) - size[met]
    count = size[out]
    place = np.repeat(start[out] - (np.cumsum(count) - count), count)
    place += np.arange(len(place))
    return np.concatenate([np.arange(base, dtype=np.uint32), store])[place]


class Shard:
    """A shard's payload, with random access."""

    def __init__(self, payload: bytes) -> None:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(payload)
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        self.base, n_rules, n_symbols, n_docs, self.nameless = struct.unpack_from("<5I", raw, 4)
        words = np.frombuffer(raw, "<u4", 3 * n_rules + n_symbols + n_docs, 24)
        self.rules = words[: 2 * n_rules].reshape(-1, 2)
        self.rule_lengths = words[2 * n_rules : 3 * n_rules]
        self.sequence = words[3 * n_rules : 3 * n_rules + n_symbols]
        self.doc_lengths = words[3 * n_rules + n_symbols :].astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, 24 + 4 * len(words))
        self._ends: np.ndarray | None = None

    def ids(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.base, self.rule_lengths)

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; other symbols are not expanded."""
        if self._ends is None:
            size = np.ones(len(self.sequence), np.int64)
            high = self.sequence >= self.base
            size[high] = self.rule_lengths[self.sequence[high] - self.base]
            self._ends = np.cumsum(size)
        first = int(np.searchsorted(self._ends, start, "right"))
        last = int(np.searchsorted(self._ends, stop, "left")) + 1
        before = int(self._ends[first - 1]) if first else 0
        return expand(self.sequence[first:last], self.rules, self.base, self.rule_lengths)[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        start = int(self.doc_lengths[:k].sum())
        return self.decode_range(start, start + int(self.doc_lengths[k]))


def pack(doc_ids: list[int | None], docs: list[np.ndarray], base: int) -> tuple[bytes, int]:
    """(payload, number of ids) of a shard; documents without an id come first."""
    return pack_flat(doc_ids, np.concatenate(docs), [len(d) for d in docs], base)


def pack_flat(doc_ids: list[int | None], ids: np.ndarray, doc_lengths: list[int], base: int) -> tuple[bytes, int]:
    """The same for documents side by side."""
    import zstandard

    rules, sequence = repair(ids, base)
    lengths = expansion_lengths(rules, base)
    words = np.concatenate([rules.ravel(), lengths, sequence, doc_lengths]).astype("<u4")
    counts = (base, len(rules), len(sequence), len(doc_lengths), doc_ids.count(None))
    raw = MAGIC + struct.pack("<5I", *counts) + words.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw), len(ids)


# Spark ---------------------------------------------------------------------------------

_SHARD = "part int, shard int, first_id long, last_id long, n_docs long, n_tokens long, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 19, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes docs and writes the files of ``path``; ids of documents are whole numbers."""
    rows = pick(docs, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        base = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = shard = 0

        def packed() -> pa.RecordBatch:
            payload, n = pack_flat(names, np.concatenate(held), lengths, base)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "first_id": pa.array([names[0]], pa.int64()), "last_id": pa.array([names[-1]], pa.int64()), "n_docs": [len(names)], "n_tokens": [n], "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                ids, counts = encoder.encode_all(piece["text"])
                counts += 1
                ends = np.cumsum(counts)
                whole, is_id = np.empty(len(ids) + len(counts), "<u4"), np.ones(len(ids) + len(counts), bool)
                is_id[ends - 1] = False
                whole[is_id], whole[ends - 1] = ids, end_id
                own, first = piece["id"].to_pylist(), 0
                while first < len(own):
                    before = int(ends[first - 1]) if first else 0
                    # up to the document with which the shard is full
                    last = min(int(np.searchsorted(ends, before + shard_tokens - size)), len(own) - 1)
                    names += own[first : last + 1]
                    lengths += counts[first : last + 1].tolist()
                    held.append(whole[before : int(ends[last])])
                    size += len(held[-1])
                    first = last + 1
                    if size >= shard_tokens:
                        yield packed()
                        names, lengths, held, size, shard = [], [], [], 0, shard + 1
        if names:
            yield packed()

    # rows that share an id, or have none, are dealt out by their texts
    keyed = rows.select("id", F.xxhash64("text").alias("h"), "text")
    ordered = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    ordered.mapInArrow(run, _SHARD).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``path``."""
    shards = spark.read.schema(_SHARD).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = Window.partitionBy("part").orderBy("shard")
    starts = shards.select("part", "shard", "n_tokens").join(before, "part").select("part", "shard", (F.col("before") + F.sum("n_tokens").over(at) - F.col("n_tokens")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch["start"].to_pylist(), batch["payload"], strict=True):
                shard = Shard(payload.as_py())
                ids = shard.ids()
                ends = np.cumsum(shard.doc_lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - shard.doc_lengths).tolist(), ends.tolist(), strict=True)]
                names = pa.array(shard.doc_ids, mask=np.arange(len(shard.doc_ids)) < shard.nameless)
                yield pa.RecordBatch.from_arrays([names, pa.array(start + ends - shard.doc_lengths), pa.array(shard.doc_lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = shards.join(starts, ["part", "shard"]).select("start", "payload")
    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 19) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path, end_id, shard_tokens)
    return read_token_files(docs.sparkSession, path)
