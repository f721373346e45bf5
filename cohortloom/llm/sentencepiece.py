"""SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces and scores of a SentencePiece model are read as a unigram lexicon: the encoding of a
text is the sequence of pieces with the largest sum of scores, characters without a piece
become byte pieces. (The vocabulary file at hand was made for merging; its own library, told
to read the model as a unigram model, gives the same ids where its 32-bit sums are exact, and the
tests hold them together.) The search reads characters one by one and keeps back pointers for a window only:
where no piece crosses a boundary, all surviving paths meet there and their ids are committed; if
pieces keep crossing, the surviving paths are followed back to the boundary that they share.

A model whose pieces hold the blank only at their start can't cross into a new word, so the search commits at every
word's end, and what it commits for a word is remembered (for a bounded number of words): each word is searched once.

Defined cases: a null or empty text has no ids; decoding turns byte pieces that are no UTF-8
into U+FFFD; a text that itself holds U+2581 decodes with spaces in its place; null ids are kept; rows that repeat each get a result; a very long
text is searched in time in proportion to it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Added to the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that normalise are not supported")
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.unknown_score = min((p.score for p in m.pieces if p.type == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.max_piece = max(map(len, self.ids), default=1)
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.words_apart = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        #: Two characters side by side in a piece; between others no piece crosses.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.singles = {p for p in self.ids if len(p) == 1}
        #: Character by character: [further characters, id, score] of each prefix of a piece.
        self.trie: dict = {}
        for piece, (number, score) in self.ids.items():
            level, node = self.trie, None
            for char in piece:
                node = level.setdefault(char, [{}, -1, 0.0])
                level = node[0]
            node[1:] = number, score
        #: What a piece says if it is no part of a longer UTF-8 sequence.
        self.said = [chr(self.byte_of[i]) if k == BYTE and self.byte_of[i] < 128 else "" if k in (CONTROL, BYTE) else " \u2047 " if k == UNKNOWN else p for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.high = np.array([k == BYTE and self.byte_of[i] >= 128 for i, k in enumerate(self.kinds)])

    def unknown_ids(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]


def viterbi(model: Model, chars: Iterable[str], window: int | None = None) -> Iterator[list[int]]:
    """Lists of ids, each as soon as it is certain. Ties go to the longer last piece.

    Ids are committed up to a boundary that no piece crosses, or on which all surviving paths converge; the latter is looked for when the open stretch has
    grown to the window, and again each time it has doubled, so the work is linear in the text. Back pointers (20 bytes a character) reach from the last
    committed boundary on: a few times the longest piece in most texts, but as far as the stretch over which no two paths converge (a run of one
    character, whose pieces can be shifted against each other, is one such stretch however long it is).
    """
    longest, unknown = model.max_piece, model.unknown_score
    limit = max(window or 4 * longest, longest + 1)
    source = iter(chars)
    text = "".join(islice(source, limit))
    more = len(text) == limit
    if not more:  # all of it lies in the window
        if text:
            yield _searched(model, text)
        return
    never = float("-inf")
    best = [0.0] + [never] * len(text)  # by boundary
    back, piece = [0] * len(best), [-1] * len(best)  # by boundary: where its last piece starts, and its id
    # what may grow long is held in arrays, which are smaller and slower
    best, back, piece = array("d", best), array("q", back), array("i", piece)
    at = reach = done = 0
    n, trial = len(text), limit
    while True:
        if more and n < at + longest:  # what a piece from here may hold
            want = max(limit, n - done)  # a long open stretch is read by its own length, so it is copied few times
            got = "".join(islice(source, want))
            more = len(got) == want
            if done >= limit:
                base = best[done]
                text, best, piece = text[done:], array("d", [x - base for x in best[done:]]), piece[done:]
                back = array("q", [max(k - done, 0) for k in back[done:]])
                at, reach, done = at - done, reach - done, 0
            text += got
            best.extend([never] * len(got))
            back.extend([0] * len(got))
            piece.extend([-1] * len(got))
            n = len(text)
        if at >= n:
            if at > done:
                yield _committed(model, text, back, piece, done, at)
            return
        here = best[at]
        if here != never:
            level, single = model.trie, False
            for end in range(at, n):
                node = level.get(text[end])
                if node is None:
                    break
                level, number, score = node
                if number >= 0:
                    single |= end == at
                    score += here
                    if score > best[end + 1]:
                        best[end + 1], back[end + 1], piece[end + 1] = score, at, number
                    if end >= reach:
                        reach = end + 1
            if not single:
                score = here + unknown
                if score > best[at + 1]:
                    best[at + 1], back[at + 1], piece[at + 1] = score, at, -1
                reach = max(reach, at + 1)
        at += 1
        if reach == at:  # no piece crosses this boundary
            meet = at
        elif at - done >= trial:
            meet = _meeting(best, back, at, reach)
            trial = max(limit, 2 * (at - meet))
        else:
            continue
        if meet > done:
            yield _committed(model, text, back, piece, done, meet)
            done = meet
            if meet == at:
                trial = limit


def _searched(model: Model, text: str) -> list[int]:
    """The ids of a text that fits the window: the same search, followed back once from its end, where all paths meet."""
    trie, singles, longest, unknown, never = model.trie, model.singles, model.max_piece, model.unknown_score, float("-inf")
    n = len(text)
    best, back, piece = [0.0] + [never] * n, [0] * (n + 1), [-1] * (n + 1)
    for at, here in enumerate(best):  # filled ahead of at
        if here == never or at == n:
            continue
        level, end = trie, at
        for char in text[at : at + longest]:
            node = level.get(char)
            if node is None:
                break
            level, number, score = node
            end += 1
            if number >= 0:
                score += here
                if score > best[end]:
                    best[end] = score
                    back[end] = at
                    piece[end] = number
        if text[at] not in singles and here + unknown > best[at + 1]:
            best[at + 1], back[at + 1], piece[at + 1] = here + unknown, at, -1
    out, end = [], n
    while end:
        start, number = back[end], piece[end]
        if number >= 0:
            out.append(number)
        else:
            out.extend(reversed(model.unknown_ids(text[start:end])))
        end = start
    out.reverse()
    return out


def _meeting(best: Sequence[float], back: Sequence[int], at: int, reach: int) -> int:
    """The last boundary on the paths to every boundary that can still be continued."""
    alive = {b for b in range(at, reach + 1) if best[b] > float("-inf")}
    while len(alive) > 1:
        last = max(alive)
        alive.remove(last)
        alive.add(back[last])
    return min(alive.pop(), at)


def _committed(model: Model, text: str, back: Sequence[int], piece: Sequence[int], first: int, end: int) -> list[int]:
    """The ids from one committed boundary to the next."""
    out: list[list[int]] = []
    while end > first:
        start, number = back[end], piece[end]
        out.append([number] if number >= 0 else model.unknown_ids(text[start:end]))
        end = start
    return [i for part in reversed(out) for i in part]


#: Longer words are encoded like others but not remembered.
LONG_WORD = 256
#: Blanks stay with what follows.
_words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall


class Encoder:
    """Encodes texts; remembers the committed ids of at most 2 * max_words words.

    All paths meet at a boundary that no piece crosses, so what the search commits before it depends on nothing after it
    and can be remembered: words, if blanks stand at the start of pieces alone, and words without their last character if no piece holds it with the one before.
    """

    def __init__(self, model: Model, max_words: int = 120_000) -> None:
        self.model, self.max_words = model, max_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _stream(self, text: str) -> bytes:
        if len(text) < 4 * self.model.max_piece:  # as viterbi would
            return array("I", _searched(self.model, text)).tobytes()
        return array("I", chain.from_iterable(viterbi(self.model, text))).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word not lately met."""
        ids = self.old.get(word)
        if ids is None and len(word) > 2 and word[-2:] not in self.model.pairs:  # a boundary that all paths share
            points = len(word) - 1
            while points > 2 and word[points - 2 : points] not in self.model.pairs:
                points -= 1
            head = word[:points]
            ids = (self.young.get(head) or self._word(head)) + b"".join([self.young.get(c) or self._word(c) for c in word[points:]])
        elif ids is None:
            ids = self._stream(word)
        if len(word) <= LONG_WORD:
            if len(self.young) >= self.max_words:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        text = text.replace(" ", BLANK)
        if self.model.dummy_prefix:
            text = BLANK + text
        if not self.model.words_apart:
            return np.frombuffer(self._stream(text), "<u4")
        return np.frombuffer(b"".join([self.young.get(w) or self._word(w) for w in _words(text)]), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        m, ids = self.model, np.asarray(ids, np.int64)
        high = m.high[ids]
        said = list(map(m.said.__getitem__, ids.tolist()))
        if high.any():
            n = len(said)
            for at in np.flatnonzero(high & ~np.concatenate([[False], high[:-1]])).tolist():
                end = at
                while end < n and high[end]:
                    end += 1
                said[at] = bytes(m.byte_of[i] for i in ids[at:end].tolist()).decode("utf-8", "replace")
        text = "".join(said).replace(BLANK, " ")
        return text[1:] if m.dummy_prefix and text.startswith(" ") else text


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, max_words: int = 120_000) -> Encoder:
    """One for each Python worker."""
    if (path, max_words) not in _ENCODERS:
        _ENCODERS[path, max_words] = Encoder(Model(path), max_words)
    return _ENCODERS[path, max_words]


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", max_words: int = 120_000) -> DataFrame:
    """id, n_ids, ids, round_trip (whether decoding gives the text) for every row. max_words bounds what a worker remembers, not the result."""
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, max_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                ids = [own.encode(t) for t in texts]
                same = [own.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(same, pa.bool_())], names=["id", "n_ids", "ids", "round_trip"])

    return rows.mapInArrow(encode, f"id {kind}, n_ids long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id, text for every row."""
    rows = pick(encoded, id=id_column, ids=ids_column)
    kind = rows.schema["id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            texts = [own.decode(i or []) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_column)
