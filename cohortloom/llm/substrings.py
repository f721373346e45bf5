"""Repeated substrings across documents, by suffix arrays of partitioned text.

Text can only repeat where its samples repeat. Every string of ``length`` bytes has a sample, its
minimiser: of its grams of ``GRAM`` bytes the one of smallest hash. The stretch of text whose strings share
one minimiser is a segment; equal strings have equal minimisers, so segments dealt out by minimiser bring all occurrences
of a string to one task.

1. Samples (hash, document, position) are dealt out by hash; those of one document only are dropped. Within a task's batch a
   hash of several documents is known to repeat and one sample of it, with their number, stands for all, so a
   passage that a third of all documents share is one row a batch. Samples met over ``hot`` times are hot; at most
   ``MOST_HOT`` can be, whatever the input, and these are broadcast.
2. Segments of repeated samples are dealt out by hash. Of equal segments in a batch the one of the smallest
   document goes on, the others are removable as they are. Segments of hot samples are cut to their single strings, which are dealt
   out by themselves and by tasks, so no task gets all that share a hot sample.
3. A task reads a bucket in runs of bounded size (a run holds whole minimisers) and builds the enhanced suffix array of
   each: suffixes in order and common-prefix lengths. A stack scan
   yields the tree of common-prefix intervals; an interval of ``length`` bytes or more whose occurrences have different left neighbours (or
   start a segment) is a maximal repeat group, given with all its occurrences.
4. Bytes of an occurrence are removable as far as its deepest group with a smaller document reaches.
   Exact copies of a whole text are removable whole and don't take part. What is left of hot strings after step 3, one
   document a bucket, meets its least document by a summed minimum and a join.

Texts shuffle once, by row, for the segments and for the texts that remain (one exchange, read twice).

Defined cases: a null text is empty; rows that share an id don't count as earlier for each other, whatever their texts; rows with
a null id are neither judged nor do they count as earlier (their texts stay whole); rows that repeat id and text get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick, text_of, written

GRAM = 24
#: Buckets at least, for tasks to share; a document's spans come from as many buckets at most.
MIN_BUCKETS = 64
#: Bytes of text handled at a time.
BATCH = 1 << 22
#: Distinct segments of a bucket whose suffixes are sorted at a time.
RUN = 1 << 14
#: Samples met more often than this are hot, if that makes at most MOST_HOT of them; else the bound is higher.
HOT, MOST_HOT = 2048, 1 << 20
#: Tasks whose hot strings meet in one bucket.
HOT_TASKS = 32
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_PLACE_BITS = np.uint64(0x3FFFF)


# bytes side by side -----------------------------------------------------------------------


def _joined(texts: list[bytes], padding: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes and zeros after them, starts, sizes)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts) + b"\0" * (padding + 32), np.uint8), np.cumsum(sizes) - sizes, sizes


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, little-endian."""
    return np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of runs of equal keys in it)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _word(words: np.ndarray, at: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes k to k + 8 of strings, zero beyond their sizes."""
    x = words[at + k]
    room = size - k
    if len(room) and room.min() < 8:
        x = x & np.where(room >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.clip(room, 0, 7)).astype(np.uint64)) - np.uint64(1))
    return x


def _codes(words: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string."""
    code = size.astype(np.uint64) * _M2
    for k in range(0, width, 8):
        code = (code ^ _word(words, at, size, k)) * _M1
        code ^= code >> np.uint64(31)
    return code


def _equal(words: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of runs of equal strings in it): by hash, and by the bytes if two strings share a hash."""
    order, first = _groups(_codes(words, at, size, width))
    inner = np.ones(len(order), bool)
    inner[first] = False
    a, b = order[np.flatnonzero(inner) - 1], order[inner]
    if (size[a] == size[b]).all() and all((_word(words, at[a], size[a], k) == _word(words, at[b], size[b], k)).all() for k in range(0, width, 8)):
        return order, first
    return _groups(size, *(_word(words, at, size, k) for k in range(0, width, 8)))


def _spread(first: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that each of n places belongs to."""
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))


def _expanded(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, first[which] + 0, 1, ... counts[which] - 1)."""
    which = np.repeat(np.arange(len(first)), counts)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _gram_hashes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of grams from their three words."""
    h = a * _M1
    h ^= h >> np.uint64(29)
    h += b
    h *= _M2
    h ^= h >> np.uint64(32)
    h += c
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


def minimisers(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, gram, first string, last string, text) of the runs of strings that share a minimiser, in order; places are those in raw.

    raw holds texts side by side; no string goes across two of them.
    """
    words, n = _words(raw), int(sizes.sum()) - length + 1
    whole = np.flatnonzero(sizes >= length)
    if not len(whole):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    inside = np.zeros(n, bool)
    for a, b in zip(starts[whole].tolist(), (starts[whole] + sizes[whole] - length + 1).tolist(), strict=True):
        inside[a:b] = True
    span = length - GRAM + 1  # grams in a string
    place = np.empty(n, np.int64)
    step = 1 << 17  # arrays that fit a cache
    for at in range(0, n, step):
        m = min(step, n - at)
        t = m + span - 1
        h = _gram_hashes(words[at : at + t], words[at + 8 : at + 8 + t], words[at + 16 : at + 16 + t])
        key = (h & ~_PLACE_BITS) | np.arange(t, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        place[at : at + m] = (key[:m] & _PLACE_BITS).astype(np.int64) + at
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    text = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, starts[text] + sizes[text] - length)
    gram = place[first]
    return _gram_hashes(words[gram], words[gram + 8], words[gram + 16]), gram, first, last, text


# rows of numbers ----------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Columns of numbers, as differences in bytes of equal weight, compressed."""
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    parts = [c.compress(np.ascontiguousarray(np.diff(a.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes()) for a in arrays]
    return len(arrays[0]).to_bytes(8, "little") + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    d = zstandard.ZstdDecompressor()
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        raw = d.decompress(blob[at + 8 : at + 8 + size], max_output_size=8 * n) if n else b""
        out.append(np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).ravel()))
        at += 8 + size
    return out


def _merged(starts: np.ndarray, ends: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of numbered owners without overlaps, by owner and start."""
    order = np.lexsort((starts, whose))
    shift = whose[order] << 32
    a, reach = starts[order] + shift, np.maximum.accumulate(ends[order] + shift)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    k = np.flatnonzero(new)
    owner = whose[order][k]
    return a[k] - (owner << 32), reach[np.append(k[1:] - 1, len(a) - 1)] - (owner << 32) if len(k) else reach, owner


def _span_rows(ids: np.ndarray, turns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, turns, spans) of the rows that have spans; spans as pairs of unsigned 32-bit numbers."""
    order, first = _groups(ids, turns)
    whose = np.empty(len(ids), np.int64)
    whose[order] = _spread(first, len(ids))
    a, b, owner = _merged(starts, ends, whose)
    pairs = np.stack([a, b], 1).astype("<u4")
    cut = np.searchsorted(owner, np.arange(len(first) + 1)).tolist()
    return ids[order[first]], turns[order[first]], [pairs[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows as tuples, about BATCH bytes of text at a time; the last column is the text."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                held.append((*row[:-1], (row[-1] or "").encode("utf-8", "surrogatepass")))
                size += len(held[-1][-1])
                if size >= BATCH:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _short(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A sample as bucket and 32 bits of its hash."""
    return (bucket << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


# step 1 ---------------------------------------------------------------------------------------

_SAMPLES = "bucket int, hashes binary, blob binary"
_PLACES = "id long, turn long, places binary, hot binary"


def _sampler(length: int, buckets: int):
    """Blobs of (id, turn, place, number) a bucket; blobs without hashes hold samples that are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            raw, starts, sizes = _joined([r[-1] for r in rows], length)
            h, gram, _, _, text = minimisers(raw, starts, sizes, length)
            if not len(h):
                continue
            ids, turns = (np.array([r[k] for r in rows], np.int64)[text] for k in (0, 1))
            place = gram - starts[text]
            order, first = _groups(h)
            several = np.minimum.reduceat(ids[order], first) != np.maximum.reduceat(ids[order], first)
            counts = np.diff(np.append(first, len(h)))
            known = np.empty(len(h), bool)
            known[order] = np.repeat(several, counts)
            speaks, number = ~known, np.ones(len(h), np.int64)
            speaks[order[first[several]]] = True
            number[order[first[several]]] = counts[several]
            where = _bucket_of(h, buckets)
            out: list[tuple] = []
            if known.any():
                out.append((int(where[known][0]), b"", _packed(ids[known], turns[known], place[known])))
            k = np.flatnonzero(speaks)
            k = k[np.argsort(where[k], kind="stable")]
            for part in np.split(k, np.flatnonzero(np.diff(where[k])) + 1):
                out.append((int(where[part[0]]), (h[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), _packed(ids[part], turns[part], place[part], number[part])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2))], names=["bucket", "hashes", "blob"])

    return run


def _repeated(most: int):
    """A bucket: places of samples that occur in several documents, a row a document; and the samples met over ``most`` times."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        hashes, told = [np.zeros(0, "<u4")], [[none] * 4]
        known = [[none] * 3]
        for raw, blob in zip(group["hashes"], group["blob"], strict=True):
            if len(raw):
                hashes.append(np.frombuffer(raw, "<u4"))
                told.append(_unpacked(blob))
            else:
                known.append(_unpacked(blob))
        h, (ids, turns, places, number) = np.concatenate(hashes), (np.concatenate(x) for x in zip(*told, strict=True))
        hot = b""
        if len(h):
            order, first = _groups(h)
            counts = np.diff(np.append(first, len(h)))
            own = ids[order]
            met = np.add.reduceat(number[order], first)
            several = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | ((counts > 1) & (met > counts))
            many = order[np.repeat(several, counts)]
            known.append([ids[many], turns[many], places[many]])
            hot = h[order[first[met > most]]].astype("<u4").tobytes()
        ids, turns, places = (np.concatenate(x) for x in zip(*known, strict=True))
        order, first = _groups(ids, turns)
        out = {"id": ids[order][first], "turn": turns[order][first], "places": [x.astype("<u4").tobytes() for x in np.split(places[order], first[1:])] if len(ids) else [], "hot": None}
        table = pd.DataFrame(out, columns=["id", "turn", "places", "hot"])
        if hot:
            table = pd.concat([table.astype(object), pd.DataFrame({"id": [int(group["bucket"].iloc[0])], "turn": [0], "places": [None], "hot": [hot]}, dtype=object)])
        return table

    return run


# step 2 ---------------------------------------------------------------------------------------

_SEGMENTS = "bucket long, texts binary, sizes binary, subs binary, blob binary, removed_id long, removed_turn long, removed binary"


def _segmenter(length: int, buckets: int, hot):
    """For each bucket the distinct segments with (segment, id, turn, offset) of each occurrence; and what is removable already.

    Strings of hot samples go to buckets of negative numbers.
    """
    width = -(-(2 * length - GRAM) // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        c, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        for rows in _chunks(batches):
            raw, starts, sizes = _joined([r[-1] for r in rows], width)
            h, gram, first, last, text = minimisers(raw, starts, sizes, length)
            if not len(h):
                continue
            wanted = np.zeros(len(raw), bool)
            for start, r in zip(starts.tolist(), rows, strict=True):
                wanted[np.frombuffer(b"".join(r[2]), "<u4").astype(np.int64) + start] = True
            k = np.flatnonzero(wanted[gram])
            bucket = _bucket_of(h[k], buckets)
            is_hot = np.isin(_short(h[k], bucket), hot.value)
            cold = k[~is_hot]
            at, size, whose, bucket, sub = first[cold], last[cold] - first[cold] + length, text[cold], bucket[~is_hot], h[cold] & np.uint64(0xFFFF)
            words = _words(raw)
            if is_hot.any():
                k = k[is_hot]
                which, strings = _expanded(first[k], last[k] - first[k] + 1)
                n = np.full(len(strings), length, np.int64)
                code = _codes(words, strings, n, -(-length // 8) * 8)
                home = -1 - (_bucket_of(code, buckets) + part // HOT_TASKS * buckets)
                at, size, whose, bucket, sub = (np.concatenate(x) for x in ((at, strings), (size, n), (whose, text[k][which]), (bucket, home), (sub, code & np.uint64(0xFFFF))))
            if not len(at):
                continue
            ids, turns = (np.array([r[j] for r in rows], np.int64)[whose] for j in (0, 1))
            order, run_of = _equal(words, at, size, width)
            least = np.minimum.reduceat(ids[order], run_of)
            number = np.empty(len(at), np.int64)
            number[order] = _spread(run_of, len(at))
            goes = ids > least[number]
            out = {name: [] for name in ("bucket", "texts", "sizes", "subs", "blob", "removed_id", "removed_turn", "removed")}
            if goes.any():
                local = at[goes] - starts[whose[goes]]
                for one in zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in _span_rows(ids[goes], turns[goes], local, local + size[goes])), strict=True):
                    for name, value in zip(out, (one[0] % buckets, None, None, None, None, *one), strict=True):
                        out[name].append(value)
            # distinct segments by bucket, and the occurrences in their least document
            face = order[run_of]
            by_bucket = np.argsort(bucket[face], kind="stable")
            rank = np.empty(len(face), np.int64)
            rank[by_bucket] = np.arange(len(face))
            own = np.flatnonzero(~goes)
            own = own[np.argsort(rank[number[own]], kind="stable")]
            own_rank = rank[number[own]]
            face = face[by_bucket]
            cuts = np.append(np.flatnonzero(np.diff(bucket[face], prepend=np.iinfo(np.int64).min)), len(face))
            own_cuts = np.searchsorted(own_rank, cuts)
            begins, ends = at[face].tolist(), (at[face] + size[face]).tolist()
            view = raw.data
            for i, j, a, b in zip(cuts.tolist(), cuts[1:].tolist(), own_cuts.tolist(), own_cuts[1:].tolist(), strict=False):
                f, o = face[i:j], own[a:b]
                blob = _packed(own_rank[a:b] - i, ids[o], turns[o], at[o] - starts[whose[o]])
                joined = b"".join([view[x:y] for x, y in zip(begins[i:j], ends[i:j], strict=True)])
                for name, value in zip(out, (int(bucket[f[0]]), c.compress(joined), size[f].astype("<u2").tobytes(), sub[f].astype("<u2").tobytes(), blob, 0, 0, None), strict=True):
                    out[name].append(value)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=[*out])

    return run


# steps 3 and 4 ------------------------------------------------------------------------------------


class RepeatGroups:
    """Maximal repeats among strings, by the interval tree of their enhanced suffix array."""

    def __init__(self, segments: list[bytes], length: int) -> None:
        sizes = np.array([len(s) for s in segments], np.int64)
        width = -(-int(sizes.max(initial=length)) // 8) * 8
        raw, starts, sizes = _joined(segments, width)
        self._build(raw, starts, sizes, length, width, None)

    @classmethod
    def of(cls, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, width: int, least: np.ndarray) -> RepeatGroups:
        """Of strings in raw; repeats that stand in strings of one ``least`` document alone are left out."""
        tree = cls.__new__(cls)
        tree._build(raw, starts, sizes, length, width, least)
        return tree

    def _build(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, width: int, least: np.ndarray | None) -> None:
        """Keeps the suffixes whose first ``length`` bytes occur twice, with different left neighbours or at the start of a segment."""
        words = _words(raw)
        which, at = _expanded(starts, np.maximum(sizes - length + 1, 0))
        offset = at - starts[which]
        keep = np.zeros(0, np.int64)
        if len(at):
            order, first = _groups(_codes(words, at, np.full(len(at), length, np.int64), -(-length // 8) * 8))
            # the left neighbour; a segment's start differs from all
            left = np.where(offset == 0, 256 + which, raw[at - 1])[order]
            sizes_of = np.diff(np.append(first, len(order)))
            worth = (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)) & (sizes_of > 1)
            if least is not None:
                own = least[which][order]
                worth &= np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            keep = np.sort(order[np.repeat(worth, sizes_of)])
        self.segment, self.offset, at = which[keep], offset[keep], at[keep]
        self.left = np.where(self.offset == 0, -1 - self.segment, raw[at - 1])
        room = sizes[self.segment] - self.offset
        big = [_word(words, at, room, k).byteswap() for k in range(0, width, 8)]
        order = np.lexsort([room, *reversed(big)])
        self.segment, self.offset, self.left, room = (x[order] for x in (self.segment, self.offset, self.left, room))
        common = np.full(max(len(order) - 1, 0), width, np.int64)
        for k in range(len(big) - 1, -1, -1):  # the first word that differs decides
            x = big[k][order]
            apart = x[1:] ^ x[:-1]
            differs = apart != 0
            # bytes alike at its start: zero bytes at the top
            alike = sum(((apart >> np.uint64(8 * b)) == 0).astype(np.int64) for b in range(1, 8))
            common[differs] = 8 * k + alike[differs]
        self.common = np.minimum(common, np.minimum(room[1:], room[:-1]))

    def groups(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(common length, first, end) in suffix order of the maximal groups, inner ones before outer ones.

        A stack holds the open intervals; one closes where the common prefix falls below its own.
        Its occurrences are a maximal repeat if they can't all be extended by one byte to the left.
        """
        left = self.left.tolist()
        blocks = np.flatnonzero(self.common >= length)
        for block in np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1) if len(blocks) else []:
            lo, hi = int(block[0]), int(block[-1]) + 2
            stack: list[list] = []  # [common length, first, left neighbour of all or None]
            for i, lcp in zip(range(lo + 1, hi + 1), [*self.common[lo : hi - 1].tolist(), 0], strict=True):
                first, side = i - 1, left[i - 1]
                while stack and stack[-1][0] > lcp:
                    deep, start, own = stack.pop()
                    own = own if own == side else None
                    if own is None:
                        yield deep, start, i
                    first, side = start, own
                if lcp >= length:
                    if stack and stack[-1][0] == lcp:
                        if stack[-1][2] != side:
                            stack[-1][2] = None
                    else:
                        stack.append([lcp, first, side])

    def reach(self, length: int, least: np.ndarray) -> np.ndarray:
        """For each suffix how many of its bytes the deepest group with a smaller document covers; 0 without one."""
        own = least[self.segment]
        out = np.zeros(len(own), np.int64)
        for deep, lo, hi in self.groups(length):
            part, got = own[lo:hi], out[lo:hi]
            got[(part > part.min()) & (got == 0)] = deep  # inner groups came first
        return out


_REMOVABLE = "id long, turn long, spans binary, string binary, at long"


def _removable(length: int):
    """A bucket: spans of documents that earlier ones repeat; of a bucket of hot strings also these (string), once for each of their least documents here."""
    width = -(-(2 * length - GRAM) // 8) * 8

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        d = zstandard.ZstdDecompressor()
        hot = int(group["bucket"].iloc[0]) < 0
        raws, size, sub, told, n = [], [], [], [], 0
        passed = []
        for texts, sizes, subs, blob, the_id, turn, removed in zip(*(group[c] for c in ("texts", "sizes", "subs", "blob", "removed_id", "removed_turn", "removed")), strict=True):
            if removed is not None:
                passed.append((int(the_id), int(turn), removed))
                continue
            raws.append(d.decompress(texts))
            size.append(np.frombuffer(sizes, "<u2"))
            sub.append(np.frombuffer(subs, "<u2"))
            which, *rest = _unpacked(blob)
            told.append((which + n, *rest))
            n += len(size[-1])
        found = [[np.zeros(0, np.int64)] * 4]
        strings: list[tuple] = []
        if n:
            raw, starts, _ = _joined(raws, width)
            del raws
            size, sub = np.concatenate(size).astype(np.int64), np.concatenate(sub)
            starts = np.cumsum(size) - size
            which, ids, turns, places = (np.concatenate(x) for x in zip(*told, strict=True))
            place_of = np.searchsorted(which, np.arange(n + 1))  # which ascends
            order = np.argsort(sub, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(sub[order].astype(np.int64), prepend=-1)), n)
            words, at = _words(raw), 0
            while at < n:
                end = int(edges[np.searchsorted(edges, min(at + RUN, n), "left")])
                some = order[at:end]
                at = end
                same, first = _equal(words, starts[some], size[some], width)
                distinct = _spread(first, len(some))
                segment, occurrence = _expanded(place_of[some[same]], place_of[some[same] + 1] - place_of[some[same]])
                of = distinct[segment]  # ascending
                least = np.minimum.reduceat(ids[occurrence], np.searchsorted(of, np.arange(len(first))))
                goes = ids[occurrence] > least[of]
                o = occurrence[goes]
                found.append([ids[o], turns[o], places[o], places[o] + size[which[o]]])
                own, own_of = occurrence[~goes], of[~goes]
                face = some[same[first]]
                if hot:
                    strings += [(i, t, None, raw[a : a + length].tobytes(), p) for i, t, a, p in zip(ids[own].tolist(), turns[own].tolist(), starts[face][own_of].tolist(), places[own].tolist(), strict=True)]
                    continue
                tree = RepeatGroups.of(raw, starts[face], size[face], length, width, least)
                deep = tree.reach(length, least)
                done = np.flatnonzero(deep)
                if len(done):
                    begin = np.searchsorted(own_of, tree.segment[done])
                    suffix, k = _expanded(begin, np.searchsorted(own_of, tree.segment[done], "right") - begin)
                    o, a = own[k], tree.offset[done][suffix]
                    found.append([ids[o], turns[o], places[o] + a, places[o] + a + deep[done][suffix]])
        out = [*zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in _span_rows(*(np.concatenate(x) for x in zip(*found, strict=True)))), strict=True)]
        rows = [(i, t, s, None, None) for i, t, s in passed + out] + strings
        return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=object) for k, name in enumerate(("id", "turn", "spans", "string", "at"))})

    return run


def _cut(text: bytes, spans: list[bytes]) -> tuple[int, int, bytes]:
    """(bytes removed, removed runs, what stays)."""
    if not spans:
        return 0, 0, text
    pairs = np.frombuffer(b"".join(spans), "<u4").astype(np.int64).reshape(-1, 2)
    starts, ends, _ = _merged(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return int((ends - starts).sum()), len(starts), b"".join(kept)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            out: list[tuple] = []
            for text, copy, spans in zip(piece["text"].to_pylist(), piece["copy"].to_pylist(), piece["spans"].to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                removed, n, kept = (len(raw), 1, b"") if copy else _cut(raw, spans or [])
                out.append((len(raw), removed, n, sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([piece["id"], *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, bucket_bytes: int = 1 << 23, keep_text: bool = False, hot: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for every row; ids are whole numbers.

    hot: samples met more often are hot; by default HOT, or more where that could make over MOST_HOT.
    """
    if not GRAM + 8 <= length <= 1 << 14:
        raise ValueError(f"strings must have {GRAM + 8} to {1 << 14} bytes")
    spark = docs.sparkSession
    rows = pick(docs, id=id_column, text=text_column).select("id", text_of().alias("text"))
    named = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    hashed = named.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n"))
    first, _ = written(hashed.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("n").alias("n")), "first-copies")
    total = first.agg(F.sum("n")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    # rows that share an id with another text are told apart by a hash of theirs
    shared, _ = written(hashed.groupBy("id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("id", F.lit(True).alias("shared")), "shared-ids")
    turn = F.when(F.col("shared"), F.col("h1")).otherwise(F.lit(0)).alias("turn")
    known = named.join(shared, "id", "left").withColumn("h1", F.when(F.col("shared"), F.xxhash64("text"))).select("id", turn, "text")
    copies = hashed.join(first.where("first < last").select("h1", "h2", "first"), ["h1", "h2"]).where(F.col("id") > F.col("first")).where(F.col("n") >= length)
    copies, _ = written(copies.join(shared, "id", "left").select("id", turn, F.lit(True).alias("copy")).distinct(), "whole-copies")
    most = max(HOT if hot is None else hot, -(-total // MOST_HOT))  # a sample takes more than one byte
    samples = known.mapInArrow(_sampler(length, buckets), _SAMPLES)
    places, places_path = written(samples.groupBy("bucket").applyInPandas(_repeated(most), _PLACES), "places")
    found = places.where("hot is not null").select("id", "hot").toArrow().to_pylist()  # MOST_HOT samples at most
    often = np.concatenate([np.zeros(0, np.int64), *((r["id"] << 32) | np.frombuffer(r["hot"], "<u4").astype(np.int64) for r in found)])
    of_row = places.where("places is not null").groupBy("id", "turn").agg(F.collect_list("places").alias("places"))
    # both joins that deal out texts are on the bare table, so that they read one exchange
    parts = known.join(of_row.join(copies, ["id", "turn"], "left_anti"), ["id", "turn"]).select("id", "turn", "places", "text")
    dealt = parts.mapInArrow(_segmenter(length, buckets, spark.sparkContext.broadcast(often)), _SEGMENTS)
    gone = dealt.groupBy("bucket").applyInPandas(_removable(length), _REMOVABLE)
    if len(often):
        gone, _ = written(gone, "removable")
        strings = gone.where("string is not null").select("id", "turn", "string", "at")
        least, _ = written(strings.groupBy("string").agg(F.min("id").alias("least")), "hot-strings")
        later = strings.join(least, "string").where(F.col("id") > F.col("least")).select("id", "turn", "at")
        # at and at + length, as two unsigned little-endian numbers
        byte = lambda c, k: F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(0xFF)), 2, "0")
        number = lambda c: F.unhex(F.concat(*[byte(c, k) for k in range(4)]))
        gone = gone.where("spans is not null").select("id", "turn", "spans").unionByName(later.select("id", "turn", F.concat(number(F.col("at")), number(F.col("at") + length)).alias("spans")))
    spans = gone.groupBy("id", "turn").agg(F.collect_list("spans").alias("spans"))
    whole = known.join(spans, ["id", "turn"], "left").join(copies, ["id", "turn"], "left").select("id", F.coalesce("copy", F.lit(False)).alias("copy"), "spans", "text")
    unknown = rows.where("id is null").select(F.col("id").cast("long").alias("id"), F.lit(False).alias("copy"), F.lit(None).cast("array<binary>").alias("spans"), "text")
    out = whole.unionByName(unknown).mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
