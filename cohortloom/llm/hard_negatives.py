"""Hard-negative mining: rows of another label whose score lies in a window below that of a positive.

Vectors are integers, a score is their inner product, higher first and ties by smaller id. Candidates are sorted by norm, longest first, and cut
to ranges of bounded size, each read in buckets. An anchor meets a bucket only if |anchor| * |longest of the bucket| (Cauchy-Schwarz) reaches its
lower limit: the lowest among its windows' lower ends, each raised to the running kth score once k are found. The range of the longest rows is searched first;
the kth scores it gives prune the other ranges before anything is moved to them, and within a range they go on rising.

Anchors and candidates meet in (block of anchors, range) groups, both of bounded size, by one shuffle; a task holds one group and a score matrix of
ROWS x BUCKET. Nothing but counts reaches the driver. Work is anchors x rows at worst (equal norms), the stated query set against all rows.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; rows that repeat another whole count once; rows
that share an id with other values are rows of their own, ties among them by a hash; shorter vectors are filled with zeros; an anchor without rows of its label gives nothing;
an empty table gives an empty result. Scores have to fit a long, else the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pick, written

#: Anchors in a block, candidates in a range (both about); anchors and candidates of one score matrix.
BLOCK_ROWS, RANGE_ROWS, ROWS, BUCKET = 4096, 16384, 256, 1024
_LEAST, _MOST = -(1 << 62), 1 << 62


def integer_vectors(rows: DataFrame, label: str | Column, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, label, v (floor of scale times each component, as double) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    vector = F.col(vector_column)
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.where(F.col(id_column).isNotNull() & label.isNotNull() & vector.isNotNull()).where(usable)
    return some.select(F.col(id_column).alias("id"), label.alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def by_norm(rows: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """key, id, label, v, norm (squared), bin: the rows in ranges of falling norm, equal norms dealt by a hash; and the number of ranges."""
    keyed = rows.select(F.xxhash64("id", "label", "v").alias("key"), "*").distinct()
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda n, x: n + x * x)
    keyed, _ = written(keyed.withColumn("norm", norm), "vectors")
    bins = max(1, -(-keyed.count() // range_rows))
    ranged = keyed.repartitionByRange(bins, F.desc("norm"), F.xxhash64("key", F.lit(1))).withColumn("bin", F.spark_partition_id())
    ranged, _ = written(ranged, "by-norm")
    return ranged, bins


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled with zeros."""
    whole = column.combine_chunks()
    ends = np.cumsum(n := whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends - n, n)] = flat
    return out


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().to_numpy(zero_copy_only=False)


def _padded(rows: list[list[int]], other: int) -> np.ndarray:
    """Rows of one length: an anchor with fewer windows has some in which nothing lies."""
    width = max(map(len, rows))
    return np.array([[*row, *[other] * (width - len(row))] for row in rows], np.int64).reshape(len(rows), width)


def _best(i: np.ndarray, w: np.ndarray, s: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of largest score, then smallest r, of each (i, w), with their places from 0."""
    order = np.lexsort((r, -s, w, i))
    i, w, s, r = i[order], w[order], s[order], r[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (w[1:] != w[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(i)) - np.repeat(starts, np.diff([*starts, len(i)]))
    top = place < k
    return i[top], w[top], s[top], r[top], place[top]


def scan(asks: pa.Table, rows: pa.Table, k: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of asks (key, label, v, norm, lo, hi): arrays of ask, window, row and score, the best k of each window within these rows."""
    width = max([0, *(int(pa.compute.max(t["v"].combine_chunks().value_lengths()).as_py() or 0) for t in (asks, rows))])
    a, c = _matrix(asks["v"], width), _matrix(rows["v"], width)
    a_norm, c_norm = (np.sqrt(_numbers(t, "norm").astype(float)) * (1 + 1e-12) for t in (asks, rows))
    most = a_norm.max() * c_norm.max()
    if most >= _MOST:
        raise OverflowError("scores don't fit a long")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # sums of either are exact below that
    lo, hi = (_padded(asks[x].to_pylist(), other) for x, other in (("lo", _MOST), ("hi", _LEAST)))
    by_id = np.lexsort((_numbers(rows, "key"), _numbers(rows, "id")))
    rank = np.empty(len(c), np.int64)
    rank[by_id] = np.arange(len(c))
    labels, keys, own_labels, own_keys = _numbers(rows, "label"), _numbers(rows, "key"), _numbers(asks, "label"), _numbers(asks, "key")
    long_first, a_order = np.argsort(-c_norm, kind="stable"), np.argsort(-a_norm, kind="stable")
    for x in range(0, len(a), ROWS):
        own = a_order[x : x + ROWS]
        low, high, vectors = lo[own], hi[own], a[own].astype(kind)
        state = tuple(np.zeros(0, np.int64) for _ in range(4))
        for y in range(0, len(c), BUCKET):
            bucket = long_first[y : y + BUCKET]
            open_ = np.flatnonzero(a_norm[own] * c_norm[bucket[0]] + 1 >= low.min(1))
            if not len(open_):
                break  # the buckets that follow are shorter still
            score = vectors[open_] @ c[bucket].astype(kind).T
            equal = own_labels[own[open_]][:, None] == labels[bucket][None, :]
            allowed = (equal if same else ~equal) & (own_keys[own[open_]][:, None] != keys[bucket][None, :])
            i, j = np.nonzero(allowed & (score >= low[open_].min(1)[:, None]) & (score <= high[open_].max(1)[:, None]))
            if not len(i):
                continue
            s, r, i = score[i, j].astype(np.int64), rank[bucket[j]], open_[i]
            found = [state]
            for w in range(low.shape[1]):
                m = (s >= low[i, w]) & (s <= high[i, w])
                found.append((i[m], np.full(m.sum(), w), s[m], r[m]))
            *state, place = _best(*map(np.concatenate, zip(*found, strict=True)), k)
            full = place == k - 1
            low[state[0][full], state[1][full]] = state[2][full]
        i, w, s, r = state
        yield own[i], w, by_id[r], s


def search(anchors: DataFrame, windows: DataFrame, ranged: DataFrame, bins: int, k: int, same: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, w, other (id), score, place (from 1): the best k rows for each window of each anchor.

    anchors: key, label, v, norm. windows: key, w, lo, hi, both ends inclusive, w from 0 without gaps. same: rows of the anchor's label or of another one.
    """
    blocks = max(1, -(-anchors.count() // block_rows))
    longest, _ = written(ranged.groupBy("bin").agg(F.max("norm").alias("longest")), "longest")
    kind = ranged.schema["id"].dataType.simpleString()

    def run(_key, asks: pa.Table, rows: pa.Table) -> pa.Table:
        names, types = ["key", "w", "other", "other_key", "score"], [pa.int64(), pa.int32(), rows.schema.field("id").type, pa.int64(), pa.int64()]
        parts = []
        if asks.num_rows and rows.num_rows:
            asks_key, ids, keys = _numbers(asks, "key"), _numbers(rows, "id"), _numbers(rows, "key")
            for a, w, c, s in scan(asks, rows, k, same):
                parts.append([asks_key[a], w, ids[c], keys[c], s])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[] for _ in names]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    found = None
    for first, last in [(0, 0), *([(1, bins - 1)] if bins > 1 else [])]:
        now = windows
        if found is not None:  # what the longest rows gave raises the lower limits
            kth = found.groupBy("key", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("key", "w", "kth")
            now = windows.join(kth, ["key", "w"], "left").select("key", "w", F.greatest("lo", "kth").alias("lo"), "hi")
        ends = now.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("w", "lo", "hi"))).alias("x")).select("key", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
        asks = anchors.join(ends, "key").withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(blocks)).cast("int"))
        asks = asks.withColumn("bin", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(longest, "bin")
        asks = asks.where(F.sqrt("norm") * F.sqrt("longest") * (1 + 1e-9) + 1 >= F.array_min("lo")).drop("longest")
        asks, _ = written(asks, "asks")
        to = asks.select(F.col("block").alias("to_block"), F.col("bin").alias("to_bin")).distinct()
        rows = ranged.join(to, F.col("bin") == F.col("to_bin")).drop("bin")
        met = asks.groupBy("block", "bin").cogroup(rows.groupBy("to_block", "to_bin")).applyInArrow(run, f"key long, w int, other {kind}, other_key long, score long")
        new, _ = written(met, "met")
        found = new if found is None else found.unionByName(new)
    place = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "other", "other_key"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("key", "w", "other", "score", "place")


def hard_negatives(vectors: DataFrame, anchor: str | Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, v (integers). anchor: a condition on them. An anchor's positives are its best other rows of its label; the negatives of
    each are the best rows of other labels with a score of low to high percent of the positive's.
    """
    ranged, bins = by_norm(pick(vectors, id="id", label="label", v="v"), range_rows)
    anchors, _ = written(ranged.where(anchor).select("key", "id", "label", "v", "norm"), "anchors")
    asks = anchors.drop("id")
    anything = anchors.select("key", F.lit(0).alias("w"), F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi"))
    best, _ = written(search(asks, anything, ranged, bins, positives, True, block_rows), "positives")
    ends = best.select("key", (F.col("place") - 1).alias("w"), *[F.expr(e).alias(n) for n, e in (("lo", f"(score * {low} + pmod(-score * {low}, 100L)) div 100"), ("hi", f"(score * {high} - pmod(score * {high}, 100L)) div 100"))])
    found = search(asks.join(ends.select("key").distinct(), "key", "left_semi"), ends, ranged, bins, negatives, False, block_rows)
    of = best.select("key", (F.col("place") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(of, ["key", "w"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
