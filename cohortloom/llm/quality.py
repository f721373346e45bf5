"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A pair holds a document of label 1 and one of label 0; the model says that the first wins with
probability sigmoid(score difference), and the weights minimise the logistic loss on the
differences of their features. The features are surface statistics of the text alone.
The raw scores are then cut at the quantile that matches the share of label 0 in the
fitting rows, and mapped by a logistic so that this cut is a score of 0.3.

The fit takes a bounded sample: at most ``max_rows`` labelled rows, those of smallest hashed id,
and all pairs of them. Their features go to the driver (max_rows * 22 numbers; of rows that repeat an id and a text one). Every document
is scored, by its whole text.

Defined cases: a null or empty text has a score like any other; labels that are null are
ignored, and of contradicting labels of one id the smaller counts; with labels of one
class or none every score is 1; rows of a null id are scored and count as held out; rows that repeat each get a score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, text_of

CUT = 0.3
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_POINTS = b".,;:!?'\"()-"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
N_FEATURES = 22


def features(text: str | None) -> list[float]:
    """Surface statistics: shares of kinds of characters, words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, k = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    lines = raw.split(b"\n")
    distinct_lines = len(set(lines)) / len(lines)
    letters = share(_LETTERS)
    upper = share(_UPPER)
    bare = sum(c for w, c in counts.items() if not w.strip(_POINTS + _SYMBOLS)) / k
    ends = sum(c for w, c in counts.items() if w[-1:] in b"!?*#$%&") / k
    stops = sum(line.rstrip()[-1:] in b".!?" for line in lines if line) / len(lines)
    sentences = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    return [
        1.0 if not words else 0.0,
        min(np.log1p(len(words)), 9.0),
        letters,
        upper / max(letters, 1e-9) if letters else 0.0,
        min(share(b"!") * 20, 2.0),
        min(share(b"|") * 20, 2.0),
        min(share(_SYMBOLS) * 10, 2.0),
        share(_POINTS),
        share(_DIGITS),
        again,
        len(counts) / k,
        np.log1p(k) * len(counts) / k,
        top / k,
        min(n / k / 10, 3.0),
        bare,
        ends,
        distinct_lines,
        min(np.log1p(n / len(lines)), 8.0),
        stops,
        min(sentences / k * 10, 3.0),
        sum(c for c in counts.values() if c > 5 and c > 0.05 * k) / k,
        sum(c * c for c in counts.values()) / (k * k),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)


def bradley_terry(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w (winner - loser))) + penalty |w|^2 / 2 over all pairs, by Newton's method.

    The sums over pairs are taken in blocks of winners, from the matrix of chances that the loser wins.
    """
    good, bad = x[y == 1], x[y == 0]
    n, w = len(good) * len(bad), np.zeros(x.shape[1])
    block = max(1, (1 << 22) // len(bad))
    for _ in range(steps):
        gradient, hessian = penalty * w, penalty * np.eye(len(w))
        for k in range(0, len(good), block):
            some = good[k : k + block]
            p = 1 / (1 + np.exp(np.clip((some @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
            gradient -= (some.T @ p.sum(1) - bad.T @ p.sum(0)) / n
            p *= 1 - p
            cross = some.T @ (p @ bad)
            hessian += ((some * p.sum(1)[:, None]).T @ some + (bad * p.sum(0)[:, None]).T @ bad - cross - cross.T) / n
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Ranker:
    """Scores texts between 0 and 1; CUT is the cut at the fitted quantile."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights = None
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._bent((x - self.mean) / self.scale)
        self.weights = bradley_terry(z, y)
        raw = z @ self.weights
        self.cut = float(np.quantile(raw, (y == 0).mean()))
        self.unit = float(max(np.subtract(*np.quantile(raw, [0.75, 0.25])), 1e-3))

    @staticmethod
    def _bent(z: np.ndarray) -> np.ndarray:
        """Each statistic and, as both ends may tell, its distance from the usual."""
        z = np.clip(z, -6, 6)
        return np.hstack([z, np.abs(z)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        raw = self._bent((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) / self.unit + np.log(CUT / (1 - CUT)), -500, 500)))


def is_held_out(the_id: Column) -> Column:
    """Never a fitting row: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(the_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Ranker:
    """A ranker from labelled rows that are not held out."""
    marked = pick(labels, id=id_column, label=label_column).where("id is not null and label is not null").where(~is_held_out(F.col("id")))
    sample = marked.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = pick(docs, id=id_column, text=text_column).join(F.broadcast(sample), "id").select("id", "label", "text").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).select("label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = feature_matrix(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["label"].cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.mapInArrow(measure, "label int, x array<double>").toArrow()
    y = found["label"].to_numpy()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, y))  # whatever the order of the tasks
    return Ranker(x[order], y[order])


def scorer(ranker: Ranker):
    """A column function: the score of a text."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(feature_matrix(texts.tolist())), dtype=float)

    return score


def score_quality(docs: DataFrame, ranker: Ranker, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row."""
    rows = pick(docs, id=id_column, text=text_column).select("id", scorer(ranker)(text_of()).alias("score"))
    return rows.select(F.col("id").alias(id_column), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranker: Ranker, text_column: str = "text") -> DataFrame:
    """The rows of docs that score CUT or more, with all their columns."""
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = F.col(f"_c{docs.columns.index(text_column)}")
    return flat.where(scorer(ranker)(text_of(text)) >= CUT).toDF(*docs.columns)
