"""Nested cross-validation of a small classifier: scaling, principal components, balanced logistic regression."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The strengths tried, inner folds.
C_GRID, INNER_FOLDS = (0.01, 0.1, 1.0, 10.0), 3


def auc(y: np.ndarray, s: np.ndarray) -> float:
    good, bad = s[y == 1], s[y == 0]
    if not len(good) or not len(bad):
        return float("nan")
    d = good[:, None] - bad[None, :]
    return float(((d > 0) + 0.5 * (d == 0)).mean())


class Classifier:
    """Standardises (population deviation), keeps components of 95 % of the variance, fits weighted logistic regression by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float, variance: float = 0.95) -> None:
        self.mean, scale = x.mean(0), x.std(0)
        self.scale = np.where(scale > 0, scale, 1.0)
        z = (x - self.mean) / self.scale
        _, s, v = np.linalg.svd(z, full_matrices=False)
        part = np.cumsum(s**2) / max((s**2).sum(), 1e-12)
        self.axes = v[: int(np.searchsorted(part, variance) + 1)].T
        f = np.hstack([z @ self.axes, np.ones((len(z), 1))])
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        w = np.zeros(f.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            g = f.T @ (weight * (p - y)) * c + w
            h = (f * (weight * p * (1 - p))[:, None]).T @ f * c + np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.w = w

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.hstack([(x - self.mean) / self.scale @ self.axes, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(f @ self.w, -30, 30)))


def inner_folds(names: list[str], y: np.ndarray, seed: int = 42) -> np.ndarray | None:
    """A fold for each row, dealt out in hash order within each class; None if a class has fewer than two rows."""
    n = min(INNER_FOLDS, int((y == 0).sum()), int((y == 1).sum()))
    if n < 2:
        return None
    out = np.zeros(len(y), int)
    for c in (0, 1):
        own = sorted(np.flatnonzero(y == c).tolist(), key=lambda k: (hashlib.sha256(f"{seed}|inner-fold|{c}|{names[k]}".encode()).hexdigest(), k))
        out[own] = np.arange(len(own)) % n
    return out


def best_c(x: np.ndarray, y: np.ndarray, folds: np.ndarray, grid=C_GRID) -> tuple[float, np.ndarray]:
    """(C, its out-of-fold scores) of the best AUC; ties go to the value nearest 1, then the earlier."""
    tried = []
    for k, c in enumerate(grid):
        s = np.empty(len(y))
        for f in np.unique(folds):
            s[folds == f] = Classifier(x[folds != f], y[folds != f], c).score(x[folds == f])
        tried.append(((round(auc(y, s), 12), -abs(np.log10(c)), -k), c, s))
    return max(tried, key=lambda t: t[0])[1:]


def select(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, float]:
    """(C, threshold) from inner out-of-fold scores alone; (1, 0.5) where a class is too small for inner folds."""
    folds = inner_folds(names, y)
    if folds is None:
        return 1.0, 0.5
    c, s = best_c(x, y, folds)
    return c, youden(y, s)


def youden(y: np.ndarray, s: np.ndarray) -> float:
    cuts = np.unique(s)[::-1]
    gain = [(s[y == 1] >= t).mean() - (s[y == 0] >= t).mean() for t in cuts]
    return float(cuts[int(np.argmax(gain))])


def nested_cv(bank: DataFrame, mode: str, subject: str, label: str, fold: str, vector: str) -> DataFrame:
    """(mode, subject, label, outer fold, score, predicted, selected C, threshold), a task for each (mode, outer fold).

    A row is a subject, so a mode's bank is small: it is repeated for each fold.
    """
    from pyspark.sql import functions as F

    every = bank.select(F.col(mode).alias("mode"), F.col(subject).cast("string").alias("subject"), F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"), F.col(vector).alias("x"))
    held = every.select("mode", F.col("fold").alias("outer_fold")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("subject")
        x, y, f = np.array(pdf["x"].tolist(), float), pdf["label"].to_numpy(), pdf["fold"].to_numpy()
        out = int(pdf["outer_fold"].iloc[0])
        train = f != out
        if len(set(y[train])) < 2 or not (~train).any():
            return pd.DataFrame(columns=["mode", "subject", "label", "outer_fold", "score", "predicted", "selected_c", "threshold"])
        c, cut = select(x[train], y[train], pdf["subject"][train].tolist())
        s = Classifier(x[train], y[train], c).score(x[~train])
        return pd.DataFrame({"mode": pdf["mode"].iloc[0], "subject": pdf["subject"][~train], "label": y[~train], "outer_fold": out, "score": s, "predicted": (s >= cut).astype(int), "selected_c": c, "threshold": cut})

    return every.join(held, "mode").groupBy("mode", "outer_fold").applyInPandas(run, "mode string, subject string, label int, outer_fold int, score double, predicted int, selected_c double, threshold double")
