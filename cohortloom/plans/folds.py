"""Out-of-fold prediction as stages that can be resumed: a model and a part of the predictions for each fold, each keyed by what it was made of.

A fold's model reads the training rows of the other folds; its part reads that model and the fold's own rows. So a change in rows that nobody trains on rebuilds one part alone, and
a change in a training row rebuilds the models of the other folds, and their parts if the models differ by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from ..operators.relations import combined_parts
from .store import StageStore, fingerprint, inputs_mark


class FoldStage:
    """fit(training rows) and predict(model, rows) are functions of tables: a model is a table too. A prediction has the key and its own columns."""

    def __init__(self, store: StageStore, fit: Callable[[DataFrame], DataFrame], predict: Callable[[DataFrame, DataFrame], DataFrame], key: str, fold: str = "fold", folds: int = 5, parameters: dict | None = None, name: str = "predictions") -> None:
        self.store, self.fit, self.predict, self.key, self.fold, self.folds, self.parameters, self.name = store, fit, predict, key, fold, folds, parameters or {}, name
        self.fitted: list[int] = []
        self.computed: list[int] = []
        self.reused: list[int] = []

    def _names(self, k: int) -> tuple[str, str]:
        return f"{self.name}-model-{k}", f"{self.name}-part-{k}"

    def run(self, rows: DataFrame, training: DataFrame, force_training: Iterable[int] = (), force_prediction: Iterable[int] = ()) -> DataFrame:
        """The predictions of all rows, each by the model of its fold. training: rows with targets and their fold; raises unless every row gets one prediction."""
        self.fitted, self.computed, self.reused, parts = [], [], [], {}
        for k in range(self.folds):  # a few folds
            model, part = self._names(k)
            train, own = training.where(F.col(self.fold) != k), rows.where(F.col(self.fold) == k)
            mark = inputs_mark({"training": fingerprint(train)}, self.parameters)
            if k in force_training or self.store.why_not(model, mark):
                self.store.put(model, self.fit(train), mark)
                self.fitted.append(k)
            mark = inputs_mark({"model": self.store.status(model)["content"], "rows": fingerprint(own)}, self.parameters)
            if k in force_prediction or self.store.why_not(part, mark, {self.key}):
                self.store.put(part, self.predict(self.store.read(model), own), mark)
                self.computed.append(k)
            else:
                self.reused.append(k)
            parts[k] = self.store.read(part)
        return combined_parts(parts, rows, self.key, self.fold)

    def status(self) -> dict:
        """Which folds have a model and a part; reads pointers alone."""
        there = lambda i: [k for k in range(self.folds) if self.store.status(self._names(k)[i])]
        models, parts = there(0), there(1)
        return {"model_folds": models, "models_complete": len(models) == self.folds, "part_folds": parts, "parts_complete": len(parts) == self.folds}
