"""A graph of stages on a store: built in order, reused while what they read is unchanged, and told about without building."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import read_json, write_json
from .store import StageStore, fingerprint, inputs_mark


@dataclass(frozen=True)
class Stage:
    """inputs: names of sources or earlier stages, given to build in this order. required: columns its table must have."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    required: frozenset[str] = frozenset()
    parameters: dict = field(default_factory=dict)


class StageGraph:
    """Stages over source tables. A stage is reusable if its stored table was made of the same inputs, by content, and of the same parameters.

    The fingerprint of a source is taken once; that of a stage is stored with its table, so a stage whose rebuild gives the same rows leaves what reads it valid.
    """

    def __init__(self, store: StageStore, sources: dict[str, DataFrame], stages: Iterable[Stage]) -> None:
        self.store, self.sources, self.stages = store, sources, {s.name: s for s in stages}
        known = set(sources)
        for s in self.stages.values():
            if unknown := set(s.inputs) - known:
                raise ValueError(f"{s.name} reads {', '.join(sorted(unknown))}, which comes neither before it nor as a source")
            known.add(s.name)
        self._marks: dict[str, str] = {}
        self.built: list[str] = []
        self.reused: list[str] = []

    def _content(self, name: str) -> str:
        if name in self.sources:
            if name not in self._marks:
                self._marks[name] = fingerprint(self.sources[name])
            return self._marks[name]
        return (self.store.status(name) or {}).get("content", "")

    def _mark(self, s: Stage) -> str:
        return inputs_mark({i: self._content(i) for i in s.inputs}, s.parameters)

    def needed(self, names: Iterable[str]) -> list[str]:
        """The named stages and those that they read, in order."""
        wanted = set(names)
        if unknown := wanted - set(self.stages):
            raise ValueError(f"no stage {', '.join(sorted(unknown))}")
        for s in reversed(self.stages.values()):
            if s.name in wanted:
                wanted |= set(s.inputs) & set(self.stages)
        return [n for n in self.stages if n in wanted]

    def run(self, *names: str, force: Iterable[str] = ()) -> dict[str, DataFrame]:
        """The tables of the named stages and of those that they read; built are only those forced or not reusable."""
        out, self.built, self.reused, forced = {}, [], [], set(force)
        for name in self.needed(names):
            s = self.stages[name]
            mark = self._mark(s)
            if name in forced or self.store.why_not(name, mark, s.required):
                table = s.build(*[out[i] if i in out else self.sources[i] for i in s.inputs])
                if missing := s.required - set(table.columns):
                    raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
                self.store.put(name, table, mark)
                self.built.append(name)
            else:
                self.reused.append(name)
            out[name] = self.store.read(name)
        return out

    def report(self, *names: str) -> dict[str, dict]:
        """reusable and reason of the stages (all by default). Builds nothing; a stage that reads one that is not reusable is not reusable either."""
        out: dict[str, dict] = {}
        for name in self.needed(names or self.stages):
            s = self.stages[name]
            stale = [i for i in s.inputs if i in out and not out[i]["reusable"]]
            reason = f"{stale[0]} is not reusable" if stale else self.store.why_not(name, self._mark(s), s.required)
            out[name] = {"reusable": not reason, "reason": reason}
        return out

    def status(self) -> dict:
        """What is there, and the last entry that ended: pointers alone are read."""
        found = {n: self.store.status(n) for n in self.stages}
        last = read_json(self.store.spark, f"{self.store.folder}/last_stage.json") or {}
        return {n: {"there": bool(x), "rows": x["rows"] if x else None, "version": x["version"] if x else None} for n, x in found.items()} | {"last_stage": last}

    def mark_done(self, entry: str, **told) -> None:
        """Remembers the entry that ended, with what it tells."""
        at = self.store.spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss') AS t").first().t
        write_json(self.store.spark, f"{self.store.folder}/last_stage.json", {"stage": entry, "at": at} | told)


class CohortRun:
    """The entries of a cohort's run: prepare, finalize, status, persistence_status.

    Sources: items (item, subject, series, sequence, label, ts, sharpness, noise, spread, and what ``matching.build_matching`` reads of an image: hash, area, centroid_x, centroid_y, boundary,
    position), marks (item, target_type, mask_area, found), predictions (item, valid, present) and vectors (item, region, vector). The networks themselves are outside: predictions and vectors
    are what they left.
    """

    #: The stages that each action of finalize ends with.
    ACTIONS = {"matching": ("matching",), "features": ("feature_bank",), "evaluate": ("results", "comparisons")}

    def __init__(self, store: StageStore, items: DataFrame, marks: DataFrame, predictions: DataFrame, vectors: DataFrame, draws: int = 2000, folds: int = 5) -> None:
        from ..operators import audit, cohort, matching, metrics, modeling, pooling

        def manifest(items: DataFrame) -> DataFrame:
            return cohort.sequence_neighbours(items, ["sequence"], ["ts", "item"], "item")

        def quality(rows: DataFrame) -> DataFrame:
            return audit.quality_audit(rows, "subject", "sharpness", "noise", "spread")

        def targets(rows: DataFrame, marks: DataFrame) -> DataFrame:
            return audit.target_audit(rows, marks, "item")

        def matched(rows: DataFrame, predictions: DataFrame) -> DataFrame:
            told = predictions.select("item", F.col("valid").alias("attention_valid"), F.col("present").alias("heart_present"), F.lit(True).alias("has_mask"))
            return matching.build_matching(rows.join(told, "item", "left"), check=False)[0]

        def bank(rows: DataFrame, predictions: DataFrame, audited: DataFrame, manifest: DataFrame, vectors: DataFrame) -> DataFrame:
            accepted = audited.where("status = 'ACCEPTED' AND target = 'HEART_PRESENT'").select("item", F.lit(True).alias("manual"))
            told = predictions.select("item", "valid", "present", F.lit(True).alias("has_mask"))
            every = rows.select("item", "subject", "series", "label", "quality_valid", "area").join(told, "item", "left").join(accepted, "item", "left").join(manifest.select("item", "selected"), "item", "left")
            return pooling.feature_bank(pooling.feature_modes(pooling.keep_flags(every)), vectors, "item", "subject", "series", "label", "vector")

        def scores(bank: DataFrame) -> DataFrame:
            parts = cohort.hash_folds(bank.where("mode = 'B0_FULL_IMAGE'"), "subject", "label", folds, "42|outer-fold").select("subject", "fold")
            return modeling.nested_cv(bank.join(parts, "subject"), "mode", "subject", "label", "fold", "x")

        self.graph = StageGraph(
            store,
            {"items": items, "marks": marks, "predictions": predictions, "vectors": vectors},
            [
                Stage("manifest", ("items",), manifest, frozenset({"item", "subject", "series", "label"})),
                Stage("quality", ("manifest",), quality, frozenset({"quality_valid", "quality_reason"})),
                Stage("target_audit", ("quality", "marks"), targets, frozenset({"item", "target", "status", "reason"})),
                Stage("matching", ("quality", "predictions"), matched, frozenset({"item", "selected", "pair_id", "exclusion_reason"})),
                Stage("feature_bank", ("quality", "predictions", "target_audit", "matching", "vectors"), bank, frozenset({"mode", "subject", "label", "x"})),
                Stage("oof_scores", ("feature_bank",), scores, frozenset({"mode", "subject", "label", "score", "predicted"}), {"folds": folds}),
                Stage("results", ("oof_scores",), lambda s: metrics.mode_metrics(s, draws), frozenset({"mode", "auc"}), {"draws": draws}),
                Stage("comparisons", ("oof_scores",), lambda s: metrics.compare_modes(s, n=draws), frozenset({"comparison", "auc_difference"}), {"draws": draws}),
            ],
        )

    def prepare(self, refresh_quality: bool = False) -> dict:
        """Manifest, quality audit, target audit."""
        tables = self.graph.run("target_audit", force=["quality"] if refresh_quality else [])
        told = {"images": tables["manifest"].count(), "accepted_targets": tables["target_audit"].where("status = 'ACCEPTED'").count()}
        self.graph.mark_done("prepare", **told)
        return {"status": "prepare_complete", "tables": tables, "built": self.graph.built} | told

    def finalize(self, action: str = "evaluate", force: Iterable[str] = ()) -> dict:
        """Matching, then features, then the evaluation, as far as the action says; predictions have to cover every item. action status tells what is there."""
        if action == "status":
            return {"status": self.status()}
        if action not in self.ACTIONS:
            raise ValueError(f"action must be one of {', '.join([*self.ACTIONS, 'status'])}")
        missing = self.graph.sources["items"].join(self.graph.sources["predictions"], "item", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"no prediction for item {missing[0].item!r}")
        tables = self.graph.run(*self.ACTIONS[action], force=force)
        self.graph.mark_done(action, rows={n: tables[n].count() for n in self.ACTIONS[action]})
        return {"status": "complete" if action == "evaluate" else f"{action}_complete", "tables": tables, "built": self.graph.built}

    def run(self, force: Iterable[str] = ()) -> dict:
        self.prepare()
        return self.finalize("evaluate", force)

    def status(self) -> dict:
        return self.graph.status()

    def persistence_status(self) -> dict:
        """Whether every stored table can be reused, and why not; starts no stage."""
        return self.graph.report()
