"""Fingerprints of tables, and a store of stages that are reused while their inputs stay the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import exists, read_json, write_json


def row_digests(table: DataFrame) -> DataFrame:
    """(digest): SHA-256 of each row as JSON of its columns in name order; nulls count."""
    ordered = F.struct(*[F.col(c) for c in sorted(table.columns)])
    return table.select(F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256).alias("digest"))


def fingerprint(table: DataFrame, buckets: int = 4096) -> str:
    """Does not depend on the order of rows or columns.

    Digests are summed as four numbers of 60 bits in each of a fixed number of buckets, so the sums that reach the driver are bounded.
    """
    part = lambda k: F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    sums = row_digests(table).groupBy(bucket).agg(F.count("*").alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)]).orderBy("bucket").collect()
    text = json.dumps([sorted(table.columns), [[str(v) for v in r] for r in sums]])
    return hashlib.sha256(text.encode()).hexdigest()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def has_columns(table: DataFrame, required: set[str]) -> bool:
    return required <= set(table.columns)


class StageStore:
    """Materialised stages under a folder: parquet tables and a JSON pointer each.

    Every write goes to a new folder; the pointer, which is swapped by a rename, then names it. So a reader meets the old table or the new one, never half of one,
    and a table that is being read stays: the ``keep`` versions before the current one are left, older ones go with the next write. A build that gives the rows
    that are there already leaves table and pointer as they are.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 1) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _state(self, stage: str) -> str:
        return f"{self.folder}/{stage}.json"

    def status(self, stage: str) -> dict | None:
        """What the pointer says: path, inputs, rows, content (a fingerprint), version and the paths of older versions."""
        state = read_json(self.spark, self._state(stage))
        return state if state and exists(self.spark, state["path"]) else None

    def why_not(self, stage: str, inputs: str, required: set[str] = frozenset()) -> str:
        """Why a stored table can't be used for these inputs; '' if it can. Reads the pointer and the table's footer, computes nothing."""
        state = self.status(stage)
        if not state:
            return "not built"
        if state["inputs"] != inputs:
            return "inputs or parameters have changed"
        table = self.spark.read.parquet(state["path"])
        if missing := set(required) - set(table.columns):
            return f"columns are missing: {', '.join(sorted(missing))}"
        rows = table.count()
        return "" if rows == state["rows"] else f"{rows} rows instead of {state['rows']}"

    def valid(self, stage: str, inputs: str, required: set[str] = frozenset()) -> bool:
        """A table is there, of these inputs, with these columns and as many rows as were written."""
        return not self.why_not(stage, inputs, required)

    def put(self, stage: str, table: DataFrame, inputs: str = "") -> bool:
        """Writes a version and swaps it in; False if the rows are those of the current version."""
        path, now = f"{self.folder}/{stage}-{uuid.uuid4().hex}", self.status(stage)
        table.write.parquet(path)
        new = self.spark.read.parquet(path)
        content, rows = fingerprint(new), new.count()
        if now and now.get("content") == content and now["rows"] == rows and self.spark.read.parquet(now["path"]).count() == rows:
            self._remove(path)
            if now["inputs"] != inputs:
                write_json(self.spark, self._state(stage), now | {"inputs": inputs})
            return False
        older = [now["path"], *now.get("older", [])] if now else []
        write_json(self.spark, self._state(stage), {"path": path, "inputs": inputs, "rows": rows, "content": content, "version": (now or {}).get("version", 0) + 1, "older": older[: self.keep]})
        for gone in older[self.keep :]:
            self._remove(gone)
        return True

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, stage: str) -> DataFrame:
        """The current version."""
        state = self.status(stage)
        if not state:
            raise ValueError(f"stage {stage} is not built")
        return self.spark.read.parquet(state["path"])

    def get(self, stage: str, inputs: dict[str, DataFrame], build: Callable[[], DataFrame], parameters: dict | None = None, required: set[str] = frozenset(), force: bool = False) -> DataFrame:
        """The stage's table: as stored if its inputs and parameters are unchanged, else built and swapped in."""
        mark = inputs_mark({name: fingerprint(t) for name, t in inputs.items()}, parameters)
        if force or not self.valid(stage, mark, required):
            self.put(stage, build(), mark)
        return self.read(stage)

    def append(self, log: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{log}")


def inputs_mark(inputs: dict[str, str], parameters: dict | None = None) -> str:
    """One fingerprint of the fingerprints of a stage's inputs and of its parameters."""
    return hashlib.sha256(json.dumps(dict(sorted(inputs.items())) | {"parameters": parameters or {}}, sort_keys=True).encode()).hexdigest()
