"""Sources and sinks: images, CSV and JSON tables, feature banks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.clean import group_key, item_token, stable_path


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str, default: str | None = None) -> str | None:
    if not exists(spark, path):
        return default
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes through a temporary name unless the text is there already; whether it wrote."""
    if read_text(spark, path) == text:
        return False
    _put(spark, path, text.encode())
    return True


def _put(spark: SparkSession, path: str, raw: bytes) -> None:
    """The bytes as a file, by a rename over what is there: a reader meets the old file or the new one, at any moment."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(raw))
    out.close()
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), over)


def read_json(spark: SparkSession, path: str, default=None):
    try:
        raw = read_text(spark, path)
        return default if raw is None else json.loads(raw)
    except ValueError:
        return default


def write_json(spark: SparkSession, path: str, value) -> bool:
    return write_text(spark, path, json.dumps(value, sort_keys=True, indent=1))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table with a header; no rows if the path is absent."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def scan_catalogue(spark: SparkSession, root: str, classes: dict[str, int], subject_glob: str = "Directory_") -> DataFrame:
    """(path, label, subject, series, token, group): image files under class folders, subjects, then series folders or none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    files = files.where(F.lower("path").rlike(r"\.(png|jpe?g)$"))
    out = None
    for name, label in classes.items():
        inside = F.regexp_extract("path", rf"/{name}/({subject_glob}[^/]*)/(?:(.*)/)?[^/]+$", 1)
        series = F.regexp_extract("path", rf"/{name}/{subject_glob}[^/]*/(?:(.*)/)?[^/]+$", 1)
        part = files.withColumns({"label": F.lit(label), "subject": inside, "series": F.when(series == "", "root").otherwise(series)}).where("subject <> ''")
        out = part if out is None else out.unionByName(part)
    own = stable_path(F.col("path"), subject_glob)
    return out.select("path", "label", "subject", "series", item_token(F.col("subject"), F.col("series"), own).alias("token"), group_key(F.col("series"), own).alias("group"), "length", "modificationTime")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own image source; pixels are decoded to gray by gray()."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(path)


def gray(image) -> "object":
    """A float array of an image row (BGR or gray bytes)."""
    import numpy as np

    x = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"]).astype(float)
    return x[:, :, 0] if x.shape[2] == 1 else x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299


def write_bank(bank: DataFrame, path: str, mode: str = "mode") -> None:
    bank.write.mode("overwrite").partitionBy(mode).parquet(path)


def read_bank(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, mode: str = "mode") -> DataFrame:
    """A bank whose old mode names become current ones."""
    bank = spark.read.parquet(path)
    if aliases:
        bank = bank.replace(aliases, subset=[mode])
    return bank


def merge_predictions(items: DataFrame, candidates: list[DataFrame], key: str, path: str | None = None) -> DataFrame:
    """items with the largest candidate table, the first of equal ones; keys must be unique. With path, items without their key find theirs by it."""
    sizes = [c.count() for c in candidates]
    if not sizes:
        return items
    best = candidates[sizes.index(max(sizes))]
    if best.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is repeated in the predictions")
    values = [c for c in best.columns if c not in (key, path)]
    out = items.join(best.select(key, *values, F.lit(True).alias("_by_key")), key, "left")
    if path is None or path not in best.columns:
        return out.drop("_by_key")
    other = best.groupBy(path).agg(*[F.first(c).alias(f"_{c}") for c in values], F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return out.join(other, path, "left").withColumns({c: F.when(F.col("_by_key"), F.col(c)).otherwise(F.col(f"_{c}")) for c in values}).select(*items.columns, *values)


def ancestors(path) -> "object":
    """A path and the folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def planned_removals(spark: SparkSession, files: DataFrame, contract: DataFrame) -> DataFrame:
    """Paths that no contract entry covers, without those below another of them. files, contract: path.

    An entry covers itself, what is below it and the folders above it; paths meet by equality of exploded ancestors.
    """
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("_up"))
    kept = contract.select(F.col("path").alias("_up"))
    below = above.join(kept, "_up", "left_semi").select("path").distinct()
    folders = contract.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    extra = files.select("path").distinct().join(below, "path", "left_anti").join(folders, "path", "left_anti")
    own = extra.select(F.col("path").alias("_up"))
    inside = extra.select("path", F.explode(ancestors(F.col("path"))).alias("_up")).where("_up <> path").join(own, "_up", "left_semi").select("path").distinct()
    return extra.join(inside, "path", "left_anti")


def find_root(spark: SparkSession, places: list[str], classes: list[str], depth: int = 4) -> str | None:
    """The first folder, from the places down to a depth and level by level, that holds a folder of each class."""
    level = [p.rstrip("/") for p in places if exists(spark, p)]
    for _ in range(depth + 1):
        below = []
        for folder in level:
            p, fs = _path(spark, folder)
            inside = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())
            if set(classes) <= set(inside):
                return folder
            below += [f"{folder}/{name}" for name in inside]
        level = below
    return None


def newest(spark: SparkSession, path: str):
    """When the newest file below a path was changed; null without files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]


def is_read_only(path, inputs: tuple[str, ...]):
    """Whether a path (a column) lies in one of the input folders, which nothing may write to."""
    return F.lit(False) if not inputs else F.greatest(*[path.startswith(f.rstrip("/") + "/") for f in inputs], F.lit(False))


#: The tables and folders of a workspace.
WORKSPACE = {
    "manifest": "manifest", "quality": "quality", "annotations": "manual_annotations", "masks": "manual_masks", "audit": "target_audit", "predictions": "predictions", "review_history": "review_history",
    "matching": "matching", "features": "feature_bank", "scores": "oof_predictions", "results": "results",
}


def workspace(root: str) -> dict[str, str]:
    """The paths of a workspace by name."""
    return {name: f"{root.rstrip('/')}/{place}" for name, place in WORKSPACE.items()}


def png(pixels) -> bytes:
    """A gray image of bytes as PNG."""
    import struct
    import zlib

    import numpy as np

    x = np.asarray(pixels, np.uint8)
    part = lambda name, raw: struct.pack(">I", len(raw)) + name + raw + struct.pack(">I", zlib.crc32(name + raw))
    rows = np.hstack([np.zeros((x.shape[0], 1), np.uint8), x]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_png(spark: SparkSession, path: str, pixels) -> bool:
    """A gray image, unless a file of the same bytes is there already (its time of change then stays); whether it wrote."""
    raw = png(pixels)
    p, fs = _path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).getLen() == len(raw):
        there = spark.read.format("binaryFile").load(path).select("content").first()
        if there and bytes(there.content) == raw:
            return False
    _put(spark, path, raw)
    return True


def read_masks(spark: SparkSession, path: str, side: int = 256) -> DataFrame:
    """(path, packed, area): masks at side x side, of the nearest pixels over 127, as packed bits; null where an image can't be read."""
    from ..functions.images import mask_of, pack

    images = read_images(spark, path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import pandas as pd

        for b in batches:
            masks = [mask_of(gray(r), side) if r["height"] > 0 else None for r in b.to_dict("records")]
            yield pd.DataFrame({"path": b["origin"], "packed": [None if m is None else pack(m) for m in masks], "area": [None if m is None else float(m.mean()) for m in masks]})

    return images.mapInPandas(run, "path string, packed binary, area double")


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """(path, perceptual_hash, sharpness, noise_ratio, dynamic_range) of the images below a path."""
    from ..functions.images import quality_metrics

    names = ["perceptual_hash", "sharpness", "noise_ratio", "dynamic_range"]
    images = read_images(spark, path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import pandas as pd

        for b in batches:
            found = [quality_metrics(gray(r)) for r in b.to_dict("records")]
            yield pd.DataFrame({"path": b["origin"], **{n: [f[n] for f in found] for n in names}})

    return images.mapInPandas(run, "path string, perceptual_hash string, sharpness double, noise_ratio double, dynamic_range double")


def read_views(spark: SparkSession, path: str, side: int = 224) -> DataFrame:
    """(path, robust, raw, content): the views of the images below a path that a classifier reads, side x side 32-bit numbers each, content as bytes of 0 and 1; null where an image can't be read."""
    from ..functions.images import classifier_views

    images = read_images(spark, path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for r in b.to_dict("records"):
                views = classifier_views(gray(r), side) if r["height"] > 0 else (None,) * 3
                yield pd.DataFrame({"path": [r["origin"]], **{n: [None if v is None else v.astype(kind).tobytes()] for n, v, kind in zip(("robust", "raw", "content"), views, (np.float32, np.float32, np.uint8), strict=True)}})

    return images.mapInPandas(run, "path string, robust binary, raw binary, content binary")
