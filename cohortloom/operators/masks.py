"""Masks from probability maps, as a stage over rows of pixels: each row's map is read, judged and packed in one pass, and nothing but the row's numbers and bits leaves it.

What a fold knows of usual masks (its prior) comes from the training masks of the other folds, by exact medians; it is a row a fold and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import images
from ..functions.clean import clean_double
from .cohort import numbered
from .robust import median_mad

#: The least scales of a prior's features.
SCALE_FLOOR = 1e-3


def mask_numbers(masks: DataFrame, item: str, packed: str, side: int) -> DataFrame:
    """item and area_ratio, boundary_touch_fraction, centroid_x, centroid_y, aspect of packed masks; null where a mask is empty or absent."""
    names = ["area_ratio", "boundary_touch_fraction", "centroid_x", "centroid_y", "aspect"]
    rows = masks.select(F.col(item).alias("item"), F.col(packed).alias("packed"))
    kind = rows.schema["item"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [images.mask_features(images.unpack(p, side)) if p is not None else dict.fromkeys(names, float("nan")) for p in pdf["packed"]]
            yield pd.DataFrame({"item": pdf["item"], **{n: [f[n] for f in found] for n in names}})

    out = rows.mapInPandas(run, f"item {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.select(F.col("item").alias(item), *[clean_double(F.col(n)).alias(n) for n in names])


def fold_priors(numbers: DataFrame, fold: str, folds: int = 5) -> DataFrame:
    """fold, n and prior (feature to centre and scale): medians and scaled deviations of the training masks, those of the other folds. numbers: fold and the features, of masks that aren't empty."""
    others = numbers.withColumn("_for", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col("_for") != F.col(fold))
    long = others.select("_for", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in images.PRIOR_FEATURES])).alias("e")).select("_for", "e.feature", "e.x")
    stats = median_mad(long, ["_for", "feature"], "x", SCALE_FLOOR)
    return stats.groupBy(F.col("_for").alias("fold")).agg(F.min("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("feature", F.struct(F.col("centre").alias("centre"), F.col("scale").alias("scale"))))).alias("prior"))


def packed_maps(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with array columns as 32-bit numbers in a binary each."""
    names = [c for c in rows.columns if c not in columns]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{c: [None if v is None else np.asarray(v, np.float32).tobytes() for v in pdf[c]] for c in columns})

    ordered = rows.select(*names, *columns)
    return ordered.mapInPandas(run, ", ".join([fields, *[f"`{c}` binary" for c in columns]]))


_PREDICTED = (
    "item {kind}, fold int, valid_initial int, reason_initial string, valid_final int, reason_final string, repair_method string, threshold_used double, area_ratio double, peak_probability double, boundary_touch_fraction double, "
    "heart_present int, presence_probability double, presence_threshold double, tta_disagreement double, mean_entropy double, uncertainty_score double, centroid_x double, centroid_y double, prior_deviation double, packed binary"
)


def predict_masks(maps: DataFrame, settings: DataFrame, priors: DataFrame, side: int) -> DataFrame:
    """The columns of the prediction schema and the packed mask of each row.

    maps: item, fold, probability and other (maps of side x side 32-bit numbers, other from the second view), presence. settings: a row a fold, threshold and presence_threshold.
    A row whose map is absent or of another size raises: it would be a wrong mask in silence.
    """
    kind = maps.schema["item"].dataType.simpleString()
    known = settings.select("fold", "threshold", "presence_threshold").join(priors.select("fold", "n", "prior"), "fold", "left")
    missing = maps.select("fold").distinct().join(known, "fold", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no settings for fold {missing[0].fold}")
    # a small table of maps is much work: it is dealt to as many tasks as a shuffle has
    dealt = maps.repartition(int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item")
    rows = dealt.select("item", F.col("fold").cast("int").alias("fold"), "probability", "other", "presence").join(F.broadcast(known), "fold")

    def map_of(raw: bytes | None) -> np.ndarray:
        if raw is None or len(raw) != 4 * side * side:
            raise ValueError(f"a map has {4 * side * side} bytes, not {None if raw is None else len(raw)}")
        return np.frombuffer(raw, np.float32).reshape(side, side).astype(float)

    def one(r) -> tuple:
        p, other = map_of(r.probability), map_of(r.other)
        prior = {"n": int(r.n), **{k: (v["centre"], v["scale"]) for k, v in dict(r.prior).items()}} if r.prior is not None else None
        first = images.candidate_mask(p, r.threshold)
        f = images.mask_features(first)
        why = images.mask_reason(f["area_ratio"], float(p.max()), f["boundary_touch_fraction"], images.prior_deviation(first, prior))
        got = images.predict(p, r.presence, r.presence_threshold, r.threshold, prior)
        if got["method"] == "presence_head_empty":
            why = ""
        f = images.mask_features(got["mask"])
        apart, entropy, doubt = images.uncertainty(p, other, r.presence, r.presence_threshold, got["deviation"], got["valid"])
        return (r.item, r.fold, int(why == ""), why, int(got["valid"]), got["reason"], got["method"], got["threshold"], f["area_ratio"], float(p.max()), f["boundary_touch_fraction"], int(got["mask"].any()), r.presence, r.presence_threshold, apart, entropy, doubt, f["centroid_x"], f["centroid_y"], got["deviation"], images.pack(got["mask"]))

    names = [c.split()[0] for c in _PREDICTED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 64):
                yield pd.DataFrame([one(r) for r in pdf.iloc[at : at + 64].itertuples(index=False)], columns=names)

    out = rows.mapInPandas(run, _PREDICTED.format(kind=kind))
    return out.withColumns({c: clean_double(F.col(c)) for c in ("centroid_x", "centroid_y")})


def region_images(rows: DataFrame, side: int, dilation: int = 15) -> DataFrame:
    """item, region (attention, attention_complement), pixels (side x side 32-bit numbers): each region of an image from its own 1st to 99th percentile.

    rows: item, image and content (side x side bytes: grey levels, and what of the canvas is image), packed (the mask).
    """
    kind = rows.schema["item"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                image, content = (np.frombuffer(x, np.uint8).reshape(side, side) for x in (r.image, r.content))
                parts = images.support(images.unpack(r.packed, side), content > 0, dilation)
                yield pd.DataFrame({"item": [r.item] * 2, "region": ["attention", "attention_complement"], "pixels": [images.region_normalise(image / 255, m).astype(np.float32).tobytes() for m in parts]})

    return rows.select("item", "image", "content", "packed").mapInPandas(run, f"item {kind}, region string, pixels binary")


#: Images that meet in one task, besides the two next to them.
CHUNK = 256


def neighbour_stacks(rows: DataFrame, pixels: DataFrame, item: str, sequence: list[str], order: list[str], payload: str = "pixels", chunk: int | None = None) -> DataFrame:
    """item, previous, stack: the item's payload between those of its neighbours in the sequence (its own where there is none), one after the other.

    Items are numbered in the order of sequences, by keys alone, and cut to chunks of bounded size; the first and last of a chunk also go to the chunk beside it (halo rows).
    So a sequence of any length is split, and the payload of an item reaches one task, or two at a cut, instead of one for each of its neighbours.
    """
    size = chunk or CHUNK
    keys = numbered(rows.select(*dict.fromkeys([*sequence, *order, item])), [*sequence, *order, item], "_n")
    own = F.floor((F.col("_n") - 1) / size).cast("long")
    at = F.pmod(F.col("_n") - 1, F.lit(size))
    targets = F.array_compact(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo")), F.when((at == 0) & (own > 0), F.struct((own - 1).alias("chunk"), F.lit(True).alias("halo"))), F.when(at == size - 1, F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo")))))
    placed = keys.select(F.col(item).alias("item"), F.xxhash64(*sequence).alias("sequence"), "_n", F.explode(targets).alias("t")).select("item", "sequence", "_n", "t.chunk", "t.halo")
    met = placed.join(pixels.select(F.col(item).alias("item"), F.col(payload).alias("payload")), "item")
    kind = met.schema["item"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        seq, raw, name = pdf["sequence"].tolist(), pdf["payload"].tolist(), pdf["item"].tolist()
        out = []
        for k in np.flatnonzero(~pdf["halo"].to_numpy()).tolist():
            a = k - 1 if k and seq[k - 1] == seq[k] else k
            b = k + 1 if k + 1 < len(seq) and seq[k + 1] == seq[k] else k
            out.append((name[k], name[a], raw[a] + raw[k] + raw[b]))
        return pd.DataFrame(out, columns=["item", "previous", "stack"])

    return met.groupBy("chunk").applyInPandas(run, f"item {kind}, previous {kind}, stack binary").withColumnRenamed("item", item)
