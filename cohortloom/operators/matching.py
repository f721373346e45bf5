"""Matching of two classes within acquisition families, under limits for subjects and sequences.

Core pairs are taken greedily, family by family. The rest of the target is dealt out to families by largest remainders and filled in rising passes; there
the limits cross families and the order counts. Up to ONE_TASK edges (at most 24 an item) one task runs through them in order; more are taken front by front
(``limited``): the same pairs, without a group that grows with the input.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import clean_double, reasons
from ..plans.scratch import kept
from .cohort import numbered
from .limited import BROADCAST, added, limited_greedy, used_keys, with_room
from .neighbours import NEAREST, mutual_edges
from .quantiles import has_large_groups
from .robust import MAD_SCALE, caliper, extended_caliper, median_mad

#: Limits of a subject and a sequence in a family, and of pairs of them.
CORE_SUBJECT, CORE_SEQUENCE = 20, 5
WIDE_SUBJECT, WIDE_SEQUENCE, SUBJECT_PAIR, SEQUENCE_PAIR = 60, 15, 60, 12
PASSES, SMALLEST_AREA = 12, 0.003
#: Blocks of the descriptor and their weights; the first is of signs and is not standardised.
HASH_WEIGHT = 0.45
BLOCKS = ((("area", "centroid_x", "centroid_y", "boundary"), 0.25), (("position",), 0.15), (("log_sharpness", "noise", "spread"), 0.15))


def eligibility(items: DataFrame) -> DataFrame:
    """Adds exclusion_reason ('' if the item takes part). Columns used: quality_valid, attention_valid, heart_present, area, hash, has_mask."""
    why = reasons(
        ("quality_invalid", F.coalesce("quality_valid", F.lit(0)) != 1), ("attention_invalid", F.coalesce("attention_valid", F.lit(0)) != 1), ("heart_not_visible", F.coalesce("heart_present", F.lit(1)) != 1),
        ("attention_area_too_small", clean_double(F.col("area"), 0.0) < SMALLEST_AREA), ("missing_phash", F.col("hash").isNull()), ("missing_attention_mask", ~F.coalesce("has_mask", F.lit(False))),
    )
    return items.withColumn("exclusion_reason", why)


def descriptor(items: DataFrame, blocks=BLOCKS, hash_column: str | None = None, clip: float = 5.0) -> DataFrame:
    """Adds descriptor: +-1 for each bit of the hash, then robust scores of the columns of each block, all times sqrt(weight / columns).

    All medians come from one aggregate and all deviations from a second; both are one row.
    """
    names = [c for columns, _ in blocks for c in columns]
    v = {c: clean_double(F.col(c)) for c in names}
    if has_large_groups(items, []):  # a buffer can't hold all values of a column: a row (name, value) each, in passes
        long = items.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), v[c].alias("x")) for c in names])).alias("e")).select("e.*")
        stats = median_mad(long, ["name"], "x")
        wide = lambda what, mark: stats.agg(*[F.max(F.when(F.col("name") == c, F.col(what))).alias(f"{mark}{c}") for c in names])
        centres, spreads = wide("centre", "_m_"), wide("scale", "_s_")
        joined = items.join(F.broadcast(centres))
    else:
        centres = items.agg(*[F.percentile(v[c], F.lit(0.5)).alias(f"_m_{c}") for c in names])
        joined = items.join(F.broadcast(centres))
        spreads = joined.agg(*[F.greatest(F.lit(1e-3), MAD_SCALE * F.percentile(F.abs(v[c] - F.col(f"_m_{c}")), F.lit(0.5))).alias(f"_s_{c}") for c in names])
    score = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce((v[c] - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), F.lit(0.0))))
    parts = F.array(*[score(c) * math.sqrt(weight / len(columns)) for columns, weight in blocks for c in columns])
    if hash_column:
        size = math.sqrt(HASH_WEIGHT / 64)
        signs = F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda k: F.when(F.call_function("getbit", F.col(hash_column), k) == 1, size).otherwise(-size))
        parts = F.concat(signs, parts)
    return joined.join(F.broadcast(spreads)).withColumn("descriptor", parts).select(*items.columns, "descriptor")


def family_count(n: int) -> int:
    """About 1,800 items a family, 8 to 32 of them, not more than items."""
    return max(min(2, n), min(n, max(8, min(32, math.ceil(n / 1800)))))


def families(items: DataFrame, vector: str, seed: int = 42, starts: int = 5) -> DataFrame:
    """Adds family, by k-means: of several starts the one of least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = kept(items.withColumn("_v", array_to_vector(F.col(vector))))
    k = family_count(ready.count())
    models = [KMeans(k=k, seed=seed + n, maxIter=200, featuresCol="_v", predictionCol="family").fit(ready) for n in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(ready).drop("_v")


def shared_families(items: DataFrame, family: str, label: str, subject: str, least_items: int = 12, least_subjects: int = 2) -> DataFrame:
    """Families with enough items and subjects of each class."""
    of = lambda c: F.col(label) == c
    counts = items.groupBy(family).agg(
        F.count_if(of(0)).alias("items_0"), F.count_if(of(1)).alias("items_1"), F.count_distinct(F.when(of(0), F.col(subject))).alias("subjects_0"), F.count_distinct(F.when(of(1), F.col(subject))).alias("subjects_1")
    )
    enough = (F.least("items_0", "items_1") >= least_items) & (F.least("subjects_0", "subjects_1") >= least_subjects)
    return counts.withColumn("shared", enough.cast("int"))


def match_target(items: DataFrame, label: str, subject: str, share: float = 0.5) -> DataFrame:
    """One row: the pairs to aim at, and the most that a subject of each class may give."""
    c = items.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count_distinct(F.when(F.col(label) == 0, F.col(subject))).alias("s0"), F.count_distinct(F.when(F.col(label) == 1, F.col(subject))).alias("s1"))
    target = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * share / 2).cast("long"), F.least("n0", "n1")))
    cap = lambda s: F.greatest(F.lit(60), F.ceil(F.try_divide(F.col("target"), F.col(s)) * 1.7))
    return c.withColumn("target", target).select("target", cap("s0").alias("cap_0"), cap("s1").alias("cap_1"))


def calipers(edges: DataFrame) -> DataFrame:
    """(family, core_caliper, extended_caliper): how far apart pairs of the core, and others, may be."""
    core = caliper(edges.where("is_core = 1"), ["family"], "distance", 2.5, 0.90).withColumnRenamed("caliper", "core_caliper")
    wide = caliper(edges, ["family"], "distance", 3.5, 0.97).withColumnRenamed("caliper", "_wide")
    return wide.join(core, "family", "left").select("family", "core_caliper", extended_caliper(F.col("core_caliper"), F.col("_wide")).alias("extended_caliper"))


_PAIR = "family long, sick long, normal long, distance double, stage string, turn long"


def core_matching(edges: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Greedy one-to-one pairs over core edges within the core caliper, by (distance, tie).

    edges: family, sick, normal, distance, is_core, tie, and subject and sequence of both sides. turn counts within a family.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        load: Counter = Counter()
        taken = []
        for e in pdf.sort_values(["distance", "tie"]).itertuples(index=False):
            counted = ("subject", e.sick_subject), ("subject", e.normal_subject), ("sequence", e.sick_sequence), ("sequence", e.normal_sequence)
            full = any(load[k] >= (CORE_SUBJECT if k[0] == "subject" else CORE_SEQUENCE) for k in counted)
            if full or ("s", e.sick) in used or ("n", e.normal) in used:
                continue
            used |= {("s", e.sick), ("n", e.normal)}
            load.update(counted)
            taken.append((e.family, e.sick, e.normal, e.distance, "CORE", len(taken)))
        return pd.DataFrame(taken, columns=["family", "sick", "normal", "distance", "stage", "turn"])

    near = edges.where("is_core = 1")
    if limits is not None:
        near = near.join(F.broadcast(limits.select("family", "core_caliper")), "family").where("distance <= core_caliper").drop("core_caliper")
    large = near.groupBy("family").agg(F.count("*").alias("_n")).where(F.col("_n") > ONE_TASK).select("family")
    if not large.limit(1).count():
        return near.groupBy("family").applyInPandas(greedy, _PAIR)
    keys = [_key("s", "sick", most=1), _key("n", "normal", most=1)] + [_key(kind, "family", f"{side}_{kind}", most=most) for kind, most in (("subject", CORE_SUBJECT), ("sequence", CORE_SEQUENCE)) for side in ("sick", "normal")]
    rows = kept(near.join(large, "family", "left_semi").select("family", "sick", "normal", "distance", F.struct("family", "distance", "tie", "sick", "normal").alias("turn"), F.array(*keys).alias("keys")))
    taken = limited_greedy(rows).drop("keys")
    place = numbered(taken, ["turn"], "_n")
    before = place.groupBy("family").agg(F.min("_n").alias("_first"))
    wide = place.join(before, "family").select("family", "sick", "normal", "distance", F.lit("CORE").alias("stage"), (F.col("_n") - F.col("_first")).cast("long").alias("turn"))
    return near.join(large, "family", "left_anti").groupBy("family").applyInPandas(greedy, _PAIR).unionByName(wide)


#: Edges that one task may order; more are taken in fronts, with the same result.
ONE_TASK = 1 << 18


def _key(kind: str, *columns: str, most: int | Column) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.struct(F.concat_ws("|", F.lit(kind), *parts).alias("key"), (F.lit(most) if isinstance(most, int) else most).cast("long").alias("most"))


def allocate(capacities: DataFrame, target: int, family: str = "family", capacity: str = "capacity") -> DataFrame:
    """quota: the target dealt out in proportion to capacities, by largest remainders (the larger capacity, then the smaller name first), none above its capacity."""
    total = capacities.agg(F.sum(capacity).alias("_total"))
    share = F.lit(float(target)) * F.col(capacity) / F.greatest(F.col("_total"), F.lit(1))
    parts = capacities.join(F.broadcast(total)).withColumn("_share", share).withColumn("_floor", F.least(F.col(capacity), F.floor("_share")))
    left = parts.agg((F.lit(target) - F.sum("_floor")).alias("_left"))
    free = F.col("_floor") < F.col(capacity)
    # one row a family, so one task does
    turn = F.row_number().over(Window.orderBy(free.desc(), F.round(F.col("_share") - F.floor("_share"), 9).desc(), F.col(capacity).desc(), family))
    out = parts.join(F.broadcast(left)).withColumn("_turn", turn)
    return out.select(family, capacity, (F.col("_floor") + (free & (F.col("_turn") <= F.col("_left"))).cast("int")).cast("long").alias("quota"))


class Extension:
    """Fills up a matching under all limits. Load counts by key; a subject's total starts with its core pairs."""

    def __init__(self, core: pd.DataFrame, caps: dict[int, int], target: int) -> None:
        self.caps, self.target, self.used, self.load, self.totals = caps, target, set(), Counter(), {}
        self.seeds = set(zip(core["sick_sequence"], core["normal_sequence"], strict=True))
        self.taken: list[tuple] = []
        self.n = 0
        for e in core.itertuples(index=False):
            self.count(e)

    @staticmethod
    def keys(e) -> tuple[list, list]:
        """(those of a family, those of a pair) with their limits."""
        own = [(("subject", e.family, s), WIDE_SUBJECT) for s in (e.sick_subject, e.normal_subject)] + [(("sequence", e.family, s), WIDE_SEQUENCE) for s in (e.sick_sequence, e.normal_sequence)]
        return own, [(("subjects", e.sick_subject, e.normal_subject), SUBJECT_PAIR), (("sequences", e.sick_sequence, e.normal_sequence), SEQUENCE_PAIR)]

    def count(self, e) -> None:
        own, pair = self.keys(e)
        self.load.update(k for k, _ in own + pair)
        for s in (e.sick_subject, e.normal_subject):
            self.totals[s] = self.totals.get(s, 0) + 1
        self.used |= {("s", e.sick), ("n", e.normal)}
        self.n += 1

    def fits(self, e, quota: int | None) -> bool:
        if ("s", e.sick) in self.used or ("n", e.normal) in self.used:
            return False
        own, pair = self.keys(e)
        if any(self.load[k] >= most for k, most in own) or any(self.load[k] >= most for k, most in pair):
            return False
        for c, s in ((1, e.sick_subject), (0, e.normal_subject)):
            # a subject that was looked at counts as one without pairs when the next family's first quota is set
            have = self.totals.setdefault(s, 0)
            if have >= self.caps[c] or (quota is not None and have >= quota):
                return False
        return True

    def fill(self, edges: list, quota: int | None, room: int | None) -> int:
        """Takes edges in order while there is room; how many."""
        got = 0
        for e in edges:
            if self.n >= self.target or (room is not None and got >= room):
                break
            if self.fits(e, quota):
                self.count(e)
                self.taken.append((e.family, e.sick, e.normal, e.distance, "EXT", len(self.taken)))
                got += 1
        return got


def extended_matching(edges: DataFrame, core: DataFrame, quotas: DataFrame, caps: dict[int, int], target: int, limits: DataFrame | None = None, spill: bool = True) -> DataFrame:
    """The pairs that rising passes add to the core, family by family, and a last pass without quotas; stage EXT, turn in the order taken.

    caps: the most pairs of a subject of each class. Edges of sequences that core pairs join come first, then reciprocal ones, then the nearer.
    """
    if edges.limit(ONE_TASK + 1).count() > ONE_TASK:
        return extended_in_rounds(edges, core, quotas, caps, target, limits, spill)
    every_key = edges.select("sick", "normal", "sick_subject", "normal_subject", "sick_sequence", "normal_sequence")
    if limits is not None:
        edges = edges.join(F.broadcast(limits.select("family", "extended_caliper")), "family").where("distance <= extended_caliper")
    else:
        edges = edges.withColumn("extended_caliper", F.lit(1.0))
    columns = ["family", "sick", "normal", "distance", "sick_subject", "normal_subject", "sick_sequence", "normal_sequence"]
    marked = edges.join(quotas.select("family", "quota"), "family").select(*columns, "reciprocal", "rank_from_sick", "rank_from_normal", "tie", "extended_caliper", "quota", F.lit(None).cast("long").alias("core_turn"))
    # a core pair is an edge of its own, wherever the wider caliper lies
    own = core.join(every_key, ["sick", "normal"]).select(*columns, F.lit(1).alias("reciprocal"), F.lit(None).cast("int").alias("rank_from_sick"), F.lit(None).cast("int").alias("rank_from_normal"), F.lit("").alias("tie"), F.lit(1.0).alias("extended_caliper"), F.lit(0).cast("long").alias("quota"), F.col("turn").cast("long").alias("core_turn"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_core = pdf["core_turn"].notna()
        work = Extension(pdf[is_core].sort_values(["family", "core_turn"]), caps, target)
        rest = pdf[~is_core].copy()
        rest["later"] = [(a, b) not in work.seeds for a, b in zip(rest["sick_sequence"], rest["normal_sequence"], strict=True)]
        rest["near"] = rest["distance"] / rest["extended_caliper"].clip(lower=1e-9)
        rest["ranks"] = rest["rank_from_sick"].fillna(NEAREST + 1) + rest["rank_from_normal"].fillna(NEAREST + 1)
        rest = rest.sort_values(["family", "later", "reciprocal", "near", "ranks", "tie"], ascending=[True, True, False, True, True, True])
        by_family = {f: [*part.itertuples(index=False)] for f, part in rest.groupby("family", sort=True)}
        for rows in by_family.values():
            room = int(rows[0].quota)
            if room > 0:
                first = max(1, min(work.totals.values(), default=1))
                for quota in np.unique(np.ceil(np.linspace(first, max(caps.values()), PASSES)).astype(int)).tolist():
                    room -= work.fill(rows, quota, room)
        for rows in by_family.values() if spill else ():
            work.fill(rows, None, None)
        return pd.DataFrame(work.taken, columns=["family", "sick", "normal", "distance", "stage", "turn"])

    return marked.unionByName(own).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, _PAIR)


def extended_in_rounds(edges: DataFrame, core: DataFrame, quotas: DataFrame, caps: dict[int, int], target: int, limits: DataFrame | None = None, spill: bool = True) -> DataFrame:
    """``extended_matching`` without one task: families and passes one after the other, as their order counts, each pass in fronts over the edges of its family.

    Edges are sorted once. One whose item is used, or whose subject or sequence has no room left in the family, never comes back, so what a pass reads falls with what was taken.
    """
    keys = ["sick_subject", "normal_subject", "sick_sequence", "normal_sequence"]
    wide = edges.join(F.broadcast(limits.select("family", "extended_caliper")), "family").where("distance <= extended_caliper") if limits is not None else edges.withColumn("extended_caliper", F.lit(1.0))
    own = kept(core.join(edges.select("sick", "normal", *keys), ["sick", "normal"]))
    count = own.count()
    seeds = own.select("sick_sequence", "normal_sequence", F.lit(False).alias("_later")).distinct()
    seeds = F.broadcast(seeds) if count <= BROADCAST else seeds
    rank = lambda c: F.coalesce(F.col(c), F.lit(NEAREST + 1))
    turn = [F.coalesce("_later", F.lit(True)), -F.col("reciprocal"), F.col("distance") / F.greatest(F.col("extended_caliper"), F.lit(1e-9)), rank("rank_from_sick") + rank("rank_from_normal"), "tie", "sick", "normal"]
    marked = wide.join(F.broadcast(quotas.select("family", "quota")), "family").join(seeds, ["sick_sequence", "normal_sequence"], "left")
    rows = kept(numbered(marked, ["family", *turn], "place").select("place", "family", "sick", "normal", "distance", "quota", *keys))

    def keyed(df: DataFrame, quota: int | None, totals: bool = True) -> DataFrame:
        most = lambda c: caps[c] if quota is None else min(caps[c], quota)
        each = [_key("s", "sick", most=1), _key("n", "normal", most=1), _key("subjects", "sick_subject", "normal_subject", most=SUBJECT_PAIR), _key("sequences", "sick_sequence", "normal_sequence", most=SEQUENCE_PAIR)]
        each += [_key(kind, "family", f"{side}_{kind}", most=n) for kind, n in (("subject", WIDE_SUBJECT), ("sequence", WIDE_SEQUENCE)) for side in ("sick", "normal")]
        each += [_key("total", "sick_subject", most=most(1)), _key("total", "normal_subject", most=most(0))] if totals else []
        return df.select("*", F.array(*each).alias("keys"))

    loads, parts = added(None, used_keys(keyed(own, None))), []
    # subjects that were looked at without a pair count when the next first quota is set
    looked = rows.select(F.col("sick_subject").alias("subject")).limit(0)
    total_of = lambda c: F.concat_ws("|", F.lit("total"), F.col(c))

    def still_open(some: DataFrame, held: int) -> tuple[DataFrame, int]:
        """some without the edges that can't come back, written anew when half of the held ones have gone; their number."""
        left = with_room(keyed(some, None, False), loads, 8, "place").drop("keys")
        n = left.count()
        return (kept(left), n) if 2 * n <= held else (some, held)

    def watch(some: DataFrame, ready: DataFrame, before: DataFrame, taken: DataFrame, cut: int | None) -> None:
        """Adds to looked: sick subjects without a pair of which an edge failed by its normal subject's total alone."""
        nonlocal looked
        totals = loads.where(F.col("key").startswith("total|")).select(F.col("key").alias("_total"), F.col("used").alias("_n"))
        bare = some.select(F.col("sick_subject").alias("subject")).distinct().join(totals, total_of("subject") == F.col("_total"), "left_anti").join(looked, "subject", "left_anti")
        bare = kept(bare)
        if not bare.limit(1).count():
            return
        last = F.element_at("keys", -1)
        bare = ready.join(bare, F.col("subject") == F.col("sick_subject"), "left_semi").join(totals, (last["key"] == F.col("_total")) & (F.col("_n") >= last["most"]), "left_semi")
        if cut is not None:
            bare = bare.where(F.col("place") < cut)
        asked = bare.select("place", "sick_subject", F.explode(F.filter("keys", lambda k: ~k["key"].startswith("total|"))).alias("k")).select("place", "sick_subject", "k.key", "k.most")
        earlier = keyed(taken.drop("keys"), None, False).select(F.col("place").alias("_place"), F.explode("keys.key").alias("key"))
        then = asked.join(before, "key", "left").join(earlier, "key", "left").groupBy("place", "sick_subject", "key", "most").agg((F.coalesce(F.first("used"), F.lit(0)) + F.count_if(F.col("_place") < F.col("place"))).alias("n"))
        seen = then.groupBy("place", "sick_subject").agg(F.bool_and(F.col("n") < F.col("most")).alias("free")).where("free").select(F.col("sick_subject").alias("subject"))
        looked = kept(looked.unionByName(seen).distinct())

    def take(some: DataFrame, quota: int | None, most: int, watched: bool) -> int:
        """One pass; how many it took."""
        nonlocal loads, count
        ready, before = keyed(some, quota), loads
        taken = kept(limited_greedy(ready, loads, "place", most))
        got = taken.count()
        if got:
            loads = added(loads, used_keys(taken))
            parts.append(taken.select(F.lit(len(parts)).alias("_step"), "place", "family", "sick", "normal", "distance"))
            count += got
        if watched:
            watch(some, ready, before, taken, taken.agg(F.max("place")).first()[0] if got == most else None)
        return got

    sizes = sorted((r.family, r.quota, r.n) for r in rows.groupBy("family", "quota").agg(F.count("*").alias("n")).collect())  # a row a family
    held = {family: (rows.where(F.col("family") == family), n) for family, _, n in sizes}
    for at, (family, quota, _) in enumerate(sizes):
        room = quota
        if room <= 0:
            continue
        watched = any(more > 0 for _, more, _ in sizes[at + 1 :])
        totals = loads.where(F.col("key").startswith("total|"))
        least = totals.agg(F.min("used")).first()[0]
        bare = looked.join(totals, total_of("subject") == F.col("key"), "left_anti").limit(1).count()
        first = 1 if bare else max(1, int(least or 1))
        got = 1
        for step in np.unique(np.ceil(np.linspace(first, max(caps.values()), PASSES)).astype(int)).tolist():
            if got:
                held[family] = still_open(*held[family])
            if room <= 0 or count >= target or not held[family][1]:
                break
            got = take(held[family][0], step, min(room, target - count), watched)
            room -= got
    if spill:
        for family, _, _ in sizes:
            if count >= target:
                break
            held[family] = still_open(*held[family])
            if held[family][1]:
                take(held[family][0], None, target - count, False)
    if not parts:
        return core.limit(0).select("family", "sick", "normal", "distance", "stage", "turn")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return numbered(every, ["_step", "place"], "_n").select("family", "sick", "normal", "distance", F.lit("EXT").alias("stage"), (F.col("_n") - 1).cast("long").alias("turn"))


def pair_ids(pairs: DataFrame) -> DataFrame:
    """Adds pair_id: numbered through, core pairs first, in the order taken."""
    order = [F.col("stage") != "CORE", F.coalesce(F.when(F.col("stage") == "CORE", F.col("family")), F.lit(0).cast("long")), "turn"]
    return numbered(pairs, order, "_n").withColumn("pair_id", F.format_string("CCM_%s_F%02d_P%06d", "stage", "family", "_n")).drop("_n")


def partners(pairs: DataFrame) -> DataFrame:
    """(item, partner, pair_id, distance) for both sides."""
    one = lambda a, b: pairs.select(F.col(a).alias("item"), F.col(b).alias("partner"), "pair_id", "distance")
    return one("sick", "normal").unionByName(one("normal", "sick"))


def outcome(items: DataFrame, shared: DataFrame, edges: DataFrame, pairs: DataFrame, limits: DataFrame, target: int, item: str, family: str) -> DataFrame:
    """(item, selected, exclusion_reason): of eligible items, '' or why an item has no partner."""
    ends = lambda df: df.select(F.explode(F.array("sick", "normal")).alias(item)).distinct()
    near = edges.join(F.broadcast(limits.select("family", "extended_caliper")), "family").where("distance <= extended_caliper")
    joined = items.join(F.broadcast(shared.select(family, "shared")), family, "left")
    for name, df in (("_edge", edges), ("_near", near), ("_pair", pairs)):
        joined = joined.join(ends(df).withColumn(name, F.lit(1)), item, "left")
    reached = pairs.agg((F.count("*") >= target).alias("_reached"))
    told = (
        F.when(F.col("_pair") == 1, "").when(F.coalesce("shared", F.lit(0)) == 0, "family_not_shared_between_classes").when(F.col("_edge").isNull(), "no_cross_class_neighbor_in_extended_top_k")
        .when(F.col("_near").isNull(), "above_extended_family_caliper").when(F.col("_reached"), "expanded_target_reached").otherwise("one_to_one_or_capacity_limit")
    )
    return joined.join(F.broadcast(reached)).select(item, F.coalesce("_pair", F.lit(0)).alias("selected"), told.alias("exclusion_reason"))


def matching_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, median and 0.9-quantile of distances by family and stage, and over all (null)."""
    return pairs.groupingSets([["family", "stage"], ["stage"], []], "family", "stage").agg(F.count("*").alias("pairs"), F.percentile("distance", F.lit(0.5)).alias("median_distance"), F.percentile("distance", F.lit(0.9)).alias("p90_distance"))


def family_summary(items: DataFrame, edges: DataFrame, limits: DataFrame, pairs: DataFrame, quotas: DataFrame) -> DataFrame:
    """A row for each shared family: items and subjects of each class, core and all candidate edges, both calipers, core and added pairs, and the pairs that were to be added.

    items: family, label, subject of the shared families.
    """
    of = lambda c: F.col("label") == c
    own = items.groupBy("family").agg(F.count_if(of(0)).alias("items_0"), F.count_if(of(1)).alias("items_1"), F.count_distinct(F.when(of(0), F.col("subject"))).alias("subjects_0"), F.count_distinct(F.when(of(1), F.col("subject"))).alias("subjects_1"))
    near = edges.groupBy("family").agg(F.count_if(F.col("is_core") == 1).alias("core_edges"), F.count("*").alias("edges"))
    got = pairs.groupBy("family").agg(F.count_if(F.col("stage") == "CORE").alias("core_pairs"), F.count_if(F.col("stage") != "CORE").alias("added_pairs"))
    every = own.join(near, "family", "left").join(limits.select("family", "core_caliper", "extended_caliper"), "family", "left").join(got, "family", "left").join(quotas.select("family", F.col("quota").alias("added_target")), "family", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.select("family", "items_0", "items_1", "subjects_0", "subjects_1", zero("core_edges"), zero("edges"), "core_caliper", "extended_caliper", zero("core_pairs"), zero("added_pairs"), (F.coalesce("core_pairs", F.lit(0)) + F.coalesce("added_pairs", F.lit(0))).alias("pairs"), zero("added_target"))


def matching_totals(manifest: DataFrame, pairs: DataFrame, families: DataFrame, target: int, caps: dict[int, int]) -> DataFrame:
    """One row: items, eligible ones, shared families, pairs wanted and made, the share of items selected, subjects of each class, their limits, the most items of a subject, and distances by stage."""
    chosen, of = F.col("selected") == 1, lambda c: F.col("label") == c
    eligible = F.col("exclusion_reason").isin("", "family_not_shared_between_classes", "no_cross_class_neighbor_in_extended_top_k", "above_extended_family_caliper", "expanded_target_reached", "one_to_one_or_capacity_limit")
    per = manifest.where(chosen).groupBy("subject").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_items_of_a_subject"))
    row = manifest.agg(
        F.count("*").alias("items"), F.count_if(eligible).alias("eligible"), F.count_if(chosen & of(0)).alias("selected_0"), F.count_if(chosen & of(1)).alias("selected_1"), F.count_distinct(F.when(chosen & of(0), F.col("subject"))).alias("subjects_0"), F.count_distinct(F.when(chosen & of(1), F.col("subject"))).alias("subjects_1"),
    )
    core = F.when(F.col("stage") == "CORE", F.col("distance"))
    added = F.when(F.col("stage") != "CORE", F.col("distance"))
    told = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("stage") == "CORE").alias("core_pairs"), *[F.percentile(c, F.lit(q)).alias(f"{n}{m}") for n, c in (("", F.col("distance")), ("core_", core), ("added_", added)) for m, q in (("distance_median", 0.5), ("distance_p90", 0.9))])
    shared = families.agg(F.count("*").alias("shared_families"))
    out = row.join(told).join(shared).join(per).withColumns({"target": F.lit(target).cast("long"), "cap_0": F.lit(caps[0]).cast("long"), "cap_1": F.lit(caps[1]).cast("long")})
    share = lambda of: (F.col("selected_0") + F.col("selected_1")) / F.greatest(F.lit(1), F.col(of))
    return out.withColumns({"added_pairs": F.col("pairs") - F.col("core_pairs"), "share_of_eligible": share("eligible"), "share_of_items": share("items"), "target_achieved": F.col("pairs") >= F.col("target")})


class Matching(tuple):
    """(manifest, pairs, summary), and as attributes ``families`` (a row a shared family) and ``totals`` (one row)."""


def check_matching(manifest: DataFrame, label: Column, subject: str) -> None:
    """Raises unless as many of both classes are selected, of two subjects each."""
    of = lambda c: label == c
    row = manifest.where("selected = 1").agg(F.count_if(of(0)).alias("n0"), F.count_if(of(1)).alias("n1"), F.count_distinct(F.when(of(0), F.col(subject))).alias("s0"), F.count_distinct(F.when(of(1), F.col(subject))).alias("s1")).first()
    if row.n0 != row.n1:
        raise ValueError(f"unequal class sizes: {row.n0} and {row.n1}")
    if min(row.s0, row.s1) < 2:
        raise ValueError(f"too few subjects: {row.s0} and {row.s1}")


def build_matching(items: DataFrame, store=None, check: bool = True) -> Matching:
    """(manifest, pairs, summary) of a cross-class matching, from eligibility to reasons.

    items: item (long), subject, sequence, label, and the columns that ``eligibility`` and ``descriptor`` use (sharpness instead of log_sharpness; hash a signed
    long), and family where it is known. The manifest has every item with family, selected, core, pair_id, partner, distance and exclusion_reason.
    store(name, table) writes a table that is used more than once and gives it back; by default tables are checkpointed.
    """
    keep = store or (lambda name, df: df.checkpoint())
    every = keep("eligibility", eligibility(items))
    ready = every.where("exclusion_reason = ''").withColumn("log_sharpness", F.log1p(F.greatest(F.lit(0.0), clean_double(F.col("sharpness"), 0.0))))
    sizes = ready.agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes")).first()
    if sizes.n < 4 or sizes.classes != 2:
        raise ValueError(f"matching needs four eligible items of both classes, not {sizes.n} of {sizes.classes}")
    described = descriptor(ready, hash_column="hash")
    grouped = keep("families", described if "family" in items.columns else families(described, "descriptor").withColumn("family", F.col("family").cast("long")))
    shared = keep("shared", shared_families(grouped, "family", "label", "subject"))
    common = grouped.join(F.broadcast(shared.where("shared = 1").select("family")), "family", "left_semi")
    if not common.limit(1).count():
        raise ValueError("no family is shared by both classes")
    goal = match_target(ready, "label", "subject").first()
    caps = {0: int(goal.cap_0), 1: int(goal.cap_1)}
    of = lambda name: common.select(F.col("item").alias(name), F.col("subject").cast("string").alias(f"{name}_subject"), F.col("sequence").cast("string").alias(f"{name}_sequence"))
    edges = keep("edges", mutual_edges(common, "family", "item", "label", "descriptor", position="position", area="area").join(of("sick"), "sick").join(of("normal"), "normal"))
    limits = keep("calipers", calipers(edges))
    core = keep("core", core_matching(edges, limits))
    per = common.groupBy("family").agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("n")).join(core.groupBy("family").agg(F.count("*").alias("taken")), "family", "left")
    capacity = per.select("family", F.greatest(F.lit(0), F.col("n") - F.coalesce("taken", F.lit(0))).cast("long").alias("capacity"))
    quotas = keep("quotas", allocate(capacity, max(0, int(goal.target) - core.count())))
    added = extended_matching(edges, core, quotas, caps, int(goal.target), limits)
    pairs = keep("pairs", pair_ids(core.unionByName(added)))
    told = outcome(grouped.select("item", "family"), shared, edges, pairs, limits, int(goal.target), "item", "family")
    mates = partners(pairs).join(pairs.select("pair_id", (F.col("stage") == "CORE").cast("int").alias("core")), "pair_id")
    manifest = every.select("item", "subject", "label", F.col("exclusion_reason").alias("_own")).join(grouped.select("item", F.col("family").alias("_family")), "item", "left").join(told, "item", "left").join(mates, "item", "left")
    manifest = keep("manifest", manifest.select("item", "subject", "label", F.col("_family").alias("family"), F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("core", F.lit(0)).alias("core"), "pair_id", "partner", "distance", F.coalesce("exclusion_reason", F.col("_own")).alias("exclusion_reason")))
    if check:
        check_matching(manifest, F.col("label"), "subject")
    out = Matching((manifest, pairs, matching_summary(pairs)))
    out.families = family_summary(common, edges, limits, pairs, quotas)
    out.totals = matching_totals(manifest, pairs, out.families, int(goal.target), caps)
    return out
