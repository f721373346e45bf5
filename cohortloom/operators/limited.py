"""Greedy choice in an order under limits: what a loop over all rows in order would take, without one task that sees them all.

Every row uses some keys, and a key may be used so many times. Rows are decided front by front: the next LOOK rows at most whose keys are not full yet go to one task, with how often their keys
are used so far, and that task runs the loop. A full key stays full, so what is left out before a front is what the loop would pass over; rows of full keys reach no task and no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import kept
from .cohort import numbered

#: Rows that one task decides at most.
LOOK = 1 << 17
#: Keys that are broadcast at most; more meet their rows in a join.
BROADCAST = 1 << 20


def used_keys(rows: DataFrame) -> DataFrame:
    """key, used: how often the rows (keys: array of (key, most)) use each key."""
    return rows.select(F.explode("keys.key").alias("key")).groupBy("key").agg(F.count("*").alias("used"))


def added(loads: DataFrame | None, more: DataFrame) -> DataFrame:
    """Both together."""
    return kept(more if loads is None else loads.unionByName(more).groupBy("key").agg(F.sum("used").alias("used")))


def with_room(rows: DataFrame, loads: DataFrame, width: int, place: str) -> DataFrame:
    """Those of rows (place: a name of each) none of whose keys, width at most, is full."""
    n = loads.count()
    if n > BROADCAST:
        each = rows.select(place, F.explode("keys").alias("k")).select(place, "k.key", "k.most")
        return rows.join(each.join(loads, "key").where("used >= most").select(place).distinct(), place, "left_anti")
    used = F.broadcast(loads.select(F.col("key").alias("_key"), F.col("used").alias("_used")))
    for k in range(width if n else 0):
        own = F.get("keys", F.lit(k))
        rows = rows.join(used, (own["key"] == F.col("_key")) & (F.col("_used") >= own["most"]), "left_anti")
    return rows


def limited_greedy(rows: DataFrame, loads: DataFrame | None = None, place: str | None = None, limit: int | None = None) -> DataFrame:
    """The rows that a loop in the order of turn takes: those none of whose keys is full at their turn; the first ``limit`` of them, if there is one.

    turn: a column that sorts all rows and leaves no ties, keys: an array of (key, most). place: a column of whole numbers from 1 that sorts them, instead of turn. loads: key, used before.
    A row's keys must differ.
    """
    loads = loads if loads is not None else rows.sparkSession.createDataFrame([], "key string, used long")
    columns = rows.columns
    if place is None:
        rows, place = kept(numbered(rows, ["turn"], "_place")), "_place"
    first, end, width = rows.agg(F.min(place), F.max(place), F.max(F.size("keys"))).first()
    seen, reach, got, parts = (first or 1) - 1, 4 * LOOK, 0, []
    step = max(1, LOOK // 8)
    while seen < (end or 0) and (limit is None or got < limit):
        open_ = with_room(rows.where((F.col(place) > seen) & (F.col(place) <= seen + reach)), loads, width, place)
        # a number for each LOOK / 8 places
        counts = sorted(map(tuple, open_.groupBy(F.floor((F.col(place) - seen - 1) / step)).count().collect()))
        size, till = 0, seen + reach
        for k, n in counts:
            if size and size + n > LOOK:
                till = seen + k * step
                break
            size += n
        if till == seen + reach:
            reach *= 4
        if size:
            new = kept(_front(open_.where(F.col(place) <= till), loads, place, None if limit is None else limit - got))
            more = new.count()
            if more:
                loads, got = added(loads, used_keys(new)), got + more
                parts.append(new)
        seen = till
    every = parts[0] if parts else rows.limit(0)
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select(*columns)


def _front(front: DataFrame, loads: DataFrame, place: str, limit: int | None) -> DataFrame:
    """What one task takes of a front."""
    front = kept(front)
    known = loads.join(front.select(F.explode("keys.key").alias("key")).distinct(), "key", "left_semi")
    asked = front.select(F.lit(0).alias("_one"), F.col(place).cast("long").alias("place"), F.col("keys.key").alias("names"), F.col("keys.most").alias("most"))

    def decide(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        load, taken = dict(zip(known["key"], known["used"], strict=True)), []
        for row in asked.sort_values("place").itertuples(index=False):
            if limit is not None and len(taken) >= limit:
                break
            if all(load.get(k, 0) < most for k, most in zip(row.names, row.most, strict=True)):
                for k in row.names:
                    load[k] = load.get(k, 0) + 1
                taken.append(row.place)
        return pd.DataFrame({"_taken": pd.Series(taken, dtype="int64")})

    picked = asked.groupBy("_one").cogroup(known.withColumn("_one", F.lit(0)).groupBy("_one")).applyInPandas(decide, "_taken long")
    return front.join(F.broadcast(picked), F.col(place) == F.col("_taken")).drop("_taken")
