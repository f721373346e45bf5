"""Connected components by alternating large-star and small-star steps over edge tables.

Rounds go on until the edges are stars (about the logarithm of the longest path). Each round is a minimum per node (summed before the shuffle), a join and a distinct; it is written
to the shared folder, and the table before it is deleted. Nothing is collected but one
count a round. Edges that come later are added to the components found (``joined_components``), over those alone that link two of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, moved to the smallest neighbour of one end."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u").where("v > u" if large else "v <= u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:  # the node itself hangs on its smallest neighbour too
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one edge and is no lower end: then the next round would leave all as it is."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have an edge. edges: u, v of one integer type, not null."""
    spark = edges.sparkSession
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):  # each round that changes edges lowers their ends, so there is a last one
        new, new_path = written(_star(_star(now, True), False), "edges")
        dropped(spark, path)
        now, path = new, new_path
    own = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return own.unionByName(roots)


def joined_components(parts: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) over the edges that led to parts and these: a part counts as one node, and edges within it are left out."""
    if parts is None:
        return written(connected_components(edges), "parts")[0]
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    ends = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_part", "u").alias("u"), F.coalesce("v_part", "v").alias("v"))
    across, path = written(ends.where("u <> v").distinct(), "across")
    if not across.limit(1).count():
        return parts
    moved, moved_path = written(connected_components(across), "moved")
    dropped(parts.sparkSession, path)
    old = parts.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(parts.select("node"), "node", "left_anti")
    out, _ = written(old.unionByName(new.select("node", "component")), "parts")
    dropped(parts.sparkSession, moved_path)
    return out
