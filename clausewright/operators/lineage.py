"""Walks of a lineage graph: bounded levels of joins that keep the least number of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions.storage import staged


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest lineage snapshot."""
    whole = F.struct(*snapshots.columns)
    return snapshots.agg(F.max_by(whole, "captured_at").alias("s")).where("s is not null").select("s.*")


def nodes_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.inline("nodes"))


def edges_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.inline("edges"))


def walk(edges: DataFrame, start: DataFrame, hops: int, upstream: bool = False) -> DataFrame:
    """node_id, hops: what is reached from start (node_id) in at most so many steps, start included at 0, each with its fewest.

    Other columns of start tell walks apart, which are made together, and stay. Each level joins the frontier with the edges and leaves
    out what was seen, so cycles end and no path is listed twice. The edges are written once, as pairs of nodes; a level is written
    too, so the planner knows its size and broadcasts a small one, and the walk ends with the first empty one."""
    walks = [c for c in start.columns if c != "node_id"]
    step = staged(edges.select(F.col("target" if upstream else "source").alias("a"), F.col("source" if upstream else "target").alias("b")).where("a is not null and b is not null"))
    seen = staged(start.where("node_id is not null").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for h in range(1, hops + 1):
        found = frontier.drop("hops").join(step, F.col("node_id") == F.col("a")).select(*walks, F.col("b").alias("node_id")).distinct()
        frontier = staged(found.join(seen, [*walks, "node_id"], "left_anti").select("node_id", *walks, F.lit(h).alias("hops")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select(*walks, "node_id", "hops")


def consumers(nodes: DataFrame, edges: DataFrame, dataset: str) -> DataFrame:
    """id, description, fields_consumed of the targets of edges whose source has the dataset's name in it, underscores aside."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    hit = edges.where(plain(F.col("source")).contains(dataset.replace("_", "").lower()))
    met = hit.join(nodes, F.col("target") == F.col("node_id"))
    return met.select(F.col("target").alias("id"), F.concat_ws(" ", "label", "relationship").alias("description"), F.array(F.lit("*")).alias("fields_consumed")).distinct()


def downstream(edges: DataFrame, start: DataFrame, hops: int = 16) -> DataFrame:
    """Everything that depends on start, without start."""
    return walk(edges, start, hops).where("hops > 0")
