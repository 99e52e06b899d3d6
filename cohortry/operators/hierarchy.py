"""Following parent/child edges until nothing new is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.workspace import materialise


def expand_hierarchy(
    seeds: DataFrame,
    edges: DataFrame,
    *,
    node: str = "node",
    parent: str = "parent",
    child: str = "child",
    max_depth: int | None = None,
) -> DataFrame:
    """All nodes reachable from ``seeds`` with the number of steps to the nearest seed.

    Each round joins only the nodes found in the round before. A round is written to the shared
    folder, so the plan stays one join deep and a lost executor repeats one round. Nodes already
    reached are dropped, which makes cycles end; the number of rounds is the depth of the graph.
    """
    depth = 0
    frontier = materialise(seeds.select(node).distinct().withColumn("depth", F.lit(depth)), "level")
    reached = frontier
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            edges.join(frontier.select(F.col(node).alias(parent)), parent, "left_semi")
            .select(F.col(child).alias(node))
            .distinct()
            .join(reached.select(node), node, "left_anti")
        )
        frontier = materialise(step.withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 16 == 0:
            reached = materialise(reached, "reached")
    return reached


class CycleError(ValueError):
    """A node is its own ancestor."""


def roots(edges: DataFrame, *, node: str = "node", parent: str = "parent") -> DataFrame:
    """Root and depth of every node of a forest in which each node has one parent at most: ``node``, ``root``, ``depth``.

    ``edges`` has a row for each node; a NULL parent, or one that has no row, makes a root of the node or of that parent, which is
    then returned as well. Pointer jumping: each round a node takes over where its ancestor points, which doubles
    the distance, so a chain of a thousand nodes is done in ten rounds. Nodes that point at a root take no
    part any more. A node with two parents and a cycle are errors; further columns and rows that repeat one another do not count.
    """
    given = edges.select(F.col(node).alias("n"), F.col(parent).alias("p")).filter("n IS NOT NULL").distinct()
    listed = materialise(given, "forest")
    several = listed.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("n").first()
    if several is not None:
        raise ValueError(f"two parents: {several.n}")
    above = listed.select(F.col("p").alias("n")).filter("n IS NOT NULL").distinct().join(listed.select("n"), "n", "left_anti")
    tops = listed.filter("p IS NULL").select("n").unionByName(above)
    done = materialise(tops.select("n", F.col("n").alias("root"), F.lit(0).cast("bigint").alias("depth")), "roots")
    finished = [done]
    nodes = listed.count()
    # each open node: an ancestor and how far it is
    open_ = materialise(listed.filter("p IS NOT NULL").select("n", F.col("p").alias("at"), F.lit(1).cast("bigint").alias("far")), "open")
    reach = 1
    while True:
        ended = open_.join(done.select(F.col("n").alias("at"), "root", "depth"), "at").select("n", "root", (F.col("depth") + F.col("far")).alias("depth"))
        ended = materialise(ended, "roots")
        finished.append(ended)
        open_ = materialise(open_.join(ended.select("n"), "n", "left_anti"), "open")
        if open_.isEmpty():
            break
        if reach > nodes:
            raise CycleError(f"a cycle holds {open_.first().n}")
        # an ancestor that is done now is met in the next round; others are jumped over
        done = ended
        further = open_.select(F.col("n").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        jumped = open_.join(further, "at", "left").select("n", F.coalesce("next", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        open_ = materialise(jumped, "open")
        reach *= 2
    found = finished[0]
    for part in finished[1:]:
        found = found.unionByName(part)
    return found.select(F.col("n").alias(node), "root", "depth")
