"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnspark.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): the smallest node it reaches.

    Each round points every node at its smallest neighbour, shortens the pointers twice
    and contracts the edges along them. A hub needs no task of its own: neighbours are
    reduced by a partial minimum, and the joins are plain ones whose hot keys adaptive
    execution can split. Tables of a round are written to the shared folder, so a lost
    executor costs a re-read. Loops, repeated and null edges are ignored.
    """
    edges = stage(_clean(edges), "edges")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = stage(near.select("node", F.least("node", "near").alias("up")), "parent")
        for _ in range(2):
            step = parent.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            parent = stage(parent.join(step, "up").select("node", F.col("higher").alias("up")), "parent")
        pointers.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        # a pointer that is not yet at its root stays in the graph as an edge
        open_ends = parent.join(step, "up").select(F.col("up").alias("a"), F.col("higher").alias("b"))
        edges = stage(_clean(moved.unionByName(open_ends)), "edges")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = pointers[0].select("node", F.col("up").alias("component"))
    for later in pointers[1:]:
        step = later.select(F.col("node").alias("component"), "up")
        found = stage(
            found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
            "component",
        )
    return found


def _clean(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
