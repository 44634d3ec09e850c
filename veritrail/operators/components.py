"""Connected components: each partition contracts its own edges, and what still ties its parts to others' is a smaller graph,
to which star rounds and the same step are applied until one task solves it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.storage import materialize

#: Graphs of at most this many edges are solved by one task.
ONE_TASK_EDGES = 200_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    if nodes:
        yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. ``edges`` (a, b) has a > b. Large-star links larger neighbours of a node to its least
    neighbour; small-star links a node and its smaller neighbours to the least of these."""
    if large:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def _contracted(edges: DataFrame, kind: str, one_task: int) -> DataFrame:
    """(node, component) of all ends of ``edges`` (a, b), which have been written."""
    if (size := edges.count()) <= one_task:
        return edges.coalesce(1).mapInPandas(_union_find, f"node {kind}, component {kind}")
    local = edges.mapInPandas(_union_find, f"node {kind}, component {kind}")
    # A node is in a partition once: a row for each partition that has it, the first with the least root.
    by_node = Window.partitionBy("node").orderBy("component")
    placed = materialize(local.select("node", "component", F.row_number().over(by_node).alias("at"), F.min("component").over(by_node).alias("root")))
    ties = materialize(placed.where("at > 1 and component <> root").select(F.col("component").alias("a"), F.col("root").alias("b")).distinct())
    found = placed.where("at = 1").select("node", "root")
    if ties.isEmpty():
        return found.select("node", F.col("root").alias("component"))
    if one_task < ties.count() > size // 2:
        # Partitions cut nearly every tie: two star rounds halve distances, and rows of one centre come together.
        ties = materialize(_stars(_stars(ties, large=True), large=False).repartition("b"))
    inner = _contracted(ties, kind, one_task).select(F.col("node").alias("root"), F.col("component").alias("whole"))
    return found.join(inner, "root", "left").select("node", F.coalesce("whole", "root").alias("component"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) with the least node as component, for edges (a, b) and, where given, single ``nodes`` (node).

    Edges with a null end are ignored; loops and repeats do no harm.
    """
    kind = edges.schema["a"].dataType.simpleString()
    clean = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _contracted(materialize(clean), kind, one_task)
    if nodes is None:
        return found
    return nodes.select("node").where("node is not null").distinct().join(found, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
