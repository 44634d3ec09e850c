"""Building a graph of nodes (id, type, label, chain) and edges (source, target, relation, confidence, evidence) step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = ["id", "type", "label", "chain"]
EDGE = ["source", "target", "relation", "confidence", "evidence"]


def _wide(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def add_nodes(nodes: DataFrame, *more: DataFrame) -> DataFrame:
    """The nodes and those of ``more`` whose id isn't there yet. Of nodes with one id the first counts: by frame, and within
    a frame by its column ``ordinal`` where it has one, then by what they hold."""
    rows = None
    for at, part in enumerate((nodes, *more)):
        order = F.col("ordinal").cast("long") if "ordinal" in part.columns else F.lit(0).cast("long")
        one = _wide(part.withColumn("__place", F.struct(F.lit(at).alias("frame"), order.alias("ordinal"))), [*NODE, "__place"])
        rows = one if rows is None else rows.unionByName(one)
    # An aggregate that keeps one row an id on each side of the shuffle, however often an id comes.
    first = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("__place", *NODE[1:])).alias("n"))
    return first.select("id", *(F.col(f"n.{c}").alias(c) for c in NODE[1:]))


def add_edges(edges: DataFrame, *more: DataFrame) -> DataFrame:
    """All edges, equal ones too."""
    out = _wide(edges, EDGE)
    for part in more:
        out = out.unionByName(_wide(part, EDGE))
    return out


def by_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def address_chains(txs: DataFrame) -> DataFrame:
    """(address, chain): the chain (asset) that most transactions of an address are of, the least of these by name."""
    ends = F.array_distinct(F.transform(F.concat("inputs", "outputs"), lambda p: p["address"]))
    seen = txs.where("asset is not null").select(F.explode(ends).alias("address"), "asset").where("address is not null")
    times = seen.groupBy("address", "asset").agg(F.count("*").alias("n"))
    return times.groupBy("address").agg(F.min(F.struct((-F.col("n")).alias("n"), "asset")).alias("c")).select("address", F.col("c.asset").alias("chain"))
