"""Fusing chain, infrastructure, linkage and sanctions data to one graph, and threat actors in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.scalars import band, make_id, noisy_or
from veritrail.operators import graph
from veritrail.operators.chain import common_input_clusters
from veritrail.operators.components import connected_components
from veritrail.operators.infra import fingerprint_clusters
from veritrail.operators.screening import screen_addresses
from veritrail.storage import materialize

LINKAGE = "address string, address2 string, ip string, ip2 string, source string, confidence double, ordinal long"
_MEMBER_OF, _SAME_ACTOR, _SANCTIONED = "member-of", "controlled-by-same-actor", "sanctioned-as"


def _clusters(members: DataFrame, kind: str) -> DataFrame:
    """(member, cluster id, size) for (member, key) rows of distinct members. The id is made of a digest of the set that is
    summed up, in any order and never gathered: how many members, and sum and exclusive or of 60 bits of a hash of each."""
    h = F.conv(F.substring(F.sha1("member"), 1, 15), 16, 10).cast("long")
    sets = members.groupBy("key").agg(F.count("*").alias("size"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed"))
    ids = sets.select("key", make_id(kind, F.concat_ws("-", "size", "total", "mixed")).alias("cluster"), "size")
    return members.join(ids, "key").select("cluster", "size", "member")


def build_graph(txs: DataFrame, obs: DataFrame, linkages: DataFrame, sdn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, type, label, chain), edges (source, target, relation, confidence, evidence)). Addresses have the chain of most
    of their transactions, where these say which (asset)."""
    spent = common_input_clusters(txs).select(F.col("address").alias("member"), F.col("cluster").alias("key"))
    paid = txs.select(F.explode("outputs").alias("o")).select(F.col("o.address").alias("member")).where("member is not null").distinct()
    wallets = _clusters(spent.unionByName(paid.join(spent, "member", "left_anti").withColumn("key", F.col("member"))), "wallet-cluster")
    wallets = materialize(wallets)
    infra = materialize(_clusters(fingerprint_clusters(obs).select(F.col("ip").alias("member"), F.col("cluster").alias("key")), "infra-cluster"))
    hits = screen_addresses(wallets.select(F.col("member").alias("address")), sdn)

    def node(df: DataFrame, id_, kind: str, label) -> DataFrame:
        chain = F.col("chain") if "chain" in df.columns else F.lit(None).cast("string")
        return df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), chain.alias("chain"))

    one = lambda df, c: df.select(c).distinct()
    placed = wallets.withColumn("chain", F.lit(None).cast("string"))
    if "asset" in txs.columns:
        placed = wallets.join(graph.address_chains(txs).withColumnRenamed("address", "member"), "member", "left")
    nodes = node(one(wallets, "cluster"), F.col("cluster"), "wallet-cluster", F.col("cluster")).unionByName(node(placed, make_id("crypto-address", F.col("member")), "crypto-address", F.col("member")))
    nodes = nodes.unionByName(node(one(infra, "cluster"), F.col("cluster"), "infrastructure-cluster", F.col("cluster"))).unionByName(node(infra, make_id("ip-address", F.col("member")), "ip-address", F.col("member")))
    nodes = nodes.unionByName(node(one(hits, "sdn_name"), make_id("sanctioned-entity", F.col("sdn_name")), "sanctioned-entity", F.col("sdn_name")))

    def edge(df: DataFrame, source, target, relation: str, confidence, evidence) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), confidence.alias("confidence"), evidence.alias("evidence"))

    edges = edge(wallets, make_id("crypto-address", F.col("member")), F.col("cluster"), _MEMBER_OF, F.lit(0.9), F.lit("common inputs"))
    edges = edges.unionByName(edge(infra, make_id("ip-address", F.col("member")), F.col("cluster"), _MEMBER_OF, F.lit(0.8), F.lit("shared certificate or domain")))
    edges = edges.unionByName(edge(hits, make_id("crypto-address", F.col("address")), make_id("sanctioned-entity", F.col("sdn_name")), _SANCTIONED, F.lit(1.0), F.lit("sanctions list")))
    known = {"address": wallets, "address2": wallets, "ip": infra, "ip2": infra}
    for a, b in (("address", "ip"), ("address", "address2"), ("ip", "ip2")):
        side = lambda c: known[c].select(F.col("member").alias(c), F.col("cluster").alias(f"{c}_cluster"))
        found = linkages.join(side(a), a).join(side(b), b)
        edges = edges.unionByName(edge(found, F.col(f"{a}_cluster"), F.col(f"{b}_cluster"), _SAME_ACTOR, F.coalesce("confidence", F.lit(0.6)), F.coalesce("source", F.lit("investigation"))))
    return nodes, edges


def actor_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(actor, type, member): clusters and sanctioned entities that edges tie together, single ones too."""
    kinds = nodes.where(F.col("type").isin("wallet-cluster", "infrastructure-cluster", "sanctioned-entity"))
    home = edges.where(F.col("relation") == _MEMBER_OF).select(F.col("source").alias("address_id"), F.col("target").alias("home"))
    same = edges.where(F.col("relation") == _SAME_ACTOR).select(F.col("source").alias("a"), F.col("target").alias("b"))
    listed = edges.where(F.col("relation") == _SANCTIONED).join(home, F.col("source") == F.col("address_id")).select(F.col("home").alias("a"), F.col("target").alias("b"))
    parts = connected_components(same.unionByName(listed), kinds.select(F.col("id").alias("node")))
    return kinds.join(parts, kinds["id"] == parts["node"]).select(make_id("threat-actor", F.col("component")).alias("actor"), "type", F.col("id").alias("member"))


def threat_actors(members: DataFrame, keep_trivial: bool = False) -> DataFrame:
    """(id, n_wallets, n_infra, n_sanctions, confidence, confidence_band) of :func:`actor_members`."""
    of = lambda t: F.count(F.when(F.col("type") == t, 1))
    actors = members.groupBy("actor").agg(of("wallet-cluster").alias("n_wallets"), of("infrastructure-cluster").alias("n_infra"), of("sanctioned-entity").alias("n_sanctions"))
    if not keep_trivial:
        actors = actors.where("n_sanctions > 0 or n_wallets + n_infra >= 2")
    wallets, infra, listed = (F.col(c) > 0 for c in ("n_wallets", "n_infra", "n_sanctions"))
    weights = F.array_compact(F.array(F.when(wallets, 0.6), F.when(infra, 0.5), F.when(wallets & infra, 0.6), F.when(listed, 0.9)))
    raw = noisy_or(weights)
    return actors.select(F.col("actor").alias("id"), "n_wallets", "n_infra", "n_sanctions", F.round(raw, 4).alias("confidence"), band(raw).alias("confidence_band"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(id, relation): the other ends of a node's edges, with repeats."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("id"), "relation")
    return out.unionByName(edges.where(F.col("target") == node).select(F.col("source").alias("id"), "relation"))
