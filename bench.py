"""Times the headline queries over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from veritrail.operators import chain, fusion, infra, screening
from veritrail.plans import registry
from veritrail.session import session
from veritrail.sources.readers import path_graph

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
#: Transactions of the large graphs, and of the large fusion.
LARGE, FUSED = (1_000_000, 4_000_000), 160_000
HEADLINE = ["structuring", "pass_through", "trade_value_anomaly", "funnel_account", "burst_velocity", "dormancy_activation", "periodicity", "ledger_pairs", "ledger_degree", "entity_risk", "mixer", "common_input_clusters", "peel_chain", "next_hop", "shell_nominee"]


def fused(spark, txs):
    """The fused graph's nodes and edges, as one frame."""
    none = [spark.createDataFrame([], schema) for schema in (infra.OBSERVATION, fusion.LINKAGE, screening.SDN)]
    nodes, edges = fusion.build_graph(txs, *none)
    return nodes.select("id").unionByName(edges.select(F.col("source").alias("id")))


def main() -> None:
    spark = session("bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(registry.QUERIES["ledger_entities"](spark, SF_DIR))  # starts the workers
    took = {}

    def timed(name, make) -> None:
        began = time.perf_counter()
        run(make())
        took[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: registry.QUERIES[name](spark, SF_DIR))
    for n in (10_000, 40_000):
        txs = path_graph(spark, n).persist()
        txs.count()
        timed(f"path_clusters_{n}", lambda txs=txs: chain.common_input_clusters(txs))
        timed(f"path_mixers_{n}", lambda txs=txs: chain.mixers(txs))
        timed(f"path_peel_{n}", lambda txs=txs: chain.peel_chains(txs))
        timed(f"path_fusion_{n}", lambda txs=txs: fused(spark, txs))
    total = round(sum(took.values()), 3)
    # Beyond what one task solves: contraction and joins, as transactions a second; not in the total.
    for n in LARGE:
        txs = path_graph(spark, n).persist()
        txs.count()
        timed(f"path_clusters_{n}", lambda txs=txs: chain.common_input_clusters(txs))
        txs.unpersist()
    txs = path_graph(spark, FUSED).persist()
    txs.count()
    timed(f"path_fusion_{FUSED}", lambda: fused(spark, txs))
    rate = round(LARGE[-1] / took[f"path_clusters_{LARGE[-1]}"])
    print(json.dumps({"metric": "total seconds of headline queries", "value": total, "unit": "sec", "queries": took, "large_graph_transactions_per_sec": rate, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
