"""Command line: ``python -m veritrail COMMAND``; tables are printed as JSON lines."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators import case, chain, fusion, infra, resolution, risk, screening, traversal
from veritrail.operators.ledger import entities
from veritrail.session import session
from veritrail.sources import catalog, exports, feeds, http, readers
from veritrail.storage import materialize


def _show(df: DataFrame, limit: int | None = None) -> None:
    for row in (df.limit(limit) if limit else df).toJSON().toLocalIterator():
        print(row)


def _ledger(spark, args) -> DataFrame:
    rows = readers.load_transfers(spark, args.ledger)
    if getattr(args, "resolve", False):
        rows = resolution.apply_resolution(rows, resolution.resolve_entities(entities(rows).select(F.col("entity").alias("name"))))
    return rows


def _watch(spark, args) -> DataFrame | None:
    return readers.load_watchlist(spark, args.watchlist) if args.watchlist else None


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veritrail", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, **defaults) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for option in options:
            required = option.endswith("!")
            sub.add_argument(option.rstrip("!"), required=required, default=defaults.get(option.strip("-!").replace("-", "_")))
        return sub

    for name in ("demo", "fuse"):
        add(name, "--transactions!", "--observations!", "--linkages!", "--sdn!", "--stix", "--misp")
    add("cluster-chain", "--transactions!")
    add("trace", "--transactions!", "--seed!", "--direction", "--max-hops", direction="forward", max_hops="4")
    add("detect-mixer", "--transactions!")
    add("infra", "--observations!", "--tor-list")
    add("screen", "--transactions!", "--sdn!")
    add("sources-list", "--category", "--chain")
    add("sources-stats")
    add("sources-fetch", "--name!", "--address", "--limit", "--cache", limit="20", cache=".cache").add_argument("--offline", action="store_true")
    add("sources-intel", "--cache", cache=".cache").add_argument("--offline", action="store_true")
    add("sources-address", "--chain!", "--address!", "--cache", cache=".cache").add_argument("--offline", action="store_true")
    for name in ("typologies", "temporal", "risk", "case"):
        sub = add(name, "--ledger!", "--watchlist", "--top", "--csv", "--json", "--stix", "--html")
        sub.add_argument("--resolve", action="store_true")
        sub.add_argument("--no-resolve", action="store_true")
    for name in ("network", "resolve"):
        add(name, "--ledger!").add_argument("--resolve", action="store_true")
    add("trace-funds", "--ledger!", "--src!", "--dst!", "--max-paths", "--max-len", max_paths="3", max_len="8")
    return top


def _export(findings: DataFrame, args) -> None:
    if args.json:
        exports.findings_json(findings, args.json)
    if args.csv:
        exports.findings_csv(findings, args.csv)
    if args.stix:
        exports.stix_bundle(exports.stix_objects(findings), args.stix)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    command = args.command
    txs = readers.load_transactions(spark, args.transactions) if getattr(args, "transactions", None) else None
    if command in ("demo", "fuse"):
        nodes, edges = fusion.build_graph(txs, readers.load_observations(spark, args.observations), readers.load_linkages(spark, args.linkages), readers.load_sdn(spark, args.sdn))
        nodes, edges = materialize(nodes), materialize(edges)
        members = materialize(fusion.actor_members(nodes, edges))
        actors = materialize(fusion.threat_actors(members))
        print(exports.render_graph_text(exports.graph_report(nodes, edges, actors, members)))
        if args.stix:
            exports.stix_bundle(exports.graph_stix_objects(nodes, edges, actors, members), args.stix)
        if args.misp:
            exports.misp_event(nodes, actors, args.misp)
        if command == "demo":
            for found in (chain.mixers(txs), chain.demix(txs), chain.peel_chains(txs)):
                _show(found)
    elif command == "cluster-chain":
        _show(chain.common_input_clusters(txs).groupBy("cluster").agg(F.array_sort(F.collect_list("address")).alias("addresses")).orderBy("cluster"))
    elif command == "trace":
        _show(chain.trace(txs, args.seed, args.direction, int(args.max_hops)).orderBy("hop", "txid", "source", "target"))
    elif command == "detect-mixer":
        for found in (chain.mixers(txs), chain.demix(txs), chain.peel_chains(txs)):
            _show(found)
    elif command == "infra":
        tor = spark.read.text(args.tor_list).select(F.trim("value").alias("ip")) if args.tor_list else None
        obs = infra.enrich(readers.load_observations(spark, args.observations), tor=tor)
        for found in (obs, infra.fingerprint_clusters(obs), infra.coactivity(obs)):
            _show(found)
    elif command == "screen":
        known = txs.select(F.explode(F.concat("inputs", "outputs")).alias("p")).select("p.address").distinct()
        _show(screening.screen_addresses(known, readers.load_sdn(spark, args.sdn)))
    elif command == "sources-list":
        _show(catalog.list_sources(catalog.catalog(spark), args.category, args.chain))
    elif command == "sources-stats":
        _show(catalog.stats(catalog.catalog(spark)))
    elif command == "sources-fetch":
        _show(http.fetch(spark, args.name, http.HttpClient(args.cache, args.offline), args.address), int(args.limit))
    elif command == "sources-intel":
        found, errors = http.build_intel(spark, http.HttpClient(args.cache, args.offline))
        _show(feeds.summary(found))
        print(errors, file=sys.stderr)
    elif command == "sources-address":
        listed = [r for r in catalog.rows() if args.chain in r[2] and r[5] == "transaction" and r[8]]
        if not listed:
            raise SystemExit(f"no source traces {args.chain}")
        _show(chain.common_input_clusters(http.fetch(spark, listed[0][0], http.HttpClient(args.cache, args.offline), args.address)))
    elif command == "typologies":
        # Shown and exported: worked out once.
        found = materialize(case.run_detectors(_ledger(spark, args), _watch(spark, args), registry=case.LEDGER))
        _show(risk.prioritized(found, int(args.top) if args.top else None))
        _export(found, args)
    elif command == "temporal":
        _show(risk.prioritized(case.run_detectors(_ledger(spark, args), registry=case.TEMPORAL)))
    elif command == "risk":
        rows = _ledger(spark, args)
        found = materialize(case.run_detectors(rows, _watch(spark, args)))
        _show(risk.entity_risk(found).orderBy(F.desc("risk"), "entity"))
        _show(risk.network_risk(found, traversal.components(rows)).orderBy(F.desc("network_risk"), "network_id"))
    elif command == "case":
        made = case.build_case(readers.load_transfers(spark, args.ledger), _watch(spark, args), resolve=not args.no_resolve)
        head = exports.report(made)
        print(exports.render_text(head))
        _export(risk.prioritized(made.findings), args)
        if args.html:
            Path(args.html).write_text(exports.render_html(head))
    elif command == "network":
        rows = _ledger(spark, args)
        for found in (traversal.components(rows), traversal.communities(rows), traversal.top_brokers(rows)):
            _show(found)
    elif command == "resolve":
        _show(resolution.merges(resolution.resolve_entities(entities(_ledger(spark, args)).select(F.col("entity").alias("name")))))
    elif command == "trace-funds":
        _show(traversal.path_of_funds(_ledger(spark, args), args.src, args.dst, int(args.max_paths), int(args.max_len)))
    return 0
