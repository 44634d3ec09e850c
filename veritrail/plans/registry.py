"""Queries over the standard tables, and the DuckDB SQL of those that SQL can express."""

from veritrail.plans import chain_queries, feed_queries, function_queries, graph_queries, ledger_queries, risk_queries, source_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (ledger_queries, graph_queries, chain_queries, risk_queries, feed_queries, source_queries, function_queries, stream_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
