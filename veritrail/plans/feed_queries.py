"""Indicator and catalog queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.sources import catalog, feeds
from veritrail.plans.views import table


def page_indicators(s, d):
    """Page addresses as indicators, three spellings of some, with tags by page."""
    rows = table(s, d, "pages").select("page_id", F.concat(F.lit("HOST-"), (F.col("page_id") % 40).cast("string")).alias("host"))
    value = F.when(F.col("page_id") % 2 == 0, F.lower("host")).otherwise(F.col("host"))
    kind = F.when(F.col("page_id") % 40 < 10, "crypto-address").when(F.col("page_id") % 40 < 20, "ipv4").when(F.col("page_id") % 40 < 30, "url").otherwise("cve")
    tag = F.when(F.col("page_id") % 3 == 0, "tor-exit").when(F.col("page_id") % 3 == 1, "c2").otherwise("sanctions")
    return rows.select(kind.alias("kind"), value.alias("value"), F.lit("pages").alias("source"), F.lit("").alias("chain"), F.array(tag).alias("tags"), F.create_map().cast("map<string,string>").alias("meta"), "page_id")


def deduped(s, d):
    return feeds.dedupe(page_indicators(s, d), F.col("page_id"))


def part_catalog(s, d):
    """Parts as a catalog of sources: brands as categories, sizes as chains."""
    chain = lambda n: F.concat(F.lit("c"), (F.col("p_size") % n).cast("string"))
    even = lambda c: F.col(c) % 2 == 0
    key = F.col("p_partkey").cast("string")
    return table(s, d, "part").select(key.alias("name"), F.col("p_brand").alias("category"), F.array_distinct(F.array(chain(7), chain(4))).alias("chains"), F.col("p_name").alias("url"), even("p_partkey").alias("keyless"), F.lit("transaction").alias("yields"), F.col("p_type").alias("parser"), F.lit("").alias("doc"), (F.col("p_partkey") % 3 == 0).alias("integrated"))


QUERIES = {
    "indicators_dedupe": lambda s, d: deduped(s, d).select("kind", "value", "chain", F.array_join("tags", ",").alias("tags")),
    "intel_summary": lambda s, d: feeds.summary(feeds.classify(deduped(s, d))),
    "catalog_filter": lambda s, d: catalog.list_sources(part_catalog(s, d), category="Brand#12", chain="c3", keyless=True, integrated=True).select("name", "parser"),
    "catalog_stats": lambda s, d: catalog.stats(part_catalog(s, d)).withColumn("chains", F.array_join("chains", ",")),
}
_PAGES = """p AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'host-' ELSE 'HOST-' END || (page_id % 40) AS value,
         CASE WHEN page_id % 40 < 10 THEN 'crypto-address' WHEN page_id % 40 < 20 THEN 'ipv4' WHEN page_id % 40 < 30 THEN 'url' ELSE 'cve' END AS kind,
         CASE page_id % 3 WHEN 0 THEN 'tor-exit' WHEN 1 THEN 'c2' ELSE 'sanctions' END AS tag FROM pages),
u AS (SELECT kind, arg_min(value, page_id) AS value, list_sort(list_distinct(list(tag))) AS tags FROM p GROUP BY kind, lower(value))"""
_CATALOG = "c AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_brand AS category, ['c' || (p_size % 7), 'c' || (p_size % 4)] AS chains, p_partkey % 2 = 0 AS keyless, p_type AS parser, p_partkey % 3 = 0 AS integrated FROM part)"
_STATS = "count(*) AS total, CAST(sum(CAST(keyless AS INT)) AS BIGINT) AS keyless, CAST(sum(CAST(integrated AS INT)) AS BIGINT) AS integrated, coalesce(array_to_string(list_sort(list_distinct(flatten(list(chains)))), ','), '') AS chains"
ORACLES = {
    "indicators_dedupe": f"WITH {_PAGES} SELECT kind, value, '' AS chain, array_to_string(tags, ',') AS tags FROM u",
    "intel_summary": f"""WITH {_PAGES},
b AS (SELECT value, CASE WHEN kind = 'crypto-address' AND list_contains(tags, 'sanctions') THEN 'sanctioned_addresses' WHEN kind = 'ipv4' AND list_contains(tags, 'tor-exit') THEN 'tor_exits'
      WHEN kind = 'ipv4' AND list_contains(tags, 'c2') THEN 'c2_ips' WHEN kind = 'url' THEN 'malicious_urls' WHEN kind = 'cve' THEN 'cves' END AS bucket FROM u)
SELECT bucket, count(DISTINCT CASE WHEN bucket = 'sanctioned_addresses' THEN lower(value) ELSE value END) AS n FROM b WHERE bucket IS NOT NULL GROUP BY bucket""",
    "catalog_filter": f"WITH {_CATALOG} SELECT name, parser FROM c WHERE category = 'Brand#12' AND list_contains(chains, 'c3') AND keyless AND integrated",
    "catalog_stats": f"WITH {_CATALOG} SELECT category, {_STATS} FROM c GROUP BY category UNION ALL SELECT 'all', {_STATS} FROM c",
}
