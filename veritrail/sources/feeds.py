"""Threat-intelligence feeds as indicators (kind, value, source, chain, tags, meta), and their union.

Text feeds are (value) rows, a line each; JSON and XML feeds (value) rows, a document each. All parsing is by column
expressions. Malformed input gives no rows.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

INDICATOR = "kind string, value string, source string, chain string, tags array<string>, meta map<string,string>"
#: Chains by the asset codes of sanctions lists (fixed values).
ASSET_CHAIN = {
    "XBT": "bitcoin", "BTC": "bitcoin", "ETH": "ethereum", "USDT": "ethereum", "USDC": "ethereum", "XMR": "monero", "LTC": "litecoin", "BCH": "bitcoin-cash",
    "BSV": "bitcoin-sv", "DASH": "dash", "ZEC": "zcash", "TRX": "tron", "XRP": "xrpl", "ARB": "arbitrum", "BASE": "base", "SOL": "solana",
}


@F.pandas_udf(BooleanType())
def is_ip(tokens: pd.Series) -> pd.Series:
    """IPv4 or IPv6 addresses."""

    def one(t) -> bool:
        try:
            ipaddress.ip_address(t)
        except ValueError:
            return False
        return t is not None

    return tokens.map(one)


def indicators(rows: DataFrame, kind: Column | str, value: Column, source: str, tags: list[str], chain: Column | None = None, meta: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    meta = F.create_map().cast("map<string,string>") if meta is None else meta
    tag_array = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    return rows.select(kind.alias("kind"), value.alias("value"), F.lit(source).alias("source"), (F.lit("") if chain is None else chain).alias("chain"), tag_array.alias("tags"), meta.alias("meta")).where("value is not null and value <> ''")


def ofac_xml(docs: DataFrame, source: str = "ofac_sdn") -> DataFrame:
    """Digital currency addresses of a sanctions list: id elements whose type says so, in any name space."""
    ids = docs.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?id>(.*?)</(?:\w+:)?id>"), F.lit(1))).alias("e"))
    part = lambda name: F.trim(F.regexp_extract("e", rf"(?s)<(?:\w+:)?{name}>(.*?)</", 1))
    ids = ids.select(part("idType").alias("t"), part("idNumber").alias("n")).where("lower(t) like 'digital currency address%' and n <> ''")
    asset = F.upper(F.trim(F.element_at(F.split("t", "-"), -1)))
    chains = F.create_map(*[F.lit(x) for kv in ASSET_CHAIN.items() for x in kv])
    return indicators(ids, "crypto-address", F.col("n"), source, ["sanctions", "ofac"], F.coalesce(chains[asset], F.lit("")), F.create_map(F.lit("asset"), asset))


def tor_exit_addresses(lines: DataFrame, source: str = "tor_exit_addresses") -> DataFrame:
    words = F.split(F.trim("value"), r"\s+")
    found = lines.where("value like 'ExitAddress%'").select(F.get(words, F.lit(1)).alias("ip")).where("ip is not null")
    return indicators(found.where(is_ip("ip")), "ipv4", F.col("ip"), source, ["tor-exit", "tor"])


def ip_list(lines: DataFrame, source: str, tags: list[str] | None = None) -> DataFrame:
    """One address a line; comments, further columns and prefix lengths are dropped."""
    line = F.trim("value")
    token = F.substring_index(F.substring_index(F.get(F.split(line, r"\s+"), F.lit(0)), ",", 1), "/", 1)
    found = lines.where((line != "") & ~line.startswith("#") & ~line.startswith(";")).select(token.alias("ip"))
    return indicators(found.where(is_ip("ip")), "ipv4", F.col("ip"), source, tags or ["blocklist"])


def tor_bulk(lines: DataFrame, source: str = "tor_bulk_exitlist") -> DataFrame:
    return ip_list(lines, source, ["tor-exit", "tor"])


def _cells(lines: DataFrame) -> DataFrame:
    """(row, at, cell) of comma-separated lines without comments; cells are unquoted and trimmed."""
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).withColumn("row", F.monotonically_increasing_id())
    cells = F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]+)'), F.lit(1))
    return rows.select("row", F.posexplode(F.transform(cells, lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))).alias("at", "cell"))


def _first(cells: DataFrame, kind: Column) -> DataFrame:
    """The first cell of each row that is of some kind."""
    return cells.withColumn("kind", kind).where("kind is not null").groupBy("row").agg(F.min(F.struct("at", "kind", "cell")).alias("f")).select("f.kind", "f.cell")


def _url(cell: Column) -> Column:
    return cell.startswith("http://") | cell.startswith("https://")


def feodo_csv(lines: DataFrame, source: str = "feodo_ipblocklist") -> DataFrame:
    return indicators(_first(_cells(lines), F.when(is_ip("cell"), "ipv4")), "ipv4", F.col("cell"), source, ["c2", "botnet"])


def sslbl_csv(lines: DataFrame, source: str = "sslbl_certs") -> DataFrame:
    sha = F.col("cell").rlike("^[a-fA-F0-9]{40}$")
    found = _first(_cells(lines), F.when(sha, "cert-sha1").when(is_ip("cell"), "ipv4"))
    value = F.when(F.col("kind") == "cert-sha1", F.lower("cell")).otherwise(F.col("cell"))
    return indicators(found, F.col("kind"), value, source, ["c2", "ssl"])


def urlhaus_csv(lines: DataFrame, source: str = "urlhaus") -> DataFrame:
    return indicators(_first(_cells(lines), F.when(_url(F.col("cell")), "url")), "url", F.col("cell"), source, ["malware"])


def threatfox_csv(lines: DataFrame, source: str = "threatfox") -> DataFrame:
    cells = _cells(lines).withColumn("host", F.when(F.col("cell").contains(":"), F.substring_index("cell", ":", 1)))
    kind = F.when(F.col("cell").startswith("http"), "url").when(F.col("host").isNotNull() & is_ip("host"), "ipv4")
    found = _first(cells, kind)
    return indicators(found, F.col("kind"), F.when(F.col("kind") == "ipv4", F.substring_index("cell", ":", 1)).otherwise(F.col("cell")), source, ["c2", "ioc"])


def raw_urls(lines: DataFrame, source: str = "raw_urls", tags: list[str] | None = None) -> DataFrame:
    found = lines.select(F.trim("value").alias("u")).where(_url(F.col("u")))
    return indicators(found, "url", F.col("u"), source, tags or ["phishing"])


def ransom_json(docs: DataFrame, source: str = "ransomwhere") -> DataFrame:
    """A list of wallets, bare or under ``result``."""
    item = "array<struct<address:string,blockchain:string,family:string>>"
    listed = F.coalesce(F.from_json("value", f"struct<result:{item}>")["result"], F.from_json("value", item))
    found = docs.select(F.explode(listed).alias("r")).select("r.*").where("address is not null")
    return indicators(found, "crypto-address", F.col("address"), source, ["ransomware", "sanctions"], F.lower(F.coalesce("blockchain", F.lit(""))), F.create_map(F.lit("family"), F.coalesce("family", F.lit(""))))


def kev_json(docs: DataFrame, source: str = "cisa_kev") -> DataFrame:
    found = docs.select(F.explode(F.from_json("value", "struct<vulnerabilities:array<struct<cveID:string,product:string>>>")["vulnerabilities"]).alias("v")).select("v.*")
    return indicators(found, "cve", F.col("cveID"), source, ["exploited"], None, F.create_map(F.lit("product"), F.coalesce("product", F.lit(""))))


#: Parsers of indicators by name, and whether they take lines.
PARSERS: dict[str, tuple[Callable[[DataFrame, str], DataFrame], bool]] = {
    "ofac_sdn_xml": (ofac_xml, False),
    "tor_exit_addresses": (tor_exit_addresses, True),
    "tor_bulk_exitlist": (tor_bulk, True),
    "raw_iplist": (ip_list, True),
    "feodo_csv": (feodo_csv, True),
    "sslbl_csv": (sslbl_csv, True),
    "urlhaus_csv": (urlhaus_csv, True),
    "threatfox_csv": (threatfox_csv, True),
    "ransomwhere_json": (ransom_json, False),
    "cisa_kev_json": (kev_json, False),
    "raw_urls": (raw_urls, True),
}


def dedupe(rows: DataFrame, order: Column) -> DataFrame:
    """One indicator for each kind, value (in any case) and chain: the first in ``order``, with the tags of all."""
    keyed = rows.withColumns({"__key": F.lower("value"), "__at": order})
    per = keyed.groupBy("kind", "__key", "chain").agg(F.min(F.struct("__at", "value", "source")).alias("f"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("all"), F.min_by("tags", "__at").alias("own"), F.min_by("meta", "__at").alias("meta"))
    return per.select("kind", "f.value", "f.source", "chain", F.when(F.col("n") > 1, F.col("all")).otherwise(F.col("own")).alias("tags"), "meta")


def classify(rows: DataFrame) -> DataFrame:
    """Indicators with the one ``bucket`` that they fall in, the first that fits, or null."""
    has = lambda t: F.array_contains("tags", t)
    kind = F.col("kind")
    bucket = F.when((kind == "crypto-address") & (has("sanctions") | has("ransomware")), "sanctioned_addresses").when((kind == "ipv4") & has("tor-exit"), "tor_exits").when((kind == "ipv4") & has("c2"), "c2_ips")
    return rows.withColumn("bucket", bucket.when(kind == "cert-sha1", "malicious_certs").when(kind == "url", "malicious_urls").when(kind == "cve", "cves"))


def summary(classified: DataFrame) -> DataFrame:
    """(bucket, n): distinct values, addresses and certificates in any case."""
    value = F.when(F.col("bucket").isin("sanctioned_addresses", "malicious_certs"), F.lower("value")).otherwise(F.col("value"))
    return classified.where("bucket is not null").groupBy("bucket").agg(F.countDistinct(value).alias("n"))
