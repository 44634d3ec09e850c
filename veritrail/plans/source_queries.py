"""Feed and explorer parsers over raw payloads made from the standard tables, with their oracles.

Customers become lines of text feeds, orders the items of JSON and XML documents, some hundred to a document. The SQL
works the parsed values out from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.plans.views import table
from veritrail.sources import feeds, onchain


def text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lines(s, d, line: Column) -> DataFrame:
    """A line for each customer number ``k`` with an address ``ip``, among comments and empty lines."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    rows = rows.withColumn("ip", text("10.1.", F.floor(F.col("k") / 250) % 250, ".", F.col("k") % 250))
    return rows.select(F.explode(F.array(line, F.when(F.col("k") % 50 == 0, "# a comment"), F.when(F.col("k") % 70 == 0, "   "))).alias("value")).where("value is not null")


def orders(s, d) -> DataFrame:
    """Orders as payments: key, payer, payee, value in cents, seconds, and the document that each is in."""
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return rows.select("k", text("A", F.col("c")).alias("a"), text("B", F.col("k") % 97).alias("b"), "v", (F.col("k") + 1500000000).alias("t"), F.floor(F.col("k") / 400).alias("doc"))


def documents(s, d, item: Column, *path: str) -> DataFrame:
    """(value): JSON documents with their items under ``path``."""
    body = F.collect_list(item)
    for name in reversed(path):
        body = F.struct(body.alias(name))
    return orders(s, d).groupBy("doc").agg(F.to_json(body).alias("value")).select("value")


def found(indicators: DataFrame) -> DataFrame:
    meta = F.array_join(F.map_values("meta"), ",")
    return indicators.select("kind", "value", "source", "chain", F.array_join("tags", ",").alias("tags"), meta.alias("meta"))


def paid(txs: DataFrame) -> DataFrame:
    one = lambda side, field: F.get(F.col(side), F.lit(0))[field]
    return txs.select("txid", "asset", "ts", one("inputs", "address").alias("payer"), one("inputs", "value").alias("paid"), one("outputs", "address").alias("payee"), one("outputs", "value").alias("received"))


def _struct(**fields) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


# Columns of ``lines`` and ``orders``.
K, A, B, V, T, IP = (lambda c=c: F.col(c) for c in ("k", "a", "b", "v", "t", "ip"))
ESPLORA_SIDE = lambda a: _struct(scriptpubkey_address=a, value=V())
RAW_SIDE = lambda a: _struct(addr=a, value=V())
HEX = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))


def esplora(s, d):
    item = _struct(txid=K().cast("string"), status=_struct(block_time=T()), vin=F.array(_struct(prevout=ESPLORA_SIDE(A()))), vout=F.array(ESPLORA_SIDE(B())))
    return paid(onchain.esplora(orders(s, d).groupBy("doc").agg(F.to_json(F.collect_list(item)).alias("value"))))


def solana_documents(s, d) -> DataFrame:
    """A document a payment; account keys are names or objects with one."""
    named = F.when(K() % 2 == 0, F.array(F.to_json(_struct(pubkey=A())), F.to_json(_struct(pubkey=B())))).otherwise(F.array(text('"', A(), '"'), text('"', B(), '"')))
    body = text('{"result":{"blockTime":', T(), ',"meta":{"preBalances":[', V() * 2, ',5],"postBalances":[', V(), ",", V() + 5, ']},"transaction":{"signatures":["', K(), '"],"message":{"accountKeys":[', F.array_join(named, ","), "]}}}}")
    return orders(s, d).select(body.alias("value"))


def sanctions_documents(s, d) -> DataFrame:
    asset = F.when(K() % 3 == 0, "XBT").when(K() % 3 == 1, "eth").otherwise("ZZZ")
    entry = text("<x:id><x:idType>", F.when(K() % 5 == 0, F.lit("Passport")).otherwise(text("Digital Currency Address - ", asset)), "</x:idType><x:idNumber> ", A(), "-", K(), " </x:idNumber></x:id>")
    return orders(s, d).groupBy("doc").agg(F.concat(F.lit("<x:sdnList>"), F.concat_ws("\n", F.collect_list(entry)), F.lit("</x:sdnList>")).alias("value")).select("value")


QUERIES = {
    "feed_sanctions_xml": lambda s, d: found(feeds.ofac_xml(sanctions_documents(s, d))),
    "feed_exit_addresses": lambda s, d: found(feeds.tor_exit_addresses(lines(s, d, F.when(K() % 2 == 0, text("ExitAddress ", IP(), " 2026-01-01")).otherwise(text("ExitNode ", K()))))),
    "feed_exit_list": lambda s, d: found(feeds.tor_bulk(lines(s, d, F.when(K() % 7 == 0, text("host-", K())).otherwise(IP())))),
    "feed_ip_list": lambda s, d: found(feeds.ip_list(lines(s, d, F.when(K() % 3 == 0, text(IP(), "/32")).when(K() % 3 == 1, text("  ", IP(), " seen")).otherwise(text("; ", IP()))), "list")),
    "feed_c2_addresses": lambda s, d: found(feeds.feodo_csv(lines(s, d, text('"', K(), '","', IP(), '","443"')))),
    "feed_certificates": lambda s, d: found(feeds.sslbl_csv(lines(s, d, F.when(K() % 2 == 0, text("2026-01-01,", F.upper(F.sha1(K().cast("string"))), ",c2")).otherwise(text("2026-01-01,", IP(), ",443"))))),
    "feed_malware_urls": lambda s, d: found(feeds.urlhaus_csv(lines(s, d, text('"', K(), '","x","', F.when(K() % 2 == 0, "http").otherwise("https"), "://h", K(), '/a"')))),
    "feed_iocs": lambda s, d: found(feeds.threatfox_csv(lines(s, d, F.when(K() % 2 == 0, text('"t", "', IP(), ':8080"')).otherwise(text('"t", "https://h', K(), '"'))))),
    "feed_phishing_urls": lambda s, d: found(feeds.raw_urls(lines(s, d, F.when(K() % 2 == 0, text(" https://h", K(), " ")).otherwise(text("ftp://h", K()))))),
    "feed_ransom_wallets": lambda s, d: found(feeds.ransom_json(documents(s, d, _struct(address=text(A(), "-", K()), blockchain=F.lit("Bitcoin"), family=F.when(K() % 2 == 0, B())), "result"))),
    "feed_exploited": lambda s, d: found(feeds.kev_json(documents(s, d, _struct(cveID=text("CVE-2026-", K()), product=F.when(K() % 2 == 0, B())), "vulnerabilities"))),
    "explorer_utxo": esplora,
    "explorer_accounts": lambda s, d: paid(onchain.blockscout(documents(s, d, F.struct(K().cast("string").alias("hash"), A().alias("from"), B().alias("to"), text(V(), "0000000000").alias("value"), T().cast("string").alias("timeStamp")), "result"))),
    "explorer_block": lambda s, d: paid(onchain.evm_block(orders(s, d).groupBy("doc").agg(F.to_json(_struct(result=F.struct(HEX(F.max("doc") + 1).alias("timestamp"), F.collect_list(F.struct(K().cast("string").alias("hash"), A().alias("from"), F.when(K() % 2 == 0, B()).alias("to"), HEX(V() * 10000000000).alias("value"))).alias("transactions")))).alias("value")))),
    "explorer_signatures": lambda s, d: onchain.solana_signatures(documents(s, d, _struct(signature=K().cast("string"), slot=V(), blockTime=T(), err=F.when(K() % 2 == 0, F.lit("failed"))), "result")),
    "explorer_balances": lambda s, d: paid(onchain.solana_tx(solana_documents(s, d))),
    "explorer_address": lambda s, d: paid(onchain.raw_address(documents(s, d, F.struct(K().cast("string").alias("hash"), T().alias("time"), F.array(_struct(prev_out=RAW_SIDE(A()))).alias("inputs"), F.array(RAW_SIDE(B())).alias("out")), "txs"))),
    "explorer_contracts": lambda s, d: paid(onchain.tron(documents(s, d, _struct(txID=K().cast("string"), block_timestamp=T(), raw_data=_struct(contract=F.array(_struct(parameter=_struct(value=_struct(owner_address=A(), to_address=B(), amount=V())))))), "data"))),
    "explorer_ledger": lambda s, d: paid(onchain.xrpl(documents(s, d, _struct(tx=_struct(hash=K().cast("string"), date=T(), Account=A(), Destination=B(), Amount=F.when(K() % 2 == 0, V().cast("string")).otherwise("x"))), "result", "transactions"))),
}

_LINES = "c AS (SELECT c_custkey AS k, '10.1.' || (c_custkey // 250 % 250) || '.' || (c_custkey % 250) AS ip FROM customer)"
_ORDERS = "o AS (SELECT o_orderkey AS k, 'A' || o_custkey AS a, 'B' || (o_orderkey % 97) AS b, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderkey + 1500000000 AS t FROM orders)"


def _lines(kind: str, value: str, source: str, tags: str, where: str = "true") -> str:
    return f"WITH {_LINES} SELECT {kind} AS kind, {value} AS value, '{source}' AS source, '' AS chain, '{tags}' AS tags, '' AS meta FROM c WHERE {where}"


def _items(kind: str, value: str, source: str, chain: str, tags: str, meta: str, where: str = "true") -> str:
    return f"WITH {_ORDERS} SELECT '{kind}' AS kind, {value} AS value, '{source}' AS source, {chain} AS chain, '{tags}' AS tags, {meta} AS meta FROM o WHERE {where}"


def _paid(asset: str, scale: str, places: int, ts: str = "CAST(t AS VARCHAR)", payee: str = "b", value: str = "v", received: str | None = None) -> str:
    amount = f"round(CAST({value} AS DOUBLE) / {scale}, {places})"
    return f"WITH {_ORDERS} SELECT CAST(k AS VARCHAR) AS txid, '{asset}' AS asset, {ts} AS ts, a AS payer, {amount} AS paid, {payee} AS payee, {received or amount} AS received FROM o"


ORACLES = {
    "feed_sanctions_xml": _items("crypto-address", "a || '-' || k", "ofac_sdn", "CASE k % 3 WHEN 0 THEN 'bitcoin' WHEN 1 THEN 'ethereum' ELSE '' END", "sanctions,ofac", "CASE k % 3 WHEN 0 THEN 'XBT' WHEN 1 THEN 'ETH' ELSE 'ZZZ' END", "k % 5 <> 0"),
    "feed_exit_addresses": _lines("'ipv4'", "ip", "tor_exit_addresses", "tor-exit,tor", "k % 2 = 0"),
    "feed_exit_list": _lines("'ipv4'", "ip", "tor_bulk_exitlist", "tor-exit,tor", "k % 7 <> 0"),
    "feed_ip_list": _lines("'ipv4'", "ip", "list", "blocklist", "k % 3 <> 2"),
    "feed_c2_addresses": _lines("'ipv4'", "ip", "feodo_ipblocklist", "c2,botnet"),
    "feed_certificates": _lines("CASE WHEN k % 2 = 0 THEN 'cert-sha1' ELSE 'ipv4' END", "CASE WHEN k % 2 = 0 THEN sha1(CAST(k AS VARCHAR)) ELSE ip END", "sslbl_certs", "c2,ssl"),
    "feed_malware_urls": _lines("'url'", "CASE WHEN k % 2 = 0 THEN 'http' ELSE 'https' END || '://h' || k || '/a'", "urlhaus", "malware"),
    "feed_iocs": _lines("CASE WHEN k % 2 = 0 THEN 'ipv4' ELSE 'url' END", "CASE WHEN k % 2 = 0 THEN ip ELSE 'https://h' || k END", "threatfox", "c2,ioc"),
    "feed_phishing_urls": _lines("'url'", "'https://h' || k", "raw_urls", "phishing", "k % 2 = 0"),
    "feed_ransom_wallets": _items("crypto-address", "a || '-' || k", "ransomwhere", "'bitcoin'", "ransomware,sanctions", "CASE WHEN k % 2 = 0 THEN b ELSE '' END"),
    "feed_exploited": _items("cve", "'CVE-2026-' || k", "cisa_kev", "''", "exploited", "CASE WHEN k % 2 = 0 THEN b ELSE '' END"),
    "explorer_utxo": _paid("bitcoin", "1e8", 8),
    "explorer_accounts": _paid("ethereum", "1e8", 8),
    "explorer_block": _paid("ethereum", "1e8", 8, "CAST(k // 400 + 1 AS VARCHAR)", "CASE WHEN k % 2 = 0 THEN b END", received="CASE WHEN k % 2 = 0 THEN round(CAST(v AS DOUBLE) / 1e8, 8) END"),
    "explorer_signatures": f"WITH {_ORDERS} SELECT CAST(k AS VARCHAR) AS signature, v AS slot, t AS block_time, CASE WHEN k % 2 = 0 THEN 'failed' END AS err FROM o",
    "explorer_balances": _paid("solana", "1e9", 9),
    "explorer_address": _paid("bitcoin", "1e8", 8),
    "explorer_contracts": _paid("tron", "1e6", 6),
    "explorer_ledger": _paid("xrpl", "1e6", 6, value="CASE WHEN k % 2 = 0 THEN v ELSE 0 END"),
}
