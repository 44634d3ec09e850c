"""The catalog of public sources: where each is, what it yields, and which parser reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.sources import feeds, onchain

# name|category|chains|url|keyless|yields|parser|documentation
_ROWS = """
ofac_sdn|sanctions||https://www.treasury.gov/ofac/downloads/sdn.xml|yes|crypto-address|ofac_sdn_xml|https://ofac.treasury.gov
ofac_consolidated|sanctions||https://www.treasury.gov/ofac/downloads/consolidated/consolidated.xml|yes|crypto-address|ofac_sdn_xml|https://ofac.treasury.gov
opensanctions_crypto|sanctions||https://data.opensanctions.org/datasets/latest/crypto/targets.simple.csv|yes|crypto-address|raw_json|https://www.opensanctions.org/datasets/crypto/
ransomwhere|sanctions|bitcoin,ethereum,monero|https://api.ransomwhe.re/export|yes|crypto-address|ransomwhere_json|https://ransomwhe.re
cryptoscamdb|sanctions|ethereum,bitcoin|https://api.cryptoscamdb.org/v1/addresses|yes|crypto-address|raw_json|https://cryptoscamdb.org
chainabuse_public|sanctions|bitcoin,ethereum|https://www.chainabuse.com|no|crypto-address|raw_json|https://www.chainabuse.com
tor_exit_addresses|tor-infra||https://check.torproject.org/exit-addresses|yes|ipv4|tor_exit_addresses|https://metrics.torproject.org
tor_bulk_exitlist|tor-infra||https://check.torproject.org/torbulkexitlist|yes|ipv4|tor_bulk_exitlist|https://metrics.torproject.org
onionoo_details|tor-infra||https://onionoo.torproject.org/details|yes|ipv4|raw_json|https://metrics.torproject.org/onionoo.html
dan_torlist|tor-infra||https://www.dan.me.uk/torlist/|yes|ipv4|raw_iplist|https://www.dan.me.uk/tornodes
feodo_ipblocklist|threat-intel||https://feodotracker.abuse.ch/downloads/ipblocklist.csv|yes|ipv4|feodo_csv|https://feodotracker.abuse.ch
feodo_recommended|threat-intel||https://feodotracker.abuse.ch/downloads/ipblocklist_recommended.txt|yes|ipv4|raw_iplist|https://feodotracker.abuse.ch
sslbl_certs|threat-intel||https://sslbl.abuse.ch/blacklist/sslblacklist.csv|yes|cert-sha1|sslbl_csv|https://sslbl.abuse.ch
sslbl_ips|threat-intel||https://sslbl.abuse.ch/blacklist/sslipblacklist.csv|yes|ipv4|sslbl_csv|https://sslbl.abuse.ch
urlhaus|threat-intel||https://urlhaus.abuse.ch/downloads/csv_recent/|yes|url|urlhaus_csv|https://urlhaus.abuse.ch
threatfox|threat-intel||https://threatfox.abuse.ch/export/csv/recent/|yes|ioc|threatfox_csv|https://threatfox.abuse.ch
firehol_level1|threat-intel||https://raw.githubusercontent.com/firehol/blocklist-ipsets/master/firehol_level1.netset|yes|ipv4|raw_iplist|https://iplists.firehol.org
cins_badguys|threat-intel||https://cinsscore.com/list/ci-badguys.txt|yes|ipv4|raw_iplist|https://cinsscore.com
blocklist_de|threat-intel||https://lists.blocklist.de/lists/all.txt|yes|ipv4|raw_iplist|https://www.blocklist.de
emergingthreats_compromised|threat-intel||https://rules.emergingthreats.net/blockrules/compromised-ips.txt|yes|ipv4|raw_iplist|https://rules.emergingthreats.net
spamhaus_drop|threat-intel||https://www.spamhaus.org/drop/drop.txt|yes|ipv4|raw_iplist|https://www.spamhaus.org/drop/
greynoise_riot|threat-intel||https://api.greynoise.io/v3/community/|no|ipv4|raw_json|https://www.greynoise.io
openphish|threat-intel||https://openphish.com/feed.txt|yes|url|raw_urls|https://openphish.com
phishtank|threat-intel||http://data.phishtank.com/data/online-valid.csv|yes|url|urlhaus_csv|https://phishtank.org
dshield_block|threat-intel||https://feeds.dshield.org/block.txt|yes|ipv4|raw_iplist|https://www.dshield.org
talos_blacklist|threat-intel||https://talosintelligence.com/documents/ip-blacklist|yes|ipv4|raw_iplist|https://talosintelligence.com
botvrij_ip|threat-intel||https://www.botvrij.eu/data/ioclist.ip-dst.raw|yes|ipv4|raw_iplist|https://www.botvrij.eu
binarydefense|threat-intel||https://www.binarydefense.com/banlist.txt|yes|ipv4|raw_iplist|https://www.binarydefense.com
greensnow|threat-intel||https://blocklist.greensnow.co/greensnow.txt|yes|ipv4|raw_iplist|https://greensnow.co
un_sc_sanctions|sanctions||https://scsanctions.un.org/resources/xml/en/consolidated.xml|yes|name|raw_json|https://www.un.org/securitycouncil/content/un-sc-consolidated-list
cisa_kev|vuln-intel||https://www.cisa.gov/sites/default/files/feeds/known_exploited_vulnerabilities.json|yes|cve|cisa_kev_json|https://www.cisa.gov/kev
nvd_cve|vuln-intel||https://services.nvd.nist.gov/rest/json/cves/2.0|yes|cve|raw_json|https://nvd.nist.gov
epss|vuln-intel||https://epss.cyentia.com/epss_scores-current.csv.gz|yes|cve|raw_json|https://www.first.org/epss/
mitre_attack|vuln-intel||https://raw.githubusercontent.com/mitre/cti/master/enterprise-attack/enterprise-attack.json|yes|ttp|raw_json|https://attack.mitre.org
btc_esplora|blockchain-explorer|bitcoin|https://blockstream.info/api/address/{addr}/txs|yes|transaction|esplora|https://github.com/Blockstream/esplora
btc_mempool|blockchain-explorer|bitcoin|https://mempool.space/api/address/{addr}/txs|yes|transaction|esplora|https://mempool.space/docs/api
btc_blockchain_info|blockchain-explorer|bitcoin|https://blockchain.info/rawaddr/{addr}|yes|transaction|blockchain_info|https://www.blockchain.com/explorer/api
blockchair_btc|blockchain-explorer|bitcoin|https://api.blockchair.com/bitcoin/dashboards/address/{addr}|yes|transaction|raw_json|https://blockchair.com/api/docs
ltc_esplora|blockchain-explorer|litecoin|https://litecoinspace.org/api/address/{addr}/txs|yes|transaction|esplora|https://litecoinspace.org
bch_blockchair|blockchain-explorer|bitcoin-cash|https://api.blockchair.com/bitcoin-cash/dashboards/address/{addr}|yes|transaction|raw_json|https://blockchair.com/api/docs
doge_blockchair|blockchain-explorer|dogecoin|https://api.blockchair.com/dogecoin/dashboards/address/{addr}|yes|transaction|raw_json|https://blockchair.com/api/docs
eth_cloudflare_rpc|blockchain-explorer|ethereum|https://cloudflare-eth.com|yes|transaction|evm_rpc|https://developers.cloudflare.com/web3/
eth_llamarpc|blockchain-explorer|ethereum|https://eth.llamarpc.com|yes|transaction|evm_rpc|https://llamanodes.com
eth_blockscout|blockchain-explorer|ethereum|https://eth.blockscout.com/api?module=account&action=txlist&address={addr}|yes|transaction|blockscout_txlist|https://docs.blockscout.com
base_blockscout|blockchain-explorer|base|https://base.blockscout.com/api?module=account&action=txlist&address={addr}|yes|transaction|blockscout_txlist|https://docs.blockscout.com
optimism_blockscout|blockchain-explorer|optimism|https://optimism.blockscout.com/api?module=account&action=txlist&address={addr}|yes|transaction|blockscout_txlist|https://docs.blockscout.com
polygon_blockscout|blockchain-explorer|polygon|https://polygon.blockscout.com/api?module=account&action=txlist&address={addr}|yes|transaction|blockscout_txlist|https://docs.blockscout.com
arbitrum_blockscout|blockchain-explorer|arbitrum|https://arbitrum.blockscout.com/api?module=account&action=txlist&address={addr}|yes|transaction|blockscout_txlist|https://docs.blockscout.com
gnosis_blockscout|blockchain-explorer|gnosis|https://gnosis.blockscout.com/api?module=account&action=txlist&address={addr}|yes|transaction|blockscout_txlist|https://docs.blockscout.com
base_rpc|blockchain-explorer|base|https://mainnet.base.org|yes|transaction|evm_rpc|https://docs.base.org
arbitrum_rpc|blockchain-explorer|arbitrum|https://arb1.arbitrum.io/rpc|yes|transaction|evm_rpc|https://docs.arbitrum.io
optimism_rpc|blockchain-explorer|optimism|https://mainnet.optimism.io|yes|transaction|evm_rpc|https://docs.optimism.io
polygon_rpc|blockchain-explorer|polygon|https://polygon-rpc.com|yes|transaction|evm_rpc|https://docs.polygon.technology
bsc_rpc|blockchain-explorer|bsc|https://bsc-dataseed.binance.org|yes|transaction|evm_rpc|https://docs.bnbchain.org
avalanche_rpc|blockchain-explorer|avalanche|https://api.avax.network/ext/bc/C/rpc|yes|transaction|evm_rpc|https://docs.avax.network
solana_rpc|blockchain-explorer|solana|https://api.mainnet-beta.solana.com|yes|transaction|solana_rpc|https://docs.solana.com/api
tron_trongrid|blockchain-explorer|tron|https://api.trongrid.io/v1/accounts/{addr}/transactions|yes|transaction|tron_account_tx|https://developers.tron.network
xrpl_rpc|blockchain-explorer|xrpl|https://s1.ripple.com:51234/|yes|transaction|xrpl_account_tx|https://xrpl.org/account_tx.html
algorand_algonode|blockchain-explorer|algorand|https://mainnet-idx.algonode.cloud/v2/accounts/{addr}/transactions|yes|transaction|raw_json|https://algonode.io
chainid_network|chain-registry||https://chainid.network/chains.json|yes|chain-metadata|raw_json|https://chainid.network
defillama_chains|chain-registry||https://api.llama.fi/v2/chains|yes|chain-metadata|raw_json|https://defillama.com/docs/api
"""
COLUMNS = "name string, category string, chains array<string>, url string, keyless boolean, yields string, parser string, doc string, integrated boolean"
INTEGRATED = {*feeds.PARSERS, *onchain.PARSERS}


def rows() -> list[tuple]:
    out = []
    for line in _ROWS.strip().splitlines():
        name, category, chains, url, keyless, yields, parser, doc = line.split("|")
        out.append((name, category, [c for c in chains.split(",") if c], url, keyless == "yes", yields, parser, doc, parser in INTEGRATED))
    return out


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), COLUMNS)


def get_source(name: str) -> dict:
    """The source of that name; KeyError if there is none."""
    names = [f.split(" ")[0] for f in COLUMNS.split(", ")]
    for row in rows():
        if row[0] == name:
            return dict(zip(names, row, strict=True))
    raise KeyError(name)


def list_sources(sources: DataFrame, category: str | None = None, chain: str | None = None, keyless: bool | None = None, integrated: bool | None = None) -> DataFrame:
    if category is not None:
        sources = sources.where(F.col("category") == category)
    if chain is not None:
        sources = sources.where(F.array_contains("chains", chain))
    if keyless is not None:
        sources = sources.where(F.col("keyless") == keyless)
    if integrated is not None:
        sources = sources.where(F.col("integrated") == integrated)
    return sources


def stats(sources: DataFrame) -> DataFrame:
    """(category, total, keyless, integrated, chains), and a row for all in category ``all``."""
    yes = lambda c: F.sum(F.col(c).cast("long"))
    chains = F.array_sort(F.array_distinct(F.flatten(F.collect_list("chains"))))
    aggregates = [F.count("*").alias("total"), yes("keyless").alias("keyless"), yes("integrated").alias("integrated"), chains.alias("chains")]
    return sources.groupBy("category").agg(*aggregates).unionByName(sources.groupBy(F.lit("all").alias("category")).agg(*aggregates))
