"""Readers, feeds, explorers, exports and streams on small inputs."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veritrail.sources import catalog, exports, feeds, http, onchain, readers
from veritrail.streaming.alerts import near_threshold_counts, watchlist_alerts


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def doc(spark, data):
    return spark.createDataFrame([(data if isinstance(data, str) else json.dumps(data),)], "value string")


def values(df):
    return sorted((r["kind"], r["value"]) for r in df.collect())


def test_text_feeds(spark):
    assert values(feeds.tor_exit_addresses(lines(spark, "ExitNode AB\nExitAddress 1.2.3.4 2026-01-01 00:00:00\nExitAddress nothing"))) == [("ipv4", "1.2.3.4")]
    assert values(feeds.ip_list(lines(spark, "# head\n; note\n\n1.2.3.0/24\n2001:db8::1, x\nnot-an-ip\n5.6.7.8 extra"), "x")) == [("ipv4", "1.2.3.0"), ("ipv4", "2001:db8::1"), ("ipv4", "5.6.7.8")]
    assert values(feeds.feodo_csv(lines(spark, '# c\n"2026-01-01","9.9.9.9","443"'))) == [("ipv4", "9.9.9.9")]
    sha = "A" * 40
    assert values(feeds.sslbl_csv(lines(spark, f"2026-01-01,{sha},bad\n2026-01-01,8.8.4.4,443"))) == [("cert-sha1", sha.lower()), ("ipv4", "8.8.4.4")]
    assert values(feeds.urlhaus_csv(lines(spark, '"1","x","http://bad.example/a"'))) == [("url", "http://bad.example/a")]
    assert values(feeds.threatfox_csv(lines(spark, '"d","7.7.7.7:80"\n"d","https://c2.example"'))) == [("ipv4", "7.7.7.7"), ("url", "https://c2.example")]
    assert values(feeds.raw_urls(lines(spark, "http://a\nftp://b\nhttps://c"))) == [("url", "http://a"), ("url", "https://c")]


def test_document_feeds(spark):
    xml = '<s xmlns="urn:x"><e><id><idType>Digital Currency Address - XBT</idType><idNumber>addr1</idNumber></id><id><idType>Passport</idType><idNumber>p</idNumber></id></e></s>'
    row = feeds.ofac_xml(doc(spark, xml)).first()
    assert (row["value"], row["chain"], row["meta"]) == ("addr1", "bitcoin", {"asset": "XBT"})
    wallets = [{"address": "w", "blockchain": "Bitcoin", "family": "f"}]
    assert values(feeds.ransom_json(doc(spark, {"result": wallets}))) == values(feeds.ransom_json(doc(spark, wallets))) == [("crypto-address", "w")]
    assert values(feeds.kev_json(doc(spark, {"vulnerabilities": [{"cveID": "CVE-1", "product": "p"}]}))) == [("cve", "CVE-1")]
    for parse in (feeds.ofac_xml, feeds.ransom_json, feeds.kev_json):
        assert parse(doc(spark, "not it")).count() == 0


def pays(row):
    return [[(p["address"], p["value"]) for p in row[side]] for side in ("inputs", "outputs")]


def test_explorers(spark):
    tx = {"txid": "t", "status": {"block_time": 5}, "vin": [{"prevout": {"scriptpubkey_address": "a", "value": 150000000}}, {"prevout": None}], "vout": [{"scriptpubkey_address": "b", "value": 1}]}
    assert pays(onchain.esplora(doc(spark, [tx])).first()) == [[("a", 1.5)], [("b", 1e-08)]]
    wei = {"result": [{"hash": "h", "from": "a", "to": "b", "value": "2000000000000000000", "timeStamp": "7"}, {"hash": "i", "from": "a", "to": None, "value": "bad", "timeStamp": "7"}]}
    assert [pays(r) for r in onchain.blockscout(doc(spark, wei)).collect()] == [[[("a", 2.0)], [("b", 2.0)]], [[("a", 0.0)], []]]
    block = {"result": {"timestamp": "0x10", "transactions": [{"hash": "h", "from": "a", "to": "b", "value": hex(3 * 10**20)}]}}
    row = onchain.evm_block(doc(spark, block)).first()
    assert pays(row) == [[("a", 300.0)], [("b", 300.0)]] and row["ts"] == "16"
    sol = {"result": {"blockTime": 1, "meta": {"preBalances": [10**9, 0, 5], "postBalances": [0, 10**9, 5]}, "transaction": {"signatures": ["s"], "message": {"accountKeys": ["a", "b", "c"]}}}}
    assert pays(onchain.solana_tx(doc(spark, sol)).first()) == [[("a", 1.0)], [("b", 1.0)]]
    assert onchain.solana_signatures(doc(spark, {"result": [{"signature": "s", "slot": 1}]})).first()["signature"] == "s"
    raw = {"txs": [{"hash": "h", "time": 1, "inputs": [{"prev_out": {"addr": "a", "value": 10**8}}], "out": [{"addr": "b", "value": 10**8}]}]}
    assert pays(onchain.raw_address(doc(spark, raw)).first()) == [[("a", 1.0)], [("b", 1.0)]]
    trx = {"data": [{"txID": "t", "block_timestamp": 1, "raw_data": {"contract": [{"parameter": {"value": {"owner_address": "a", "to_address": "b", "amount": 1500000}}}]}}]}
    assert pays(onchain.tron(doc(spark, trx)).first()) == [[("a", 1.5)], [("b", 1.5)]]
    xrp = {"result": {"transactions": [{"tx": {"hash": "h", "date": 1, "Account": "a", "Destination": "b", "Amount": "2500000"}}, {"tx_json": {"Account": "a", "Amount": {"value": "1"}}}]}}
    assert [pays(r) for r in onchain.xrpl(doc(spark, xrp)).collect()] == [[[("a", 2.5)], [("b", 2.5)]], [[("a", 0.0)], []]]
    for parse in onchain.PARSERS.values():
        assert parse(doc(spark, "nonsense")).count() == 0


def test_catalog(spark):
    rows = catalog.rows()
    assert (len(rows), sum(r[4] for r in rows), sum(r[8] for r in rows), len({c for r in rows for c in r[2]})) == (61, 59, 46, 17)
    assert catalog.get_source("cisa_kev")["parser"] == "cisa_kev_json"
    with pytest.raises(KeyError):
        catalog.get_source("nothing")


class Replies:
    """A client that answers from a table."""

    def __init__(self, **by_name):
        self.by_url = {catalog.get_source(n)["url"]: v for n, v in by_name.items()}

    def get(self, url):
        if url not in self.by_url:
            raise RuntimeError("no reply")
        return self.by_url[url].encode()


def test_intel(spark):
    client = Replies(tor_exit_addresses="ExitAddress 1.2.3.4 x", tor_bulk_exitlist="1.2.3.4\n5.6.7.8", urlhaus='"1","http://bad"')
    found, errors = http.build_intel(spark, client)
    assert {r["bucket"]: r["n"] for r in feeds.summary(found).collect()} == {"tor_exits": 2, "malicious_urls": 1}
    assert len(errors) == 6
    with pytest.raises(RuntimeError):
        http.build_intel(spark, client, on_error="raise")


def test_offline_cache(tmp_path):
    client = http.HttpClient(str(tmp_path), offline=True)
    with pytest.raises(RuntimeError):
        client.get("http://nowhere.invalid/x")


class Server(BaseHTTPRequestHandler):
    """Signatures and their transactions; a feed that changes with every reply, fails at first, or isn't there."""

    hits: Counter = Counter()

    def log_message(self, *args):
        pass

    def _reply(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        self.hits[self.path] += 1
        n = self.hits[self.path]
        if self.path == "/flaky" and n < 3:
            self._reply(503, "later")
        elif self.path == "/gone":
            self._reply(404, "no")
        else:
            self._reply(200, f"10.0.0.{n}\n10.0.1.1\n")

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.hits[asked["method"]] += 1
        if asked["method"] == "getSignaturesForAddress":
            self._reply(200, json.dumps({"result": [{"signature": f"s{i}", "slot": i} for i in range(5)][: asked["params"][1]["limit"]]}))
        elif asked["params"] == ["s3", {"encoding": "json", "maxSupportedTransactionVersion": 0}]:
            self._reply(400, "bad")
        else:
            tx = {"blockTime": 1, "meta": {"preBalances": [10**9, 0], "postBalances": [0, 10**9]}, "transaction": {"signatures": [asked["params"][0]], "message": {"accountKeys": ["a", "b"]}}}
            self._reply(200, json.dumps({"result": tx}))


@pytest.fixture
def server(monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Server.hits.clear()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = {"solana_rpc": f"{base}/rpc", "tor_bulk_exitlist": f"{base}/exits", "sslbl_ips": f"{base}/flaky", "urlhaus": f"{base}/gone"}
    known = catalog.get_source
    monkeypatch.setattr(catalog, "get_source", lambda name: known(name) | ({"url": urls[name]} if name in urls else {}))
    yield base
    server.shutdown()


def test_two_phases(spark, tmp_path, server):
    client = http.HttpClient(str(tmp_path), pause=0.01)
    found = http.fetch(spark, "solana_rpc", client, "addr", on_error="skip")
    assert sorted(r["txid"] for r in found.collect()) == ["s0", "s1", "s2", "s4"]
    assert Server.hits["getTransaction"] == 5 and Server.hits["getSignaturesForAddress"] == 1
    with pytest.raises(RuntimeError, match="400"):
        http.fetch(spark, "solana_rpc", client, "addr")
    assert http.fetch(spark, "solana_rpc", client, "addr", limit=2).count() == 2
    before = dict(Server.hits)
    again = http.fetch(spark, "solana_rpc", http.HttpClient(str(tmp_path), offline=True), "addr", limit=2)
    assert sorted(r["txid"] for r in again.collect()) == ["s0", "s1"] and dict(Server.hits) == before


def test_feeds_side_by_side(spark, tmp_path, server):
    client = http.HttpClient(str(tmp_path), pause=0.01)
    names = ["tor_bulk_exitlist", "sslbl_ips", "urlhaus"]
    found, errors = http.build_intel(spark, client, names)
    assert sorted(r["value"] for r in found.collect()) == ["10.0.0.1", "10.0.0.3", "10.0.1.1"] and list(errors) == ["urlhaus"] and "404" in errors["urlhaus"]
    assert Server.hits["/flaky"] == 3 and Server.hits["/gone"] == 1
    # Online, a reply is fetched again and replaces what is cached; offline, nothing is fetched.
    newer, _ = http.build_intel(spark, client, names[:1])
    assert sorted(r["value"] for r in newer.collect()) == ["10.0.0.2", "10.0.1.1"]
    kept, missing = http.build_intel(spark, http.HttpClient(str(tmp_path), offline=True), names[:1] + ["urlhaus"])
    assert sorted(r["value"] for r in kept.collect()) == ["10.0.0.2", "10.0.1.1"] and "offline" in missing["urlhaus"]


def test_readers(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"id": "a", "src": "x", "dst": None, "amount": 5, "timestamp": "2026-01-01T02:00:00Z", "more": 1}, {"id": "b", "src": "x", "timestamp": "bad"}]))
    rows = {r["id"]: r for r in readers.load_transfers(spark, str(tmp_path / "l.json")).collect()}
    assert rows["a"]["ts_micros"] == 1767232800000000 and rows["b"]["ts_micros"] == 0 and rows["b"]["ordinal"] == 1
    (tmp_path / "t.json").write_text(json.dumps([{"txid": "t", "inputs": [{"address": "a", "value": 1}], "outputs": []}]))
    assert readers.load_transactions(spark, str(tmp_path / "t.json")).first()["inputs"][0]["address"] == "a"
    (tmp_path / "bad.json").write_text("{")
    assert readers.load_sdn(spark, str(tmp_path / "bad.json")).count() == 0


def test_times(spark):
    from veritrail.functions.scalars import parse_micros

    cases = {"2026-01-01T00:00:00Z": 0, "2026-01-01T02:00:00+02:00": 0, "2026-01-01 00:00:01": 1, "2026-01-01": 0, "2026-01-01T00:00:00Z trailing": 0, "2026-01-01 and more": 0, "bad": None, "now": None, "": None, None: None, "2026-13-01": None}
    got = {r["t"]: r["m"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_micros(F.col("t")).alias("m")).collect()}
    assert got == {k: None if v is None else 1767225600000000 + v * 1000000 for k, v in cases.items()}


def test_exports(spark, tmp_path):
    findings = spark.createDataFrame([("finding--1", "structuring", ["<b>", "it's"], 0.9, "HIGH", "{}")], "id string, typology string, entities array<string>, score double, severity string, features string")
    objects = [json.loads(r["object"]) for r in exports.stix_objects(findings).collect()]
    assert sorted(o["type"] for o in objects) == ["identity", "indicator", "note"]
    assert [o for o in objects if o["type"] == "note"][0]["object_refs"] == [o["id"] for o in objects if o["type"] == "indicator"]
    exports.findings_csv(findings, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["entities"] == "<b>|it's"
    made = {"summary": {"case": "<script>"}, "entity_risk": [], "network_risk": [], "brokers": [], "findings": [{"typology": "t", "entities": ["<b>"], "score": 0.5, "severity": "LOW", "features": "{}"}], "merges": []}
    page = exports.render_html(made)
    assert "<script>" not in page and "<b>" not in page and "http" not in page
    assert "none above" in exports.render_text(made)


def test_streams(spark, tmp_path):
    rows = [(f"t{i}", "a", "x", 9500.0, f"2026-01-01 0{i}:00:00") for i in range(4)]
    df = spark.createDataFrame(rows, "id string, src string, dst string, amount double, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("seen", watchlist_alerts(stream, spark.createDataFrame([("x",)], "entity string"))), ("near", near_threshold_counts(stream))):
        query = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "seen" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("seen").count() == 4
    assert spark.table("near").agg(F.max("n")).first()[0] == 4
