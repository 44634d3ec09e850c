"""Fetching sources: a data source with a partition for each request, so that executors fetch side by side.

A request that fails is tried again and then recorded as an error row; the others' replies stay. Replies are cached in a folder
that, on a cluster, all executors have to share; only offline are they read from there.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritrail.sources import catalog, feeds, onchain
from veritrail.storage import materialize

#: Feeds that an intelligence bundle is made of by default (fixed values).
DEFAULT_FEEDS = ["ofac_sdn", "ransomwhere", "tor_exit_addresses", "tor_bulk_exitlist", "feodo_ipblocklist", "sslbl_certs", "sslbl_ips", "urlhaus", "cisa_kev"]
#: Signatures and account transactions asked for by default (fixed values).
SIGNATURES, ACCOUNT_ROWS = 8, 25
REPLY = "at int, source string, value string, error string"


class HttpClient:
    """GET and POST. Online, replies are fetched and the cache is brought up to date; offline, only what is cached can be had."""

    def __init__(self, cache_dir: str | None = None, offline: bool = False, timeout: float = 30.0, tries: int = 3, pause: float = 0.5) -> None:
        self.cache, self.offline, self.timeout, self.tries, self.pause = Path(cache_dir) if cache_dir else None, offline, timeout, tries, pause

    def _fetch(self, key: str, request: urllib.request.Request) -> bytes:
        place = self.cache / hashlib.sha1(key.encode()).hexdigest() if self.cache else None
        if self.offline:
            if place and place.exists():
                return place.read_bytes()
            raise RuntimeError(f"offline and not cached: {request.full_url}")
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    data = reply.read()
                break
            except urllib.error.HTTPError as error:
                # What the server refuses it refuses again; what it can't do now it may do later.
                if error.code < 500 and error.code != 429 or not left:
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(self.pause * (self.tries - left))
        if place:
            self.cache.mkdir(parents=True, exist_ok=True)
            whole = place.with_suffix(f".{time.time_ns()}")
            whole.write_bytes(data)
            whole.rename(place)
        return data

    def get(self, url: str) -> bytes:
        return self._fetch(url, urllib.request.Request(url))

    def post(self, url: str, payload: dict) -> bytes:
        body = json.dumps(payload, sort_keys=True)
        return self._fetch(f"{url}|{body}", urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"}))


def _asked(client, at: int, source: str, url: str, payload: str | None) -> tuple:
    """A reply's row; the client's errors become its last column."""
    try:
        data = client.post(url, json.loads(payload)) if payload else client.get(url)
        return at, source, data.decode("utf-8", "replace"), None
    except Exception as error:  # recorded, whatever it is: other requests go on
        return at, source, None, f"{type(error).__name__}: {error}"


def reply_source(client) -> type[DataSource]:
    """The data source ``replies``: option ``requests`` is a JSON list of (source, url, payload or null)."""

    class Request(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.requests = json.loads(options["requests"])

        def partitions(self) -> list[InputPartition]:
            return [Request((at, *r)) for at, r in enumerate(self.requests)] or [Request(None)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value is not None:
                yield _asked(client, *partition.value)

    class Replies(DataSource):
        @classmethod
        def name(cls) -> str:
            return "replies"

        def schema(self) -> str:
            return REPLY

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Replies


def replies(spark: SparkSession, requests: list[tuple], client) -> DataFrame:
    """(at, source, value, error) of the requests (source, url, payload), fetched once."""
    spark.dataSource.register(reply_source(client))
    return materialize(spark.read.format("replies").option("requests", json.dumps(requests)).load())


def follow_up(asked: DataFrame, client) -> DataFrame:
    """(at, source, value, error) of requests that earlier replies led to (at, source, url, payload): a task for each, in the
    same plan as what they come from. Run it once, as :func:`fetch` does by writing it."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([_asked(client, *row) for row in batch.itertuples(index=False)], columns=["at", "source", "value", "error"])

    return asked.select("at", "source", "url", "payload").repartition(64, "at").mapInPandas(run, REPLY)


def _rpc(method: str, params: list) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})


def lines(documents: DataFrame) -> DataFrame:
    """(value) a line each."""
    return documents.select(F.explode(F.split(F.regexp_replace("value", r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r")).alias("value"))


def _good(found: DataFrame, on_error: str) -> DataFrame:
    """Replies without errors; the first error is raised unless they are to be skipped."""
    if on_error == "raise" and (bad := found.where("error is not null").orderBy("at").first()):
        raise RuntimeError(f"{bad['source']}: {bad['error']}")
    return found.where("error is null").select("value")


def fetch(spark: SparkSession, name: str, client, address: str | None = None, block: str = "latest", limit: int | None = None, on_error: str = "raise") -> DataFrame:
    """A source's indicators, or its transactions for an address; (value) as it came where nothing parses it."""
    source = catalog.get_source(name)
    url, parser, chain = source["url"], source["parser"], (source["chains"] or [""])[0]
    if (("{addr}" in url) or parser in ("solana_rpc", "xrpl_account_tx")) and not address:
        raise ValueError(f"source {name} requires an address")
    url = url.replace("{addr}", address or "")
    one = lambda payload=None: _good(replies(spark, [(name, url, payload)], client), on_error)
    if parser == "evm_rpc":
        return onchain.evm_block(one(_rpc("eth_getBlockByNumber", [block, True])), chain)
    if parser == "solana_rpc":
        most = limit or SIGNATURES
        signatures = onchain.solana_signatures(one(_rpc("getSignaturesForAddress", [address, {"limit": most}]))).where("signature is not null and signature <> ''").limit(most)
        how = F.struct(F.lit("json").alias("encoding"), F.lit(0).alias("maxSupportedTransactionVersion"))
        params = F.concat(F.lit("["), F.to_json(F.array("signature")).substr(F.lit(2), F.length(F.to_json(F.array("signature"))) - 2), F.lit(","), F.to_json(how), F.lit("]"))
        payload = F.concat(F.lit('{"jsonrpc":"2.0","id":1,"method":"getTransaction","params":'), params, F.lit("}"))
        asked = signatures.select(F.monotonically_increasing_id().cast("int").alias("at"), F.lit(name).alias("source"), F.lit(url).alias("url"), payload.alias("payload"))
        return onchain.solana_tx(_good(materialize(follow_up(asked, client)), on_error))
    if parser == "xrpl_account_tx":
        asked = {"account": address, "limit": limit or ACCOUNT_ROWS, "ledger_index_min": -1, "ledger_index_max": -1}
        return onchain.xrpl(one(json.dumps({"method": "account_tx", "params": [asked]})), chain)
    if parser in onchain.PARSERS:
        return onchain.PARSERS[parser](one(), chain)
    if parser in feeds.PARSERS:
        parse, by_line = feeds.PARSERS[parser]
        return parse(lines(one()) if by_line else one(), name)
    return one()


def build_intel(spark: SparkSession, client, names: list[str] | None = None, on_error: str = "skip") -> tuple[DataFrame, dict[str, str]]:
    """(indicators with their bucket, errors by source) of several feeds, fetched side by side."""
    names = names or DEFAULT_FEEDS
    sources = {name: catalog.get_source(name) for name in names}
    errors = {name: "requires an address" for name, s in sources.items() if "{addr}" in s["url"]}
    got = replies(spark, [(name, s["url"], None) for name, s in sources.items() if name not in errors], client)
    # A row a source.
    errors |= {r["source"]: r["error"] for r in got.where("error is not null").collect()}
    if errors and on_error == "raise":
        raise RuntimeError("; ".join(f"{name}: {error}" for name, error in errors.items()))
    out = spark.createDataFrame([], feeds.INDICATOR + ", at int")
    for at, name in enumerate(names):
        parse, by_line = feeds.PARSERS.get(sources[name]["parser"], (None, False))
        if parse is not None and name not in errors:
            own = got.where((F.col("source") == name) & F.col("error").isNull()).select("value")
            out = out.unionByName(parse(lines(own) if by_line else own, name).withColumn("at", F.lit(at)))
    order = F.struct("at", F.monotonically_increasing_id())
    return feeds.classify(feeds.dedupe(out, order)), errors
