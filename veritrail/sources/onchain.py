"""Explorer and node replies, a JSON document a row in ``value``, as transactions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_PAY = "array<struct<address:string,value:double>>"


@F.pandas_udf(DoubleType())
def hex_amount(texts: pd.Series) -> pd.Series:
    """Whole numbers of any length, hexadecimal after 0x; anything else is 0."""

    def one(t) -> float:
        try:
            return float(int(t, 16) if t.startswith("0x") else int(t))
        except (AttributeError, ValueError):
            return 0.0

    return texts.map(one)


def _one(address: Column, value: Column) -> Column:
    """A list of one payment, or of none where there is no address."""
    return F.when(address.isNotNull() & (address != ""), F.array(F.struct(address.alias("address"), value.alias("value")))).otherwise(F.array().cast(_PAY))


def _many(items: Column, address, value, scale: float, places: int = 8) -> Column:
    paid = F.transform(items, lambda i: F.struct(address(i).alias("address"), F.round(F.coalesce(value(i), F.lit(0)).cast("double") / scale, places).alias("value")))
    return F.coalesce(F.filter(paid, lambda p: p["address"].isNotNull() & (p["address"] != "")), F.array().cast(_PAY))


def _transactions(rows: DataFrame, txid: Column, chain: str, ts: Column, inputs: Column, outputs: Column) -> DataFrame:
    return rows.select(txid.alias("txid"), F.lit(chain).alias("asset"), ts.cast("string").alias("ts"), inputs.alias("inputs"), outputs.alias("outputs"))


def _each(docs: DataFrame, schema: str, path: str | None) -> DataFrame:
    parsed = F.from_json("value", schema)
    for field in (path or "").split("."):
        parsed = parsed[field] if field else parsed
    return docs.select(F.explode(parsed).alias("t"))


def esplora(docs: DataFrame, chain: str = "bitcoin") -> DataFrame:
    out = "struct<scriptpubkey_address:string,value:bigint>"
    rows = _each(docs, f"array<struct<txid:string,status:struct<block_time:bigint>,vin:array<struct<prevout:{out}>>,vout:array<{out}>>>", None)
    ins = _many(F.col("t.vin"), lambda i: i["prevout"]["scriptpubkey_address"], lambda i: i["prevout"]["value"], 1e8)
    outs = _many(F.col("t.vout"), lambda i: i["scriptpubkey_address"], lambda i: i["value"], 1e8)
    return _transactions(rows, F.col("t.txid"), chain, F.col("t.status.block_time"), ins, outs)


def blockscout(docs: DataFrame, chain: str = "ethereum") -> DataFrame:
    rows = _each(docs, "struct<result:array<struct<hash:string,`from`:string,`to`:string,value:string,timeStamp:string>>>", "result")
    value = F.round(F.coalesce(F.expr("try_cast(t.value as decimal(38,0))"), F.lit(0)).cast("double") / 1e18, 8)
    ts = F.coalesce(F.expr("try_cast(t.timeStamp as bigint)"), F.lit(0))
    return _transactions(rows, F.col("t.hash"), chain, ts, _one(F.col("t.from"), value), _one(F.col("t.to"), value))


def evm_block(docs: DataFrame, chain: str = "ethereum") -> DataFrame:
    # Python sees a block's time once, and a block isn't held by each of its transactions.
    schema = "struct<result:struct<timestamp:string,transactions:array<struct<hash:string,`from`:string,`to`:string,value:string>>>>"
    parsed = docs.select(F.from_json("value", schema)["result"].alias("b")).select(F.col("b.timestamp").alias("time"), F.col("b.transactions").alias("each")).withColumn("time", hex_amount("time"))
    rows = parsed.select("time", F.explode("each").alias("t")).withColumn("wei", hex_amount("t.value"))
    value = F.round(F.col("wei") / 1e18, 8)
    return _transactions(rows, F.col("t.hash"), chain, F.when(F.col("time") > 0, F.col("time").cast("long")), _one(F.col("t.from"), value), _one(F.col("t.to"), value))


def solana_signatures(docs: DataFrame) -> DataFrame:
    rows = _each(docs, "struct<result:array<struct<signature:string,slot:bigint,blockTime:bigint,err:string>>>", "result")
    return rows.select("t.signature", "t.slot", F.col("t.blockTime").alias("block_time"), "t.err")


def solana_tx(docs: DataFrame, chain: str = "solana") -> DataFrame:
    """One transaction from the changes of balances: what falls is an input, what rises an output."""
    schema = "struct<result:struct<blockTime:bigint,meta:struct<preBalances:array<bigint>,postBalances:array<bigint>>,transaction:struct<signatures:array<string>,message:struct<accountKeys:array<string>>>>>"
    rows = docs.select(F.from_json("value", schema)["result"].alias("r")).where("r is not null")
    # Keys are names, or objects with a pubkey.
    name = lambda k: F.coalesce(F.get_json_object(k, "$.pubkey"), k)
    moves = F.transform(F.arrays_zip(F.col("r.transaction.message.accountKeys").alias("k"), F.col("r.meta.preBalances").alias("a"), F.col("r.meta.postBalances").alias("b")), lambda z: F.struct(name(z["k"]).alias("address"), ((z["b"] - z["a"]).cast("double") / 1e9).alias("value")))
    known = F.filter(moves, lambda m: m["address"].isNotNull() & m["value"].isNotNull())
    ins = F.transform(F.filter(known, lambda m: m["value"] < 0), lambda m: F.struct(m["address"].alias("address"), F.round(-m["value"], 9).alias("value")))
    outs = F.transform(F.filter(known, lambda m: m["value"] > 0), lambda m: F.struct(m["address"].alias("address"), F.round(m["value"], 9).alias("value")))
    return _transactions(rows, F.get("r.transaction.signatures", F.lit(0)), chain, F.col("r.blockTime"), F.coalesce(ins, F.array().cast(_PAY)), F.coalesce(outs, F.array().cast(_PAY)))


def raw_address(docs: DataFrame, chain: str = "bitcoin") -> DataFrame:
    out = "struct<addr:string,value:bigint>"
    rows = _each(docs, f"struct<txs:array<struct<hash:string,time:bigint,inputs:array<struct<prev_out:{out}>>,`out`:array<{out}>>>>", "txs")
    ins = _many(F.col("t.inputs"), lambda i: i["prev_out"]["addr"], lambda i: i["prev_out"]["value"], 1e8)
    return _transactions(rows, F.col("t.hash"), chain, F.col("t.time"), ins, _many(F.col("t.out"), lambda i: i["addr"], lambda i: i["value"], 1e8))


def tron(docs: DataFrame, chain: str = "tron") -> DataFrame:
    rows = _each(docs, "struct<data:array<struct<txID:string,block_timestamp:bigint,raw_data:struct<contract:array<struct<parameter:struct<value:struct<owner_address:string,to_address:string,amount:bigint>>>>>>>>", "data")
    rows = rows.select("t.txID", "t.block_timestamp", F.explode("t.raw_data.contract").alias("c")).select("txID", "block_timestamp", "c.parameter.value.*").where("owner_address is not null or to_address is not null")
    value = F.round(F.coalesce("amount", F.lit(0)).cast("double") / 1e6, 6)
    return _transactions(rows, F.col("txID"), chain, F.col("block_timestamp"), _one(F.col("owner_address"), value), _one(F.col("to_address"), value))


def xrpl(docs: DataFrame, chain: str = "xrpl") -> DataFrame:
    tx = "struct<hash:string,date:bigint,Account:string,Destination:string,Amount:string>"
    rows = _each(docs, f"struct<result:struct<transactions:array<struct<tx:{tx},tx_json:{tx}>>>>", "result.transactions").select(F.coalesce("t.tx", "t.tx_json").alias("x")).where("x.Account is not null or x.Destination is not null")
    # Amounts in drops are digits; issued currencies are objects and count 0.
    value = F.round(F.coalesce(F.expr("try_cast(x.Amount as bigint)"), F.lit(0)).cast("double") / 1e6, 6)
    return _transactions(rows, F.col("x.hash"), chain, F.col("x.date"), _one(F.col("x.Account"), value), _one(F.col("x.Destination"), value))


PARSERS = {"esplora": esplora, "blockscout_txlist": blockscout, "evm_rpc": evm_block, "blockchain_info": raw_address, "tron_account_tx": tron, "xrpl_account_tx": xrpl, "solana_rpc": solana_tx}
