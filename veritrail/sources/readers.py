"""Readers of JSON arrays and Parquet tables into relations with fixed schemas and row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.scalars import epoch_micros
from veritrail.operators.chain import TRANSACTION
from veritrail.operators.fusion import LINKAGE
from veritrail.operators.infra import OBSERVATION
from veritrail.operators.screening import SDN

TRANSFER = "id string, src string, dst string, amount double, timestamp string, currency string, channel string, counterparty_country string, goods_value double"


def _fields(schema: str, *without: str) -> str:
    return ", ".join(f for f in schema.split(", ") if f.split(" ")[0] not in without)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of the JSON array that a file holds, with ``ordinal``, its place. Bad JSON gives no rows.

    A file is one value, so this is for exports that fit a task; larger data come as JSON lines or Parquet.
    """
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("at", "r"))
    return items.select("r.*", F.col("at").cast("long").alias("ordinal"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, split over tasks; ``ordinal`` grows with the place in the input but has gaps."""
    return spark.read.schema(schema).json(path).withColumn("ordinal", F.monotonically_increasing_id())


def load_transfers(spark: SparkSession, path: str) -> DataFrame:
    rows = json_array(spark, path, TRANSFER)
    return rows.withColumn("ts_micros", epoch_micros(F.col("timestamp"))).withColumn("id", F.coalesce("id", F.concat(F.lit("row-"), F.col("ordinal").cast("string"))))


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    rows = json_array(spark, path, "txid string, asset string, timestamp string, " + _fields(TRANSACTION, "txid", "ts", "ordinal"))
    return rows.withColumnRenamed("timestamp", "ts")


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    rows = json_array(spark, path, "ip string, timestamp string, " + _fields(OBSERVATION, "ip", "ts", "ordinal"))
    return rows.withColumnRenamed("timestamp", "ts")


def load_linkages(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, _fields(LINKAGE, "ordinal"))


def load_sdn(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, _fields(SDN, "ordinal"))


def load_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(entity) from a JSON array of names."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("entity")).distinct()


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    """``n`` transactions that each spend two neighbouring addresses: one cluster of n + 1 addresses, as a chain."""
    address = lambda i: F.struct(F.concat(F.lit("a"), F.lpad(i.cast("string"), 9, "0")).alias("address"), F.lit(1.0).alias("value"))
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("t"), i.cast("string")).alias("txid"), F.lit("2026-01-01T00:00:00Z").alias("ts"), F.array(address(i), address(i + 1)).alias("inputs"), F.array(F.struct(F.concat(F.lit("o"), i.cast("string")).alias("address"), F.lit(1.9).alias("value"))).alias("outputs"), i.alias("ordinal"))
