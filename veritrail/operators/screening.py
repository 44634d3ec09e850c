"""Screening of addresses and names against sanctions entries (name, program, aka, addresses, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.names import squeeze

SDN = "name string, program string, aka array<string>, addresses struct<crypto:array<string>>, ordinal long"


def screen_addresses(addresses: DataFrame, sdn: DataFrame) -> DataFrame:
    """(address, listed, sdn_name, program, confidence) of ``addresses`` (address) that are listed, in any case."""
    listed = sdn.select("name", "program", F.explode("addresses.crypto").alias("listed")).withColumn("key", F.lower("listed"))
    known = addresses.select("address").where("address is not null").distinct().withColumn("key", F.lower("address"))
    return known.join(listed, "key").select("address", "listed", F.col("name").alias("sdn_name"), "program", F.lit(1.0).alias("confidence"))


def screen_names(names: DataFrame, sdn: DataFrame) -> DataFrame:
    """(name, matched, sdn_name, program, confidence): names equal to an entry's name or alias but for case and spaces.
    Of input names (name, ordinal) that are equal in this way, the last counts."""
    known = names.where("name is not null").withColumn("key", squeeze(F.col("name"))).groupBy("key").agg(F.max_by("name", "ordinal").alias("name"))
    aka = F.coalesce("aka", F.array().cast("array<string>"))
    listed = sdn.select(F.col("name").alias("sdn_name"), "program", F.explode(F.concat(F.array("name"), aka)).alias("matched")).withColumn("key", squeeze(F.col("matched")))
    return known.join(listed, "key").select("name", "matched", "sdn_name", "program", F.lit(0.85).alias("confidence"))
