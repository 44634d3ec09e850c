"""Observations of infrastructure (ip, ts text, cert_sha256, domains, ports, tags, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.scalars import clamp
from veritrail.operators.components import connected_components
from veritrail.operators.risk import numbered
from veritrail.storage import materialize

OBSERVATION = "ip string, ts string, asn string, cert_sha256 string, domains array<string>, ports array<int>, tags array<string>, ordinal long"
#: Tags of services that hide who uses them (fixed values).
ANONYMIZERS = ["tor-exit", "tor", "vpn", "proxy"]
#: Addresses of a block, about.
BLOCK = 1024


def enrich(obs: DataFrame, tor: DataFrame | None = None, vpn: DataFrame | None = None, proxy: DataFrame | None = None) -> DataFrame:
    """Observations with tags of the lists (ip) that hold their address, sorted, and whether any of those hides users."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    out = obs.withColumn("tags", tags)
    for name, known in (("tor-exit", tor), ("vpn", vpn), ("proxy", proxy)):
        if known is not None:
            out = out.join(known.select("ip").distinct().withColumn("__tag", F.array(F.lit(name))), "ip", "left").withColumn("tags", F.concat("tags", F.coalesce("__tag", F.array().cast("array<string>")))).drop("__tag")
    out = out.withColumn("tags", F.array_sort(F.array_distinct("tags")))
    return out.withColumn("anonymized", F.arrays_overlap("tags", F.array(*map(F.lit, ANONYMIZERS))))


def fingerprint_clusters(obs: DataFrame) -> DataFrame:
    """(ip, cluster): addresses that share a certificate or a domain, named by the least."""
    keys = obs.select("ip", F.explode(F.concat(F.array(F.when(F.coalesce("cert_sha256", F.lit("")) != "", F.concat(F.lit("cert:"), "cert_sha256"))), F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: F.concat(F.lit("domain:"), d)))).alias("key")).where("key is not null")
    hub = keys.groupBy("key").agg(F.min("ip").alias("a"))
    edges = keys.join(hub, "key").select("a", F.col("ip").alias("b"))
    return connected_components(edges, obs.select(F.col("ip").alias("node"))).select(F.col("node").alias("ip"), F.col("component").alias("cluster"))


def temporal_signatures(obs: DataFrame) -> DataFrame:
    """(ip, n, active_days, peak_hour, hours as text): when an address is active. Times without a T don't count."""
    timed = obs.where(F.col("ts").contains("T")).select("ip", F.substring_index("ts", "T", 1).alias("day"), F.expr("try_cast(substr(substring_index(ts, 'T', -1), 1, 2) as int)").alias("hour"), "ordinal")
    per = timed.groupBy("ip").agg(F.count("*").alias("n"), F.countDistinct("day").alias("active_days"))
    hours = timed.where("hour is not null").groupBy("ip", "hour").agg(F.count("*").alias("k"), F.min("ordinal").alias("first"))
    peak = hours.groupBy("ip").agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "hour")).alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hour", "k"))), lambda h: F.concat_ws(":", h["hour"].cast("string"), h["k"].cast("string"))), ",").alias("hours"))
    return per.join(peak, "ip", "left").select("ip", "n", "active_days", F.col("p.hour").alias("peak_hour"), "hours")


def coactivity(obs: DataFrame, min_shared_days: int = 2) -> DataFrame:
    """(a, b, shared_days, confidence): pairs of addresses active on the same days.

    Two addresses that share ``min_shared_days`` days share one even when each leaves out all but one of those of its commonest
    days. So addresses meet on their rarer days only, once for each pair (on the rarest day that they share), and the days that
    nearly all have in common make no pairs. Addresses of a day meet by blocks, whose days are bits of words.
    """
    days = materialize(obs.where(F.col("ts").contains("T")).select(F.substring_index("ts", "T", 1).alias("day"), "ip").where("ip is not null").distinct())
    # A row a day: its place in order of how many have it, the rarest first.
    many = days.groupBy("day").agg(F.count("*").alias("n"))
    ranked = numbered(many.select(F.struct("n", "day").alias("component"))).select(F.col("component.day").alias("day"), (F.col("i") - 1).alias("rank"))
    placed = days.join(ranked, "day").select("ip", F.col("rank").cast("int").alias("rank"))
    per = materialize(placed.groupBy("ip").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).where(F.size("ranks") >= min_shared_days))
    rare = per.select("ip", "ranks", F.explode(F.slice("ranks", F.lit(1), F.size("ranks") - (min_shared_days - 1))).alias("rank"))
    parts = rare.groupBy("rank").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = rare.join(parts, "rank").groupBy("rank", F.pmod(F.xxhash64("ip"), F.col("parts")).alias("block"))
    blocks = materialize(blocks.agg(F.collect_list(F.struct("ip", "ranks")).alias("held")))
    a, b = (blocks.select("rank", F.col("block").alias(f"{name}_block"), F.col("held").alias(name)) for name in ("a", "b"))
    # As many tasks as shuffles have, however few bytes the blocks are.
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.join(b, "rank").where("a_block <= b_block").repartition(tasks, "rank", "a_block", "b_block")
    found = both.groupBy("rank", "a_block", "b_block").applyInArrow(_shared(min_shared_days), "a string, b string, shared_days long")
    return found.withColumn("confidence", clamp(F.lit(0.3) + F.lit(0.2) * F.col("shared_days")))


def _shared(least: int):
    """Pairs of two blocks of addresses that share ``least`` days, none of which is rarer than the one where the blocks meet."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(table: pa.Table) -> pa.Table:
        out = []
        for row in range(table.num_rows):
            one = lambda c: table[c][row]  # noqa: B023, E731
            # Lists stay Arrow's: as Python's objects they would cost more than all that is done with them.
            sides = [one(c).values for c in (("a",) if one("a_block") == one("b_block") else ("a", "b"))]
            ranks = [(side.field("ranks").value_lengths().to_numpy(), side.field("ranks").flatten().to_numpy()) for side in sides]
            days = np.unique(np.concatenate([flat for _, flat in ranks]))
            here = int(np.searchsorted(days, one("rank").as_py()))
            # The days of an address as bits of words, the rarest first.
            words = []
            for many, flat in ranks:
                at = np.zeros((many.size, -(-days.size // 64) * 64), dtype=bool)
                at[np.repeat(np.arange(many.size), many), np.searchsorted(days, flat)] = True
                words.append(np.packbits(at, axis=1, bitorder="little").view(np.uint64))
            # Pairs that have met on a rarer day, or that come the other way round: after some days nearly all have.
            shape = len(words[0]), len(words[-1])
            met = np.tri(*shape, dtype=bool) if len(sides) == 1 else np.zeros(shape, bool)
            for w in range(-(-here // 64)):
                rarer = np.uint64((1 << min(here - 64 * w, 64)) - 1)
                met |= ((words[0][:, w] & rarer)[:, None] & words[-1][:, w]) != 0
            i, j = np.nonzero(~met)
            n = sum(np.bitwise_count(words[0][i, w] & words[-1][j, w]).astype(np.int64) for w in range(words[0].shape[1]))
            fits = n >= least
            i, j, n = i[fits], j[fits], n[fits]
            known = pa.concat_arrays([side.field("ip") for side in sides])
            order = np.empty(len(known), dtype=np.int64)
            order[pc.sort_indices(known).to_numpy()] = np.arange(len(known))
            j = j if len(sides) == 1 else j + len(sides[0])
            swap = order[i] > order[j]
            out.append(pa.table({"a": known.take(pa.array(np.where(swap, j, i))), "b": known.take(pa.array(np.where(swap, i, j))), "shared_days": n}))
        return pa.concat_tables(out)

    return run
