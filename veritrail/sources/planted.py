"""Small ledgers and transactions with planted cases, to hold the detectors against a known truth."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from veritrail.operators.chain import TRANSACTION
from veritrail.operators.infra import OBSERVATION
from veritrail.operators.ledger import DAY, HOUR
from veritrail.storage import materialize

LEDGER = "id string, src string, dst string, amount double, ts_micros long, counterparty_country string, goods_value double"
START = 1_735_689_600_000_000


def ledger(spark: SparkSession, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transfers, planted (typology, entity), watchlist (entity)): a case of each typology among ordinary payments."""
    rnd, rows, truth = random.Random(seed), [], []

    def pay(src, dst, amount, hours, country=None, goods=None) -> None:
        rows.append((f"p{len(rows)}", src, dst, float(amount), START + int(hours * HOUR), country, goods))

    def planted(typology, *names) -> None:
        truth.extend((typology, n) for n in names)

    for i in range(4):
        pay(f"teller-{i}", "smurf", 9_400 + 100 * i, 5 * i)
    planted("structuring", "smurf")
    for i in range(5):
        pay(f"layer-{i}", f"layer-{i + 1}", 50_000 - 700 * i, 300 + 9 * i)
    planted("layering", *(f"layer-{i}" for i in range(6)))
    pay("payer", "mule", 20_000, 600)
    pay("mule", "owner", 19_000, 603)
    planted("pass_through", "mule")
    for i in range(3):
        pay(f"ring-{i}", f"ring-{(i + 1) % 3}", 30_000 - 400 * i, 900 + 200 * i)
    planted("round_tripping", "ring-0", "ring-1", "ring-2")
    pay("importer", "exporter", 100_000, 1_300, "Farland", 40_000.0)
    planted("trade_value_anomaly", "importer", "exporter")
    for a, b in ((0, 1), (1, 2), (2, 0), (0, 2)):
        pay(f"front-{a}", f"front-{b}", 7_000 + a, 1_500 + 400 * b)
    planted("shell_nominee", "front-0", "front-1", "front-2")
    for i in range(6):
        pay(f"donor-{i}", "funnel", 3_000 + i, 2_000 + 30 * i, ("North", "South", "East")[i % 3])
    pay("funnel", "sink", 15_000, 2_300, "North")
    planted("funnel_account", "funnel")
    for i in range(6):
        pay("burst", f"shop-{i}", 50, 240 * i)
    for i in range(9):
        pay("burst", f"shop-{10 + i}", 60, 1_450 + i / 4)
    planted("burst_velocity", "burst")
    for i in range(3):
        pay("sleeper", f"cafe-{i}", 20 + i, 24 * i)
    for i in range(4):
        pay("sleeper", f"cafe-{10 + i}", 900 + i, 24 * 130 + 3 * i)
    planted("dormancy_activation", "sleeper")
    for i in range(8):
        pay("clock", f"bar-{i}", 75, 24 * i)
    planted("periodicity", "clock")
    pay("helper", "listed", 500, 3_500)
    planted("sanctions_nexus", "helper")
    for i in range(25):
        pay(f"home-{i}", f"store-{rnd.randrange(1000)}-{i}", rnd.randint(5, 400), rnd.randrange(24 * 90))
    return spark.createDataFrame(rows, LEDGER), spark.createDataFrame(truth, "typology string, entity string"), spark.createDataFrame([("listed",)], "entity string")


def transactions(spark: SparkSession, noisy: bool = False, owners: int = 6, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, wallets (member, cluster), mixers (label)). Noisy ones have inputs of two owners together."""
    rnd, rows, wallets = random.Random(seed), [], []

    def add(ins, outs) -> str:
        at = len(rows)
        pay = lambda side: [{"address": a, "value": float(v)} for a, v in side]
        rows.append((f"t{at}", f"2026-01-{1 + at % 28:02d}T00:00:00", pay(ins), pay(outs), at))
        return f"t{at}"

    for o in range(owners):
        own = [f"o{o}-{i}" for i in range(4)]
        wallets.extend((a, f"owner-{o}") for a in own)
        for a, b in zip(own, own[1:], strict=False):
            add([(a, rnd.randint(1, 9)), (b, rnd.randint(1, 9))], [(f"shop-{rnd.randrange(9)}", 3)])
    mixers = [add([(f"m{k}-{i}", 5) for i in range(4)], [(f"x{k}-{i}", 4.9) for i in range(4)]) for k in range(2)]
    wallets.extend((f"m{k}-{i}", f"mix-{k}") for k in range(2) for i in range(4))
    for i in range(4):
        add([(f"peel-{i}", 100 - 10 * i)], [(f"spent-{i}", 9), (f"peel-{i + 1}", 90 - 10 * i)])
        wallets.append((f"peel-{i}", f"peel-{i}"))
    if noisy:
        add([("o0-0", 1), ("o1-0", 1)], [("shop-0", 2)])
    return spark.createDataFrame(rows, TRANSACTION), spark.createDataFrame(wallets, "member string, cluster string"), spark.createDataFrame([(m,) for m in mixers], "label string")


def copies(frame: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows of a small frame once for each key (key), which ends what ``names`` hold: strings, or sides of transactions.

    Keys are dealt out first, since those of a small file are in one task. What is made is written to the shared folder: Spark takes
    what is exploded to be as small as the keys, and would broadcast it in joins.
    """
    spark = keys.sparkSession
    keys = keys.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    items = "[" + ",".join(frame.toJSON().collect()) + "]"
    rows = keys.select(F.col("key").cast("string").alias("key"), F.explode(F.from_json(F.lit(items), ArrayType(frame.schema))).alias("r")).select("key", "r.*")

    def ended(c: str) -> Column:
        own = lambda name: F.concat(name, F.lit("-"), F.col("key"))
        side = lambda x: F.struct(own(x["address"]).alias("address"), x["value"].alias("value"))
        return F.transform(c, side) if c in ("inputs", "outputs") else own(F.col(c))

    return materialize(rows.withColumns({c: ended(c) for c in names}).drop("key"))


def ledgers(keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`ledger`, all of it once for each key (key)."""
    rows, truth, listed = ledger(keys.sparkSession)
    return copies(rows, keys, "id", "src", "dst"), copies(truth, keys, "entity"), copies(listed, keys, "entity")


def many_transactions(keys: DataFrame, noisy: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`transactions`, all of them once for each key (key)."""
    txs, wallets, mixed = transactions(keys.sparkSession, noisy)
    return copies(txs, keys, "txid", "inputs", "outputs"), copies(wallets, keys, "member", "cluster"), copies(mixed, keys, "label")


def observations(spark: SparkSession, groups: int = 4) -> tuple[DataFrame, DataFrame]:
    """(observations, clusters (member, cluster)): addresses tied by a certificate or by a domain, and single ones."""
    rows, truth = [], []
    for g in range(groups):
        for i in range(4):
            # The first three share a certificate, the last two a domain.
            rows.append((f"h{g}-{i}", "2026-01-01T00:00:00", None, f"cert-{g}" if i < 3 else None, [f"site-{g}"] if i > 1 else [], [], [], len(rows)))
            truth.append((f"h{g}-{i}", f"group-{g}"))
    rows.append(("alone", "2026-01-01T00:00:00", None, None, ["own"], [], [], len(rows)))
    truth.append(("alone", "alone"))
    return spark.createDataFrame(rows, OBSERVATION), spark.createDataFrame(truth, "member string, cluster string")
