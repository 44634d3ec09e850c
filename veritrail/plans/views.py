"""The standard tables as relations of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions.scalars import ntz_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task gets where what it makes of them is several times as large.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks to deal ``rows`` out to: as many as keep the machine busy, and no more than TASK_ROWS rows in each."""
    spark = rows.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(least, -(-rows.count() // TASK_ROWS))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as payments from customers to suppliers; returned ones flow back, without a goods value."""
    t = lambda name: table(spark, sf_dir, name)
    # Orders get their country first, so that the many lines are shuffled once less.
    placed = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    back = F.col("l_returnflag") == "R"
    customer, supplier = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(back, supplier).otherwise(customer).alias("src"),
        F.when(back, customer).otherwise(supplier).alias("dst"),
        F.col("l_extendedprice").alias("amount"),
        ntz_micros(F.col("l_shipdate")).alias("ts_micros"),
        F.col("n_name").alias("counterparty_country"),
        F.when(~back, F.col("l_quantity") * F.col("p_retailprice")).alias("goods_value"),
    )


TRANSFERS = """transfers AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS src,
         CASE WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS dst,
         l_extendedprice AS amount, epoch_us(l_shipdate) AS ts_micros, n_name AS counterparty_country,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity * p_retailprice END AS goods_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""



def brisk(rows: DataFrame) -> DataFrame:
    """Transfers of a quarter of the amounts, thirty times as fast: many of them in the windows that detectors have by default."""
    return rows.withColumns({"amount": F.col("amount") / 4, "ts_micros": F.expr("ts_micros div 30")})


BRISK = "brisk AS (SELECT * REPLACE (amount / 4 AS amount, ts_micros // 30 AS ts_micros) FROM transfers)"


def funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments to collectors, who pass one of five on: those with even numbers to two others, the rest to four."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    number, at = F.col("o_custkey") % 97, F.col("o_orderkey")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    rows = rows.select(text("C", F.col("o_custkey")).alias("payer"), text("K", number).alias("collector"), F.concat(text("X", number), text("-", at % F.when(number % 2 == 0, 2).otherwise(4))).alias("sink"), (at % 5 == 0).alias("on"), F.col("o_totalprice").alias("amount"), "n_name")
    pay = lambda src, dst, country: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(country).alias("counterparty_country"))
    each = F.array_compact(F.array(pay("payer", "collector", "n_name"), F.when(F.col("on"), pay("collector", "sink", "n_name"))))
    return rows.select(F.explode(each).alias("p"), "amount").select("p.*", "amount")


FUNNELS = """paid AS (
  SELECT o_custkey % 97 AS k, o_orderkey AS num, 'C' || o_custkey AS payer, o_totalprice AS amount, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
funnels AS (
  SELECT payer AS src, 'K' || k AS dst, amount, n_name AS counterparty_country FROM paid
  UNION ALL SELECT 'K' || k, 'X' || k || '-' || (num % CASE WHEN k % 2 = 0 THEN 2 ELSE 4 END), amount, n_name FROM paid WHERE num % 5 = 0)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers each paying three others, as a sparse ledger with cycles; names are far from alike."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    # The count is one row.
    rows = suppliers.join(F.broadcast(suppliers.agg(F.count("*").alias("n"))))
    rows = rows.select("s_suppkey", "s_acctbal", "n", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    to = (F.col("s_suppkey") * (F.col("k") + 1) + 7 * F.col("k")) % F.col("n") + 1
    name = lambda c: F.md5(c.cast("string"))
    amount = F.abs(F.round("s_acctbal")) + 10.0 * F.col("k")
    return rows.select(F.concat_ws("-", "s_suppkey", "k").alias("id"), name(F.col("s_suppkey")).alias("src"), name(to).alias("dst"), amount.alias("amount"), (F.lit(883612800000000) + 3_600_000_000 * F.col("s_suppkey") * F.col("k")).alias("ts_micros"), F.lit(None).cast("string").alias("counterparty_country"), F.lit(None).cast("double").alias("goods_value"))


RINGS = """rings AS (
  SELECT s_suppkey || '-' || k AS id, md5(CAST(s_suppkey AS VARCHAR)) AS src, md5(CAST((s_suppkey * (k + 1) + 7 * k) % n + 1 AS VARCHAR)) AS dst, abs(round(s_acctbal)) + 10e0 * k AS amount
  FROM (SELECT s_suppkey, s_acctbal, count(*) OVER () AS n FROM supplier), (VALUES (1), (2), (3)) v(k))"""


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transfers of one side."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"), F.lit(None).cast("string").alias("dst"), F.col("value").alias("amount"), ntz_micros(F.col("ts")).alias("ts_micros"))


def slow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events 45 times as slow, so that users fall silent for months."""
    return event_ledger(spark, sf_dir).withColumn("ts_micros", F.col("ts_micros") * 45)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order, at times that are an hour apart but for up to as many minutes as the user's number says."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", place.alias("at"))
    minutes = F.col("at") * 60 + F.col("event_id") % (F.col("user_id") % 60 + 1)
    return rows.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1.0).alias("amount"), (minutes * 60000000).alias("ts_micros"))


TICKS = """ev AS (SELECT 'U' || user_id AS entity, (60 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) + event_id % (user_id % 60 + 1)) * 60000000 AS ts_micros FROM events WHERE user_id IS NOT NULL)"""
EVENTS = """ev AS (SELECT 'U' || user_id AS entity, epoch_us(ts) AS ts_micros FROM events WHERE user_id IS NOT NULL)"""


def named(df: DataFrame) -> DataFrame:
    """Entities as one string, so that rows compare by value."""
    return df.withColumn("entities", F.array_join("entities", "|"))
