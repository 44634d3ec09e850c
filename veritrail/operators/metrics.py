"""How well results meet a known truth: clusters, labels and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scores(counts: DataFrame) -> DataFrame:
    """(precision, recall, f1, tp, fp, fn) of (tp, predicted, real); nothing predicted is all right, nothing real all found."""
    share = lambda whole: F.when(F.col(whole) > 0, F.col("tp") / F.col(whole)).otherwise(1.0)
    scored = counts.withColumns({"p": share("predicted"), "r": share("real")})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return scored.select(F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("real") - F.col("tp")).alias("fn"))


def pairwise_scores(found: DataFrame, truth: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row of scores over pairs of members that share a cluster, for (member, cluster) rows of both.

    Pairs are counted from the sizes of clusters and of what two clusters have in common, and never made. A member is in
    one cluster of each at most; those outside ``universe`` (member) don't count.
    """
    if universe is not None:
        found, truth = (x.join(universe.select("member").distinct(), "member", "left_semi") for x in (found, truth))
    ours, theirs = found.select("member", F.col("cluster").alias("a")), truth.select("member", F.col("cluster").alias("b"))

    def pairs(rows: DataFrame, name: str, *by: str) -> DataFrame:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
        return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name))

    # Both sides meet as rows of one member, not in a join: Spark's guess of a side's size can be far too small, and then all of it is broadcast.
    sides = ours.select("member", "a", F.lit(None).cast(theirs.schema["b"].dataType).alias("b")).unionByName(theirs.select("member", F.lit(None).cast(ours.schema["a"].dataType).alias("a"), "b"))
    met = sides.groupBy("member").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("member is not null and a is not null and b is not null")
    # Three single rows.
    both = pairs(met, "tp", "a", "b")
    return _scores(both.crossJoin(pairs(ours, "predicted", "a")).crossJoin(pairs(theirs, "real", "b")))


def label_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of scores for sets of labelled things (label)."""
    side = lambda rows, ours: rows.select("label", F.when(F.lit(ours), 1).alias("ours"), F.when(F.lit(not ours), 1).alias("theirs"))
    # A null label is one of its side, and none that both have.
    sides = side(found, True).unionByName(side(truth, False)).groupBy("label", F.when(F.col("label").isNull(), F.col("ours").isNotNull())).agg(F.max("ours").alias("ours"), F.max("theirs").alias("theirs"))
    total = lambda c: F.count(c)
    return _scores(sides.agg(total(F.when(F.col("ours") == F.col("theirs"), 1)).alias("tp"), total("ours").alias("predicted"), total("theirs").alias("real")))


def typology_recall(findings: DataFrame, planted: DataFrame) -> DataFrame:
    """(typology, planted, recovered, recall) for planted (typology, entity), and the mean of all as ``macro``."""
    got = findings.select("typology", F.explode("entities").alias("entity")).distinct().withColumn("found", F.lit(1))
    each = planted.select("typology", "entity").distinct().join(got, ["typology", "entity"], "left")
    share: Column = F.round(F.col("recovered") / F.col("planted"), 4)
    per = each.groupBy("typology").agg(F.count("*").alias("planted"), F.count("found").alias("recovered")).withColumn("recall", share)
    return per.unionByName(per.agg(F.lit("macro").alias("typology"), F.sum("planted").alias("planted"), F.sum("recovered").alias("recovered"), F.round(F.avg("recall"), 4).alias("recall")))
