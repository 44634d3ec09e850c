"""Risk of entities and of networks from findings (id, typology, entities, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.scalars import band, clamp, noisy_or
from veritrail.storage import materialize

#: How much a finding of each typology counts (fixed values); others count DEFAULT_WEIGHT.
WEIGHTS = {
    "sanctions_nexus": 1.00, "round_tripping": 0.85, "layering": 0.80, "funnel_account": 0.80, "structuring": 0.75, "shell_nominee": 0.70,
    "pass_through": 0.65, "trade_value_anomaly": 0.70, "dormancy_activation": 0.55, "burst_velocity": 0.50, "periodicity": 0.45,
}
DEFAULT_WEIGHT, BONUS, MAX_BONUS = 0.5, 0.05, 0.15


def contributions(findings: DataFrame, weights: dict | None = None) -> DataFrame:
    """(entity, typology, contribution, finding_id): the strongest finding of each typology for each entity."""
    table = F.create_map(*[F.lit(x) for kv in (WEIGHTS | (weights or {})).items() for x in kv])
    weighed = findings.select(F.explode("entities").alias("entity"), "typology", "id", clamp(F.coalesce(table[F.col("typology")], F.lit(DEFAULT_WEIGHT)) * F.col("score")).alias("contribution"))
    best = weighed.where("entity is not null").groupBy("entity", "typology").agg(F.min(F.struct((-F.col("contribution")).alias("c"), "id")).alias("b"))
    return best.select("entity", "typology", (-F.col("b.c")).alias("contribution"), F.col("b.id").alias("finding_id"))


def entity_risk(findings: DataFrame, weights: dict | None = None) -> DataFrame:
    """One row an entity: noisy-or of its typologies, and a bonus for their diversity."""
    per = contributions(findings, weights).groupBy("entity").agg(F.collect_list("contribution").alias("w"), F.array_sort(F.collect_list("typology")).alias("typologies"), F.collect_list(F.struct("typology", "contribution", "finding_id")).alias("contributions"))
    per = per.withColumn("base_noisy_or", noisy_or(F.col("w"))).withColumn("typology_count", F.size("w").cast("long"))
    bonus = F.least(F.lit(BONUS) * (F.col("typology_count") - 1), F.lit(MAX_BONUS))
    risk = clamp(F.col("base_noisy_or") + bonus)
    return per.select("entity", risk.alias("risk"), band(risk).alias("risk_band"), "typology_count", "typologies", bonus.alias("diversity_bonus"), "base_noisy_or", F.array_sort("contributions").alias("contributions"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (component) with their number ``i`` in order: places within ranges, and what the ranges before hold."""
    ranged = materialize(rows.repartitionByRange("component").withColumn("range", F.spark_partition_id()))
    # A row a range; its first component puts it in order.
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("component"))
    return ranged.join(before, "range").select("component", (place + F.col("before")).cast("int").alias("i"))


def network_risk(findings: DataFrame, parts: DataFrame, weights: dict | None = None) -> DataFrame:
    """One row a component (node, component) with flagged members, numbered in order of its least member.

    All that a component has is summed up, in parts and in any order: complements of risks as decimals of their logarithms, so
    that its risk and the mean, to six places, don't depend on how rows are dealt out.
    """
    placed = materialize(parts.join(entity_risk(findings, weights).select(F.col("entity").alias("node"), "risk", "typologies"), "node", "left").select("component", "risk", "typologies"))
    decimal = lambda c: c.cast("decimal(28,10)")
    per = placed.groupBy("component").agg(
        F.count("*").alias("size"),
        F.count("risk").alias("flagged_entities"),
        F.max("risk").alias("peak_entity_risk"),
        F.sum(decimal(F.col("risk"))).alias("total"),
        F.sum(F.when(F.col("risk") < 1.0, decimal(F.ln(F.lit(1.0) - F.col("risk"))))).alias("logs"),
    )
    # At most as many as there are typologies.
    kinds = placed.select("component", F.explode("typologies").alias("typology")).distinct().groupBy("component").agg(F.array_sort(F.collect_list("typology")).alias("typologies"))
    number = numbered(per.select("component"))
    out = per.where("flagged_entities > 0").join(number, "component").join(kinds, "component", "left")
    risk = F.when(F.col("peak_entity_risk") >= 1.0, 1.0).otherwise(F.round(F.lit(1.0) - F.exp(F.col("logs").cast("double")), 6))
    mean = F.round(F.col("total").cast("double") / F.col("flagged_entities"), 6)
    return out.withColumn("network_risk", risk).select(F.concat(F.lit("network-"), F.col("i").cast("string")).alias("network_id"), "component", "size", "flagged_entities", "network_risk", band(F.col("network_risk")).alias("network_risk_band"), "peak_entity_risk", mean.alias("mean_entity_risk"), "typologies")


def prioritized(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Findings by falling score, then typology and id."""
    out = findings.orderBy(F.desc("score"), "typology", "id")
    return out.limit(top) if top else out
