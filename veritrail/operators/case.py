"""All detectors over a ledger, and the case they make."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators import detectors, ledger, resolution, risk, traversal
from veritrail.storage import materialize

#: Detectors by typology, each from a ledger to typed findings.
LEDGER = {
    "structuring": detectors.structuring,
    "layering": traversal.layering,
    "pass_through": detectors.pass_through,
    "round_tripping": traversal.round_tripping,
    "trade_value_anomaly": detectors.trade_value_anomaly,
    "shell_nominee": traversal.shell_nominee,
    "funnel_account": detectors.funnel_account,
}
TEMPORAL = {
    "burst_velocity": detectors.burst_velocity,
    "dormancy_activation": detectors.dormancy_activation,
    "periodicity": detectors.periodicity,
}


def run_detectors(transfers: DataFrame, watchlist: DataFrame | None = None, enabled: list[str] | None = None, thresholds: dict | None = None, registry: dict | None = None) -> DataFrame:
    """Findings of the registered detectors (all by default); ``thresholds``: keyword arguments by typology."""
    out = None
    for name, detect in (registry or LEDGER | TEMPORAL).items():
        if enabled is None or name in enabled:
            found = detectors.as_findings(detect(transfers, **(thresholds or {}).get(name, {})), name)
            out = found if out is None else out.unionByName(found)
    if watchlist is not None and (enabled is None or "sanctions_nexus" in enabled):
        found = detectors.as_findings(traversal.sanctions_nexus(transfers, watchlist), "sanctions_nexus")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no detector is enabled")
    return out


@dataclass
class Case:
    """What a case is made of; all but the reference are DataFrames."""

    reference: str
    transfers: DataFrame
    merges: DataFrame
    findings: DataFrame
    components: DataFrame
    entity_risk: DataFrame
    network_risk: DataFrame

    @cached_property
    def brokers(self) -> DataFrame:
        """Found when they are asked for: exact betweenness takes far more than all else."""
        return traversal.top_brokers(self.transfers)

    def summary(self) -> dict:
        count = lambda df: df.count()
        return {"case": self.reference, "transfers": count(self.transfers), "entities": count(ledger.entities(self.transfers)), "findings": count(self.findings), "flagged_entities": count(self.entity_risk), "networks": count(self.network_risk), "merges": count(self.merges)}


def case_reference(transfers: DataFrame) -> str:
    """Ten hexadecimal digits from the sorted digests of all rows, summed up in Spark."""
    rows = transfers.select(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "src", "dst", "amount"))).alias("h"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"))
    return total.select(F.upper(F.substring(F.sha1(F.encode(F.concat_ws(":", "n", "s"), "UTF-8")), 1, 10))).first()[0]


def build_case(transfers: DataFrame, watchlist: DataFrame | None = None, resolve: bool = True, reference: str | None = None, thresholds: dict | None = None) -> Case:
    """Resolve names, run all detectors, and roll their findings up."""
    mapping = None
    if resolve:
        mapping = materialize(resolution.resolve_entities(ledger.entities(transfers).select(F.col("entity").alias("name"))))
        transfers = resolution.apply_resolution(transfers, mapping)
    transfers = materialize(transfers)
    merged = resolution.merges(mapping) if mapping is not None else transfers.sparkSession.createDataFrame([], "canonical string, members array<string>")
    findings = materialize(run_detectors(transfers, watchlist, thresholds=thresholds))
    parts = materialize(traversal.components(transfers))
    return Case(reference or case_reference(transfers), transfers, merged, findings, parts, risk.entity_risk(findings), risk.network_risk(findings, parts))
