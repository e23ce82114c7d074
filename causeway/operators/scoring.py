"""Finding scores, package risk and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights and thresholds (fixed values).
SEVERITY_WEIGHT = {"low": 0.4, "medium": 0.6, "high": 0.8, "critical": 1.0}
PHASE_WEIGHT = {"runtime": 0.5, "import": 0.8, "install": 1.0}
CONFIDENCE_WEIGHT = {"dynamic": 0.4, "ambiguous": 0.6, "resolved": 1.0}
SUSPICIOUS, MALICIOUS = 0.40, 0.70
OBFUSCATION_BONUS, TECHNIQUE_BONUS = 1.15, 0.05
CONTROL_CEILING = MALICIOUS - TECHNIQUE_BONUS


def weight(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def finding_score(severity: Column, phase: Column, confidence: Column, obfuscated: Column, phase_weighting: bool = True) -> Column:
    """E-09: severity x phase x confidence, raised for obfuscation, within [0, 1]."""
    by_phase = weight(phase, PHASE_WEIGHT) if phase_weighting else F.lit(1.0)
    score = weight(severity, SEVERITY_WEIGHT) * by_phase * weight(confidence, CONFIDENCE_WEIGHT)
    return clamp(F.when(F.coalesce(obfuscated, F.lit(False)), score * OBFUSCATION_BONUS).otherwise(score))


def package_risk(findings: DataFrame, packages: DataFrame, key: str = "dist_id") -> DataFrame:
    """E-10: the largest score, raised for every further objective, below the malicious mark unless data flows.

    ``findings`` has ``key``, score, objective and kind; ``packages`` names every package, so that
    those without findings get a risk of 0.
    """
    sums = findings.groupBy(key).agg(
        F.max("score").alias("top"),
        F.count_distinct("objective").alias("objectives"),
        F.max((F.col("kind") == "data").cast("int")).alias("any_data"),
        F.count(F.lit(1)).alias("findings"),
    )
    raw = clamp(F.col("top") + F.lit(TECHNIQUE_BONUS) * (F.col("objectives") - 1))
    risk = F.when(F.col("top").isNull(), 0.0).when(F.col("any_data") == 1, raw).otherwise(F.least(raw, F.lit(CONTROL_CEILING)))
    return packages.join(sums, key, "left").select(key, F.coalesce("findings", F.lit(0)).alias("findings"), risk.alias("risk"))


def verdict(risk: Column) -> Column:
    """E-11."""
    return F.when(risk >= MALICIOUS, "malicious").when(risk >= SUSPICIOUS, "suspicious").otherwise("clean")


def is_flagged(risk: Column, threshold: float = SUSPICIOUS) -> Column:
    return risk >= threshold
