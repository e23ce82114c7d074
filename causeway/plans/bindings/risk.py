"""Scoring over ``events``: a user is a package, an event a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import scoring
from causeway.runtime import table

#: Event types as severities and objectives.
SEVERITY_OF = {"error": "critical", "purchase": "high", "signup": "medium"}
OBJECTIVE_OF = {"error": "exfiltration", "purchase": "dropper", "signup": "backdoor", "click": "unknown"}


def _pick(column: str, mapping: dict[str, str], rest: str):
    out = F.lit(rest)
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("dist_id"),
        _pick("event_type", SEVERITY_OF, "low").alias("severity"),
        _pick("event_type", OBJECTIVE_OF, "denial_of_service").alias("objective"),
        F.element_at(F.array(F.lit("runtime"), F.lit("import"), F.lit("install")), (F.col("user_id") % 3 + 1).cast("int")).alias("phase"),
        F.when(F.col("value") < 20, "dynamic").when(F.col("value") < 60, "ambiguous").otherwise("resolved").alias("confidence"),
        (F.get_json_object("props", "$.k").cast("int") % 4 == 0).alias("obfuscated"),
        F.when(F.col("event_id") % 3 == 0, "control").otherwise("data").alias("kind"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return f.withColumn("score", scoring.finding_score(*map(F.col, ("severity", "phase", "confidence", "obfuscated"))))


def e09_finding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", "severity", "phase", "confidence", F.round("score", 9).alias("score"))


def e10_package_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir)
    packages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dist_id")).union(found.select("dist_id")).distinct()
    risk = scoring.package_risk(found, packages)
    return risk.select("dist_id", F.col("findings").cast("long").alias("findings"), F.round("risk", 9).alias("risk"), scoring.verdict(F.col("risk")).alias("verdict"))


FINDINGS_SQL = """
SELECT event_id, user_id AS dist_id,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
  CASE event_type WHEN 'error' THEN 'exfiltration' WHEN 'purchase' THEN 'dropper' WHEN 'signup' THEN 'backdoor' WHEN 'click' THEN 'unknown' ELSE 'denial_of_service' END AS objective,
  CASE user_id % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'import' ELSE 'install' END AS phase,
  CASE WHEN value < 20 THEN 'dynamic' WHEN value < 60 THEN 'ambiguous' ELSE 'resolved' END AS confidence,
  coalesce(CAST(json_extract(props, '$.k') AS INTEGER) % 4 = 0, false) AS obfuscated,
  CASE WHEN event_id % 3 = 0 THEN 'control' ELSE 'data' END AS kind
FROM events
"""

SCORED_SQL = f"""
SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    (CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.8::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END)
  * (CASE phase WHEN 'install' THEN 1.0::DOUBLE WHEN 'import' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END)
  * (CASE confidence WHEN 'resolved' THEN 1.0::DOUBLE WHEN 'ambiguous' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END)
  * (CASE WHEN obfuscated THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END))) AS score
FROM ({FINDINGS_SQL})
"""

RISK_SQL = f"""
WITH s AS ({SCORED_SQL}),
p AS (SELECT c_custkey AS dist_id FROM customer UNION SELECT dist_id FROM s),
g AS (SELECT dist_id, max(score) AS top, count(DISTINCT objective) AS objectives, bool_or(kind = 'data') AS any_data, count(*) AS n FROM s GROUP BY dist_id),
r AS (SELECT dist_id, n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, top + 0.05::DOUBLE * (objectives - 1))) AS raw, any_data FROM g)
SELECT p.dist_id, coalesce(n, 0) AS findings, CASE WHEN n IS NULL THEN 0.0::DOUBLE WHEN any_data THEN raw ELSE least(raw, 0.70::DOUBLE - 0.05::DOUBLE) END AS risk
FROM p LEFT JOIN r ON p.dist_id = r.dist_id
"""

BINDINGS = {
    "e09_finding_score": (e09_finding_score, f"SELECT event_id, severity, phase, confidence, round(score, 9) AS score FROM ({SCORED_SQL})"),
    "e10_package_risk": (
        e10_package_risk,
        f"SELECT dist_id, findings, round(risk, 9) AS risk, CASE WHEN risk >= 0.70 THEN 'malicious' WHEN risk >= 0.40 THEN 'suspicious' ELSE 'clean' END AS verdict FROM ({RISK_SQL})",
    ),
}
