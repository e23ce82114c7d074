"""Dependency graphs: edges from requirements, dependents, blast radius, betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.names import package_name, requirement_name, requirement_optional
from causeway.runtime import stored

#: Nodes beyond which betweenness is not computed (fixed value).
BETWEENNESS_NODES = 5000
#: Levels after which what is reached is stored as one table; changes no result.
LEVELS = 16


def from_requirements(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B-02: nodes (name) and edges (src, dst, requirement, optional) of name and requirements.

    Requirements outside the set and on the package itself give none; of several on one package the first counts.
    """
    own = packages.select(package_name(F.col("name")).alias("src"), "requirements").where("src is not null")
    nodes = own.select(F.col("src").alias("name")).distinct()
    each = own.select("src", F.posexplode("requirements").alias("at", "requirement"))
    each = each.select("src", "at", "requirement", requirement_name(F.col("requirement")).alias("dst"), requirement_optional(F.col("requirement")).alias("optional"))
    inside = each.where("dst is not null and src <> dst").join(nodes.withColumnRenamed("name", "dst"), "dst", "left_semi")
    first = inside.groupBy("src", "dst").agg(F.min(F.struct("at", "requirement", "optional")).alias("first"))
    return nodes, first.select("src", "dst", "first.requirement", "first.optional")


def required_edges(edges: DataFrame) -> DataFrame:
    """B-07: edges without those that only an extra asks for."""
    return edges.where(~F.col("requirement").rlike(r"extra\s*=="))


def reached_from(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Columns search, node and depth: all that each name reaches along ``hops`` (src, dst), however far, itself at depth 0."""
    hop = stored(hops.distinct(), "hops")
    level = stored(nodes.select(F.col("name").alias("search"), F.col("name").alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    seen, d = level, 0
    while True:
        d += 1
        met = level.withColumnRenamed("node", "src").join(hop, "src").select("search", F.col("dst").alias("node")).distinct()
        level = stored(met.join(seen, ["search", "node"], "left_anti").withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            return seen
        seen = seen.union(level)
        if d % LEVELS == 0:
            seen = stored(seen, "reached")


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """B-03, B-04: direct and transitive dependents of every node, and their share of the others."""
    reached = reached_from(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)
    sums = reached.where("depth > 0").groupBy(F.col("search").alias("name")).agg(F.count(F.lit(1)).alias("transitive"), F.sum((F.col("depth") == 1).cast("int")).alias("direct"))
    n = nodes.count()
    share = F.coalesce("transitive", F.lit(0)) / F.lit(n - 1) if n > 1 else F.lit(0.0)
    return nodes.join(sums, "name", "left").select("name", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("transitive", F.lit(0)).alias("transitive"), share.alias("share"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """B-05: directed, unweighted, scaled by (n - 1)(n - 2) if n > 2. Numbers of paths a level forward, dependence a level back."""
    n = nodes.count()
    if n > BETWEENNESS_NODES:
        return None
    hop = edges.select("src", "dst").distinct()
    levels = [stored(nodes.select(F.col("name").alias("s"), F.col("name").alias("v"), F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("s", "v")
    while True:
        met = levels[-1].withColumnRenamed("v", "src").join(hop, "src").select("s", F.col("dst").alias("v"), "paths").join(seen, ["s", "v"], "left_anti")
        level = stored(met.groupBy("s", "v").agg(F.sum("paths").alias("paths")), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("s", "v"))
    parts = []
    later = levels[-1].withColumn("rest", F.lit(0.0))
    for level in levels[-2::-1]:
        parts.append(later)
        ahead = later.select("s", F.col("v").alias("dst"), F.col("paths").alias("below"), "rest")
        gain = level.withColumnRenamed("v", "src").join(hop, "src").join(ahead, ["s", "dst"]).groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("paths") / F.col("below") * (1 + F.col("rest"))).alias("rest"))
        later = stored(level.join(gain, ["s", "v"], "left").withColumn("rest", F.coalesce("rest", F.lit(0.0))), "rest")
    total = None
    for p in parts:
        total = p if total is None else total.union(p)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return nodes.select("name", F.lit(0.0).alias("betweenness"))
    sums = total.where("s <> v").groupBy(F.col("v").alias("name")).agg(F.sum("rest").alias("sum"))
    return nodes.join(sums, "name", "left").select("name", (F.coalesce("sum", F.lit(0.0)) * scale).alias("betweenness"))


def ranked(findings: DataFrame) -> DataFrame:
    """B-06: flagged packages by dependents, then risk, both falling, then name."""
    return findings.orderBy(F.desc("transitive"), F.desc("risk"), F.asc("name"))
