"""Findings from sources and sinks in the same file or definition, snippets, targets and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.display import clip

#: Characters of a snippet's line (fixed value).
SNIPPET = 120
#: Sinks that make the install-time execution rule high (fixed values).
HIGH_SINKS = ("exec", "eval", "compile")


def cooccurring(sources: DataFrame, sinks: DataFrame, place: list[str], order: str = "ord") -> DataFrame:
    """E-04, O-08: each sink with the first source of its place. Sources shrink to one for each place before the join."""
    first = sources.groupBy(*place).agg(F.min(F.struct(order, "source")).alias("first"))
    return sinks.join(first, place).select(*place, "sink", F.col("first.source").alias("source"))


def first_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """E-03: one finding for each sink: the first root, in order, of the rule's typical phase."""
    met = paths.join(roots, "root").where("phase = typical_phase")
    return met.groupBy("rule", "sink").agg(F.min_by("root", "root_ord").alias("root"))


def severity(rule_severity: Column, override: Column, sink: Column) -> Column:
    """E-06: rules with an override are high where the sink runs code as such."""
    return F.when(F.coalesce(override, F.lit(False)) & sink.isin(*HIGH_SINKS), "high").otherwise(rule_severity)


def message(title: Column, symbol: Column, sink: Column) -> Column:
    """E-08."""
    return F.format_string("%s: %s reaches %s", title, symbol, sink)


def snippets(steps: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """E-14: the line of each distinct (path, line) of a finding, in the order first seen, cut at SNIPPET.

    ``steps``: key, pos, path, line (from 1). ``files``: path, text. Only files on a path are split (O-13), and only lines asked for are made rows.
    """
    first = steps.groupBy(*key, "path", "line").agg(F.min("pos").alias("pos"))
    wanted = first.select("path", "line").distinct().groupBy("path").agg(F.collect_set("line").alias("lines"))
    split = files.join(wanted, "path").select("path", "lines", F.split("text", "\n").alias("all"))
    lines = split.select("path", F.explode(F.filter("lines", lambda n: n <= F.size("all"))).alias("line"), "all")
    text = lines.select("path", "line", clip(F.regexp_replace(F.get("all", F.col("line") - 1), r"\r$", ""), SNIPPET).alias("text"))
    return first.join(text, ["path", "line"]).select(*key, "pos", "path", "line", "text")


def file_ids(files: DataFrame, dist: str = "dist", path: str = "path") -> DataFrame:
    """IO-13: paths of a distribution without repeats, numbered from 0 in byte order.

    Numbers come from counts by leading characters, then from places within these, so that no window holds a whole large distribution.
    """
    from pyspark.sql import Window as W

    rows = files.groupBy(dist, path).agg(F.min("bytes").alias("bytes")).withColumn("_lead", F.substring(path, 1, 2))
    leads = rows.groupBy(dist, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    before = leads.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(dist).orderBy("_lead").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(dist, "_lead").orderBy(path)) - 1
    return rows.withColumn("_place", place).join(before, [dist, "_lead"]).select(dist, path, (F.col("_before") + F.col("_place")).cast("long").alias("file_id"), "bytes")
