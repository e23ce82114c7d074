"""Scanning of the bundled inert sources.

SQL cannot compute these rows; for some queries it states them (``samples.expected``, which says how they came about). Queries whose rows
nobody has checked one by one have no SQL and are held by unit tests only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import catalogue, syntax
from causeway.plans import samples, scan
from causeway.plans.samples import expected
from causeway.plans.scan import CONFIDENCES, MODES, PHASES, Graphs, Options
from causeway.runtime import stored


def sources(spark: SparkSession, names: tuple[str, ...] = ()) -> DataFrame:
    rows = [(d, p, t) for d, files in samples.packages().items() for p, t in files.items() if not names or d in names]
    return spark.createDataFrame(rows, "dist_id string, path string, text string")


def _graphs(spark: SparkSession, *names: str) -> Graphs:
    return Graphs(scan.build_graphs(sources(spark, names)))


def _named(ordinal: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), ordinal + 1)


def _symbols(g: Graphs, key: str) -> DataFrame:
    return g.symbols.select(F.col("key").alias(key), F.col("qualified").alias(f"{key}_name"))


def p01_ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of nodes of a module that parses and of one that does not."""
    return syntax.parse_files(sources(spark, ("guards", "broken"))).groupBy("dist_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def n01_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, "garden", "roots", "broken")
    return g.symbols.join(g.files, ["dist_id", "file"]).select("dist_id", "path", "qualified", "kind", F.col("line").cast("long").alias("line"))


def g05_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, "calls", "hub", "roots")
    calls = g.calls.join(_symbols(g, "src"), "src").join(_symbols(g, "dst"), "dst")
    return calls.select("dist_id", F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"), _named(F.col("confidence"), CONFIDENCES).alias("confidence"))


def r01_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls are resolved to: by imports, types of names and attributes, folded attribute names."""
    results = _graphs(spark, "calls", "types").nodes.where("kind = 'call_result'")
    return results.select("dist_id", "path", F.col("line").cast("long").alias("line"), "label")


def f01_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, "flows", "guards", "files")
    end = lambda c: g.nodes.select(F.col("node").alias(c), F.concat_ws(" ", F.col("line").cast("string"), "kind", "label").alias(f"{c}_node"))
    edges = g.edges.join(end("src"), "src").join(end("dst"), "dst")
    return edges.select("dist_id", F.col("src_node").alias("source"), F.col("dst_node").alias("target"), "kind", _named(F.col("confidence"), CONFIDENCES).alias("confidence"), "callee", "obfuscating").distinct()


def h01_phase_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, "garden", "roots", "hub")
    return g.roots.join(_symbols(g, "key"), "key").select("dist_id", _named(F.col("phase"), PHASES).alias("phase"), "kind", F.col("key_name").alias("symbol"))


def m02_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.find_sources(_graphs(spark, "origins")).select("dist_id", F.col("line").cast("long").alias("line"), "source_kind", "pattern").distinct()


def m17_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.find_sinks(_graphs(spark, "ends", "files")).select("dist_id", F.col("line").cast("long").alias("line"), "sink_kind", "pattern").distinct()


def _prepared(spark: SparkSession) -> scan.Prepared:
    names = [n for pairs in samples.PAIRS.values() for n in pairs]
    return scan.Prepared(scan.build_graphs(sources(spark, tuple(names))))


def e01_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes, one after the other, over the same graphs."""
    ready = _prepared(spark)
    some = [scan.evaluate(ready, Options(mode)).select(F.lit(mode).alias("mode"), "dist_id", "rule", "severity", "phase", "confidence", F.round("score", 9).alias("score"), "message") for mode in MODES]
    return reduce(DataFrame.unionByName, some).distinct()


def e12_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all samples; one input was skipped."""
    ready = _prepared(spark)
    found = stored(scan.evaluate(ready), "findings")
    skipped = spark.createDataFrame([("notes.whl", "not_an_sdist", "notes.whl")], "dist_id string, reason string, detail string")
    rows = scan.reports(ready.g.graphs, found, skipped=skipped)
    return rows.select("dist_id", F.array_join(F.array_sort(F.array_distinct("findings.rule")), " ").alias("rules"), F.round("risk", 9).alias("risk"), "verdict", F.col("skipped.reason").alias("reason"))


def e15_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.rules(spark).select("ord", "rule", "title", "kind", "severity", "objective", "typical_phase")


def _values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL; ``columns``: name and type of each."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'{n}::{k} AS {n}' for n, k in zip(names, kinds))} FROM (VALUES {body}) AS t({', '.join(names)})"


BINDINGS = {name: (globals()[name], _values(rows, columns)) for name, (columns, rows) in expected.ROWS.items()} | {
    "p01_ast_nodes": (p01_ast_nodes, None),
    "f01_flow_edges": (f01_flow_edges, None),
    "e01_findings": (e01_findings, None),
    "e12_reports": (e12_reports, None),
    "e15_rules": (e15_rules, "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r[0]}', '{r[1]}', '{r[4]}', '{r[5]}', '{r[6]}', '{r[7]}')" for k, r in enumerate(catalogue.RULES)) + ") AS t(ord, rule, title, kind, severity, objective, typical_phase)"),
}
