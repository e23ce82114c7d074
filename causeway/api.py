"""Scanning from Python and from the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway import __version__
from causeway.operators import catalogue, deps
from causeway.operators.cache import Store, default_location
from causeway.operators.display import exit_code, text_report
from causeway.plans.scan import MODES, SCHEMA_VERSION, Options, build_graphs, evaluate, graphs_where, reports
from causeway.runtime import stored
from causeway.sources import archives


def _graphs(dists: DataFrame) -> DataFrame:
    return graphs_where(archives.python_of(dists))


def scan_archives(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """Reports for all source archives at ``path`` (a file, a folder, or a pattern)."""
    dists = stored(archives.sdists(spark, path), "dists")
    graphs = _graphs(dists)
    out = reports(graphs, stored(evaluate(graphs, options), "findings"), options, archives.skipped_of(dists))
    identity = dists.select("dist_id", F.struct("name", "version", "filename", "kind", "sha256", "size_bytes").alias("distribution"))
    return out.join(identity, "dist_id", "left")


def scan_cached(spark: SparkSession, path: str, store: Store, day: int) -> DataFrame:
    """C-02, C-04, O-05: dist_id, cached, report_json. Digests are looked up first; only what is not known is unpacked and analysed."""
    shape = (catalogue.RULESET_VERSION, SCHEMA_VERSION)
    files = archives.listed(spark, path).withColumn("sha256", F.sha2("content", 256))
    here = stored(files.select("path", "sha256"), "digests").withColumns({"ruleset": F.lit(shape[0]), "schema": F.lit(shape[1])})
    hits = stored(here.join(store.entries().select("sha256", "ruleset", "schema", "report_json"), ["sha256", "ruleset", "schema"]), "hits")
    fresh = stored(archives.unpacked(files.join(hits.select("sha256").distinct(), "sha256", "left_anti")), "dists")
    graphs = _graphs(fresh)
    out = reports(graphs, stored(evaluate(graphs), "findings"), skipped=archives.skipped_of(fresh))
    rows = out.select("dist_id", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("report_json"))
    made = stored(rows.join(fresh.select("dist_id", "sha256"), "dist_id").select("dist_id", "sha256", F.lit(shape[0]).alias("ruleset"), F.lit(shape[1]).alias("schema"), "report_json"), "reports")
    store.add(made, day)
    store.touch(hits, day)
    return made.select("dist_id", F.lit(False).alias("cached"), "report_json").union(hits.select(F.substring_index("path", "/", -1), F.lit(True), "report_json"))


def scan_directory(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """The report for a source tree in place; it has no identity."""
    graphs = build_graphs(archives.directory(spark, path).where("text is not null").select("dist_id", "path", "text"))
    return reports(graphs, stored(evaluate(graphs, options), "findings"), options).withColumn("distribution", F.lit(None).cast("string"))


def scan(spark: SparkSession, path: str, options: Options = Options()) -> dict:
    out = scan_directory(spark, path, options) if os.path.isdir(path) else scan_archives(spark, path, options)
    return out.first().asDict(recursive=True)


def scan_many(spark: SparkSession, paths: list[str], options: Options = Options()) -> list[dict]:
    """Reports in the order of ``paths``; what fails does so in its own place."""
    dirs = [p for p in paths if os.path.isdir(p)]
    files = [p for p in paths if p not in dirs]
    out = {}
    if files:
        dists = stored(archives.sdists(spark, files), "dists")
        graphs = _graphs(dists)
        for r in reports(graphs, stored(evaluate(graphs, options), "findings"), options, archives.skipped_of(dists)).collect():
            out[r["dist_id"]] = r.asDict(recursive=True)
    for d in dirs:
        out[d] = scan(spark, d, options)
    return [out.get(p if p in dirs else Path(p).name) for p in paths]


def project(spark: SparkSession, path: str) -> DataFrame:
    """B-06: the flagged packages of a set of archives by how many others depend on them."""
    dists = stored(archives.normalised_name(archives.sdists(spark, path)), "dists")
    graphs = _graphs(dists)
    risk = reports(graphs, stored(evaluate(graphs), "findings"), skipped=archives.skipped_of(dists)).select("dist_id", "risk", "verdict")
    first = dists.where("project is not null").groupBy("project").agg(F.min(F.struct("filename", "dist_id", "version", "requires_dist")).alias("d"))
    nodes, edges = deps.from_requirements(first.select(F.col("project").alias("name"), F.col("d.requires_dist").alias("requirements")))
    blast = deps.blast_radius(nodes, edges)
    between = deps.betweenness(nodes, edges)
    blast = blast.withColumn("betweenness", F.lit(None).cast("double")) if between is None else blast.join(between, "name")
    out = first.select(F.col("project").alias("name"), F.col("d.dist_id").alias("dist_id"), F.col("d.version").alias("version")).join(risk, "dist_id").join(blast, "name")
    return deps.ranked(out.where("verdict <> 'clean'"))


def rules(spark: SparkSession) -> DataFrame:
    return catalogue.rules(spark)


def ruleset_version() -> int:
    return catalogue.RULESET_VERSION


def version() -> str:
    return __version__


def cli_main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """V-04, V-05: 0 for clean, 1 for flagged, 2 for wrong usage, 3 for an error."""
    parser = argparse.ArgumentParser(prog="causeway")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan")
    s.add_argument("paths", nargs="+")
    s.add_argument("--json", action="store_true")
    s.add_argument("--mode", choices=MODES, default="reachability")
    s.add_argument("--min-confidence", choices=("dynamic", "ambiguous", "resolved"))
    p = commands.add_parser("project")
    p.add_argument("path")
    commands.add_parser("rules")
    c = commands.add_parser("cache")
    c.add_argument("what", choices=("stats", "clear"))
    c.add_argument("--path", default=default_location())
    commands.add_parser("version")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command == "version":
        print(version())
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if args.command == "rules":
            for r in rules(spark).orderBy("ord").collect():
                print(f"{r['rule']}  {r['severity']:<8}  {r['title']}")
            return 0
        if args.command == "cache":
            store = Store(spark, args.path)
            if args.what == "clear":
                store.clear()
            else:
                print(json.dumps(store.stats((catalogue.RULESET_VERSION, SCHEMA_VERSION))))
            return 0
        if args.command == "project":
            found = [r.asDict() for r in project(spark, args.path).collect()]
            print(json.dumps(found, indent=2))
            return 1 if found else 0
        found = scan_many(spark, args.paths, Options(args.mode, args.min_confidence))
        for r in found:
            print(json.dumps(r) if args.json else text_report(r))
        return exit_code(found)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(cli_main())
