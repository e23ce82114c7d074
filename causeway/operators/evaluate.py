"""Evaluation of verdicts against labels: confusion, ranks, tables, draws."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(rows: DataFrame, by: list[str], errors_as_negative: bool = True) -> DataFrame:
    """V-07, V-08: counts and rates of rows (``by``, malicious, flagged, error).

    Rows with an error count as not flagged, or not at all.
    """
    bad = F.col("error").isNotNull()
    used = rows if errors_as_negative else rows.where(~bad)
    hit = F.col("flagged") & ~bad
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    g = used.groupBy(*by).agg(
        total(F.col("malicious") & hit).alias("tp"),
        total(~F.col("malicious") & hit).alias("fp"),
        total(F.col("malicious") & ~hit).alias("fn"),
        total(~F.col("malicious") & ~hit).alias("tn"),
        total(bad).alias("errors"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    g = g.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "fp_per_1k": _share(1000 * fp, fp + tn)})
    return g.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nearest_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """V-09: the values at places n // 2 and min(n - 1, int(n * 0.95)) of each group, from 0.

    Numbers of values are summed first; places are sought among distinct values.
    """
    if not by:
        return nearest_rank(rows.withColumn("_all_rows", F.lit(0)), ["_all_rows"], value).drop("_all_rows")
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = n.withColumn("_upto", F.sum("_n").over(upto))
    totals = n.groupBy(*by).agg(F.sum("_n").alias("_all"))
    both = ranked.join(totals, by)
    half, late = F.floor(F.col("_all") / 2), F.least(F.col("_all") - 1, F.floor(F.col("_all") * 0.95))
    return both.groupBy(*by).agg(F.min(F.when(F.col("_upto") > half, F.col(value))).alias("median"), F.min(F.when(F.col("_upto") > late, F.col(value))).alias("p95"))


def noise(rows: DataFrame) -> DataFrame:
    """V-10: mean findings and mean sinks of benign packages."""
    return rows.where("not malicious").agg(F.avg("findings").alias("mean_findings"), F.avg("sinks").alias("mean_sinks"))


def thresholds(rows: DataFrame, points: list[float], score: str = "score") -> DataFrame:
    """V-27: rows once for each threshold, flagged above it. The list of points is short and fixed."""
    return rows.withColumn("threshold", F.explode(F.array(*map(F.lit, points)))).withColumn("flagged", F.col(score) > F.col("threshold"))


def ablation(metrics: DataFrame, pairs: list[tuple[str, str]], values: list[str], on: list[str]) -> DataFrame:
    """V-13: differences of metrics between two modes."""
    out = None
    for a, b in pairs:
        left = metrics.where(F.col("mode") == a).select(*on, *[F.col(v).alias(f"_{v}") for v in values])
        right = metrics.where(F.col("mode") == b).select(*on, *values)
        diff = left.join(right, on).select(F.lit(f"{a}-{b}").alias("delta"), *on, *[(F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values])
        out = diff if out is None else out.unionByName(diff)
    return out


def shapes(findings: DataFrame) -> DataFrame:
    """V-11: findings alike in everything but place, with their number."""
    keys = ["package", "rule", "objective", "kind", "score", "confidence", "phase", "steps", "ambiguous"]
    return findings.withColumn("score", F.round("score", 4)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def distinct_sinks(findings: DataFrame) -> DataFrame:
    return findings.groupBy("package").agg(F.count_distinct("rule", "file", "line").alias("sinks"))


def coverage(entries: DataFrame) -> DataFrame:
    """V-12: entries by source and why they are left out."""
    return entries.groupBy("source", F.coalesce("excluded", F.lit("included")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def per_rule(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """V-14: packages of each kind that a rule finds, the median of their best confidence, findings by phase."""
    best = findings.groupBy("package", "rule").agg(F.max(F.struct("score", "confidence")).alias("best"))
    counts = best.join(packages.select("package", "malicious"), "package").groupBy("rule").agg(
        F.sum(F.col("malicious").cast("long")).alias("tp_packages"), F.sum((~F.col("malicious")).cast("long")).alias("fp_packages"), F.median("best.confidence").alias("median_confidence")
    )
    phases = findings.groupBy("rule").agg(*[F.sum((F.col("phase") == p).cast("long")).alias(p) for p in ("install", "import", "runtime")])
    return counts.join(phases, "rule")


def misses(rows: DataFrame, threshold: float) -> DataFrame:
    """V-15: missed malicious packages: errored, without findings, or below the threshold."""
    kind = F.when(F.col("error").isNotNull(), "errored").when(F.col("findings") == 0, "none").when(F.col("score") < threshold, "below")
    return rows.where("malicious").withColumn("miss", kind).where("miss is not null").groupBy("miss").agg(F.count(F.lit(1)).alias("n"))


def recall_by_stratum(rows: DataFrame, overlap: DataFrame) -> DataFrame:
    """V-16: recall over all, and over what the other corpus does not have."""
    flagged = F.coalesce(F.col("flagged"), F.lit(False)).cast("double")
    j = rows.join(overlap, "id", "left").withColumn("stratum", F.explode(F.when(F.col("overlap") == "new", F.array(F.lit("new"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    return j.groupBy("stratum").agg(F.avg(flagged).alias("recall"), F.count(F.lit(1)).alias("n"))


def worst_case(fp: Column, errors: Column, n: Column) -> Column:
    """V-17: false positives a thousand if every errored row were one."""
    return _share(1000 * (fp + errors), n)


def path_suffix(member: Column, suffix: Column) -> Column:
    """V-18: whether a path ends with another, part by part."""
    return (member == suffix) | F.endswith(member, F.concat(F.lit("/"), suffix))


def content_id(files: DataFrame, key: str) -> DataFrame:
    """V-19: digest over sorted paths and digests of the files of a package (path, sha256 as hex)."""
    piece = lambda x: F.concat(x["path"].cast("binary"), F.unhex(F.lit("00")), F.unhex(x["sha256"]))
    sorted_ = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.groupBy(key).agg(F.sha2(F.aggregate(sorted_, F.lit(b""), lambda acc, x: F.concat(acc, piece(x))), 256).alias("content_id"))


def shallowest(files: DataFrame, key: str) -> DataFrame:
    """V-20: the build file nearest to the root, and its directory."""
    depth = F.size(F.split("path", "/"))
    name = F.substring_index("path", "/", -1)
    found = files.where(name.isin("setup.py", "pyproject.toml"))
    best = found.groupBy(key).agg(F.min(F.struct(depth.alias("depth"), F.col("path"))).alias("b"))
    return best.select(key, F.substring_index("b.path", "/", -1).alias("build_file"), F.regexp_replace("b.path", "(^|/)[^/]*$", "").alias("root"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """V-21, E-03, E-08: the first row of each key, without a window: the least struct of the order and the rest."""
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return least.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*order, *rest)])


def seeded_split(ids: list[str], dev: int = 20, seed: int = 20261019) -> dict[str, str]:
    """V-22: of the shuffled sorted ids the first are for development. For lists that fit the driver, as manifests do."""
    order = sorted(set(ids))
    random.Random(seed).shuffle(order)
    return {x: "dev" if k < dev else "test" for k, x in enumerate(order)}


def overlap(new: DataFrame, old: DataFrame) -> DataFrame:
    """V-23: how each row of ``new`` (id, content_id, name, version) is known: by content, by release, or not."""
    by_content = old.select("content_id").where("content_id is not null").distinct().withColumn("_c", F.lit(True))
    by_release = old.select("name", "version").where("name is not null and version is not null").distinct().withColumn("_r", F.lit(True))
    j = new.join(by_content, "content_id", "left").join(by_release, ["name", "version"], "left")
    return j.select("id", F.when(F.col("_c"), "content").when(F.col("_r"), "release").otherwise("new").alias("overlap"))


def holdout(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """V-24: releases that are not known, of each name the first."""
    left = candidates.join(known.select("name", "version").distinct(), ["name", "version"], "left_anti")
    return left.groupBy("name").agg(F.min(F.struct("version", "id")).alias("b")).select("name", "b.version", "b.id")


def next_ranked(candidates: DataFrame, known: DataFrame, n: int, above: int) -> DataFrame:
    """V-25: the next ``n`` below a rank whose hash is not known (the limit is the feature)."""
    return candidates.where(F.col("rank") > above).join(known.select("sha256").distinct(), "sha256", "left_anti").orderBy("rank").limit(n)
