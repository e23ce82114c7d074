"""Name resolution as joins: aliases, nearest scopes, precedence, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A set of more candidates than this becomes a hub (fixed value).
HUB_ABOVE = 8


def last_binding(aliases: DataFrame, keys: list[str], order: str = "ord", value: str = "target") -> DataFrame:
    """N-07, N-09: of several bindings of a name the last counts."""
    return aliases.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def canonicalise(uses: DataFrame, aliases: DataFrame, file: str = "file", dotted: str = "dotted") -> DataFrame:
    """N-07: the first part of a dotted name through the aliases of its file (file, local, target, ord)."""
    last = last_binding(aliases, [file, "local"])
    head = F.substring_index(dotted, ".", 1)
    rest = F.expr(f"substring({dotted}, length(substring_index({dotted}, '.', 1)) + 1)")
    return uses.withColumn("local", head).join(last, [file, "local"], "left").withColumn("canonical", F.when(F.col("target").isNull(), F.col(dotted)).otherwise(F.concat("target", rest))).drop("local", "target")


def nearest_scope(uses: DataFrame, chain: DataFrame | None, definitions: DataFrame, keys: list[str], every: bool = False) -> DataFrame:
    """N-08, R-04, F-18: what defines a name in the nearest scope that does.

    ``uses``: ``keys``, scope, name. ``chain``: scope, ancestor, depth (a scope is its own at depth 0), or None if ``uses`` has
    a row for each ancestor and depth itself. ``definitions``: scope, name, definition. One row each with the last definition, or
    all of that scope if ``every``. Uses meet one row for each scope and name, however many definitions it has.
    """
    last = definitions.groupBy("scope", "name").agg(F.max("definition").alias("definition"))
    found = _met(uses, chain, last)
    if every:
        near = found.groupBy(*keys).agg(F.min("depth").alias("depth"))
        near = found.drop("definition").join(near, [*keys, "depth"])
        return near.join(definitions.withColumnRenamed("scope", "ancestor"), ["ancestor", "name"]).select(*keys, "depth", "ancestor", "definition")
    best = found.groupBy(*keys).agg(F.min(F.struct("depth", (-F.col("definition")).alias("last"), "ancestor")).alias("b"))
    return best.select(*keys, F.col("b.depth").alias("depth"), F.col("b.ancestor").alias("ancestor"), (-F.col("b.last")).alias("definition"))


def nearest_span(uses: DataFrame, chain: DataFrame | None, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """F-18: number, first and last of all definitions in the nearest scope, from sums of each scope and name.

    Arguments as for ``nearest_scope``; result: ``keys``, depth, n, first, last.
    """
    spans = definitions.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"), F.min("definition").alias("first"), F.max("definition").alias("last"))
    of_depth = _met(uses, chain, spans).repartition(*keys).groupBy(*keys, "depth").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return of_depth.groupBy(*keys).agg(F.min(F.struct("depth", "n", "first", "last")).alias("b")).select(*keys, "b.*")


def _met(uses: DataFrame, chain: DataFrame | None, defined: DataFrame) -> DataFrame:
    along = uses if chain is None else uses.join(chain, "scope")
    return along.join(defined.withColumnRenamed("scope", "ancestor"), ["ancestor", "name"])


def first_match(candidates: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """G-02, V-23: candidates of the least rank of their key, all of them."""
    best = candidates.groupBy(*keys).agg(F.min(rank).alias(rank))
    return candidates.join(best, [*keys, rank], "left_semi")


def hubs(edges: DataFrame, site: str = "site", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """G-06, F-20, O-03: sites with more than HUB_ABOVE targets, as sites to sets and sets to targets.

    Result: rows of site and hub (null for sites with few targets), and of hub and target. Equal sets share a hub.
    """
    sets = edges.groupBy(site).agg(F.array_sort(F.collect_set(target)).alias("targets"))
    named = sets.withColumn("hub", F.when(F.size("targets") > HUB_ABOVE, F.sha2(F.array_join(F.transform("targets", lambda t: t.cast("string")), ",").cast("binary"), 256)))
    bridge = named.where("hub is not null").select("hub", "targets").dropDuplicates(["hub"]).select("hub", F.explode("targets").alias(target))
    return named.select(site, "hub", F.size("targets").alias("n_targets")), bridge


def any_prefix(names: DataFrame, prefixes: DataFrame, dotted: Column) -> DataFrame:
    """M-01 as a hash join: the first prefix, by rank, that a dotted name is under."""
    from causeway.functions.names import dotted_prefixes

    met = names.withColumn("prefix", F.explode(dotted_prefixes(dotted))).join(prefixes, "prefix")
    return first_match(met, names.columns)
