"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.runtime import stored


def connected(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``comp`` (the smallest node reachable) for every node of ``links`` (columns ``a``, ``b``).

    Each round a node takes the smallest label among its neighbours', then the label of that label; the
    rounds grow as the logarithm of the longest path. Labels are written to the shared folder after each
    round. Nothing but a count reaches the driver.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        took = labels.join(near, "node", "left").select("node", F.least("comp", F.coalesce("low", "comp")).alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        new = stored(took.join(jump, "to", "left").select("node", F.least("to", F.coalesce("next", "to")).alias("comp"), "was"), "labels")
        labels = new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``comps`` (node, comp) after further ``links`` (a, b), which are searched as links among components only."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    mapped = stored(links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("ca"), F.coalesce("_b", "b").alias("cb")), "mapped")
    among = connected(mapped.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    fresh = mapped.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("comp")), F.struct(F.col("b").alias("node"), F.col("cb").alias("comp")))).alias("x")).select("x.*").distinct()
    every = comps.union(fresh.join(comps.select("node"), "node", "left_anti").select("node", "comp"))
    new = every.join(among.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left")
    return stored(new.select("node", F.coalesce("_to", "comp").alias("comp")), "labels")
