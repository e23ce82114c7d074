"""Bounded reachability over edge tables: searches with canonical shortest paths, closures, phases.

All searches run in one loop, a level at a time. What a breadth-first queue would meet first is the
smallest path of nodes among the shortest ones, so the order of discovery needs no numbering: it is the order
of node paths, and one grouped minimum a level finds parents without a window. Levels go to the shared folder, so that a
lost executor costs a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.runtime import stored

#: Edges of a path at most (fixed value).
DEPTH = 64


def bfs(edges: DataFrame, sources: DataFrame, depth: int = DEPTH) -> DataFrame:
    """X-01, X-04: for each search every node reached, with its canonical shortest path.

    ``edges``: src, dst, edge. ``sources``: search, node. Result: search, node, depth, nodes, edges; the
    source itself has depth 0 and an empty edge path.
    """
    kind = edges.schema["edge"].dataType.simpleString()
    hop = stored(edges.select("src", "dst", "edge"), "hops")
    level = stored(sources.select("search", "node").distinct().select("search", "node", F.lit(0).alias("depth"), F.array("node").alias("nodes"), F.expr(f"cast(array() as array<{kind}>)").alias("edges")), "level")
    reached = level
    for d in range(1, depth + 1):
        met = level.withColumnRenamed("node", "src").join(hop, "src").join(reached.select("search", F.col("node").alias("dst")), ["search", "dst"], "left_anti")
        best = met.groupBy("search", "dst").agg(F.min(F.struct("nodes", "edge", "edges")).alias("best"))
        new = best.select("search", F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("best.nodes", F.array("dst")).alias("nodes"), F.concat("best.edges", F.array("best.edge")).alias("edges"))
        level = stored(new, "level")
        if level.isEmpty():
            break
        reached = reached.union(level)
    return reached


def closure(edges: DataFrame, start: DataFrame, bound: int | None = None) -> DataFrame:
    """Nodes from which ``start`` can be left along ``edges`` (src, dst), start included."""
    hop = edges.select("src", "dst").distinct()
    level = stored(start.select("node").distinct(), "closure")
    seen = level
    while bound is None or bound > 0:
        new = level.withColumnRenamed("node", "src").join(hop, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        level = stored(new, "closure")
        if level.isEmpty():
            break
        seen = seen.union(level)
        bound = None if bound is None else bound - 1
    return seen


def can_reach(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """X-02: nodes with a path to any sink."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sinks)


def data_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """X-03: one canonical shortest path for each search and sink it reaches.

    Edges that lead to no sink are left out first (O-01), which changes no path.
    """
    live = can_reach(edges, sinks)
    used = edges.join(live.withColumnRenamed("node", "dst"), "dst", "left_semi").join(live.withColumnRenamed("node", "src"), "src", "left_semi")
    found = bfs(used, sources.join(live, "node", "left_semi"), depth)
    return found.join(sinks.select("node").distinct(), "node", "left_semi")


def paths_via(edges: DataFrame, sources: DataFrame, via: DataFrame, sinks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """X-06: paths through a joint. ``via``: stop, go: where a leg ends and where the next begins.

    Each joint takes the first search that reaches it; each sink takes the first joint that reaches it.
    """
    first = data_paths(edges, sources, via.select(F.col("stop").alias("node")), depth)
    to_stop = first.groupBy(F.col("node").alias("stop")).agg(F.min(F.struct("search", "depth", "nodes", "edges")).alias("first"))
    joints = via.join(to_stop, "stop").groupBy("go").agg(F.min(F.struct("stop", "first")).alias("joint"))
    second = data_paths(edges, joints.select(F.col("go").alias("search"), F.col("go").alias("node")), sinks, depth)
    whole = second.withColumnRenamed("search", "go").join(joints, "go")
    best = whole.groupBy("node").agg(F.min(F.struct("go", "joint", "nodes", "edges")).alias("b"))
    return best.select(
        F.col("b.joint.first.search").alias("search"),
        "node",
        F.col("b.joint.stop").alias("stop"),
        F.col("b.go").alias("go"),
        F.concat("b.joint.first.nodes", "b.nodes").alias("nodes"),
        F.concat("b.joint.first.edges", "b.edges").alias("edges"),
    )


def path_facts(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """X-05, X-09: least confidence, whether any step obfuscates, and number of transforms of each path.

    ``edges``: edge, confidence, obfuscating, kind.
    """
    steps = paths.select(*key, F.explode("edges").alias("edge")).join(edges, "edge")
    return steps.groupBy(*key).agg(F.min("confidence").alias("confidence"), F.max("obfuscating").alias("obfuscated"), F.sum((F.col("kind") == "transform").cast("int")).alias("transforms"))


def is_well_formed(kinds: Column) -> Column:
    """X-08: a path has steps, begins at a source and ends at a sink."""
    return (F.size(kinds) > 0) & (F.get(kinds, F.lit(0)) == "source") & (F.element_at(kinds, -1) == "sink")


def strongest_phase(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """H-03: the largest phase (an ordinal) among the roots that reach a node. ``roots``: node, phase."""
    hop = edges.select("src", "dst").distinct()
    state = stored(roots.groupBy("node").agg(F.max("phase").alias("phase")), "phase")
    level = state
    while True:
        met = level.withColumnRenamed("node", "src").join(hop, "src").groupBy(F.col("dst").alias("node")).agg(F.max("phase").alias("offer"))
        better = met.join(state, "node", "left").where(F.col("phase").isNull() | (F.col("offer") > F.col("phase"))).select("node", F.col("offer").alias("phase"))
        level = stored(better, "phase")
        if level.isEmpty():
            return state
        state = stored(state.join(level.select("node"), "node", "left_anti").union(level), "phase")
