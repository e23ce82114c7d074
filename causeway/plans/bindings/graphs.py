"""Reachability, phases and dependencies over graphs derived from ``part``, ``customer`` and ``nation``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import deps, reach
from causeway.runtime import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size", "p_brand")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p -> p // 2 and p -> p // 3 from p = 2 on; attributes of the edges come from p."""
    p = _parts(spark, sf_dir).where("node >= 2").select(F.col("node").alias("src"), F.explode(F.array(F.lit(2), F.lit(3))).alias("by"))
    dst = F.floor(F.col("src") / F.col("by"))
    out = p.select("src", dst.cast("long").alias("dst"), (F.col("src") * 4 + F.col("by")).alias("edge")).where("dst >= 1")
    return out.withColumns({"confidence": (F.col("edge") % 3).cast("int"), "obfuscating": F.col("edge") % 7 == 0, "kind": F.when(F.col("edge") % 2 == 0, "transform").otherwise("assignment")})


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _parts(spark, sf_dir)
    return p.where("p_size <= 5").select(F.col("node").alias("search"), "node"), p.where("p_size >= 45").select("node")


EDGES_SQL = """e AS (SELECT src, dst, edge, (edge % 3)::INTEGER AS confidence, edge % 7 = 0 AS obfuscating, CASE WHEN edge % 2 = 0 THEN 'transform' ELSE 'assignment' END AS kind
  FROM (SELECT p_partkey AS src, p_partkey // k AS dst, p_partkey * 4 + k AS edge FROM part, (VALUES (2), (3)) AS v(k) WHERE p_partkey >= 2) WHERE dst >= 1)"""
PATHS_SQL = f"""WITH RECURSIVE {EDGES_SQL},
w AS (SELECT p_partkey AS search, p_partkey AS node, 0 AS depth, [p_partkey] AS nodes, []::BIGINT[] AS edges FROM part WHERE p_size <= 5
  UNION ALL SELECT search, dst, depth + 1, list_append(nodes, dst), list_append(edges, edge) FROM w JOIN e ON node = src WHERE depth < 64),
b AS (SELECT search, node, min({{'d': depth, 'n': nodes, 'e': edges}}) AS x FROM w GROUP BY search, node),
paths AS (SELECT search, node, x.d AS depth, x.n AS nodes, x.e AS edges FROM b),
sinks AS (SELECT p_partkey AS node FROM part WHERE p_size >= 45)"""


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">").alias(c)


def x01_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reach.bfs(part_edges(spark, sf_dir), _ends(spark, sf_dir)[0])
    return found.select("search", "node", "depth", _text("nodes"), _text("edges"))


def x02_can_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.can_reach(part_edges(spark, sf_dir), _ends(spark, sf_dir)[1])


def x03_data_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reach.data_paths(part_edges(spark, sf_dir), *_ends(spark, sf_dir))
    return found.select("search", "node", "depth", _text("nodes"), _text("edges"))


def x05_path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return reach.path_facts(reach.data_paths(edges, *_ends(spark, sf_dir)), edges, ["search", "node"])


def x06_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints: parts of one brand; the second leg begins at three times the part, if there is one."""
    edges = part_edges(spark, sf_dir)
    p = _parts(spark, sf_dir)
    via = p.where("p_brand = 'Brand#1'").select(F.col("node").alias("stop"), (F.col("node") * 3).alias("go")).join(p.select(F.col("node").alias("go")), "go")
    sources, sinks = _ends(spark, sf_dir)
    return reach.paths_via(edges, sources, via, sinks).select("search", "node", "stop", "go", _text("nodes"))


X06_SQL = f"""{PATHS_SQL},
via AS (SELECT p_partkey AS stop, p_partkey * 3 AS go FROM part WHERE p_brand = 'Brand#1' AND p_partkey * 3 IN (SELECT p_partkey FROM part)),
first AS (SELECT node AS stop, min({{'s': search, 'd': depth, 'n': nodes}}) AS f FROM paths WHERE node IN (SELECT stop FROM via) GROUP BY node),
joint AS (SELECT go, min({{'stop': via.stop, 'f': f}}) AS j FROM via JOIN first ON via.stop = first.stop GROUP BY go),
w2 AS (SELECT go, go AS node, 0 AS depth, [go] AS nodes FROM joint UNION ALL SELECT go, dst, depth + 1, list_append(nodes, dst) FROM w2 JOIN e ON node = src),
b2 AS (SELECT go, node, min({{'d': depth, 'n': nodes}}) AS x FROM w2 WHERE node IN (SELECT node FROM sinks) GROUP BY go, node),
z AS (SELECT node, min({{'go': b2.go, 'j': j, 'n': x.n}}) AS b FROM b2 JOIN joint ON b2.go = joint.go GROUP BY node)
SELECT b.j.f.s AS search, node, b.j.stop AS stop, b.go AS go, array_to_string(list_concat(b.j.f.n, b.n), '>') AS nodes FROM z"""


def x07_control_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles: customers and their nation call one another; roots are rich customers."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("c"), F.col("c_nationkey").cast("long").alias("n"), "c_acctbal")
    edges = c.select(F.col("c").alias("src"), F.col("n").alias("dst"), F.col("c").alias("edge")).union(c.where("c_acctbal < 0").select(F.col("n").alias("src"), F.col("c").alias("dst"), (-F.col("c")).alias("edge")))
    roots = c.groupBy("n").agg(F.max("c").alias("c"))
    return reach.bfs(edges, roots.select(F.col("c").alias("search"), F.col("c").alias("node"))).select("search", "node", "depth")


X07_SQL = """WITH r AS (SELECT c_nationkey AS n, max(c_custkey) + 1000 AS c FROM customer GROUP BY 1)
SELECT c AS search, c AS node, 0 AS depth FROM r UNION ALL SELECT c, n, 1 FROM r
UNION ALL SELECT r.c, c_custkey + 1000, 2 FROM r JOIN customer ON c_nationkey = r.n WHERE c_acctbal < 0 AND c_custkey + 1000 <> r.c"""


def h03_phase_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _parts(spark, sf_dir).where("p_size <= 2 or p_size >= 49").select("node", F.when(F.col("p_size") <= 2, 2).otherwise(1).alias("phase"))
    found = reach.strongest_phase(part_edges(spark, sf_dir), roots)
    return _parts(spark, sf_dir).join(found, "node", "left").select("node", F.coalesce("phase", F.lit(0)).alias("phase"))


H03_SQL = f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT p_partkey AS node, CASE WHEN p_size <= 2 THEN 2 ELSE 1 END AS phase FROM part WHERE p_size <= 2 OR p_size >= 49
  UNION SELECT dst, phase FROM w JOIN e ON node = src)
SELECT p_partkey AS node, coalesce(max(phase), 0)::INTEGER AS phase FROM part LEFT JOIN w ON node = p_partkey GROUP BY 1"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("Part_"), c.cast("string"))
    half, third = F.floor(k / 2), F.floor(k / 3)
    needs = F.array(F.concat(name(half), F.lit(">=1")), F.concat(name(third), F.lit("; extra == 'x'")), F.lit("outside<2"), name(k), F.concat(name(half), F.lit("[s]")), F.lit("-bad"))
    return table(spark, sf_dir, "part").select(name(k).alias("name"), needs.alias("requirements"))


def b02_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.from_requirements(packages(spark, sf_dir))[1]


B02_SQL = """edges AS (SELECT 'part-' || p_partkey AS src, 'part-' || (p_partkey // 2) AS dst, 'Part_' || (p_partkey // 2) || '>=1' AS requirement, false AS optional FROM part WHERE p_partkey >= 1
  UNION ALL SELECT 'part-' || p_partkey, 'part-' || (p_partkey // 3), 'Part_' || (p_partkey // 3) || '; extra == ''x''', true FROM part WHERE p_partkey >= 2 AND p_partkey // 3 <> p_partkey // 2)"""


def b03_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = deps.from_requirements(packages(spark, sf_dir))
    out = deps.blast_radius(nodes, edges)
    return out.select("name", F.col("direct").cast("long").alias("direct"), F.col("transitive").cast("long").alias("transitive"), F.round("share", 9).alias("share"))


B03_SQL = f"""WITH RECURSIVE {B02_SQL}, w AS (SELECT dst AS name, src AS dependent FROM edges UNION SELECT name, src FROM w JOIN edges ON dst = dependent),
t AS (SELECT name, count(*) AS transitive FROM w GROUP BY 1), d AS (SELECT dst AS name, count(*) AS direct FROM edges GROUP BY 1), n AS (SELECT count(*) AS n FROM part)
SELECT 'part-' || p_partkey AS name, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, round(CASE WHEN n > 1 THEN coalesce(transitive, 0)::DOUBLE / (n - 1) ELSE 0 END, 9) AS share
FROM part CROSS JOIN n LEFT JOIN t ON t.name = 'part-' || p_partkey LEFT JOIN d ON d.name = 'part-' || p_partkey"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Priorities point to segments, segments to nations, nations to regions: a graph of a few dozen nodes at any size."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        edge(o.where("o_totalprice > 200000"), F.col("o_orderpriority"), F.col("c_mktsegment"))
        .union(edge(c.where("c_acctbal > 9000"), F.col("c_mktsegment"), tag("n", "c_nationkey")))
        .union(edge(n, tag("n", "n_nationkey"), tag("r", "n_regionkey")))
        .distinct()
    )
    nodes = n.select(tag("n", "n_nationkey").alias("name")).union(r.select(tag("r", "r_regionkey"))).union(edges.select("src")).union(edges.select("dst")).distinct()
    return nodes, edges


def b05_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.betweenness(*_places(spark, sf_dir)).select("name", F.round("betweenness", 9).alias("betweenness"))


B05_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT o_orderpriority AS src, c_mktsegment AS dst FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000
  UNION SELECT DISTINCT c_mktsegment, 'n' || c_nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
nodes AS (SELECT 'n' || n_nationkey AS name FROM nation UNION SELECT 'r' || r_regionkey FROM region UNION SELECT src FROM e UNION SELECT dst FROM e),
w AS (SELECT src AS s, [src, dst] AS path, dst AS t, 1 AS d FROM e UNION ALL SELECT s, list_append(path, dst), dst, d + 1 FROM w JOIN e ON t = src),
m AS (SELECT s, t, min(d) AS d FROM w GROUP BY s, t), short AS (SELECT w.* FROM w JOIN m USING (s, t, d)),
c AS (SELECT s, t, count(*) AS n FROM short GROUP BY s, t),
x AS (SELECT s, t, unnest(path[2:-2]) AS v FROM short), y AS (SELECT v, sum(1.0 / n) AS total FROM x JOIN c USING (s, t) GROUP BY v), k AS (SELECT count(*) AS n FROM nodes)
SELECT name, round(coalesce(total, 0) * CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 1 END, 9) AS betweenness FROM nodes CROSS JOIN k LEFT JOIN y ON v = name"""


BINDINGS = {
    "x01_bfs": (x01_bfs, f"{PATHS_SQL} SELECT search, node, depth, array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges FROM paths"),
    "x02_can_reach": (x02_can_reach, f"WITH RECURSIVE {EDGES_SQL}, w AS (SELECT p_partkey AS node FROM part WHERE p_size >= 45 UNION SELECT src FROM w JOIN e ON dst = node) SELECT node FROM w"),
    "x03_data_paths": (x03_data_paths, f"{PATHS_SQL} SELECT search, node, depth, array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges FROM paths WHERE node IN (SELECT node FROM sinks)"),
    "x05_path_facts": (
        x05_path_facts,
        f"{PATHS_SQL}, s AS (SELECT search, node, unnest(edges) AS edge FROM paths WHERE node IN (SELECT node FROM sinks)) SELECT search, node, min(confidence) AS confidence, bool_or(obfuscating) AS obfuscated, count(*) FILTER (kind = 'transform') AS transforms FROM s JOIN e USING (edge) GROUP BY search, node",
    ),
    "x06_paths_via": (x06_via, X06_SQL),
    "x07_control_paths": (x07_control_paths, X07_SQL),
    "h03_phase_map": (h03_phase_map, H03_SQL),
    "b02_dependency_edges": (b02_dependency_edges, f"WITH {B02_SQL} SELECT * FROM edges"),
    "b03_b04_blast_radius": (b03_blast_radius, B03_SQL),
    "b05_betweenness": (b05_betweenness, B05_SQL),
}
