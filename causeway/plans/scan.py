"""From source files of many distributions to findings, risks, verdicts and reports, in one plan.

Graphs are built a distribution at a time on Python workers (a distribution is bounded by the limits of
unpacking), and searched there: one pass walks back from decoders, opened files and processes, a second one finds phases and all paths
from sources and roots to sinks. What is looked up by name, shape or rule, and all that makes findings of paths, is
joins over all distributions together. Keys carry the distribution, so that partitions follow nodes, not distributions.
"""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.literals import LITERAL_SHAPES, escape_encoded, sensitive_path, written_location
from causeway.functions.names import dotted_prefixes
from causeway.operators import catalogue as cat
from causeway.operators import cooccurrence, scoring, search
from causeway.operators.evaluate import first_of
from causeway.operators.walker import Package
from causeway.runtime import ship, stored

SCHEMA_VERSION = 2
PHASES, CONFIDENCES = ("runtime", "import", "install"), ("dynamic", "ambiguous", "resolved")
MODES = ("file_cooccurrence", "definition_cooccurrence", "reachability_unweighted", "reachability")

GRAPH = """dist_id string, error string,
files array<struct<file:int,path:string>>,
symbols array<struct<symbol:int,name:string,qualified:string,kind:string,file:int,scope:int,line:int>>,
call_edges array<struct<src:int,dst:int,confidence:int>>,
roots array<struct<ord:int,phase:int,kind:string,symbol:int>>,
flow_nodes array<struct<node:int,kind:string,label:string,file:int,line:int,col:int,owner:int>>,
flow_edges array<struct<edge:int,src:int,dst:int,kind:string,confidence:int,callee:string,obfuscating:boolean>>,
first_argument array<struct<formal:int,first:int>>,
file_writes array<struct<written:int,go:int,handle:int>>,
conditional array<int>, interpreters array<int>, stdin array<struct<node:int,receiver:int>>,
ast_nodes int, parse_errors int"""


@dataclass(frozen=True)
class Options:
    mode: str = "reachability"
    min_confidence: str | None = None

    @property
    def phase_weighting(self) -> bool:
        return self.mode != "reachability_unweighted"


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Seconds that the graph of one distribution may take.
TIME_LIMIT = 300.0


@contextmanager
def time_limit(seconds: float):
    """Raises TimeoutError in what runs longer."""

    def stop(*_) -> None:
        raise TimeoutError(f"more than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _graph_row(dist: str, files: list, top: list, backend: str | None, backend_path: list, limit: float = TIME_LIMIT) -> dict:
    try:
        with time_limit(limit):
            p = Package([(f["path"], f["text"] or "") for f in files or []], top or [], backend, backend_path or []).build()
    except Exception as e:  # V-26: a hostile input costs its own row
        return {"dist_id": dist, "error": f"{type(e).__name__}: {str(e)[:200]}"}
    named = lambda names, rows: [dict(zip(names.split(), r)) for r in rows]
    calls = {(owner, t): k for owner, ts in p.reached.items() for t, k in sorted(ts, key=lambda x: x[1]) if isinstance(t, int)}
    return {
        "dist_id": dist,
        "error": None,
        "files": named("file path", [(k, path) for k, (path, _) in enumerate(p.files)]),
        "symbols": named("symbol name qualified kind file scope line", [(s.id, s.name, s.qualified, s.kind, s.file, s.scope, s.line) for s in p.symbols]),
        "call_edges": named("src dst confidence", [(a, b, k) for (a, b), k in sorted(calls.items())]),
        "roots": named("ord phase kind symbol", [(k, *r) for k, r in enumerate(p.roots)]),
        "flow_nodes": named("node kind label file line col owner", p.nodes),
        "flow_edges": named("edge src dst kind confidence callee obfuscating", p.edges),
        "first_argument": named("formal first", p.first_argument),
        "file_writes": named("written go handle", p.file_writes),
        "conditional": sorted(p.conditional),
        "interpreters": sorted(p.interpreters),
        "stdin": named("node receiver", p.stdin),
        "ast_nodes": p.ast_nodes,
        "parse_errors": p.errors,
    }


def build_graphs(sources: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row for each distribution. ``sources``: dist_id, path, text. ``meta``: dist_id, top_level_modules, build_backend, backend_path."""
    python = sources.where(F.endswith("path", F.lit(".py")))
    one = python.groupBy("dist_id").agg(F.collect_list(F.struct("path", "text")).alias("files"))
    if meta is None:
        one = one.withColumns({"top_level_modules": F.lit(None).cast("array<string>"), "build_backend": F.lit(None).cast("string"), "backend_path": F.lit(None).cast("array<string>")})
    else:
        one = one.join(meta, "dist_id", "left")
    return graphs_where(one)


def graphs_where(one: DataFrame) -> DataFrame:
    """Graphs of rows that hold all files of a distribution, without an exchange.

    ``one``: dist_id, files (array of structs with path and text), top_level_modules, build_backend, backend_path.
    """
    ship(one.sparkSession)
    spark_schema = T._parse_datatype_string(GRAPH)
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spark_schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                row = _graph_row(r["dist_id"], r["files"], r["top_level_modules"] or _top_level([f["path"] for f in r["files"]]), r["build_backend"], r["backend_path"])
                yield pa.RecordBatch.from_pylist([row], schema)

    return stored(one.select("dist_id", "files", "top_level_modules", "build_backend", "backend_path").mapInArrow(run, spark_schema), "graphs")


def _top_level(paths: list[str]) -> list[str]:
    """IO-18 for one list of paths."""
    inits = [p.removesuffix("/__init__.py") for p in paths if p.endswith("/__init__.py")]
    found = {p for p in inits if "/" not in p} or {p.split("/")[1] for p in inits if p.count("/") == 1}
    return sorted(found | {p.removesuffix(".py") for p in paths if "/" not in p and p.endswith(".py") and p != "setup.py"})


def _key(number: Column, dist: str = "dist_id") -> Column:
    return F.format_string("%s#%08d", F.col(dist), number)


class Graphs:
    """The tables that one row for each distribution holds."""

    def __init__(self, graphs: DataFrame):
        self.graphs = graphs.where("error is null")
        each = lambda c: self.graphs.select("dist_id", F.explode(c).alias("x")).select("dist_id", "x.*")
        self.files = each("files")
        self.symbols = each("symbols").withColumn("key", _key(F.col("symbol")))
        self.roots = each("roots").withColumn("key", _key(F.col("symbol")))
        self.calls = each("call_edges").select("dist_id", _key(F.col("src")).alias("src"), _key(F.col("dst")).alias("dst"), F.concat(_key(F.col("src")), F.lit(">"), _key(F.col("dst"))).alias("edge"), "confidence")
        nodes = each("flow_nodes").join(self.files, ["dist_id", "file"], "left")
        self.nodes = nodes.select("dist_id", _key(F.col("node")).alias("node"), "kind", "label", "path", "line", "col", _key(F.col("owner")).alias("owner"))
        self.edges = each("flow_edges").select("dist_id", _key(F.col("src")).alias("src"), _key(F.col("dst")).alias("dst"), _key(F.col("edge")).alias("edge"), "kind", "confidence", "callee", "obfuscating")
        self.first = each("first_argument").select(_key(F.col("formal")).alias("formal"), _key(F.col("first")).alias("first"))
        self.writes = each("file_writes").select("dist_id", _key(F.col("written")).alias("written"), F.when(F.col("go") >= 0, _key(F.col("go"))).alias("go"), F.when(F.col("handle") >= 0, _key(F.col("handle"))).alias("handle"))
        self.stdin = each("stdin").select(_key(F.col("node")).alias("node"), _key(F.col("receiver")).alias("receiver"))
        self.conditional = self.graphs.select("dist_id", F.explode("conditional").alias("n")).select(_key(F.col("n")).alias("node"))
        self._origins: DataFrame | None = None

    def decoders(self) -> DataFrame:
        """Results of calls that decode, with the nodes' columns."""
        patterns = self.nodes.sparkSession.createDataFrame([(d,) for d in cat.DECODERS], "pattern string")
        return _under(self.nodes.where("kind = 'call_result'"), patterns).dropDuplicates(["node"])

    def origins(self, what: str) -> DataFrame:
        """What the walks back found: start, end (and node, the same as end)."""
        if self._origins is None:
            self._origins = _searched(self.graphs, ["flow_nodes", "flow_edges", "file_writes", "interpreters", "stdin"], {"decoders": self.decoders()}, _origins, "origins")
        rows = self._origins.where(F.col("what") == what)
        return rows.select("dist_id", _key(F.col("start")).alias("start"), _key(F.col("end")).alias("end"), _key(F.col("end")).alias("node"))


def _searched(graphs: DataFrame, columns: list[str], questions: dict[str, DataFrame], work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``work`` on each distribution's row: its graph ``columns``, then a list of numbers for each of ``questions`` (tables with a column node).

    It yields (what, start, end, nodes, edges); numbers become keys again.
    """
    rows = graphs.select("dist_id", *columns)
    for name, asked in questions.items():
        dist, number = F.expr("left(node, length(node) - 9)"), F.right(F.col("node"), F.lit(8)).cast("int")
        rows = rows.join(asked.where("node is not null").select(dist.alias("dist_id"), number.alias("n")).groupBy("dist_id").agg(F.collect_set("n").alias(name)), "dist_id", "left")
    names = [*columns, *questions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                found = [(row["dist_id"], *x) for x in work(**{c: row[c] or [] for c in names})]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + 10_000]), kinds)], ["dist_id", "what", "start", "end", "nodes", "edges"])

    return stored(rows.mapInArrow(run, "dist_id string, what string, start int, end int, nodes array<int>, edges array<int>"), schema)


def _flow(flow_edges: list[dict]) -> list[tuple[int, int, int]]:
    return [(e["src"], e["dst"], e["edge"]) for e in flow_edges]


def _origins(flow_nodes, flow_edges, file_writes, interpreters, stdin, decoders) -> Iterator[tuple]:
    """M-06, M-18, M-19: decoders of constants; what an opened file's path is made of; inputs of interpreters."""
    kinds = {n["node"]: n["kind"] for n in flow_nodes}
    back = search.adjacent((b, a, e) for a, b, e in _flow(flow_edges))
    for n in sorted(decoders):
        if search.is_constant(back, kinds, n):
            yield "decoder", n, n, None, None
    # the walk back from an opened file does not enter what was written to it
    bare = search.adjacent((e["dst"], e["src"], e["edge"]) for e in flow_edges if not (e["kind"] == "transform" and e["callee"] == "open" and kinds[e["dst"]] == "definition"))
    for h in sorted({w["handle"] for w in file_writes if w["handle"] >= 0}):
        for n in search.walked(bare, h, search.PATH_NODES)[0]:
            yield "handle", h, n, None, None
    runs = set(interpreters)
    for r in sorted({x["receiver"] for x in stdin}):
        if not runs.isdisjoint(search.walked(back, r)[0]):
            yield "stdin", r, r, None, None


def _reached(flow_edges, call_edges, roots, file_writes, sources, downloads, sinks, owners) -> Iterator[tuple]:
    """X-03, X-06, X-07, H-03: paths of data, paths through written files, paths of calls, phases (as the end)."""
    flow = _flow(flow_edges)
    for s, end, path in search.data_paths(flow, sources, set(sinks)):
        yield "data", s, end, *path
    via = [(w["written"], w["go"]) for w in file_writes if w["go"] >= 0]
    for s, end, path in search.paths_via(flow, downloads, via, set(sinks)):
        yield "file_write", s, end, *path
    calls = [(c["src"], c["dst"]) for c in call_edges]
    for s, end, path in search.data_paths([(a, b, 0) for a, b in calls], [r["symbol"] for r in roots], set(owners)):
        yield "call", s, end, path[0], []
    for n, phase in search.phases(calls, [(r["symbol"], r["phase"]) for r in roots]).items():
        yield "phase", n, phase, None, None


def _under(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """M-01 as a hash join: rows with every pattern that their label is under."""
    return rows.withColumn("pattern", F.explode(dotted_prefixes(F.col("label")))).join(F.broadcast(patterns), "pattern")


def find_sources(g: Graphs) -> DataFrame:
    """M-02..M-06, M-14: dist_id, node, kind, pattern; one row for each node and kind."""
    spark = g.nodes.sparkSession
    patterns = spark.createDataFrame(cat.source_patterns(), "source_kind string, pattern string, rank int")
    fed = g.edges.select(F.col("dst").alias("node")).distinct()
    named = patterns.where("source_kind in ('environment', 'system_identity', 'user_input', 'network_response')")
    results = g.nodes.where("kind = 'call_result'")
    reads = g.nodes.where("kind = 'use'").join(fed, "node", "left_anti")
    by_name = _under(results.unionByName(reads), named).select("dist_id", "node", "source_kind", "pattern", "rank", "path", "line", "col")

    literals = g.nodes.where("kind = 'literal'")
    shapes = [(k, p, n) for k, p, n in cat.source_patterns() if k in ("sensitive_file", "suspicious_literal")]
    tests = [F.when(sensitive_path(p, F.col("label")) if k == "sensitive_file" else LITERAL_SHAPES[p](F.col("label")), F.struct(F.lit(k).alias("source_kind"), F.lit(p).alias("pattern"), F.lit(n).alias("rank"))) for k, p, n in shapes]
    by_shape = literals.withColumn("x", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))).select("dist_id", "node", "x.*", "path", "line", "col")
    method = lambda c: F.substring_index(c, ".", -1)
    path_api = lambda c: F.exists(F.array(*map(F.lit, cat.PATH_APIS)), lambda p: (c == p) | F.startswith(c, F.concat(p, F.lit("."))))
    into = g.nodes.where("kind = 'parameter'").select(F.col("node").alias("dst"), F.col("label").alias("into"))
    uses = g.edges.join(literals.select(F.col("node").alias("src")), "src", "left_semi").join(into, "dst", "left")
    called = F.when(F.col("kind") == "transform", F.col("callee")).when(F.col("kind") == "argument", F.col("into"))
    separators = uses.groupBy(F.col("src").alias("node")).agg(F.min(F.coalesce(method(called).isin(*cat.SEPARATOR_METHODS) & ~path_api(called), F.lit(False))).alias("only")).where("only")
    by_shape = by_shape.join(separators.select("node", F.lit("<literal:home-or-root-path>").alias("pattern")), ["node", "pattern"], "left_anti").select(*by_name.columns)

    decoders = g.decoders()
    decoded = decoders.join(g.origins("decoder").select("node"), "node", "left_semi").select("dist_id", "node", F.col("label").alias("pattern"), "path", "line", "col")
    escaped = literals.where(escape_encoded(F.col("label"))).select("dist_id", "node", F.lit("<escaped-literal>").alias("pattern"), "path", "line", "col")
    rank = next(n for k, _, n in cat.source_patterns() if k == "decoded_literal")
    by_fold = decoded.union(escaped).withColumns({"source_kind": F.lit("decoded_literal"), "rank": F.lit(rank)}).select(*by_name.columns)
    return first_of(by_name.unionByName(by_shape).unionByName(by_fold), ["dist_id", "node", "source_kind"], ["rank", "pattern"])


def find_sinks(g: Graphs) -> DataFrame:
    """M-17..M-19: dist_id, node, sink_kind, pattern, owner; one row for each node and kind."""
    spark = g.nodes.sparkSession
    patterns = spark.createDataFrame(cat.sink_patterns(), "sink_kind string, pattern string, first_only boolean, rank int")
    firsts = g.first.select(F.col("first").alias("node"))
    formals = g.nodes.where("kind = 'parameter'").join(firsts, "node", "left_anti")
    # patterns in angle brackets are no names: what they stand for is looked up below
    called = _under(formals, patterns.where("not startswith(pattern, '<')")).join(g.first.withColumnRenamed("formal", "node"), "node", "left")
    by_name = called.select("dist_id", F.when(F.col("first_only"), F.coalesce("first", "node")).otherwise(F.col("node")).alias("node"), "sink_kind", "pattern", "rank", "owner", "path", "line", "col")

    parts = g.origins("handle").select(F.col("start").alias("search"), F.col("end").alias("node")).join(g.nodes.select("node", "kind", "label"), "node")
    site = F.exists(F.array(*map(F.lit, cat.SITE_DIRS)), lambda p: (F.col("label") == p) | F.startswith("label", F.concat(p, F.lit("."))))
    built = parts.groupBy("search").agg(
        F.collect_set(F.when(F.col("kind") == "literal", F.col("label"))).alias("literals"),
        F.max(F.coalesce(F.col("kind").isin("call_result", "use") & (F.col("node") != F.col("search")) & site, F.lit(False))).alias("site"),
    )
    places = [(p[7:-1], p, n) for _, p, _, n in cat.sink_patterns() if p.startswith("<write:")]
    tests = [F.when(written_location(place, F.col("literals"), F.col("site")), F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("rank"))) for place, p, n in places]
    written = g.writes.join(built.withColumnRenamed("search", "handle"), "handle").withColumn("x", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    by_write = written.select(F.col("written").alias("node"), F.lit("persistence_write").alias("sink_kind"), "x.pattern", "x.rank").join(g.nodes, "node").select(*by_name.columns)

    fed = g.origins("stdin").select(F.col("start").alias("receiver"))
    rank = next(n for _, p, _, n in cat.sink_patterns() if p == "<interpreter-stdin>")
    stdin = g.stdin.join(fed, "receiver", "left_semi").join(g.nodes, "node").select("dist_id", "node", F.lit("code_execution").alias("sink_kind"), F.lit("<interpreter-stdin>").alias("pattern"), F.lit(rank).alias("rank"), "owner", "path", "line", "col")
    return first_of(by_name.unionByName(by_write).unionByName(stdin), ["dist_id", "node", "sink_kind"], ["rank", "pattern"])


def _steps(paths: DataFrame, g: Graphs, keys: list[str]) -> DataFrame:
    """X-05: steps, least confidence and whether a transform obfuscates, of paths with ``nodes`` and ``edges``."""
    at = paths.select(*keys, F.posexplode("nodes").alias("pos", "at")).join(g.nodes.select(F.col("node").alias("at"), "label", "path", "line", "col"), "at").drop("at")
    kind = paths.select(*keys, F.posexplode("edges").alias("pos", "edge")).withColumn("pos", F.col("pos") + 1).join(g.edges.select("edge", "kind", "confidence", "obfuscating", "callee"), "edge").drop("edge")
    both = at.join(kind, [*keys, "pos"], "left")
    step = F.struct("pos", F.when(F.col("pos") == 0, "source").otherwise(F.coalesce("kind", F.lit("joint"))).alias("kind"), "path", "line", "col", F.col("label").alias("symbol"), F.col("callee").alias("detail"))
    found = both.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min("confidence").alias("confidence"), F.max("obfuscating").alias("obfuscated"))
    last = F.size("steps") - 1
    return found.withColumn("steps", F.transform("steps", lambda s, k: F.struct(F.when(k == last, "sink").otherwise(s["kind"]).alias("kind"), s["path"].alias("path"), s["line"].alias("line"), s["col"].alias("col"), s["symbol"].alias("symbol"), s["detail"].alias("detail"))))


class Prepared:
    """What all modes share: sources, sinks, phases, and all paths with the steps of those of data, each computed once."""

    def __init__(self, graphs: DataFrame):
        self.g = g = Graphs(graphs)
        self.sources, self.sinks = stored(find_sources(g), "sources"), stored(find_sinks(g), "sinks")
        reads = self.sources.where("source_kind = 'sensitive_file'").join(g.nodes.select("node", "owner"), "node").select(F.col("owner").alias("node"))
        questions = {"sources": self.sources, "downloads": self.sources.where("source_kind = 'network_response'"), "sinks": self.sinks, "owners": self.sinks.select(F.col("owner").alias("node")).union(reads)}
        self.found = _searched(g.graphs, ["flow_edges", "call_edges", "roots", "file_writes"], questions, _reached, "found")
        self.phases = self.found.where("what = 'phase'").select(_key(F.col("start")).alias("owner"), F.col("end").alias("phase_ord"))
        self._steps: DataFrame | None = None

    def steps(self) -> DataFrame:
        if self._steps is None:
            number = lambda c: F.transform(c, lambda n: F.when(n >= 0, _key(n)))
            via = F.when(F.col("what") == "data", "").otherwise(F.col("what"))
            paths = self.found.where("what in ('data', 'file_write')").select(_key(F.col("start")).alias("search"), _key(F.col("end")).alias("node"), number("nodes").alias("nodes"), number("edges").alias("edges"), via.alias("via"))
            self._steps = stored(_steps(paths, self.g, ["search", "node", "via"]), "steps")
        return self._steps

    def calls(self) -> DataFrame:
        """Paths of calls: search, node, nodes, edges (as keys)."""
        keys = F.transform("nodes", lambda n: _key(n))
        out = self.found.where("what = 'call'").select(_key(F.col("start")).alias("search"), _key(F.col("end")).alias("node"), keys.alias("nodes"))
        pairs = F.expr("transform(slice(nodes, 2, size(nodes)), (n, k) -> concat(nodes[k], '>', n))")
        return out.withColumn("edges", pairs)


def evaluate(graphs: DataFrame | Prepared, options: Options = Options()) -> DataFrame:
    """E-01..E-09, E-16: findings of all rules over all distributions."""
    ready = graphs if isinstance(graphs, Prepared) else Prepared(graphs)
    g, sources, sinks, phases = ready.g, ready.sources, ready.sinks, ready.phases
    rules = cat.rules(g.graphs.sparkSession)
    by_source = rules.where("kind = 'data'").select("*", F.explode("sources").alias("source_kind")).drop("sources").select("*", F.explode("sinks").alias("sink_kind")).drop("sinks")
    src = sources.select("dist_id", F.col("node").alias("source"), "source_kind", F.col("pattern").alias("source_pattern"), F.col("path").alias("source_path"), F.col("line").alias("source_line"), F.col("col").alias("source_col"))
    snk = sinks.select("dist_id", F.col("node").alias("sink"), "sink_kind", F.col("pattern").alias("sink_pattern"), "owner", F.col("path").alias("sink_path"), F.col("line").alias("sink_line"), F.col("col").alias("sink_col"))

    if options.mode in ("file_cooccurrence", "definition_cooccurrence"):
        found = _cooccurring(g, rules, src, snk, options.mode)
    else:
        hits = ready.steps().withColumnRenamed("search", "source").withColumnRenamed("node", "sink")
        data = hits.join(src, "source").join(snk.drop("dist_id"), "sink").join(F.broadcast(by_source.withColumn("via", F.coalesce("via", F.lit("")))), ["source_kind", "sink_kind", "via"])
        data = data.withColumn("confidence", F.coalesce("confidence", F.lit(2))).withColumn("obfuscated", F.coalesce("obfuscated", F.lit(False)) | (F.col("source_kind") == "decoded_literal"))
        keep = ["dist_id", "rule", "ord", "title", "kind", "severity", "severity_override", "objective", "typical_phase", "source", "source_pattern", "sink", "sink_pattern", "owner", "confidence", "obfuscated", "steps"]
        found = data.select(*keep).unionByName(_control(ready, rules, src, snk).select(*keep))

    found = found.join(phases, "owner", "left").withColumn("phase", F.element_at(F.array(*map(F.lit, PHASES)), F.coalesce("phase_ord", F.lit(0)) + 1))
    if options.min_confidence is not None:
        found = found.where(F.col("confidence") >= CONFIDENCES.index(options.min_confidence))
    found = found.withColumn("severity", cooccurrence.severity(F.col("severity"), F.col("severity_override"), F.col("sink_pattern")))
    found = found.withColumn("confidence", F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence") + 1))
    found = found.join(g.conditional.withColumnRenamed("node", "sink").withColumn("_c", F.lit(True)), "sink", "left")
    score = scoring.finding_score(F.col("severity"), F.col("phase"), F.col("confidence"), F.col("obfuscated"), options.phase_weighting)
    return found.select(
        "dist_id", "rule", "ord", "objective", "severity", "phase", "confidence", score.alias("score"), "kind", "obfuscated", F.coalesce("_c", F.lit(False)).alias("conditional"),
        cooccurrence.message(F.col("title"), F.get("steps.symbol", F.lit(0)), F.col("sink_pattern")).alias("message"), "source", "sink", "source_pattern", "sink_pattern", "steps",
    )


def _reads_as_sinks(src: DataFrame, g: Graphs) -> DataFrame:
    """E-05: the sensitive reads that a rule about reads is after, as if they were sinks."""
    owner = g.nodes.select(F.col("node").alias("sink"), "owner")
    return src.where("source_kind = 'sensitive_file'").select("dist_id", F.col("source").alias("sink"), F.lit("sensitive_file").alias("sink_kind"), F.col("source_pattern").alias("sink_pattern"), F.col("source_path").alias("sink_path"), F.col("source_line").alias("sink_line"), F.col("source_col").alias("sink_col")).join(owner, "sink").select("dist_id", "sink", "sink_kind", "sink_pattern", "owner", "sink_path", "sink_line", "sink_col")


def _control(ready: Prepared, rules: DataFrame, src: DataFrame, snk: DataFrame) -> DataFrame:
    """X-07, E-03: from phase roots along calls to the definitions that hold a sink; the first root of the rule's phase."""
    g, paths = ready.g, ready.calls()
    targets = snk.unionByName(_reads_as_sinks(src, g))
    roots = g.roots.select(F.col("key").alias("search"), F.col("ord").alias("root_ord"), F.element_at(F.array(*map(F.lit, PHASES)), F.col("phase") + 1).alias("root_phase"))
    wanted = rules.where("kind = 'control'").select("*", F.explode("sinks").alias("sink_kind")).drop("sinks", "sources")
    met = paths.withColumnRenamed("node", "owner").join(targets, "owner").join(roots, "search").join(F.broadcast(wanted), "sink_kind").where("root_phase = typical_phase")
    first = first_of(met.select("dist_id", "rule", "sink", "root_ord", "ord", "title", "kind", "severity", "severity_override", "objective", "typical_phase", F.col("search").alias("source"), "sink_pattern", "owner", "nodes", "edges", "sink_path", "sink_line", "sink_col"), ["dist_id", "rule", "sink"], ["root_ord"])
    conf = first.select("rule", "sink", F.explode("edges").alias("edge")).join(g.calls.select("edge", "confidence"), "edge").groupBy("rule", "sink").agg(F.min("confidence").alias("confidence"))
    names = g.symbols.select("key", "qualified", "file", "line", "dist_id").join(g.files, ["dist_id", "file"]).select("key", "qualified", "path", "line")
    at = first.select("rule", "sink", F.posexplode("nodes").alias("pos", "key")).join(names, "key")
    step = F.struct("pos", F.when(F.col("pos") == 0, "source").otherwise("call").alias("kind"), "path", "line", F.lit(1).alias("col"), F.when(F.col("pos") == 0, F.concat(F.lit("<phase-root> "), F.col("qualified"))).otherwise(F.col("qualified")).alias("symbol"), F.lit(None).cast("string").alias("detail"))
    steps = at.groupBy("rule", "sink").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    last = F.struct(F.lit("sink").alias("kind"), F.col("sink_path").alias("path"), F.col("sink_line").alias("line"), F.col("sink_col").alias("col"), F.col("sink_pattern").alias("symbol"), F.lit(None).cast("string").alias("detail"))
    bare = F.transform("steps", lambda s: F.struct(s["kind"].alias("kind"), s["path"].alias("path"), s["line"].alias("line"), s["col"].alias("col"), s["symbol"].alias("symbol"), s["detail"].alias("detail")))
    return first.join(steps, ["rule", "sink"]).join(conf, ["rule", "sink"], "left").withColumns({"confidence": F.coalesce("confidence", F.lit(2)), "obfuscated": F.lit(False), "source_pattern": F.lit("<phase-root>"), "steps": F.concat(bare, F.array(last))})


def _cooccurring(g: Graphs, rules: DataFrame, src: DataFrame, snk: DataFrame, mode: str) -> DataFrame:
    """E-04: modes A and B. Each sink with the first source of the rule's kinds in its file or definition."""
    roots = g.roots.select("dist_id", F.col("key").alias("source"), F.lit("phase_root").alias("source_kind"), F.lit("<phase-root>").alias("source_pattern"), F.col("key").alias("source_owner"), F.element_at(F.array(*map(F.lit, PHASES)), F.col("phase") + 1).alias("root_phase"))
    roots = roots.join(g.symbols.select(F.col("key").alias("source"), "file", F.col("line").alias("source_line"), "dist_id"), ["dist_id", "source"]).join(g.files.withColumnRenamed("path", "source_path"), ["dist_id", "file"]).withColumn("source_col", F.lit(1)).drop("file")
    owned = src.join(g.nodes.select(F.col("node").alias("source"), F.col("owner").alias("source_owner")), "source").withColumn("root_phase", F.lit(None).cast("string"))
    every = owned.unionByName(roots)
    targets = snk.unionByName(_reads_as_sinks(src, g))
    pairs = rules.select("*", F.explode("sources").alias("source_kind")).drop("sources")
    of_rule = every.join(F.broadcast(pairs), "source_kind").where("source_kind <> 'phase_root' or root_phase = typical_phase")
    place = F.col("source_path") if mode == "file_cooccurrence" else F.col("source_owner")
    first = of_rule.withColumn("place", place).groupBy("dist_id", "rule", "place").agg(F.min(F.struct("source_path", "source_line", "source_col", "source", "source_pattern", "source_kind")).alias("s"))
    wanted = rules.select("*", F.explode("sinks").alias("sink_kind")).drop("sinks", "sources")
    met = targets.join(F.broadcast(wanted), "sink_kind").withColumn("place", F.col("sink_path") if mode == "file_cooccurrence" else F.col("owner")).join(first, ["dist_id", "rule", "place"])
    step = lambda kind, p: F.struct(F.lit(kind).alias("kind"), *[F.col(c).alias(n) for c, n in zip(p, ("path", "line", "col", "symbol"))], F.lit(None).cast("string").alias("detail"))
    steps = F.array(step("source", ["s.source_path", "s.source_line", "s.source_col", "s.source_pattern"]), step("sink", ["sink_path", "sink_line", "sink_col", "sink_pattern"]))
    return met.select("dist_id", "rule", "ord", "title", "kind", "severity", "severity_override", "objective", "typical_phase", F.col("s.source").alias("source"), F.col("s.source_pattern").alias("source_pattern"), "sink", "sink_pattern", "owner", F.lit(2).alias("confidence"), (F.col("s.source_kind") == "decoded_literal").alias("obfuscated"), steps.alias("steps"))


def reports(graphs: DataFrame, findings: DataFrame, options: Options = Options(), skipped: DataFrame | None = None) -> DataFrame:
    """E-10..E-13: one report row for each distribution; those that were skipped (dist_id, reason, detail) are clean with a reason."""
    bad = graphs.where("error is not null").select("dist_id", F.lit("analysis_failed").alias("reason"), F.col("error").alias("detail"))
    skipped = bad if skipped is None else bad.unionByName(skipped)
    packages = graphs.select("dist_id").union(skipped.select("dist_id")).distinct()
    risk = scoring.package_risk(findings, packages)
    each = F.struct("ord", F.col("steps.path").alias("_paths"), F.col("steps.line").alias("_lines"), "rule", "objective", "severity", "phase", "confidence", "score", "kind", "obfuscated", "conditional", "message", "steps")
    listed = findings.groupBy("dist_id").agg(F.array_sort(F.collect_list(each)).alias("findings"))
    listed = listed.withColumn("findings", F.transform("findings", lambda x: x.dropFields("ord", "_paths", "_lines")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    stats = graphs.where("error is null").select("dist_id", F.struct(size("files").alias("files"), "ast_nodes", "parse_errors", size("symbols").alias("symbols"), size("call_edges").alias("call_edges"), size("flow_nodes").alias("flow_nodes"), size("flow_edges").alias("flow_edges"), size("roots").alias("phase_roots")).alias("stats"))
    out = risk.withColumnRenamed("findings", "n_findings").join(listed, "dist_id", "left").join(stats, "dist_id", "left").join(skipped.select("dist_id", F.struct("reason", "detail").alias("skipped")), "dist_id", "left")
    return out.select(
        "dist_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(cat.RULESET_VERSION).alias("ruleset_version"), F.lit(options.mode).alias("mode"), "skipped",
        F.col("n_findings").cast("long").alias("n_findings"), F.coalesce("findings", F.expr("cast(array() as " + listed.schema["findings"].dataType.simpleString() + ")")).alias("findings"),
        "risk", scoring.verdict(F.col("risk")).alias("verdict"), "stats",
    )


def scan_sources(sources: DataFrame, meta: DataFrame | None = None, options: Options = Options(), skipped: DataFrame | None = None) -> DataFrame:
    """Reports for all distributions in ``sources`` (dist_id, path, text)."""
    graphs = build_graphs(sources, meta)
    return reports(graphs, stored(evaluate(graphs, options), "findings"), options, skipped)


def graphs_of(spark: SparkSession, packages: dict[str, dict[str, str]]) -> DataFrame:
    """Graphs of sources given as {distribution: {path: text}}."""
    rows = [(d, p, t) for d, files in packages.items() for p, t in files.items()]
    return build_graphs(spark.createDataFrame(rows, "dist_id string, path string, text string"))
