import ast

import pytest
from pyspark.sql import functions as F

from causeway.functions import decoding, names
from causeway.operators import cache, deps, evaluate, reach, scoring, syntax
from causeway.operators.display import exit_code, one_line


def fold(code):
    got = syntax.fold(ast.parse(code, mode="eval").body)
    return got and got[0]


def test_folding():
    assert fold("'a' + 'b' * 3") == b"abbb"
    assert fold("'olleh'[::-1]") == b"hello"
    assert fold("''.join(['a', chr(98)])") == b"ab"
    assert fold("base64.b64decode('aGk=').decode()") == b"hi"
    assert fold("bytes.fromhex('68 69')") == b"hi" and fold("codecs.decode('uv', 'rot13')") == b"hi"
    assert fold("zlib.decompress(b'x')") is None and fold("name") is None and fold("'a' * 99999999") is None
    assert fold("base64.b64decode(" * 9 + "'aGk='" + ")" * 9) is None


def test_tolerant_parsing():
    tree, text, errors = syntax.parse("x = 1\nprint 'old'\ny = (\n")
    assert errors >= 2 and any(isinstance(n, ast.Assign) for n in tree.body)
    rows = syntax.node_rows("a = 'é' + b\n", "d", "p.py")
    assert rows[0][4] == "module" and [r[3] for r in rows[1:]].count(0) == 1
    name = next(r for r in rows if r[10] == "b")
    assert (name[6], name[7]) == (1, 12)  # columns count bytes
    assert syntax.str_literal("rb'''x'y'''") == "x'y" and syntax.str_literal("f'x'") is None
    assert syntax.fstring_template(ast.parse("f'a{x}b'", mode="eval").body) == "a{}b"
    assert syntax.parse("(" * 5000)[2] >= 1


def test_scores(spark):
    rows = [("critical", "install", "resolved", False, 1.0), ("critical", "install", "resolved", True, 1.0), ("high", "import", "ambiguous", True, 0.8 * 0.8 * 0.6 * 1.15), ("low", "runtime", "dynamic", None, 0.4 * 0.5 * 0.4)]
    df = spark.createDataFrame(rows, "s string, p string, c string, o boolean, want double")
    got = df.select("want", scoring.finding_score(F.col("s"), F.col("p"), F.col("c"), F.col("o")).alias("got"), scoring.verdict(F.col("want")).alias("v")).collect()
    assert all(r["got"] == pytest.approx(r["want"]) for r in got)
    found = spark.createDataFrame([("a", 1.0, "x", "control"), ("b", 0.5, "x", "data"), ("b", 0.4, "y", "control")], "dist_id string, score double, objective string, kind string")
    risk = {r["dist_id"]: r["risk"] for r in scoring.package_risk(found, spark.createDataFrame([("a",), ("b",), ("c",)], "dist_id string")).collect()}
    assert risk == {"a": 0.7 - 0.05, "b": pytest.approx(0.55), "c": 0.0}


def test_paths_take_the_first_of_the_shortest(spark):
    e = spark.createDataFrame([(1, 2, 10), (1, 3, 11), (2, 4, 12), (3, 4, 13), (4, 1, 14), (1, 2, 9)], "src int, dst int, edge int")
    s = spark.createDataFrame([(1, 1)], "search int, node int")
    got = {r["node"]: (r["nodes"], r["edges"]) for r in reach.bfs(e, s).collect()}
    assert got == {1: ([1], []), 2: ([1, 2], [9]), 3: ([1, 3], [11]), 4: ([1, 2, 4], [9, 12])}
    assert reach.bfs(e, s, depth=1).count() == 3


def test_dependencies(spark):
    rows = [("App", ["web>=1", "json"]), ("web", ["http", "json", "web"]), ("http", ["json[x]; extra == 'y'"]), ("json", []), ("tool", ["web", "web<2", "outside"])]
    nodes, edges = deps.from_requirements(spark.createDataFrame(rows, "name string, requirements array<string>"))
    assert edges.count() == 6 and deps.required_edges(edges).count() == 5
    got = {r["name"]: (r["transitive"], r["direct"]) for r in deps.blast_radius(nodes, edges).collect()}
    assert got["json"] == (4, 3) and got["http"] == (3, 1) and got["app"] == (0, 0)
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    mid = {r["name"]: r["betweenness"] for r in deps.betweenness(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), chain).collect()}
    assert mid == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_cache_keys(spark):
    df = spark.createDataFrame([("ab" * 32, 6, 2)], "sha256 string, ruleset int, schema int")
    raw = df.select(cache.encode_key(*map(F.col, df.columns)).alias("k"))
    assert len(raw.first()["k"]) == 40 and tuple(raw.select(cache.decode_key(F.col("k")).alias("x")).first()["x"]) == ("ab" * 32, 6, 2)
    with pytest.raises(Exception, match="40 bytes"):
        raw.select(cache.decode_key(F.substring("k", 1, 39)).alias("x")).collect()
    bad = df.withColumn("report_json", F.lit("{broken"))
    with pytest.raises(Exception, match="unreadable"):
        cache.get(df, bad, "n long").collect()
    assert cache.cacheable("reachability", None, True, False) and not cache.cacheable("reachability", None, True, True)


def test_evaluation(spark):
    rows = spark.createDataFrame([(True, True, None), (True, False, None), (False, True, None), (False, False, "x"), (True, True, "x")], "malicious boolean, flagged boolean, error string")
    r = evaluate.confusion(rows, []).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["errors"]) == (1, 1, 2, 1, 2) and r["precision"] == 0.5
    assert evaluate.confusion(rows, [], errors_as_negative=False).first()["tn"] == 0
    v = evaluate.nearest_rank(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double"), [], "x").first()
    assert (v["median"], v["p95"]) == (3.0, 4.0)
    split = evaluate.seeded_split([f"p{k}" for k in range(50)])
    assert sum(v == "dev" for v in split.values()) == 20 and split == evaluate.seeded_split([f"p{k}" for k in range(49, -1, -1)])


def test_relative_imports_and_escapes(spark):
    df = spark.createDataFrame([("a.b", 1, "c"), ("a.b", 2, "c"), ("a.b", 3, ""), ("a", 3, "x")], "p string, d int, r string")
    assert [x[0] for x in df.select(names.resolve_relative(F.col("p"), F.col("d"), F.col("r"))).collect()] == ["a.b.c", "a.c", "", None]
    lit = spark.createDataFrame([("a\\n\\x41\\\\",), ("\\q",), ("",)], "v string")
    assert [x[0] for x in lit.select(decoding.escapes_decode(F.col("v"))).collect()] == ["a\nA\\", None, ""]


def test_terminal_output():
    assert one_line("a\n  b\x1b[2J‮") == "a b\\u{1b}[2J\\u{202e}"
    assert exit_code([]) == 0 and exit_code([{"verdict": "clean"}, None]) == 3


def test_blast_radius_of_a_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([(f"p{k}",) for k in range(n)], "name string")
    edges = spark.createDataFrame([(f"p{k + 1}", f"p{k}") for k in range(n - 1)], "src string, dst string")
    got = {r["name"]: (r["direct"], r["transitive"], r["share"]) for r in deps.blast_radius(nodes, edges).collect()}
    assert got == {f"p{k}": (int(k < n - 1), n - 1 - k, (n - 1 - k) / (n - 1)) for k in range(n)}
