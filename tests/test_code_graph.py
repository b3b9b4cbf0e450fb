"""References, calls, dead code, imports and reports on small projects."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codemill.functions.predicates import is_callable
from codemill.operators import code_graph, imports, reports

KIND = "rec_id long, project string, filePath string, content string, symbolName string, symbolType string, language string, startLine int, endLine int, score double"


def chunks(spark, rows):
    """rows: file, first line, content, symbol, type."""
    full = [(i, "p", f, c, s, t, "typescript", n, n + (c or "").count("\n"), 0.0) for i, (f, n, c, s, t) in enumerate(rows)]
    return spark.createDataFrame(full, KIND)


def edges(spark, rows):
    return {(r.caller, r.callee) for r in code_graph.call_edges(chunks(spark, rows)).collect()}


def test_call_edges(spark):
    rows = [("/f1", 1, "function a() {\n  b();\n}", "a", "function"), ("/f2", 1, "function b() {\n  return 1;\n}", "b", "function"), ("/f2", 9, "function r() {\n  r();\n}", "r", "function")]
    assert edges(spark, rows) == {("a", "b"), ("r", "r")}
    rows = [("/f1", 1, "function g() {\n  f.bar();\n}", "g", "function"), ("/f2", 5, "bar() {\n  return 1;\n}", "Foo.bar", "method")]
    assert edges(spark, rows) == {("g", "Foo.bar")}
    rows = [("/f1", 1, "function big() {\n  x;", "big", "function"), ("/f1", 3, "  late();\n}", "big", "function"), ("/f2", 1, "function late() {}", "late", "function")]
    assert edges(spark, rows) == {("big", "late")}


def scan(names, text):
    """Left to right, at each start the longest name that stands whole."""
    out, at = [], 0
    alternatives = sorted(names, key=len, reverse=True)
    pattern = re.compile(r"(?<![A-Za-z0-9_$])(?:" + "|".join(map(re.escape, alternatives)) + r")(?![A-Za-z0-9_$])")
    while m := pattern.search(text, at):
        out.append(m[0])
        at = m.end()
    return sorted(out)


def test_occurrences_equal_a_scan(spark):
    rng = random.Random(9)
    names = ["a", "b", "A.b", "A.b.c", "c", "ab", "b.a"]
    texts = ["".join(rng.choice(["a", "b", "c", "A", ".", ".", " ", "(", "ab"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    lines = spark.createDataFrame([("p", "f", i, "o", i, t) for i, t in enumerate(texts)], "project string, filePath string, rec_id long, owner string, line int, text string")
    wanted = spark.createDataFrame([("p", n) for n in names], "project string, name string")
    got = {}
    for r in code_graph.occurrences(lines, wanted).collect():
        got.setdefault(r.line, []).append(r.name)
    # a chain is read as a whole: dots at its ends are no part of it
    for i, t in enumerate(texts):
        want = sorted(n for run in re.findall(r"[A-Za-z0-9_$]+(?:\.[A-Za-z0-9_$]+)*", t) for n in scan(names, run))
        assert sorted(got.get(i, [])) == want, t


def test_reference_counts(spark):
    rows = [("/lib.ts", 1, "export function engine() {\n  return engine();\n}", "engine", "function"), ("/lib.ts", 5, "function caller() {\n  engine(); engine();\n}", "caller", "function"), ("/x.ts", 1, "class engine {}", "engine", "class"), ("/g.md", 1, "see engine", "", "")]
    t = chunks(spark, rows)
    got = {(r.symbolName, r.filePath): r.references for r in code_graph.reference_counts(code_graph.inventory(t), t).collect()}
    assert got == {("engine", "/lib.ts"): 4, ("engine", "/x.ts"): 4, ("caller", "/lib.ts"): 0}
    asked = spark.createDataFrame([(1, "p", "engine"), (2, "p", ""), (3, "p", "eng")], "query_id long, scope string, name string")
    hits = [(r.filePath, r.line, r.total) for r in code_graph.reference_scan(asked, t).orderBy("rank").collect()]
    assert hits == [("/g.md", 1, 5), ("/lib.ts", 1, 5), ("/lib.ts", 2, 5), ("/lib.ts", 6, 5), ("/x.ts", 1, 5)]
    assert code_graph.reference_scan(asked, t, include_docs=False).count() == 4


@pytest.mark.parametrize(
    ("name", "kind", "content", "language", "owner", "common", "wanted", "signals"),
    [
        ("f", "function", "function f() {}", "typescript", False, False, 80, []),
        ("f", "function", "export function f() {}", "typescript", False, False, 50, ["exported"]),
        ("A.m", "method", "m() {}", "typescript", True, False, 60, ["owner-class-referenced"]),
        ("A.m", "method", "@Override\nvoid m() {}", "java", False, False, 45, ["polymorphic"]),
        ("init", "function", "", "typescript", False, False, 50, ["constructor-like"]),
        ("handleClick", "function", "", "typescript", False, True, 40, ["dynamic-hook-name", "common-name"]),
        ("_x", "function", "", "python", False, False, 90, ["private-by-convention"]),
        ("__x", "function", "", "python", False, False, 80, []),
        ("create", "method", "public abstract void create()", "java", True, True, 0, ["exported", "owner-class-referenced", "polymorphic", "constructor-like", "common-name"]),
    ],
)
def test_dead_score(spark, name, kind, content, language, owner, common, wanted, signals):
    from codemill.functions.identifiers import is_exported

    row = spark.createDataFrame([(name, kind, content, language)], "symbolName string, symbolType string, content string, language string")
    score, found = code_graph.dead_score(is_exported("symbolName", "language", "content"), F.lit(owner), F.lit(common))
    assert row.select(score.alias("s"), found.alias("f")).first() == (wanted, signals)


def test_dead_code(spark):
    rows = [("/src/a.ts", 1, "function used() {}", "used", "function"), ("/src/a.ts", 3, "function dead() {\n  used();\n}", "dead", "function"), ("/src/main.ts", 1, "function entry() {}", "entry", "function"), ("/tests/a.ts", 1, "function t() {}", "t", "function")]
    got = code_graph.dead_code(chunks(spark, rows)).collect()
    assert [(r.symbolName, r.confidence, r.category) for r in got] == [("dead", 80, "likely dead")]
    assert code_graph.dead_code(chunks(spark, []).where("false")).count() == 0


def test_reach_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("a", "c")], "src string, dst string")
    start = spark.createDataFrame([("a", "a")], "anchor string, node string")
    got = lambda d: sorted((r.node, r.depth) for r in code_graph.reach(start, e, d).collect())
    assert got(6) == [("b", 1), ("c", 1)] and got(0) == []
    tree, totals = code_graph.call_paths(start, e, 3, 100)
    rows = {tuple(r.path): r.cyclic for r in tree.collect()}
    assert rows == {("a",): False, ("a", "b"): False, ("a", "b", "c"): False, ("a", "b", "c", "a"): True, ("a", "b", "c", "b"): True, ("a", "c"): False, ("a", "c", "a"): True, ("a", "c", "b"): False, ("a", "c", "b", "c"): True}
    tree, totals = code_graph.call_paths(start, e, 3, 2)
    assert tree.count() == 2 and totals.first().truncated


def test_change_impact(spark):
    rows = [
        ("/p/src/slug.ts", 1, "export function formatSlug(s) {\n  return s;\n}", "formatSlug", "function"),
        ("/p/src/api.ts", 1, 'import { formatSlug } from "./slug";\nfunction createPost(t) {\n  return formatSlug(t);\n}', "createPost", "function"),
        ("/p/src/report.ts", 1, 'import { x } from "./slug";', "", "code"),
        ("/p/src/notes.ts", 1, "// see formatSlug", "", "code"),
        ("/p/tests/slug.test.ts", 1, 'import { formatSlug } from "../src/slug";\nfunction check() {\n  formatSlug("a");\n}', "check", "function"),
    ]
    t = chunks(spark, rows)
    graph = imports.import_graph(t, spark.createDataFrame([("p", "/p")], "project string, path string"))
    anchors = spark.createDataFrame([("formatSlug", "p", "formatSlug", "/p/src/slug.ts")], "anchor string, project string, symbolName string, filePath string")
    got = {k: v.collect() for k, v in code_graph.change_impact(anchors, t, graph).items()}
    assert [(r.symbolName, r.depth) for r in got["callers"]] == [("createPost", 1)]
    assert [(r.filePath, r.alsoReferences) for r in sorted(got["importers"], key=lambda r: r["rank"])] == [("/p/src/api.ts", True), ("/p/src/report.ts", False)]
    assert [(r.filePath, r.line) for r in sorted(got["references"], key=lambda r: r["rank"])] == [("/p/src/api.ts", 1), ("/p/src/api.ts", 3), ("/p/src/notes.ts", 1)]
    assert [(r.filePath, r.via) for r in got["coveredBy"]] == [("/p/tests/slug.test.ts", "call")]
    assert got["counts"][0].references == 5 and got["fan_out"] == []


@pytest.mark.parametrize(
    ("text", "language", "wanted"),
    [
        ('import a from "./a";\nimport type { B } from "b";\nexport { c } from "./c";\nconst d = require("d");\nimport "./e"', "typescript", [("./a", 1), ("b", 2), ("./e", 5)]),
        ("import os, a.b as c\nfrom . import x\nfrom ..m.n import (y,\n z)\nx = 'import q'", "python", [("a.b", 1), ("os", 1), (".", 2), ("..m.n", 3)]),
        ('package a\nimport "fmt"\nimport (\n  x "y/z"\n  "q"\n)', "go", [("fmt", 2), ("y/z", 4), ("q", 5)]),
        ("import static a.b.C;\nimport d.*;", "java", [("a.b.C", 1), ("d", 2)]),
        ("#include <stdio.h>\n#include \"a/b.h\"", "c", [("stdio.h", 1), ("a/b.h", 2)]),
        ("use crate::a::b::{C, D};\nuse std::io;", "rust", [("crate::a::b", 1), ("std::io", 2)]),
        ("x", "unknown", []),
    ],
)
def test_import_extraction(text, language, wanted):
    assert [(raw, line) for raw, _, line in imports.extract(text, language)] == wanted


def test_import_resolution(spark):
    files = ["/p/src/a.ts", "/p/src/b/index.ts", "/p/pkg/m.py", "/p/pkg/sub/__init__.py", "/p/deep/pkg2/q.py", "/p/x.h"]
    index = spark.createDataFrame([("p", f) for f in files], "project string, filePath string")
    specs = [("/p/src/c.ts", "typescript", "./a"), ("/p/src/c.ts", "typescript", "./b"), ("/p/src/c.ts", "typescript", "react"), ("/p/src/c.ts", "typescript", "./zz"), ("/p/pkg/n.py", "python", ".m"), ("/p/z.py", "python", "pkg.sub"), ("/p/z.py", "python", "pkg2.q"), ("/p/z.py", "python", "os"), ("/p/pkg/n.py", "python", "."), ("/p/c/d.c", "c", "x.h"), ("/p/A.java", "java", "a.b.C")]
    rows = spark.createDataFrame([("p", f, g, raw, "local", i) for i, (f, g, raw) in enumerate(specs)], "project string, filePath string, language string, raw string, kind string, line int")
    got = {r.line: (r.status, r.path) for r in imports.resolved(rows, index, spark.createDataFrame([("p", "/p")], "project string, path string")).collect()}
    ok = lambda p: ("resolved", p)
    assert [got[i] for i in range(len(specs))] == [ok("/p/src/a.ts"), ok("/p/src/b/index.ts"), ("external", None), ("unresolved", None), ok("/p/pkg/m.py"), ok("/p/pkg/sub/__init__.py"), ok("/p/deep/pkg2/q.py"), ("external", None), ("unresolved", None), ok("/p/x.h"), ("external", None)]


def test_coupling(spark):
    pairs = {"app": ["hub"], "main": ["entry"], "entry": ["hub", "mid"], "mid": ["hub", "helper"], "hub": ["util", "helper"], "helper": ["util"], "orphan": ["util"]}
    nodes = ["app", "main", "entry", "mid", "hub", "helper", "orphan", "util", "standalone"]
    e = spark.createDataFrame([("p", a, b) for a, bs in pairs.items() for b in bs] + [("p", "hub", "util"), ("p", "hub", "hub")], "project string, filePath string, path string")
    external = spark.createDataFrame([("p", "hub", 3), ("p", "standalone", 2)], "project string, filePath string, externalImports int")
    rows = reports.coupling(spark.createDataFrame([("p", n) for n in nodes], "project string, filePath string"), e, external)
    by = {r.filePath: r for r in rows.collect()}
    assert [by[n].instability for n in ("util", "main", "hub", "helper", "standalone")] == [0.0, 1.0, 0.4, 0.333, None] and by["hub"].externalImports == 3
    bands = reports.coupling_bands(rows).orderBy("band", "rank").collect()
    assert [r.filePath for r in bands if r.band == "topFanIn"] == ["hub", "util", "helper", "entry", "mid"] and [r.filePath for r in bands if r.band == "changeMagnets"] == ["hub"]
    cut = [r for r in reports.coupling_bands(rows, 2).collect() if r.band == "topFanIn"]
    assert len(cut) == 2 and cut[0].total == 5 and cut[0].truncated


def test_hotspots(spark):
    f = lambda rows, kind: spark.createDataFrame(rows, "project string, filePath string, " + kind)
    sizes = f([("p", n, c, s) for n, c, s in (("big.ts", 6, 15), ("small.ts", 1, 1), ("mega.ts", 500, 900), ("dense.ts", 3, 5), ("quiet.ts", 2, 2), ("a.test.ts", 6, 15), ("index.ts", 6, 15))], "chunks int, symbols int")
    churn = f([("p", n, 20) for n in ("big.ts", "small.ts", "a.test.ts", "index.ts")] + [("p", "mega.ts", 500), ("p", "gone.ts", 3)], "churn int")
    dead = f([("p", "dense.ts", 4, 10)], "dead int, candidates int")
    fans = f([("p", "dense.ts", 4, 4)], "fanIn int, fanOut int")
    got = {r.filePath: r for r in reports.hotspots(sizes, churn, dead, fans).collect()}
    assert got["big.ts"].band == "critical" and got["small.ts"].band == "warm" and got["mega.ts"].score == 100.0 and got["dense.ts"].deadDensity == 0.4
    assert got["dense.ts"].score == 27.0 and "quiet.ts" not in got and got["a.test.ts"].band == got["index.ts"].band == "review" and got["index.ts"].score == 20.0


def test_api_diff(spark):
    from codemill.functions.signatures import parameters_differ

    kind = "path string, symbolType string, symbolName string, language string, startLine int, signature string, exported boolean"
    base = spark.createDataFrame([("a", "function", n, "typescript", 1, s, e) for n, s, e in (("gone", "gone()", True), ("hid", "hid()", True), ("sig", "sig(a)", True), ("same", "same(a: int)", True))], kind)
    head = spark.createDataFrame([("a", "function", n, "typescript", 1, s, e) for n, s, e in (("hid", "hid()", False), ("sig", "sig(a, b)", True), ("same", "same(a: long)", True), ("new", "new()", True))], kind)
    diff = reports.api_diff(base, head, parameters_differ("base_signature", "head_signature", "language"), include_unchanged=True)
    assert [(r.kind, r.symbolName) for r in diff.orderBy("rank").collect()] == [("removed", "gone"), ("visibility-narrowed", "hid"), ("signature-changed", "sig"), ("added", "new"), ("unchanged", "same")]
    assert reports.diff_counts(diff).first().breaking == 3


def test_query_log(spark):
    log = spark.createDataFrame([("p", "alpha", 3, 10), ("p", "alpha", 1, 30), (None, "beta", 0, 20)], "project string, query string, result_count int, latency_ms int")
    r = reports.query_log_summary(log).first()
    assert (r.total, r.avg_latency, r.max_latency, r.repeat_rate) == (3, 20.0, 30, 0.333)
    assert [(r.query, r.avg_results) for r in reports.top_queries(log).collect()] == [("alpha", 2.0), ("beta", 0.0)] and [r.query for r in reports.zero_hit_queries(log).collect()] == ["beta"]


def test_callable_kinds(spark):
    assert [r[0] for r in spark.createDataFrame([("method",), ("class",)], "t string").select(is_callable("t")).collect()] == [True, False]
