"""Scalar functions and predicates on the cases that pin them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codemill.functions import identifiers, predicates, scalars, signatures
from codemill.settings import load_settings, project_settings


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [_kind(v) for v in values.values()]))) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def _kind(v):
    return {str: "string", int: "int", float: "double", type(None): "string", bool: "boolean", list: "array<double>"}[type(v)]


def values(spark, function, cases):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    return [r["x"] for r in rows.select("i", function(F.col("s")).alias("x")).orderBy("i").collect()]


def test_split_identifier(spark):
    got = values(spark, identifiers.split_identifier, ["getUserName", "user_id", "HTTPServer", "fs.readFile", "sha256sum", "__init__", "kebab-case", "$a", "", None, "漢字Name"])
    assert got == [["get", "User", "Name"], ["user", "id"], ["HTTP", "Server"], ["fs", "read", "File"], ["sha256sum"], ["init"], ["kebab", "case"], ["a"], [], None, ["Name"]]


def test_identifier_terms(spark):
    cases = ["getUserName(user_id); getUserName()", "plain words only", "", None, "a" + "B" * 3000]
    got = values(spark, identifiers.identifier_terms, cases)
    assert got[:4] == ["getusername get user name user_id user id", "", "", ""] and len(got[4]) == 2000
    assert values(spark, identifiers.query_parts, ["how is HTTPServer built", " - . ", None]) == [["how", "is", "http", "server", "built"], [], []]


def test_identifier_lines(spark):
    got = one(spark, identifiers.identifier_lines("c", "n", 5), c="foo();\n  foobar\n$foo\n\tx.foo = 1", n="foo")
    assert [(r.line, r.text) for r in got] == [(5, "foo();"), (8, "x.foo = 1")]


@pytest.mark.parametrize(
    ("language", "name", "content", "wanted"),
    [("typescript", "f", "export async function f", True), ("typescript", "f", "function f", False), ("go", "Foo", "", True), ("go", "foo", "", False), ("java", "f", "public void f", True), ("python", "f", "def f", False), ("rust", "f", "pub(crate) fn f", True), (None, "f", None, False)],
)
def test_exported(spark, language, name, content, wanted):
    assert one(spark, identifiers.is_exported("n", "g", "c"), n=name, g=language, c=content) is wanted


def test_similarity_and_camel(spark):
    assert one(spark, identifiers.similarity("a", "b"), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, identifiers.similarity("a", "b"), a="x" * 65, b="x" * 65) == 0.0
    assert values(spark, identifiers.to_camel, ["snake_case_name", "kebab-x", "one"]) == ["snakeCaseName", "kebabX", "one"]
    assert values(spark, identifiers.normal_identifier, ["getUser_name", "get-user-name"]) == ["getusername", "getusername"]


def test_globs():
    assert predicates.glob_to_like("src/**/*.ts") == "%src/%%.ts" and predicates.glob_to_like("/a_b/*") == "/a\\_b/%" and predicates.glob_to_like("50%") == "%50\\%%"
    assert [bool(re.match(predicates.glob_to_regex("docs/**/*.md"), p)) for p in ("docs/a.md", "docs/x/y.md", "src/docs/a.md", "docs/a.mdx")] == [True, True, False, False]


def test_path_predicates(spark):
    paths = ["src/a.test.ts", "tests/x.py", "a/test_b.py", "a/contest.py", "src/main.rs", "src/.main", "dist/x.js", "x.pb.go", "a/distance.js", "b.min.css", "README.MD", None]
    assert values(spark, predicates.is_test_file, paths)[:4] == [True, True, True, False]
    assert values(spark, predicates.is_entry_point, paths)[4:6] == [True, False]
    assert values(spark, predicates.is_generated_path, paths)[6:10] == [True, True, False, True]
    assert values(spark, predicates.is_document, paths)[10:] == [True, None]


def test_path_factor(spark):
    short, long_, test = values(spark, predicates.path_factor, ["src/a.ts", "x/" * 90, "src/a.test.ts"])
    assert short > 1.05 and long_ == pytest.approx(1.0) and test < short * 0.86
    assert values(spark, predicates.path_factor, [None]) == [1.0]


def test_symbol_match(spark):
    rows = spark.createDataFrame([("getUserName", "getUser"), ("A.getUserName", "getUser"), ("forgetUser", "getUser"), ("x", "")], "n string, q string")
    assert [r[0] for r in rows.select(predicates.symbol_matches("n", "q")).collect()] == [True, True, False, False]


def test_scalars(spark):
    assert one(spark, scalars.round_up("x", 1), x=0.25) == 0.3 and one(spark, scalars.round_up("x", 1), x=-0.25) == -0.2
    assert one(spark, scalars.day_of_millis(F.lit(1_700_000_000_000))) == "2023-11-14"
    assert one(spark, scalars.cosine("a", "b"), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0 and one(spark, scalars.cosine("a", "b"), a=[1.0, 1.0], b=[2.0, 2.0]) == pytest.approx(1.0)
    assert values(spark, scalars.format_bytes, ["10", "2048", str(5 * 1024**3)]) == ["10 B", "2.0 KB", "5.0 GB"]
    assert values(spark, scalars.table_name, ["my-proj.x"]) == ["idx_my_proj_x"]
    assert scalars.effective_chunk_chars() == 1500 and scalars.chunk_step() == 1300
    logs = F.array(F.struct(F.lit(" Yes").alias("token"), F.lit(-0.1).alias("logprob")), F.struct(F.lit("no").alias("token"), F.lit(-2.0).alias("logprob")))
    assert 0.86 < one(spark, scalars.yes_probability(logs)) < 0.88
    assert one(spark, scalars.yes_probability(F.filter(logs, lambda t: F.lit(False)), None)) is None


def test_refs_paths_and_model_answers():
    assert scalars.safe_git_ref("v1.2/x~3") == "v1.2/x~3"
    for bad in ("-x", "a..b", "a b", "a@{1}", "", "a;b"):
        with pytest.raises(ValueError):
            scalars.safe_git_ref(bad)
    assert scalars.is_within("/a/b/c", "/a/b") and not scalars.is_within("/a/bc", "/a/b")
    assert "inside" in scalars.overlap_note("/a/b", {"p": "/a"}) and scalars.overlap_note("/x", {"p": "/a"}) is None
    assert scalars.expansion_variants('ok {"variants": ["Load user", " find  USER ", "get } user", "x", "y"]}', "load  user", 3) == ["find  USER", "get } user", "x"]
    assert scalars.expansion_variants("no json", "q") == [] and scalars.first_json_object('{"a": "}"}') == {"a": "}"}


@pytest.mark.parametrize(
    ("text", "language", "wanted"),
    [
        ("// c\nexport async function foo(\n  a: string,\n  b = {x: 1},\n): Promise<void> {\n  return", "typescript", "export async function foo( a: string, b = {x: 1}, ): Promise<void>"),
        ('@dec\ndef f(a, *b):\n    """x"""\n', "python", "def f(a, *b)"),
        ("/* one\ntwo */\npublic int f(int a) {", "java", "public int f(int a)"),
        ("# only a comment", "python", ""),
        (None, None, ""),
        ("func " + "x" * 300 + "() {", "go", "func " + "x" * 195 + "…"),
    ],
)
def test_signature(text, language, wanted):
    assert signatures.derive_signature(text, language) == wanted


def test_parameters():
    p = signatures.parameters
    assert p("def f(self, a, b=(1, 2), *args: int, **kw)", "python") == ["a", "b", "args", "kw"]
    assert p("func (x *Foo) Bar(a int, b map[string]int) error", "go") == ["a", "b"]
    assert p("public <T> void f(final List<Map<A, B>> xs, int... n)", "java") == ["xs", "n"]
    assert p("function f({a, b}: Props, c?: number)", "typescript")[1:] == ["c"] and p("class A", "java") is None
    assert not signatures.params_differ("f(a: int)", "f(a: string)", "typescript") and signatures.params_differ("f(a)", "f(a, b)", "python") and not signatures.params_differ("const x", "f(a)", "typescript")


def test_settings():
    s = load_settings("max_file_bytes: 10\nboost:\n  short_path: 0.2\n  source_roots: a, b\nallowed_extensions: [.x, .y]\n", {"CODEMILL_MMR_TOP_K": "7", "CODEMILL_MAX_FILE_BYTES": "11"})
    assert (s.max_file_bytes, s.boost.short_path, s.boost.source_roots, s.allowed_extensions, s.mmr_top_k) == (11, 0.2, ("a", "b"), (".x", ".y"), 7)
    with pytest.raises(ValueError, match="max_file_bytes"):
        load_settings("max_file_bytes: many", {})
    p = project_settings('{"ignore": ["a"], "max_file_bytes": -1, "git_tracked_only": true}')
    assert p.ignore == ("a",) and p.git_tracked_only and p.problems == ("max_file_bytes",) and project_settings("{").problems == ("not valid JSON",) and project_settings(None).docs


def test_split_identifier_against_a_scan(spark):
    rng = random.Random(3)
    cases = ["".join(rng.choice("aZ9_.-$éÉ") for _ in range(rng.randint(0, 9))) for _ in range(500)]

    def scan(name):
        kind = lambda c: "o" if not c.isalnum() else "d" if c.isdigit() else "u" if c.isupper() else "l"
        out, word = [], ""
        for i, c in enumerate(name):
            k, before, after = kind(c), kind(name[i - 1]) if i else "o", kind(name[i + 1]) if i + 1 < len(name) else "o"
            if k == "o" or word and k == "u" and (before in "ld" or before == "u" and after == "l"):
                out, word = out + [word], ""
            word += "" if k == "o" else c
        return [w for w in [*out, word] if w]

    assert values(spark, identifiers.split_identifier, cases) == [scan(c) for c in cases]
