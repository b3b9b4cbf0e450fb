"""Document conformance: classes of claims, regions, verdicts, findings."""

import itertools

import pytest
from pyspark.sql import functions as F

from codemill.operators import conformance

CASES = [
    ("searchIndex", "identifier"), ("IndexManager.checkDocs", "identifier"), ("_private", "identifier"), ("src/core/doctor.ts", "path"), ("README.md", "path"), ("docs/", "path"),
    ("CUSTOM_NUM_CTX", "env"), ("POST /search/batch", "endpoint"), ("get /health", "endpoint"), ("bun run dev", "cmd"), ("git sync", "cmd"), ("--rerank", "flag"), ("typescript@5.1.0", "dep"),
    ("@scope/pkg@^2.0.0", "dep"), ("search.mmr.lambda=0.5", "kv"), ("embedding:0.6b", "model-tag"), ("search.mmr.lambda", "config-path"), ("src/core/doctor.ts → checkProject", "composite"),
    ("2.4.0", "opaque"), ("some random words here", "opaque"), ("https://example.com/x", "external"), ("dist/bundle.min.js", "artifact"), ("node_modules/left-pad/index.js", "artifact"),
    ("owner/repo:3.1", "external"), ("<home>/x.yml", "external"), ("ubuntu-24.04-arm", "opaque"), ("", None), ("x" * 201, None), ("key: value", "kv"),
]


def test_span_classes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, token string")
    got = [r.c for r in rows.select("i", conformance.span_class(F.col("token")).alias("c")).orderBy("i").collect()]
    assert got == [c for _, c in CASES]


def test_regions(spark):
    text = "`a1`\n```js\n`b1`\n~~~\n`b2`\n```\n# Roadmap\n`c1`\n# Use\n<!-- doccheck-ignore --> `d1`\n`d2`\n`e1` and `e2`\n"
    docs = spark.createDataFrame([("p", "README.md", text), ("p", "docs/changelog.md", "`x`"), ("p", "e.md", None), ("p", "f.md", "")], "project string, doc string, text string")
    got = [(r.doc, r.line, r.token, r.region) for r in conformance.spans(docs).orderBy("doc", "line", "pos").collect()]
    assert got == [("README.md", 1, "a1", "current"), ("README.md", 3, "b1", "example"), ("README.md", 5, "b2", "example"), ("README.md", 8, "c1", "planned"), ("README.md", 12, "e1", "current"), ("README.md", 12, "e2", "current"), ("docs/changelog.md", 1, "x", "historical")]


@pytest.fixture(scope="module")
def code(spark):
    rows = [
        ("/p/src/core/doctor.ts", 'export const MAX_NAME = "index-job";\nexport function checkProject(a) {\n  const timeoutMs = 5; route("/search/batch"); return process.env.MY_TOKEN_ENV + cfg.search.limit;\n}', "checkProject", "function"),
        ("/p/src/other.ts", "export class IndexManager {\n  getThing() { flags.dryMode; }\n}", "IndexManager", "class"),
        ("/p/lib/a/deep.ts", "x", "", "code"), ("/p/lib/b/deep.ts", "y", "", "code"),
    ]
    return spark.createDataFrame([(i, "p", f, c, s, t, "typescript", 1, 1 + c.count("\n")) for i, (f, c, s, t) in enumerate(rows)], "rec_id long, project string, filePath string, content string, symbolName string, symbolType string, language string, startLine int, endLine int")


VERDICTS = [
    ("checkProject", "ok", 100), ("checkProject()", "skipped", 0), ("IndexManager.getThing()", "ok", 95), ("timeoutMs", "ok", 100), ("index-job", None, None), ("checkProjekt", "missing", 92), ("someUnknownThing", "missing", 95), ("word", "skipped", 0), ("API", "skipped", 0), ("QWER", "review", 50),
    ("IndexManager.getThing", "ok", 95), ("src/core/doctor.ts", "ok", 100), ("core/doctor.ts", "ok", 95), ("doctor.ts", "ok", 90), ("deep.ts", "missing", 70), ("src/core/", "ok", 90), ("src/none.ts", "missing", 95), ("src/none.py", "missing", 85), ("src/*.ts", "ok", 90),
    ("src/*.py", "missing", 85), ("tsconfig.json", "skipped", 0), ("MY_TOKEN_ENV", "ok", 100), ("OTHER_TOKEN_ENV", "missing", 95), ("XDG_SOMETHING", "skipped", 0), ("GET /search/batch", "ok", 100), ("GET /none/such", "missing", 93), ("--dry-mode", "ok", 90), ("--unknown-flag", "missing", 92),
    ("--help", "skipped", 0), ("npm run build", "ok", 100), ("npm run nothing", "missing", 92), ("react@18", "ok", 100), ("react@17", "missing", 80), ("vue@3", "missing", 80), ("search.limit=5", "ok", 90), ("search.nothing=5", "missing", 85), ("search.limit", "skipped", 0),
    ("src/core/doctor.ts → checkProject", "ok", 100), ("src/core/doctor.ts → noSuch", "missing", 94), ("src/zip.ts → checkProject", "missing", 93), ("model:0.6b", "review", 60),
]


def test_verdicts(spark, code):
    docs = spark.createDataFrame([("p", "README.md", "\n".join(f"`{t}`" for t, _, _ in VERDICTS))], "project string, doc string, text string")
    roots = spark.createDataFrame([("p", "/p")], "project string, path string")
    manifests = spark.createDataFrame([("p", {"react": "^18.2.0"}, {"build": "x"})], "project string, dependencies map<string,string>, scripts map<string,string>")
    rows = conformance.verdicts(conformance.spans(docs), code, roots, manifests)
    got = {r.token: (r.status, r.confidence) for r in rows.collect()}
    assert {t: got[t] for t, s, _ in VERDICTS if s} == {t: (s, c) for t, s, c in VERDICTS if s}
    found = {r.token: r for r in rows.collect()}
    assert found["checkProjekt"].suggestion == "checkProject" and [e.path for e in found["timeoutMs"].evidence] == ["/p/src/core/doctor.ts"]


def test_demotion_findings_and_reverse_coverage(spark, code):
    text = "`a/b.py` here\nfor example `noSuchThing`\n`myPrivateName` and `my_private_name`\n`goneFunction` `goneFunction`\n" + "\n".join(f"`missingName{i}`" for i in range(12))
    docs = spark.createDataFrame([("p", "README.md", text)], "project string, doc string, text string")
    roots = spark.createDataFrame([("p", "/p")], "project string, path string")
    claims = conformance.spans(docs)
    rows = conformance.demoted(conformance.verdicts(claims, code, roots))
    got = {r.token: (r.status, r.confidence) for r in rows.collect()}
    assert all(got[t] == ("review", 50) for t in ("a/b.py", "noSuchThing", "myPrivateName", "my_private_name")) and got["goneFunction"][0] == "missing"
    out = conformance.findings(rows, 100, None).orderBy("rank").collect()
    assert len(out) == 17 and {r.total for r in out} == {17} and [r.id for r in out][:3] == sorted(r.id for r in out if r.confidence == 95)[:3]
    assert conformance.findings(rows, 3).count() == 3 and conformance.findings(rows, 100, 200).first().omitted > 0
    assert {r.symbolName for r in conformance.undocumented(code, claims).collect()} == {"checkProject", "IndexManager"}
    said = spark.createDataFrame([("p", "a.md", "`checkProject`")], "project string, doc string, text string")
    assert {r.symbolName for r in conformance.undocumented(code, conformance.spans(said)).collect()} == {"IndexManager"}
    sure = conformance.judged(rows, F.lit(0.9))
    assert {r.status for r in sure.where("token = 'goneFunction'").collect()} == {"ok"} and {r.status for r in sure.where("token = 'noSuchThing'").collect()} == {"review"}
    assert conformance.drifted(rows, spark.createDataFrame([("p", "README.md")], "project string, path string")).count() == rows.count() and conformance.skip_counts(rows).count() == 0


def test_nearest_names_lose_no_pair(spark):
    import random

    rng = random.Random(4)
    words = ["".join(p) for p in itertools.product("ab", repeat=3)] + ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    tokens = spark.createDataFrame([("p", w) for w in words[:60]], "project string, token string")
    names = spark.createDataFrame([("p", w) for w in words[40:]], "project string, name string")
    got = {r.token: (r.suggestion, r.similarity) for r in conformance.nearest_names(tokens, names).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for t in set(words[:60]):
        best = max(((1 - distance(t, n) / max(len(t), len(n)), n) for n in set(words[40:]) if abs(len(t) - len(n)) <= 3), key=lambda x: (round(x[0], 9), [-ord(c) for c in x[1]] + [1]))
        if best[0] > 0.6:
            assert got[t][1] == pytest.approx(best[0], abs=1e-6), (t, best)
        else:
            assert t not in got
