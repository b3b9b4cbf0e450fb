"""Trees, history, registry, code table, chunker and streams on real folders."""

import os
import random
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from codemill.functions.predicates import relative_path
from codemill.operators import chunking, ranking
from codemill.plans.api import Engine
from codemill.sources import chunk_table, files, history, registry
from codemill.sources.registry import Store
from codemill.streaming import operators as streams
from codemill.streaming.jobs import EventRing, JobQueue


def write(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_ignore_rules(spark):
    rules = files.ignore_rules("*.log\n/top\nsub/deep\n!keep.log\nfolder/\n# no\n", always=())
    paths = ["a.log", "x/keep.log", "top", "x/top", "sub/deep/a", "x/sub/deep", "folder/a", "x/folder/a", "folder"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", files.is_ignored(F.col("p"), rules).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [True, False, True, False, True, False, True, True, False]


def test_scan_reasons(spark, tmp_path):
    write(tmp_path, src__a_dot_py="x = 1", src__b_dot_txt="x", node_modules__c_dot_js="x", big_dot_py="y" * 100, d_dot_ts="x")
    listed = files.listing(spark, str(tmp_path))
    rows = files.scanned(listed, str(tmp_path), files.ignore_rules(), (".py", ".js", ".ts"), ("python",), 100)
    got = {os.path.basename(r.path): r.reason for r in rows.collect()}
    assert got == {"a.py": None, "b.txt": "extension", "c.js": "ignored", "big.py": None, "d.ts": "language"}
    assert {r.reason for r in files.scanned(listed, str(tmp_path), [], (".py",), max_bytes=99).collect() if r.path.endswith("big.py")} == {"oversize"}
    tracked = listed.where("path like '%a.py'").select("path")
    assert files.scan_counts(files.scanned(listed, str(tmp_path), [], (".py",), tracked=tracked)).collect()
    assert [r.text for r in files.texts(spark, tracked, str(tmp_path)).collect()] == ["x = 1"]


def test_documents_and_references(spark, tmp_path):
    write(tmp_path, README_dot_md="a", docs__x__y_dot_md="b", other__z_dot_md="c", package_dot_json='{"dependencies": {"a": "^1"}, "scripts": {"t": "x"}}')
    listed, root = files.listing(spark, str(tmp_path)), str(tmp_path)
    docs = files.documents(listed, root)
    assert sorted(r.relative for r in docs.collect()) == ["README.md", "docs/x/y.md"]
    refs = spark.createDataFrame([("README.md",), ("other/z.md",), ("no.md",), ("../x.md",), ("/etc/x",)], "ref string")
    got = {r.ref: r.status for r in files.resolved_references(refs, docs, listed, root).collect()}
    assert got == {"README.md": "matched", "other/z.md": "filtered", "no.md": "missing", "../x.md": "outsideRoot", "/etc/x": "outsideRoot"}
    m = files.manifests(spark.createDataFrame([("a", (tmp_path / "package.json").read_text()), ("b", "{"), ("c", None)], "path string, text string")).orderBy("path").collect()
    assert m[0].dependencies == {"a": "^1"} and m[0].scripts == {"t": "x"} and m[1].scripts == m[2].dependencies == {}
    assert {r.name for r in files.root_names(listed, root).collect()} == {"README.md", "docs", "other", "package.json"}


def git(cwd, *args, when=1_700_000_000, who="Ann"):
    env = {**os.environ, "GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": f"{who}@x", "GIT_COMMITTER_NAME": who, "GIT_COMMITTER_EMAIL": f"{who}@x"}
    return subprocess.run(["git", *args], cwd=cwd, env=env, capture_output=True, text=True, check=True).stdout


def test_history_of_a_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    write(tmp_path, a_dot_py="def f(x):\n    return x\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "First\n\nWith a body")
    write(tmp_path, a_dot_py="def f(x, y):\n    return x\n", b__c_dot_py="z = 1\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "Second change", when=1_700_100_000, who="Bob")
    repo = str(tmp_path)
    log = history.commits(spark, repo).orderBy("timestamp").collect()
    assert [(r.subject, r.body, r.author, r.files) for r in log] == [("First", "With a body", "Ann", ["a.py"]), ("Second change", None, "Bob", ["a.py", "b/c.py"])]
    raw = history.git(repo, "log", "-z", f"--format={history.COMMIT_FORMAT}", "--name-only")
    parsed = history.parse_log(spark.createDataFrame([("r", raw)], "repo string, raw string")).orderBy("timestamp").collect()
    assert [(r.hash, r.files, r.body, r.timestamp) for r in parsed] == [(r.hash, r.files, r.body, r.timestamp) for r in log]
    rows = history.commits(spark, repo)
    assert {r.filePath: r.churn for r in history.churn(rows, "/root").collect()} == {"/root/a.py": 2, "/root/b/c.py": 1}
    assert [r.subject for r in history.search_commits(rows, "SECOND").collect()] == ["Second change"] and history.search_commits(rows, author="ann", limit=1).first().truncated
    blame = history.parse_blame(spark.createDataFrame([("a.py", history.git(repo, "blame", "--porcelain", "a.py"))], "filePath string, raw string"))
    assert [(r.line, r.author) for r in blame.orderBy("line").collect()] == [(1, "Bob"), (2, "Ann")]
    assert tuple(history.blame_summary(blame, "filePath").first()) == ("a.py", "Bob", "2023-11-16", 2, False)
    hits = spark.createDataFrame([(1, 1, 7, "a.py", 2, 2), (1, 2, 8, "none.py", 1, 1)], "query_id long, rank int, rec_id long, filePath string, startLine int, endLine int")
    assert {r.rec_id: r.lastAuthor for r in history.with_blame(hits, blame).collect()} == {7: "Ann", 8: None}
    assert history.commit_time(repo, "HEAD") == 1_700_100_000_000 and {r.path for r in history.tracked_files(spark, repo).collect()} == {f"{repo}/a.py", f"{repo}/b/c.py"}
    diff = Engine(spark).get_api_diff(history.tree(spark, repo, "HEAD~1"), history.tree(spark, repo, "HEAD"))
    assert [(r.kind, r.symbolName) for r in diff.collect()] == [("signature-changed", "f")]
    with pytest.raises(ValueError, match="git log"):
        history.git("/", "log")


def test_store_swaps_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(a=spark.range(3), b=spark.range(1))
    store.write(a=store.read("a").where("id > 0"))
    assert store.read("a").count() == 2 and store.read("b").count() == 1 and store.orphans() == []
    spark.range(1).write.parquet(str(tmp_path / "s" / "left-over"))
    assert store.orphans() == ["left-over"]
    store.drop("b")
    assert list(store.tables()) == ["a"]


def test_registry(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    assert sorted(map(tuple, registry.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, registry.inserted_ignoring(old, spark.createDataFrame([("b", 9), ("d", 1)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 2), ("d", 1)]
    assert [r.v for r in registry.kept_newest(old, 1, "v").collect()] == [2] and registry.kept_newest(old, 0, "v").count() == 0
    jobs = spark.createDataFrame([("1", "pending", 0, 1, '{"project": "p"}', None), ("1", "completed", 0, 1, "{", None), ("2", "running", 5, 2, None, None), ("3", "pending", 1, 3, "", None), ("4", "pending", 1, 2, '{"project": "px"}', None)], "id string, status string, priority int, created_at int, payload string, error string")
    now = registry.jobs_now(jobs)
    assert {r.id: r.status for r in now.collect()} == {"1": "completed", "2": "running", "3": "pending", "4": "pending"}
    assert [r.id for r in registry.claim_order(now).orderBy("place").collect()] == ["4", "3"]
    assert {r.id: r.status for r in registry.interrupted(now).collect()}["2"] == "failed" and {r.priority for r in registry.restored(now).collect()} == {-5}
    empty = spark.createDataFrame([], "name string, index_name string, project string")
    assert {r.id for r in registry.deep_removed("p", empty, empty, empty, jobs)[3].collect()} == {"1", "2", "3", "4"} and registry.deep_removed("p", empty, empty, empty, jobs)[3].count() == 4


def test_chunker():
    text = '"""Module."""\nimport a\n\n# Says\n# what.\n@dec\ndef f(x):\n    return x\n\nclass A:\n    """Doc of A."""\n    y = 1\n    def m(self):\n        return 1\n    async def n(self):\n        return 2\n'
    got = chunking.chunk_text(text, "python", 60, 10)
    assert [(c.name, c.kind, c.start, c.end) for c in got] == [("", "code", 1, 2), ("f", "function", 6, 8), ("A", "class", 10, 12), ("A.m", "method", 13, 14), ("A.n", "method", 15, 16)]
    assert got[1].doc == "# Says\n# what." and got[2].doc == "Doc of A."
    script = 'import {a} from "b";\n\n/** Says. */\nexport async function foo(a) {\n  if (a) { return "}"; }\n}\nclass Q {\n  m() { return 1 }\n}\nconst z = (x) => {\n  return x;\n};\ninterface I { a: string }\nlet q = 1;\n'
    got = chunking.chunk_text(script, "typescript")
    assert [(c.name, c.kind, c.start, c.end, c.doc) for c in got] == [("", "code", 1, 1, None), ("foo", "function", 4, 6, "/** Says. */"), ("Q", "class", 7, 9, None), ("z", "function", 10, 12, None), ("I", "interface", 13, 13, None), ("", "code", 14, 14, None)]
    go = "package a\n\n// Foo does.\nfunc (s *Srv) Foo(a int) {\n\treturn\n}\n\ntype T struct {\n\ta int\n}\n"
    assert [(c.name, c.kind) for c in chunking.chunk_text(go, "go")] == [("", "code"), ("Srv.Foo", "method"), ("T", "struct")]
    assert chunking.chunk_text("  \n", "python") == [] and chunking.chunk_text(None, "") == [] and [c.name for c in chunking.chunk_text("def (", "python")] == [""]


def test_windows_equal_a_loop(spark):
    rng = random.Random(2)
    texts = ["", " " * 40, "x" * 15, None] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    got = {}
    for r in chunking.windows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), 15, 4).orderBy("n").collect():
        got.setdefault(r.id, []).append((r.content, r.startLine, r.endLine))
    for i, t in enumerate(texts):
        want = [(t[a : a + 15], 1 + t[:a].count("\n"), 1 + t[:a].count("\n") + t[a : a + 15].count("\n")) for a in range(0, len(t) if len(t) > 15 else 1, 11)] if t else []
        assert got.get(i, []) == [w for w in want if w[0].strip()]
        assert [p for p in chunking.pieces(t or "", 15, 11)] == got.get(i, [])


def test_index_search_and_sync(spark, tmp_path):
    root, store = tmp_path / "proj", Store(spark, str(tmp_path / "store"))
    write(root, src__a_dot_py='def load_user(name):\n    """Loads the profile of a user."""\n    return fetch(name)\n', src__b_dot_py="from a import load_user\n\ndef caller():\n    return load_user(1)\n", src__c_dot_py="x = 1\n")
    engine = Engine(spark, store)
    with pytest.raises(ValueError, match="no index yet"):
        engine.chunks
    assert engine.index_project(str(root), "proj") == {"new": 3}
    assert engine.index_project(str(root), "proj") == {"unchanged": 3}
    (root / "src/c.py").unlink()
    write(root, src__b_dot_py="from a import load_user\n\ndef other():\n    return load_user(2)\n")
    os.utime(root / "src/b.py", (2_000_000_000, 2_000_000_000))
    assert engine.sync_project(str(root), "proj") == {"unchanged": 1, "changed": 1, "deleted": 1}
    assert {r.symbolName for r in engine.chunks.where("symbolName <> ''").collect()} == {"load_user", "other"}
    assert engine.search_codebase("load user profile", "proj", mode="text").orderBy("rank").first().symbolName == "load_user"
    top = engine.search_codebase("fetch", "proj", context_lines=2, limit=1).first()
    assert top.signature == "def load_user(name)" or top.symbolName
    assert [r.symbolName for r in engine.find_symbol("load_u").collect()] == ["load_user"]
    assert {(r.filePath[-4:], r.line) for r in engine.find_references("load_user").collect()} == {("a.py", 1), ("b.py", 1), ("b.py", 4)}
    tree, totals = engine.get_call_graph("load_user", "proj", direction="callers")["callers"]
    assert {r.path[-1].name for r in tree.collect()} == {"load_user", "other"} and not totals.first().truncated
    forward, back = engine.get_dependencies(f"{root}/src/b.py")
    assert forward.first().raw == "a"
    assert engine.get_index_status("proj").first().files == 2 and [r.name for r in engine.list_indexes().collect()] == ["proj"]
    assert {r.symbolName for r in engine.find_dead_code("proj").collect()} == {"other"} and engine.get_repo_overview("proj")["languages"].first().language == "python"
    assert engine.get_file_outline(f"{root}/src/a.py").first().symbolName == "load_user" and engine.get_context_pack("load user", "proj").count() >= 1
    assert engine.get_change_impact("load_user", "proj")["callers"].first().symbolName == "other"
    docs = spark.createDataFrame([("proj", "README.md", "Use `load_user` and `load_usr`, see `src/a.py` and `src/zz.py`.\n```\n`x_y`\n```\n")], "project string, doc string, text string")
    found = {r.token: r.band for r in engine.check_docs(docs, "proj")["findings"].collect()}
    assert found == {"load_usr": "drift", "src/zz.py": "drift"}
    for bad in (lambda: engine.find_symbol("x", "none"), lambda: engine.get_file_outline("/none"), lambda: engine.get_call_graph("zzz", "proj")):
        with pytest.raises(ValueError):
            bad()
    table = chunk_table.ChunkTable(store)
    assert table.compact()["after"] <= table.stats()["files"] and table.stats()["rows"] == engine.chunks.count()
    engine.delete_project("proj")
    assert engine.chunks.count() == 0 and engine.list_indexes().count() == 0


def test_stream_of_changes_equals_the_batch(spark, tmp_path):
    kind = "project string, filePath string, event string, ts long"
    rows = [("p", f"/f{i % 5}", "unlink" if i % 7 == 3 else "change", i) for i in range(30)]
    spark.createDataFrame(rows[:15], kind).coalesce(1).write.json(str(tmp_path / "in"))
    spark.createDataFrame(rows[15:], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    table = chunk_table.ChunkTable(Store(spark, str(tmp_path / "t")), 4)

    def read(wanted):
        return wanted.select(F.concat("filePath", F.lit("#0")).alias("id"), "project", "filePath", F.lit("text").alias("content"))

    changes = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = streams.watch(changes, table, read, str(tmp_path / "cp"))
        q.awaitTermination(120)
    last = {f: e for _, f, e, _ in rows}
    assert {r.filePath for r in table.read().collect()} == {f for f, e in last.items() if e != "unlink"}


def test_windows_sessions_and_rings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:09:59"), (3, "a", "2024-01-01 00:20:00"), (4, "b", "2024-01-01 00:05:00")], "id long, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r.k, r.beats) for r in streams.sessions(rows, "t", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    rows.write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    for name, streamed, batch, mode in (("w", streams.counts_by_window(source, "t", "k", "10 minutes"), streams.counts_by_window(rows, "t", "k", "10 minutes"), "complete"),):
        q = streamed.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))
    q = streams.ringed(source.select("k", "id"), "k", 2).writeStream.format("memory").queryName("r").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r.lastId, r.held, r.oldest) for r in spark.table("r").collect()} == {("a", 3, 2, 2), ("b", 4, 1, 4)}
    assert [r.id for r in streams.ring(rows, 2, 3).orderBy("id").collect()] == [3, 4] and streams.ring(rows, 99, 3).count() == 3
    assert streams.notifications(spark.createDataFrame([("job-completed", "p"), ("index-updated", "p"), ("other", None)], "type string, project string")).select("resource").collect()[1][0] == "index/p"


def test_revisions_and_retries(spark):
    r, made = streams.Revisions(), []
    make = lambda: made.append(1) or spark.range(1)
    r.derived("p", "x", make), r.derived("p", "x", make)
    r.written("p")
    r.derived("p", "x", make)
    assert len(made) == 2
    tries, failed = [], []

    def run(items):
        tries.append(list(items))
        if 2 in items and len(items) == 1 and tries.count([2]) > 1 or 3 in items or len(items) > 1:
            raise ValueError("x") if 3 in items or len(items) > 1 else None or ValueError("x")

    streams.retried([1, 3], run, lambda item, e: failed.append(item))
    assert failed == [3] and [1] in tries


def test_job_queue_and_events():
    ring, order = EventRing(3), []
    queue = JobQueue(1, lambda kind, job: ring.add(kind, job=job.id))
    gate = threading.Event()
    queue.register("wait", lambda job, progress: gate.wait(10))
    queue.register("note", lambda job, progress: order.append(job.payload["n"]))
    queue.register("bad", lambda job, progress: 1 / 0)
    first = queue.enqueue("wait", {"project": "p"})
    low, high, gone = queue.enqueue("note", {"n": 1}, 0), queue.enqueue("note", {"n": 2}, 5), queue.enqueue("note", {"n": 3}, 9)
    assert queue.busy("p") and queue.cancel(gone.id) and not queue.cancel("none")
    gate.set()
    assert queue.wait(low.id, 10).status == "completed" and queue.wait(high.id, 10).status == "completed" and order == [2, 1] and first.status == "completed"
    assert queue.wait(queue.enqueue("bad", {}).id, 10).error == "division by zero" and gone.status == "cancelled"
    with pytest.raises(ValueError, match="no handler"):
        queue.enqueue("none", {})
    rows, last = ring.since(0)
    assert len(rows) == 3 and ring.since(last) == ([], last) and len(ring.since(last + 50)[0]) == 3


def test_replace_leaves_unknown_columns_out(spark):
    old = spark.createDataFrame([("p", "/a", "1"), ("p", "/b", "2"), ("q", "/a", "3")], "project string, filePath string, content string")
    new = spark.createDataFrame([("p", "/a", "9", 1)], "project string, filePath string, content string, extra int")
    got = chunk_table.replaced(old, new, spark.createDataFrame([("p", "/b")], "project string, filePath string"))
    assert sorted(map(tuple, got.collect())) == [("p", "/a", "9"), ("q", "/a", "3")]
    assert chunk_table.vector_index(old) is None and chunk_table.content_scan(spark.createDataFrame([("/a", "x", "", "", "", 1, 1)] * 3, "filePath string, content string, symbolName string, symbolType string, language string, startLine int, endLine int"), 2).first().truncated


def test_vector_index_and_text_index(spark):
    rows = spark.createDataFrame([(i, "p", f"word{i % 3} text", [float((i * 7 + k) % 5 - 2) for k in range(4)]) for i in range(20)], "rec_id long, project string, content string, vector array<float>")
    cells = chunk_table.vector_index(rows, planes=3, dim=4, rows=10)
    assert cells.count() == 20 and cells.select("cell").distinct().count() > 1
    postings, stats = chunk_table.text_index(rows)
    assert {r.leg for r in stats.collect()} == {"content"} and postings.where("term = 'word1'").count() == 7 and ranking.words("content") is not None
    assert rows.select(relative_path(F.lit("/a/b"), F.lit("/a/")).alias("x")).first().x == "b"
