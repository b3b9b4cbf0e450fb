"""Counters, migration, snapshots, sizes, and functions for SQL."""

from pyspark.sql import functions as F

from codemill.functions import sql
from codemill.operators import maintenance
from codemill.plans.api import Engine
from codemill.sources.registry import Store


def test_migration_swaps_model_and_vectors_together(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text('def f():\n    """Says what it does."""\n    return 1\n')
    store = Store(spark, str(tmp_path / "s"))
    engine = Engine(spark, store)
    engine.index_project(str(tmp_path / "p"), "p")
    embed = lambda c: F.array(F.length(c).cast("float"))
    assert maintenance.migrated(store, "p", "hash", 64, embed) == "noop" and maintenance.migrated(store, "p", "m", 1, embed, lambda: True) == "cancelled"
    assert len(engine.chunks.first().vector) == 64
    assert maintenance.migrated(store, "p", "m", 1, embed) == "swapped"
    row = engine.chunks.first()
    assert row.vector == [float(len(row.content))] and len(row.doc_vector) == 1 and engine.list_indexes().first().embed_model == "m" and store.orphans() == []


def test_counts_snapshots_and_sizes(spark):
    chunks = spark.createDataFrame([("p", "/a", 1, [1.0]), ("p", "/a", 2, None), ("p", "/b", 3, [1.0])], "project string, filePath string, rec_id long, vector array<float>")
    indexes = spark.createDataFrame([("p", 9, 9, "ready"), ("q", 9, 9, "error")], "name string, file_count int, chunk_count int, status string")
    assert {r.name: (r.file_count, r.chunk_count) for r in maintenance.reconciled(indexes, chunks).collect()} == {"p": (2, 3), "q": (0, 0)}
    log, cache = spark.createDataFrame([("p", "x"), (None, "y")], "project string, query string"), spark.createDataFrame([("p", "/a"), ("p", "/a")], "index_name string, file_path string")
    assert {r.name: (r.files, r.chunks, r.vectors, r.queries) for r in maintenance.statistics(indexes, chunks, cache, log).collect()} == {"p": (1, 3, 2, 1), "q": (0, 0, 0, 0)}
    reports = spark.createDataFrame([("p", None, True, 0, 0), ("q", None, True, 0, 0)], "project string, ts timestamp, consistent boolean, findings int, needs_review int")
    found = spark.createDataFrame([("p", "drift"), ("p", "review")], "project string, band string")
    assert {r.project: (r.consistent, r.findings, r.needs_review) for r in maintenance.snapshot(reports, found, "p").collect()} == {"p": (False, 1, 1), "q": (True, 0, 0)}
    files = spark.createDataFrame([("/r/a/x", 5), ("/r/a/y", 6), ("/r/b", 7), ("/z", 1)], "path string, size long")
    assert {r.entry: r.bytes for r in maintenance.disk_usage(files, "/r/").collect()} == {"a": 11, "b": 7}


def test_functions_for_sql(spark):
    assert "split_identifier" in sql.register(spark)
    row = spark.sql("SELECT split_identifier('HTTPServer_x2Y') AS a, is_test_file('a/x.test.ts') AS b, round_up(0.25D, 1) AS c, bare_name('A.b') AS d, is_entry_point('src/main.py') AS e, is_generated_path('dist/a.js') AS f, derive_signature('def f(a):', 'python') AS g, identifier_runs('a.b c') AS h, is_document('a.MD') AS i, normal_identifier('a_B-c') AS j").first()
    assert tuple(row) == (["HTTP", "Server", "x2", "Y"], True, 0.3, "b", True, True, "def f(a)", ["a", "b", "c"], True, "abc")
