"""Ranking and search on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemill.operators import ranking, search
from codemill.settings import Boost

LEG = "query_id long, leg string, leg_ord int, rank int, id long, weight double, native double"


def chunk_rows(spark, rows):
    kind = "rec_id long, project string, filePath string, content string, symbolName string, symbolType string, language string, startLine int, endLine int, doc string, id_terms string, score double"
    return spark.createDataFrame([(*r, 1.0) for r in rows], kind)


def test_fusion_of_two_lists(spark):
    rows = [(1, "x", 0, 1, 10, 1.0, 0.0), (1, "x", 0, 2, 20, 1.0, 0.0), (1, "x", 0, 3, 30, 1.0, 0.0), (1, "y", 1, 1, 20, 1.0, 0.0), (1, "y", 1, 2, 10, 1.0, 0.0), (1, "y", 1, 3, 40, 1.0, 0.0)]
    got = ranking.top(ranking.fused(spark.createDataFrame(rows, LEG)), 10, F.round("score", 12).desc(), F.col("first")).orderBy("rank").collect()
    assert [r.id for r in got] == [10, 20, 30, 40] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    flat = ranking.fused(spark.createDataFrame(rows, LEG), 10_000).agg(F.max("score") / F.min("score")).first()[0]
    assert flat == pytest.approx(2, rel=1e-3)
    assert ranking.fused(spark.createDataFrame([], LEG)).count() == 0


def test_one_leg_keeps_its_metric(spark):
    rows = [(1, "text", 1, 1, 10, 1.0, 7.5), (2, "text", 1, 1, 10, 1.0, 7.5), (2, "doc", 3, 1, 10, 1.0, 3.0)]
    got = {r.query_id: (r.metric, r.score) for r in ranking.combined(spark.createDataFrame(rows, LEG)).collect()}
    assert got[1] == ("text", 7.5) and got[2] == ("rrf", pytest.approx(2 / 61))


def test_bm25_equals_the_formula(spark):
    docs = spark.createDataFrame([("p", 1, "a b b"), ("p", 2, "b c"), ("p", 3, None), ("q", 4, "a"), ("p", 5, "")], "scope string, id long, text string")
    asked = spark.createDataFrame([(1, "p", "B b zzz"), (2, None, "a"), (3, "p", "")], "query_id long, scope string, text string")
    got = {(r.query_id, r.id): r.score for r in ranking.bm25(asked, docs).collect()}
    idf = math.log(1 + 0.5 / 2.5)
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 4)}
    assert got[1, 1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_equals_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    v[9] = 0
    docs = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, [1.0])], "id long, vector array<float>")
    asked = docs.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in ranking.nearest(asked, docs, 5, metric, 8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    d = v.astype(float)
    for q, rows in got.items():
        if metric == "l2":
            dist = ((d - d[q]) ** 2).sum(1)
        elif metric == "dot":
            dist = -(d @ d[q])
        else:
            n = np.linalg.norm(d, axis=1)
            dist = np.where(n > 0, 1 - (d @ d[q]) / np.maximum(n * n[q], 1e-300), np.inf)
        assert [i for _, i in sorted(rows)] == sorted(range(300), key=lambda i: (round(float(dist[i]), 9), i))[:5]
    assert len(got) == 6


def test_equal_texts_have_equal_vectors(spark):
    got = [r.v for r in spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(ranking.hash_embedding(F.col("t")).alias("v")).collect()]
    import hashlib

    digest = hashlib.sha256(b"a").digest()
    assert got[0] == got[1] != got[2] and got[0] == pytest.approx([(digest[i % 32] - 127.5) / 127.5 for i in range(64)], abs=1e-6)


def test_diversity(spark):
    rows = [(1, 1, 1, 1.0, [1.0, 0.0]), (1, 2, 2, 0.9, [1.0, 0.0]), (1, 3, 3, 0.5, [0.0, 1.0]), (2, 1, 1, 1.0, [1.0]), (2, 2, 2, 0.5, None)]
    got = ranking.diversified(spark.createDataFrame(rows, "query_id long, id long, rank int, relevance double, vector array<double>"), 2)
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == [(1, 1, 1), (1, 2, 3), (2, 1, 1), (2, 2, 2)]


def test_budget_keeps_the_first_and_stops(spark):
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 50), (2, 1, 10), (2, 2, 100), (2, 3, 5)], "query_id long, rank int, size int")
    got = sorted((r.query_id, r["rank"], r.omitted) for r in ranking.within_budget(rows, F.col("size"), 100).collect())
    assert got == [(1, 1, 1), (2, 1, 2)]
    assert ranking.within_budget(rows, F.col("size"), None).count() == 5


def test_rerank_failure_counts_half(spark):
    rows = spark.createDataFrame([(1, 1, 10, 0.2), (1, 2, 20, None), (1, 3, 30, 0.9), (1, 4, 40, 1.0)], "query_id long, rank int, id long, p double")
    assert [r.id for r in ranking.reranked(rows, F.col("p"), 3).orderBy("rank").collect()] == [30, 20, 10, 40]


NAMES = ["getUserName", "getUserEmail", "get_user_name", "refreshCache", "buildIndex", "IndexManager", "parseJSONString", "searchTableText"]


def symbols(spark):
    return chunk_rows(spark, [(i, "p", f"/p/{n}.ts", "x", n, "function", "typescript", 1, 2, None, None) for i, n in enumerate(NAMES)])


@pytest.mark.parametrize(("query", "first"), [("getUserNme", "getUserName"), ("GETUSERNME", "getUserName"), ("IdexManagr", "IndexManager"), ("refresh", "refreshCache"), ("ab", None), ("", None)])
def test_find_symbol(spark, query, first):
    asked = spark.createDataFrame([(1, None, query)], "query_id long, scope string, text string")
    got = search.find_symbol(asked, symbols(spark)).orderBy("rank").collect()
    assert (got[0].symbolName if got else None) == first
    assert all(r.fuzzy == (query != "refresh") for r in got)
    if query == "getUserNme":
        assert "getUserEmail" in [r.symbolName for r in got]


def test_search_modes_and_filters(spark):
    rows = [(1, "p", "/p/src/a.ts", "load user profile", "loadUser", "function", "typescript", 1, 3, "Loads a user.", "loaduser load user"), (2, "p", "/p/test/a.test.ts", "load user profile", "t", "function", "python", 1, 3, None, None), (3, "q", "/q/b.ts", "other", "o", "function", "typescript", 1, 2, None, None)]
    chunks, asked = chunk_rows(spark, rows), spark.createDataFrame([(1, "p", "load user"), (2, None, "nothing here")], "query_id long, scope string, text string")
    got = search.search(asked, chunks, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rec_id, r.metric, r.doc_hit) for r in got] == [(1, 1, "rrf", True), (1, 2, "rrf", False)]
    assert [r.metric for r in search.search(asked, chunks, 5, "text", doc=False).collect()] == ["text", "text"]
    assert [r.rec_id for r in search.search(asked, chunks, 5, where=search.filters("python")).collect()] == [2]
    plain = search.search(asked, chunks, 5, boost=Boost(enabled=False)).where("query_id = 1").agg(F.max("score")).first()[0]
    assert got[0].score > plain
    with pytest.raises(ValueError):
        search.search(asked, chunks, mode="fuzzy")


def test_variants_count_half(spark):
    first = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "query_id long, rank int, id long")
    more = spark.createDataFrame([(1, 0, 1, 20), (1, 0, 2, 30)], "query_id long, variant int, rank int, id long")
    got = search.merged_variants(first, more, 10).orderBy("rank").collect()
    assert [r.id for r in got] == [20, 10, 30] and got[2].score == pytest.approx(0.5 / 62)


def test_context_pack(spark):
    rows = [(i, "p", "/p/a.ts", "x" * 100, f"f{i:02}", "function", "typescript", 10 * i + 1, 10 * i + 5, None, None) for i in range(12)]
    hits = spark.createDataFrame([(1, 1, 3)], "query_id long, rank int, rec_id long")
    edges = spark.createDataFrame([("/p/a.ts", "./b", "/p/b.ts"), ("/p/a.ts", "react", None)], "filePath string, raw string, path string")
    got = search.context_pack(hits, chunk_rows(spark, rows), edges).first()
    assert [o.symbolName for o in got.outline] == ["f03", "f04", "f05", "f06", "f07"] and [i.raw for i in got.imports] == ["./b"] and got.omitted == 0
    assert got.size == 100 + 120 + 5 * (3 + 8 + 20) + (3 + 7 + 30) + 80


def test_cached_embedding(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    cache = spark.createDataFrame([("m", "x", 1, [9.0])], "model string, hash string, dim int, vector array<float>").withColumn("hash", F.sha2(F.lit("a"), 256)).withColumn("created_at", F.current_timestamp())
    rows, new = search.cached_embedding(texts, cache, lambda c: F.array(F.length(c).cast("float")), "m")
    assert {r.id: r.vector for r in rows.collect()} == {1: [9.0], 2: [1.0], 3: [9.0]} and new.count() == 1
