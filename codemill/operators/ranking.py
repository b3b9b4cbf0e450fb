"""Retrieval legs and what is made of them: BM25, trigrams, nearest vectors, fusion, boost, diversity, budgets.

All operators take a table of queries (query_id, ...) and answer all of them in one plan. Every order ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemill.functions.predicates import path_factor
from codemill.settings import RRF_K, Boost

K1, B = 1.2, 0.75
#: Rows of one block of vectors.
BLOCK = 4096


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and _; none for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.array().cast("array<string>"))


def trigrams(text: Column | str) -> Column:
    """Runs of three characters of the lower-cased words of a text; a word of fewer has none."""
    col = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1))
    grams = F.flatten(F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3))))
    return F.coalesce(grams, F.array().cast("array<string>"))


def postings(docs: DataFrame, terms: Column, wanted: DataFrame | None = None) -> DataFrame:
    """scope, id, term, tf, dl of docs (scope, id and what terms reads). Only terms of wanted (term), where it is given; dl counts
    all terms. One shuffle of what is left after the map side has counted."""
    rows = docs.select("scope", "id", terms.alias("terms")).withColumn("dl", F.size("terms")).where("dl > 0")
    rows = rows.select("scope", "id", "dl", F.explode("terms").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("scope", "id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, terms: Column) -> DataFrame:
    """scope, n (documents with a term), avgdl."""
    sizes = docs.select("scope", F.size(terms).alias("dl")).where("dl > 0")
    return sizes.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(queries: DataFrame, docs: DataFrame, terms: Callable[[str], Column] = words) -> DataFrame:
    """query_id, id, score of the documents that share a term with a query.

    queries: query_id, scope (null: every scope), text. docs: scope, id, text. Document frequencies and lengths are those of
    the document's scope. A query without terms has no rows; terms of a query count once."""
    asked = queries.select("query_id", F.col("scope").alias("q_scope"), F.explode(F.array_distinct(terms("text"))).alias("term"))
    found = postings(docs, terms("text"), asked).withColumn("df", F.count("*").over(Window.partitionBy("scope", "term")))
    stats = corpus_stats(docs, terms("text"))
    weight = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(stats, "scope").select("scope", "id", "term", (weight * saturated).alias("part"))
    own = asked.where("q_scope is not null").select("query_id", "term", F.col("q_scope").alias("scope")).join(scored, ["scope", "term"])
    every = asked.where("q_scope is null").select("query_id", "term").join(scored, "term")
    cols = ["query_id", "id", "part"]
    return own.select(cols).union(every.select(cols)).groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def top(rows: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The k first rows of each query with their rank, from 1; ties end in id."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order, F.col("id"))))
    return ranked.where(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """ids, vectors: blocks of at most BLOCK rows with usable vectors of dim values."""
    usable = rows.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                flat = part.column(1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0)), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["ids", "flat"]
                )

    return usable.mapInArrow(run, "ids array<long>, flat array<float>")


def nearest(queries: DataFrame, docs: DataFrame, k: int, metric: str = "l2", dim: int = 64) -> DataFrame:
    """query_id, id, distance, rank: the k nearest documents of each query (query_id, vector) among docs (id, vector).

    metric: l2 (squared), cosine (1 - similarity; all-zero vectors have none and take no part) or dot (negative product), all
    in double precision. Vectors that are null or not of dim values take no part. Exact: the stated queries meet all rows in
    blocks of BLOCK, each block pair keeps its k best and the best of these remain; ties go to the smaller id."""
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_flat, ids, flat in zip(*(batch.column(i) for i in range(4))):
                q_id, d_id = np.array(q_ids.values), np.array(ids.values)
                q = np.array(q_flat.values, np.float64).reshape(len(q_id), dim)
                d = np.array(flat.values, np.float64).reshape(len(d_id), dim)
                if metric == "cosine":
                    keep, keep_d = np.linalg.norm(q, axis=1) > 0, np.linalg.norm(d, axis=1) > 0
                    q, q_id, d, d_id = q[keep], q_id[keep], d[keep_d], d_id[keep_d]
                    q, d = q / np.linalg.norm(q, axis=1, keepdims=True), d / np.linalg.norm(d, axis=1, keepdims=True)
                if not len(q_id) or not len(d_id):
                    continue
                dot = q @ d.T
                dist = {"dot": -dot, "cosine": 1 - dot}.get(metric)
                if dist is None:
                    dist = (q**2).sum(1)[:, None] + (d**2).sum(1)[None, :] - 2 * dot
                order = np.lexsort((np.broadcast_to(d_id, dist.shape), dist.round(12)), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q_id)), order.shape[1])
                cols = order.ravel()
                # the few that stay are computed again without the cancellation of the product form
                exact = dist[rows, cols] if metric != "l2" else ((q[rows] - d[cols]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(q_id[rows]), pa.array(d_id[cols]), pa.array(exact)], names=["query_id", "id", "distance"])

    q = _blocks(queries, "query_id", "vector", dim).select(F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    pairs = _blocks(docs, "id", "vector", dim).crossJoin(q).select("q_ids", "q_flat", "ids", "flat")
    found = pairs.mapInArrow(run, "query_id long, id long, distance double")
    return top(found, k, F.round("distance", 9))


def fused(legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, score, first: reciprocal rank fusion of legs (query_id, leg, leg_ord, rank, id, weight).

    score is the sum of weight / (k + rank); first is the first leg's place and the rank in it, the order of ties. A row that a
    leg has twice counts with its better rank."""
    best = legs.groupBy("query_id", "leg", "leg_ord", "id").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    return best.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg_ord", "rank")).alias("first"))


def combined(legs: DataFrame) -> DataFrame:
    """query_id, id, score, metric, first, legs: fusion where two legs or more of a query have rows (metric rrf); where only one
    has, its own metric is kept (metric is the leg's name; a distance is negated, so that more is better). legs are the names of
    those that have the row. One shuffle on query_id; the legs are read once."""
    alive = F.size(F.collect_set("leg").over(Window.partitionBy("query_id")))
    best = legs.withColumn("alive", alive).groupBy("query_id", "alive", "leg", "leg_ord", "id").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"), F.max("native").alias("native"))
    rows = best.groupBy("query_id", "id").agg(
        F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("fused"), F.min(F.struct("leg_ord", "rank")).alias("first"), F.max("native").alias("native"), F.max("alive").alias("alive"), F.collect_set("leg").alias("legs")
    )
    many = F.col("alive") > 1
    return rows.select("query_id", "id", F.when(many, F.col("fused")).otherwise(F.col("native")).alias("score"), F.when(many, F.lit("rrf")).otherwise(F.col("legs")[0]).alias("metric"), "first", "legs")


def boosted(rows: DataFrame, relative: Column, boost: Boost = Boost(), score: str = "score") -> DataFrame:
    """score times the factor of the path; untouched where boost is not enabled."""
    return rows.withColumn(score, F.col(score) * path_factor(relative, boost)) if boost.enabled else rows


def within_budget(rows: DataFrame, size: Column, most: int | None, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Rows of each query while their running size fits; the first is always kept. omitted: rows of the query left out."""
    if not most or most <= 0:
        return rows.withColumn("omitted", F.lit(0).cast("long"))
    w = Window.partitionBy(by).orderBy(order)
    sized = rows.withColumn("_used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.row_number().over(w) == 1)
    keep = F.col("_first") | (F.col("_used") <= most)
    marked = sized.withColumn("_keep", keep).withColumn("omitted", F.sum((~keep).cast("long")).over(Window.partitionBy(by)))
    return marked.where("_keep").drop("_used", "_first", "_keep")


def diversified(rows: DataFrame, k: int, weight: float = 0.5, pool: int = 20) -> DataFrame:
    """Maximal marginal relevance: query_id, id, rank of the k rows chosen from the pool first ones of each query.

    rows: query_id, id, rank, relevance (more is better), vector. Relevance is scaled to [0, 1] within the query (all equal: 1).
    In turn the row with the highest weight * relevance - (1 - weight) * max(0, cosine to a chosen one) is taken, ties to the
    earlier rank. A query with a missing vector, or vectors of different lengths, keeps its order."""
    keep = rows.where(F.col("rank") <= pool).select("query_id", "id", "rank", F.col("relevance").cast("double").alias("relevance"), F.col("vector").cast("array<double>").alias("vector"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "id"], kind="stable").reset_index(drop=True)
        lengths = {len(v) if v is not None else -1 for v in part["vector"]}
        if -1 in lengths or len(lengths) > 1:
            picked = list(range(min(k, len(part))))
        else:
            v = np.stack(part["vector"].to_numpy())
            norm = np.linalg.norm(v, axis=1)
            unit = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
            near = np.maximum(0.0, unit @ unit.T)
            rel = part["relevance"].to_numpy(float)
            span = rel.max() - rel.min()
            rel = (rel - rel.min()) / span if span > 0 else np.ones(len(rel))
            picked, closest = [], np.zeros(len(rel))
            while len(picked) < min(k, len(part)):
                value = weight * rel - (1 - weight) * closest
                value[picked] = -np.inf
                best = int(np.argmax(value))
                picked.append(best)
                closest = np.maximum(closest, near[best])
        return pd.DataFrame({"query_id": part["query_id"].iloc[0], "id": part["id"].iloc[picked].to_numpy(), "rank": np.arange(1, len(picked) + 1, dtype=np.int32)})

    kind = dict(rows.dtypes)
    return keep.groupBy("query_id").applyInPandas(choose, f"query_id {kind['query_id']}, id {kind['id']}, rank int")


def reranked(rows: DataFrame, judge: Column, pool: int = 20) -> DataFrame:
    """The first pool rows of each query in the order of judge (a probability; null, where it fails, counts 0.5), then the rest."""
    scored = rows.withColumn("rerank_score", F.when(F.col("rank") <= pool, F.coalesce(judge, F.lit(0.5))))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return scored.withColumn("rank", F.row_number().over(w))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A vector that depends on nothing but the text: values (byte - 127.5) / 127.5 of its SHA-256, around and around. Equal
    texts have equal vectors; a stand-in where no model is served."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((F.conv(F.substring(digest, 2 * (i % 32) + 1, 2), 16, 10).cast("double") - 127.5) / 127.5).cast("float"))
