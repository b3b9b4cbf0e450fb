"""Search as one plan over a table of queries: legs, fusion, boost, re-ranking, diversity, slice, enrichment, budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemill.functions.identifiers import query_parts
from codemill.functions.predicates import relative_path, row_filter, symbol_matches
from codemill.functions.scalars import pack_entry_size, result_size
from codemill.operators import ranking
from codemill.settings import PACK_BELOW, PACK_BUDGET, PACK_IMPORTS, PACK_LIMIT, PACK_OUTLINE, VARIANT_FETCH, VARIANT_WEIGHT, Boost

MODES = ("vector", "text", "hybrid")


def current(chunks: DataFrame, *columns: str) -> DataFrame:
    """The chunks, repeated rows of a rec_id once (they differ in nothing but indexedAt), with the columns that are named."""
    return chunks.where("rec_id is not null").select("rec_id", *columns).dropDuplicates(["rec_id"])


def distinct_queries(queries: DataFrame, text: str = "query", scope: str = "project") -> DataFrame:
    """query_id, scope, text: each non-blank query of a scope once, trimmed; query_id is a hash of both."""
    rows = queries.select(F.col(scope).alias("scope"), F.trim(F.col(text)).alias("text")).where("text <> ''").distinct()
    return rows.select(F.xxhash64(F.coalesce("scope", F.lit("")), "text").alias("query_id"), "scope", "text")


def leg_pool(limit: int, mode: str) -> int:
    return max(3 * limit, 10) if mode == "hybrid" else limit


def fetch_limit(limit: int, rerank: bool = False, mmr: bool = False, rerank_top: int = 20, mmr_top: int = 20) -> int:
    """Rows that search hands to the later stages."""
    return max(limit, rerank_top if rerank else 0, mmr_top if mmr else 0)


def legs(
    queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", pool: int = 10, embed: Callable[[Column], Column] | None = None, where: Column | None = None, doc: bool = True, dim: int = 64
) -> DataFrame:
    """query_id, leg, leg_ord, rank, id, weight, native of all legs that the mode and the columns of chunks allow.

    vector: nearest vectors (needs embed); text: BM25 over content. hybrid has both, and BM25 over id_terms for queries of two
    identifier words or more. doc adds the legs over doc_vector and doc. native is the leg's own metric, distances negated."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {', '.join(MODES)}")
    rows = chunks.where(where) if where is not None else chunks
    has = set(chunks.columns)
    out: list[DataFrame] = []

    def add(found: DataFrame, name: str, order: int, native: Column, *by: Column) -> None:
        out.append(ranking.top(found, pool, *by).select("query_id", F.lit(name).alias("leg"), F.lit(order).alias("leg_ord"), "rank", "id", F.lit(1.0).alias("weight"), native.alias("native")))

    def text_leg(name: str, order: int, asked: DataFrame, column: str) -> None:
        docs = rows.where(F.col(column).isNotNull()).select(F.col("project").alias("scope"), F.col("rec_id").alias("id"), F.col(column).alias("text"))
        add(ranking.bm25(asked, docs), name, order, F.col("score"), F.round("score", 9).desc())

    def vector_leg(name: str, order: int, column: str) -> None:
        asked = queries.select("query_id", "scope", embed(F.col("text")).alias("vector"))  # type: ignore[misc]
        docs = rows.select(F.col("rec_id").alias("id"), F.col(column).alias("vector"), F.col("project").alias("_p"))
        everywhere = ranking.nearest(asked.where("scope is null"), docs, pool, dim=dim)
        within = nearest_in_scope(asked.where("scope is not null"), docs.withColumnRenamed("_p", "scope"), pool, dim)
        add(everywhere.drop("rank").union(within.drop("rank")), name, order, -F.col("distance"), F.round("distance", 9))

    if mode in ("vector", "hybrid") and embed is not None and "vector" in has:
        vector_leg("vector", 0, "vector")
    if mode in ("text", "hybrid"):
        text_leg("text", 1, queries, "content")
    if mode == "hybrid" and "id_terms" in has:
        parts = F.array_join(query_parts("text"), " ")
        text_leg("id_terms", 4, queries.where(F.size(query_parts("text")) >= 2).select("query_id", "scope", parts.alias("text")), "id_terms")
    if doc and mode != "text" and embed is not None and "doc_vector" in has:
        vector_leg("doc_vector", 2, "doc_vector")
    if doc and mode != "vector" and "doc" in has:
        text_leg("doc", 3, queries, "doc")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def nearest_in_scope(queries: DataFrame, docs: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """As ranking.nearest by l2, each query within its scope only: an equi-join on the scope, whose pairs are measured by a
    column expression and cut to k by a grouped limit. Queries of a scope meet its rows once; nothing is sent to all."""
    from codemill.functions.scalars import squared_distance

    usable = docs.where(F.size("vector") == dim)
    pairs = queries.where(F.size("vector") == dim).select("query_id", "scope", F.col("vector").alias("q")).join(usable, "scope")
    return ranking.top(pairs.select("query_id", "id", squared_distance("q", "vector").alias("distance")), k, F.round("distance", 9))


def search(
    queries: DataFrame,
    chunks: DataFrame,
    limit: int = 5,
    mode: str = "hybrid",
    embed: Callable[[Column], Column] | None = None,
    where: Column | None = None,
    boost: Boost = Boost(),
    doc: bool = True,
    roots: DataFrame | None = None,
    max_chars: int | None = None,
    mmr: bool = False,
    judge: Column | None = None,
) -> DataFrame:
    """query_id, rank, rec_id, score, metric, doc_hit, filePath, symbolName, startLine, endLine, project (and omitted) of the
    limit best chunks of each query (query_id, scope, text). Only fused lists are boosted; roots (project, path) makes paths
    relative. With a budget, whole chunks are left out from the end; the first always stays. A query without a hit has no row."""
    pool = leg_pool(limit, mode)
    found = legs(queries, chunks, mode, pool, embed, where, doc)
    rows = ranking.combined(found)
    wanted = ["filePath", "symbolName", "startLine", "endLine", "project", *(["vector"] if mmr else []), *(["content"] if max_chars or judge is not None else [])]
    rows = rows.withColumn("doc_hit", F.arrays_overlap("legs", F.array(F.lit("doc"), F.lit("doc_vector")))).drop("legs")
    rows = rows.join(current(chunks, *wanted).withColumnRenamed("rec_id", "id"), "id")
    relative = F.col("filePath")
    if roots is not None:
        rows = rows.join(roots.select("project", F.col("path").alias("_root")).dropDuplicates(["project"]), "project", "left")
        relative = relative_path("filePath", "_root")
    if boost.enabled:
        from codemill.functions.predicates import path_factor

        rows = rows.withColumn("score", F.when(F.col("metric") == "rrf", F.col("score") * path_factor(relative, boost)).otherwise(F.col("score")))
    rows = ranking.top(rows, fetch_limit(limit, judge is not None, mmr), F.round("score", 12).desc(), F.col("first"))
    if judge is not None:
        rows = ranking.reranked(rows, judge)
    if mmr:
        relevance = F.coalesce(F.col("rerank_score"), F.col("score")) if judge is not None else F.col("score")
        chosen = ranking.diversified(rows.withColumn("relevance", relevance), limit).withColumnRenamed("rank", "_rank")
        rows = rows.join(chosen, ["query_id", "id"]).withColumn("rank", F.col("_rank")).drop("_rank")
    rows = rows.where(F.col("rank") <= limit)
    if max_chars:
        rows = ranking.within_budget(rows, result_size("content"), max_chars)
    out = ["query_id", "rank", F.col("id").alias("rec_id"), "score", "metric", "doc_hit", "filePath", "symbolName", "startLine", "endLine", "project"]
    return rows.select(*out, *(["omitted"] if max_chars else []), *(["content"] if max_chars else []))


def merged_variants(original: DataFrame, variants: DataFrame, limit: int) -> DataFrame:
    """Weighted fusion of the hits of queries and of their variants: both query_id, rank, id; variants also variant. The
    original list counts 1 and comes first, each variant VARIANT_WEIGHT."""
    first = original.select("query_id", F.lit("original").alias("leg"), F.lit(0).alias("leg_ord"), "rank", "id", F.lit(1.0).alias("weight"))
    more = variants.select("query_id", F.concat(F.lit("variant-"), F.col("variant")).alias("leg"), (F.col("variant") + 1).alias("leg_ord"), "rank", "id", F.lit(VARIANT_WEIGHT).alias("weight"))
    return ranking.top(ranking.fused(first.unionByName(more)), limit, F.round("score", 12).desc(), F.col("first"))


def variant_fetch(limit: int) -> int:
    return max(limit, VARIANT_FETCH)


def across_projects(rows: DataFrame, mode: str, limit: int) -> DataFrame:
    """Hits of several projects (query_id, id, distance, score) as one list: by distance in vector mode, where rows without one
    are left out, else by score, a missing one counting 0."""
    if mode == "vector":
        return ranking.top(rows.where("distance is not null"), limit, F.col("distance"))
    return ranking.top(rows, limit, F.coalesce("score", F.lit(0.0)).desc())


def find_symbol(queries: DataFrame, chunks: DataFrame, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """query_id, rank, rec_id, symbolName, filePath, startLine, fuzzy, score of the symbols that queries (query_id, scope, text) name.

    Strict hits (equal, beginning with it, or a part behind a dot that does) are ordered equal, beginning, dotted, then by name,
    path and line. Trigram hits answer only a query without a strict hit in its scope, best score first, ties by name. Of each
    symbol of a file the first chunk stands. A query under three characters has no trigram hit, an empty one none at all."""
    symbols = current(chunks, "symbolName", "filePath", "startLine", "project").where("symbolName <> ''")
    heads = symbols.groupBy("project", "filePath", "symbolName").agg(F.min(F.struct("startLine", "rec_id")).alias("h")).select("project", "filePath", "symbolName", "h.*")
    asked = queries.where("text <> ''")
    strict = _strict_hits(asked, heads)
    tier = F.when(F.col("symbolName") == F.col("text"), 0).when(F.startswith("symbolName", "text"), 1).otherwise(2)
    strict = strict.withColumn("tier", tier)
    w = Window.partitionBy("query_id").orderBy("tier", "symbolName", "filePath", "startLine", "rec_id")
    cols = ["query_id", "rank", "rec_id", "symbolName", "filePath", "startLine"]
    first = strict.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(*cols, F.lit(False).alias("fuzzy"), F.lit(None).cast("double").alias("score"))
    if not fuzzy:
        return first
    missed = asked.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    docs = heads.select(F.col("project").alias("scope"), F.col("rec_id").alias("id"), F.col("symbolName").alias("text"))
    near = ranking.bm25(missed, docs, ranking.trigrams).join(heads.withColumnRenamed("rec_id", "id"), "id")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "symbolName", "id")
    second = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumnRenamed("id", "rec_id")
    return first.unionByName(second.select(*cols, F.lit(True).alias("fuzzy"), "score"))


def _strict_hits(asked: DataFrame, heads: DataFrame) -> DataFrame:
    """Joined on the first three characters of every place where a name can match, then tested: no pair is formed that shares
    no beginning. Queries of one or two characters are joined on those."""
    n = F.least(F.length("text"), F.lit(3))
    q = asked.withColumn("key", F.substring("text", F.lit(1), n))
    places = F.concat(F.array(F.col("symbolName")), F.transform(F.regexp_extract_all("symbolName", F.lit(r"\.(?=(.+))"), F.lit(1)), lambda x: x))
    keys = F.array_distinct(F.flatten(F.transform(places, lambda p: F.transform(F.sequence(F.lit(1), F.least(F.length(p), F.lit(3))), lambda i: F.substring(p, F.lit(1), i)))))
    s = heads.withColumn("key", F.explode(keys))
    pairs = q.join(s, "key").where(F.col("scope").isNull() | (F.col("scope") == F.col("project"))).where(symbol_matches("symbolName", "text"))
    return pairs.drop("key")


def outlines(chunks: DataFrame) -> DataFrame:
    """project, filePath, symbolType, symbolName, startLine, endLine: the symbols of each file, parts of one put together."""
    rows = current(chunks, "project", "filePath", "symbolType", "symbolName", "startLine", "endLine").where("symbolName <> ''")
    return rows.groupBy("project", "filePath", "symbolType", "symbolName").agg(F.min("startLine").alias("startLine"), F.max("endLine").alias("endLine"))


def context_pack(hits: DataFrame, chunks: DataFrame, imports: DataFrame | None = None, limit: int = PACK_LIMIT, max_chars: int = PACK_BUDGET) -> DataFrame:
    """query_id, rank, rec_id, filePath, outline, imports, size, omitted: hits (query_id, rank, rec_id) with the outline around
    them (symbols that overlap, and the next PACK_BELOW below; at most PACK_OUTLINE, by line) and at most PACK_IMPORTS resolved
    imports (filePath, raw, path) of their file, as far as whole entries fit the budget."""
    rows = hits.where(F.col("rank") <= limit).select("query_id", "rank", "rec_id").join(current(chunks, "content", "filePath", "startLine", "endLine"), "rec_id")
    outline = outlines(chunks).select("filePath", F.col("symbolType").alias("o_type"), F.col("symbolName").alias("o_name"), F.col("startLine").alias("o_start"), F.col("endLine").alias("o_end"))
    near = rows.select("query_id", "rec_id", "filePath", "startLine", "endLine").join(outline, "filePath")
    overlap = (F.col("o_start") <= F.col("endLine")) & (F.col("o_end") >= F.col("startLine"))
    below = near.where((F.col("o_start") > F.col("endLine")) & ~overlap)
    below = below.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "rec_id").orderBy("o_start", "o_name", "o_type"))).where(F.col("n") <= PACK_BELOW).drop("n")
    both = near.where(overlap).unionByName(below)
    both = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "rec_id").orderBy("o_start", "o_name", "o_type"))).where(F.col("n") <= PACK_OUTLINE)
    lists = both.groupBy("query_id", "rec_id").agg(F.sort_array(F.collect_list(F.struct(F.col("o_start").alias("startLine"), F.col("o_name").alias("symbolName"), F.col("o_type").alias("symbolType"), F.col("o_end").alias("endLine")))).alias("outline"))
    rows = rows.join(lists, ["query_id", "rec_id"], "left")
    edge = "array<struct<raw:string,path:string>>"
    if imports is not None:
        ranked = imports.where("path is not null").select("filePath", "raw", "path").distinct()
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("filePath").orderBy("path", "raw"))).where(F.col("n") <= PACK_IMPORTS)
        rows = rows.join(ranked.groupBy("filePath").agg(F.sort_array(F.collect_list(F.struct("raw", "path"))).alias("imports")), "filePath", "left")
    else:
        rows = rows.withColumn("imports", F.lit(None).cast(edge))
    rows = rows.withColumn("size", pack_entry_size("content", "outline", "imports"))
    return ranking.within_budget(rows, F.col("size"), max_chars).select("query_id", "rank", "rec_id", "filePath", "outline", "imports", "size", "omitted")


def filters(language: str | None = None, symbol_type: str | None = None, path_glob: str | None = None) -> Column:
    return row_filter(language, symbol_type, path_glob)


def framed(text: Column, model: str | None, kind: str, prefixes: dict[str, dict[str, str]] | None = None) -> Column:
    """text behind the prefix that a model wants for documents or queries; as it is for unknown models."""
    prefix = (prefixes or FRAMES).get((model or "").split(":")[0], {}).get(kind, "")
    return F.concat(F.lit(prefix), text)


#: Prefixes of public embedding models.
FRAMES = {
    "nomic-embed-text": {"doc": "search_document: ", "query": "search_query: "},
    "mxbai-embed-large": {"query": "Represent this sentence for searching relevant passages: "},
    "e5": {"doc": "passage: ", "query": "query: "},
}


def cached_embedding(texts: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], model: str) -> tuple[DataFrame, DataFrame]:
    """(texts with vector, cache rows to append): vectors come from the cache by (model, SHA-256 of the text), the rest is
    embedded, each distinct text once. texts: id, text; cache: model, hash, dim, vector, created_at."""
    keyed = texts.withColumn("hash", F.sha2("text", 256))
    known = cache.where(F.col("model") == model).select("hash", F.col("vector")).dropDuplicates(["hash"])
    new = keyed.select("hash", "text").dropDuplicates(["hash"]).join(known, "hash", "left_anti").select("hash", embed(F.col("text")).alias("vector"))
    rows = keyed.join(known.unionByName(new), "hash", "left")
    return rows, new.select(F.lit(model).alias("model"), "hash", F.size("vector").alias("dim"), "vector", F.current_timestamp().alias("created_at"))
