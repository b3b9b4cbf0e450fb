"""Reports over the code table: overview, coupling, hotspots, differences of interfaces, query log, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemill.functions.predicates import is_entry_point, is_test_file, relative_path
from codemill.functions.scalars import round_up
from codemill.operators.search import current


def language_histogram(chunks: DataFrame) -> DataFrame:
    """project, language ('' for none), files, symbols."""
    rows = current(chunks, "project", "filePath", "symbolName", "language")
    named = F.count(F.when(F.coalesce("symbolName", F.lit("")) != "", 1))
    return rows.groupBy("project", F.coalesce("language", F.lit("")).alias("language")).agg(F.countDistinct("filePath").alias("files"), named.alias("symbols"))


def symbol_histogram(chunks: DataFrame) -> DataFrame:
    """project, symbolType ('code' for none), chunks."""
    kind = F.when(F.coalesce("symbolType", F.lit("")) == "", "code").otherwise(F.col("symbolType"))
    return current(chunks, "project", "symbolType").groupBy("project", kind.alias("symbolType")).agg(F.count("*").alias("chunks"))


def folder_histogram(chunks: DataFrame, roots: DataFrame, limit: int = 12) -> DataFrame:
    """project, folder, files, rank: the largest top-level folders of a project ('.' for files at its root)."""
    files = chunks.where("filePath is not null").select("project", "filePath").distinct().join(roots.select("project", F.col("path").alias("_r")).dropDuplicates(["project"]), "project", "left")
    relative = relative_path("filePath", "_r")
    folder = F.when(F.contains(relative, F.lit("/")), F.substring_index(F.ltrim(relative), "/", 1)).otherwise(F.lit("."))
    counted = files.groupBy("project", folder.alias("folder")).agg(F.count("*").alias("files"))
    w = Window.partitionBy("project").orderBy(F.col("files").desc(), "folder")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def largest_files(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """project, filePath, symbols, rank: the files with the most distinct symbols."""
    rows = chunks.where("symbolName <> '' and filePath is not null").groupBy("project", "filePath").agg(F.countDistinct("symbolName").alias("symbols"))
    w = Window.partitionBy("project").orderBy(F.col("symbols").desc(), "filePath")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def entry_points(chunks: DataFrame, limit: int = 20) -> DataFrame:
    rows = chunks.where("filePath is not null").where(is_entry_point("filePath")).select("project", "filePath").distinct()
    w = Window.partitionBy("project").orderBy("filePath")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def file_sizes(chunks: DataFrame) -> DataFrame:
    """project, filePath, chunks, symbols (distinct)."""
    rows = current(chunks, "project", "filePath", "symbolName").where("filePath is not null")
    return rows.groupBy("project", "filePath").agg(F.count("*").alias("chunks"), F.countDistinct(F.when(F.col("symbolName") != "", F.col("symbolName"))).alias("symbols"))


def coupling(files: DataFrame, edges: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """project, filePath, fanIn, fanOut, instability, externalImports of every file; edges: project, filePath, path.

    Fans count distinct other files; files that only edges name count too. instability is fanOut of both, null without any."""
    pairs = edges.where("path is not null and filePath <> path").select("project", "filePath", "path").distinct()
    out = pairs.groupBy("project", "filePath").agg(F.count("*").alias("o")).withColumn("i", F.lit(0).cast("long"))
    into = pairs.groupBy("project", F.col("path").alias("filePath")).agg(F.count("*").alias("i")).select("project", "filePath", F.lit(0).cast("long").alias("o"), "i")
    own = files.select("project", "filePath").distinct().select("project", "filePath", F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("i"))
    rows = own.unionByName(out).unionByName(into).groupBy("project", "filePath").agg(F.sum("i").alias("fanIn"), F.sum("o").alias("fanOut"))
    both = F.col("fanIn") + F.col("fanOut")
    rows = rows.withColumn("instability", F.when(both > 0, round_up(F.col("fanOut") / both, 3)))
    if external is None:
        return rows.withColumn("externalImports", F.lit(0).cast("long"))
    return rows.join(external.select("project", "filePath", "externalImports"), ["project", "filePath"], "left").withColumn("externalImports", F.coalesce("externalImports", F.lit(0)).cast("long"))


def coupling_bands(rows: DataFrame, limit: int = 50, magnet: int = 2) -> DataFrame:
    """project, band, rank, filePath, fanIn, fanOut, instability, total, truncated of the bands topFanIn, changeMagnets and
    unstableLeaves; a file may stand in several."""
    both = F.col("fanIn") + F.col("fanOut")
    bands = [
        ("topFanIn", F.col("fanIn") > 0, [F.col("fanIn").desc()]),
        ("changeMagnets", (F.col("fanIn") >= magnet) & (F.col("fanOut") >= magnet), [both.desc(), F.col("fanIn").desc()]),
        ("unstableLeaves", (F.col("fanIn") == 0) & (F.col("fanOut") > 0), [F.col("fanOut").desc()]),
    ]
    out = None
    for name, member, order in bands:
        w = Window.partitionBy("project")
        part = rows.where(member).withColumn("rank", F.row_number().over(w.orderBy(*order, "filePath"))).withColumn("total", F.count("*").over(w))
        part = part.where(F.col("rank") <= limit).select("project", F.lit(name).alias("band"), "rank", "filePath", "fanIn", "fanOut", "instability", "total", (F.col("total") > limit).alias("truncated"))
        out = part if out is None else out.unionByName(part)
    return out


#: Fixed values of the hotspot score.
CHURN_FULL, SIZE_FULL, DEAD_POINTS, DEAD_FULL, COUPLING_POINTS, COUPLING_FULL, DEMOTED, WARM, CRITICAL = 20, 40, 15, 0.5, 15, 8, 20, 25, 50


def hotspots(sizes: DataFrame, churn: DataFrame, dead: DataFrame, fans: DataFrame, limit: int | None = 20) -> DataFrame:
    """project, band, rank, filePath, score, churn, chunks, symbols, deadSymbols, deadDensity, fanIn, fanOut, total, truncated.

    sizes: project, filePath, chunks, symbols; churn: project, filePath, churn; dead: project, filePath, dead, candidates; fans:
    project, filePath, fanIn, fanOut. Change times size, with points for dead symbols and coupling; test files and entry points
    reach DEMOTED at most and stand under review. Files that score nothing and have nothing dead are not listed."""
    key = ["project", "filePath"]
    rows = sizes.join(churn.select(*key, "churn"), key, "left").join(dead.select(*key, "dead", "candidates"), key, "left").join(fans.select(*key, "fanIn", "fanOut"), key, "left")
    rows = rows.fillna(0, ["churn", "dead", "candidates", "fanIn", "fanOut"])
    base = 100 * F.log1p("churn") / F.log1p(F.lit(CHURN_FULL)) * F.log1p(F.col("chunks") + F.col("symbols")) / F.log1p(F.lit(SIZE_FULL))
    density = F.when(F.col("candidates") > 0, F.col("dead") / F.col("candidates")).otherwise(0.0)
    debt = F.when(F.col("dead") > 0, DEAD_POINTS * F.least(F.lit(1.0), density / DEAD_FULL)).otherwise(0.0)
    both = F.col("fanIn") + F.col("fanOut")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + debt + COUPLING_POINTS * F.least(F.lit(1.0), both / COUPLING_FULL)))
    demoted = is_test_file("filePath") | is_entry_point("filePath")
    rows = rows.withColumn("score", round_up(F.when(demoted, F.least(score, F.lit(float(DEMOTED)))).otherwise(score), 1)).where("score <> 0 or dead > 0")
    band = F.when(demoted | (F.col("score") < WARM), "review").when(F.col("score") >= CRITICAL, "critical").otherwise("warm")
    w = Window.partitionBy("project", "band")
    rows = rows.withColumn("band", band).withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("churn").desc(), "filePath"))).withColumn("total", F.count("*").over(w))
    rows = rows.withColumn("deadDensity", F.when(density > 0, round_up(density * 1000, 1) / 1000))
    out = rows.select("project", "band", "rank", "filePath", "score", "churn", "chunks", "symbols", F.col("dead").alias("deadSymbols"), "deadDensity", "fanIn", "fanOut", "total", (F.col("total") > (limit or 2**31)).alias("truncated"))
    return out.where(F.col("rank") <= limit) if limit else out


KIND_RANK = ("removed", "visibility-narrowed", "signature-changed", "added", "unchanged")


def api_diff(base: DataFrame, head: DataFrame, differs: Column, limit: int | None = 200, include_unchanged: bool = False) -> DataFrame:
    """kind, breaking, path, symbolType, symbolName, base_line, head_line, base_signature, head_signature, rank.

    base and head: path, symbolType, symbolName, language, startLine, signature, exported; differs is a column over
    base_signature, head_signature and language that says whether parameters changed. One full outer join on path, type and
    name; a rename is one removed and one added symbol. Breaking kinds come first, then path and name."""
    key = ["path", "symbolType", "symbolName"]
    side = lambda df, p: df.groupBy(*key).agg(F.max_by(F.struct("startLine", "signature", "exported", "language"), "startLine").alias(p))
    rows = side(base, "b").join(side(head, "h"), key, "full")
    rows = rows.select(*key, F.col("b").isNotNull().alias("in_base"), F.col("h").isNotNull().alias("in_head"), F.coalesce("b.language", "h.language").alias("language"), F.col("b.startLine").alias("base_line"), F.col("h.startLine").alias("head_line"), F.col("b.signature").alias("base_signature"), F.col("h.signature").alias("head_signature"), F.col("b.exported").alias("was"), F.col("h.exported").alias("is"))
    changed = ~F.col("base_signature").eqNullSafe(F.col("head_signature")) & F.coalesce(differs, F.lit(False))
    kind = F.when(~F.col("in_head"), "removed").when(~F.col("in_base"), "added").when(F.col("was") & ~F.col("is"), "visibility-narrowed").when(changed, "signature-changed").otherwise("unchanged")
    rows = rows.withColumn("kind", kind).withColumn("breaking", F.col("kind").isin(*KIND_RANK[:3]))
    if not include_unchanged:
        rows = rows.where("kind <> 'unchanged'")
    order = F.array_position(F.array(*(F.lit(k) for k in KIND_RANK)), F.col("kind"))
    order = (order, "path", "symbolName", "symbolType")
    if limit:  # the window sees no more than limit rows
        rows = rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("int"))
    return rows.select("kind", "breaking", *key, "base_line", "head_line", "base_signature", "head_signature", "rank")


def diff_counts(diff: DataFrame) -> DataFrame:
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k.replace("-", "_"))
    return diff.agg(*(count(k) for k in KIND_RANK), F.count(F.when(F.col("breaking"), 1)).alias("breaking"))


def query_log_summary(log: DataFrame, *by: str) -> DataFrame:
    """total, distinct queries, average and longest latency, repeat rate ((total - distinct) / total), of each group or of all."""
    total, distinct = F.count("*"), F.countDistinct("query")
    aggs = [total.alias("total"), distinct.alias("distinct_queries"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.max("latency_ms").alias("max_latency"), F.when(total > 0, round_up((total - distinct) / total, 3)).alias("repeat_rate")]
    return log.groupBy(*by).agg(*aggs) if by else log.agg(*aggs)


def top_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    """query, n, avg_results, rank: the commonest, ties by query."""
    rows = log.groupBy("query").agg(F.count("*").alias("n"), round_up(F.avg("result_count"), 2).alias("avg_results"))
    return rows.orderBy(F.col("n").desc(), "query").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "query")))


def zero_hit_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.where("result_count = 0").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query").limit(limit)


def worst(status: Column) -> Column:
    """fail before warn before ok, as an aggregate."""
    rank = F.max(F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0))
    return F.when(rank == 2, "fail").when(rank == 1, "warn").otherwise("ok")


def index_health(indexes: DataFrame, chunks: DataFrame, served: list[str] | None = None, ann_rows: int = 50_000, docs: bool = True, has_ann: bool = False, has_text_index: bool = True) -> DataFrame:
    """project, status, finding of every registered project; a project without a finding has one that says ok.

    Rules: error status, no table, model not served: fail; no doc columns, no text index over rows, many rows without a vector
    index, other counts than registered (unless it is being indexed), no files but rows: warn."""
    rows = chunks.where("rec_id is not null").groupBy("project").agg(F.countDistinct("rec_id").alias("rows"), F.countDistinct("filePath").alias("files"))
    joined = indexes.select(F.col("name").alias("project"), F.col("status").alias("state"), "file_count", "chunk_count", "embed_model").dropDuplicates(["project"]).join(rows, "project", "left")
    has_docs = "doc" in chunks.columns and "doc_vector" in chunks.columns
    there, busy = F.col("rows").isNotNull(), F.coalesce(F.col("state") == "indexing", F.lit(False))
    rules = [
        (F.col("state") == "error", "fail", "index is in error"),
        (~there, "fail", "table missing"),
        (F.col("embed_model").isNotNull() & ~F.col("embed_model").isin(*(served or [""])) if served is not None else F.lit(False), "fail", "model not served"),
        (there & F.lit(docs and not has_docs), "warn", "no documentation columns"),
        (there & F.lit(not has_text_index), "warn", "no text index"),
        (there & (F.col("rows") >= ann_rows) & F.lit(not has_ann), "warn", "no vector index"),
        (there & ~busy & (F.col("rows") != F.col("chunk_count")), "warn", "row count differs from the registry"),
        (there & ~busy & (F.col("file_count") == 0), "warn", "no files but rows"),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("status"), F.lit(t).alias("finding"))) for c, s, t in rules)), lambda x: x.isNotNull())
    found = F.when(F.size(found) == 0, F.array(F.struct(F.lit("ok").alias("status"), F.lit("healthy").alias("finding")))).otherwise(found)
    return joined.select("project", F.inline(found))


def orphan_tables(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables (table_name) that no registered project has."""
    return tables.select("table_name").distinct().join(indexes.select("table_name").distinct(), "table_name", "left_anti")


def project_of(paths: DataFrame, indexes: DataFrame) -> DataFrame:
    """filePath, project: the project with the longest root above each path; null where there is none. Joined on every folder of
    the path, so that no pair is formed that does not match."""
    parts = F.split("filePath", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = paths.select("filePath").distinct().select("filePath", F.explode(above).alias("root"))
    roots = indexes.where("path is not null").select(F.regexp_replace("path", "/+$", "").alias("root"), F.col("name").alias("project"))
    best = spread.join(roots, "root").groupBy("filePath").agg(F.max(F.struct(F.length("root"), "project")).alias("b")).select("filePath", "b.project")
    return paths.select("filePath").distinct().join(best, "filePath", "left")
