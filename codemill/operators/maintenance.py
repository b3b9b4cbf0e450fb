"""Keeping an index: counters, new vectors under the same name, snapshots of document checks, sizes, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemill.sources import registry
from codemill.sources.chunk_table import ChunkTable
from codemill.sources.registry import Store


def reconciled(indexes: DataFrame, chunks: DataFrame) -> DataFrame:
    """indexes with the counts that the chunks really have; a project without chunks has zeros."""
    real = chunks.groupBy(F.col("project").alias("name")).agg(F.countDistinct("filePath").cast("int").alias("_files"), F.countDistinct("rec_id").cast("int").alias("_chunks"))
    rows = indexes.join(real, "name", "left")
    return rows.withColumn("file_count", F.coalesce("_files", F.lit(0))).withColumn("chunk_count", F.coalesce("_chunks", F.lit(0))).select(*indexes.columns)


def migrated(store: Store, project: str, model: str, dim: int, embed: Callable[[Column], Column], cancelled: Callable[[], bool] = lambda: False) -> str:
    """Gives all chunks of a project vectors of another model: noop if it has that model already, cancelled, or swapped.

    The new vectors are written beside the old ones; tables and the project's model then change together, so that readers never
    see vectors of two models, and a writer that dies leaves the old index and a folder that Store.orphans names."""
    indexes, table = store.read("indexes"), ChunkTable(store)
    row = indexes.where(F.col("name") == project).select("embed_model", "embed_dim").first()
    if row is None:
        raise ValueError(f"no project {project}")
    if (row["embed_model"], row["embed_dim"]) == (model, dim):
        return "noop"
    frames = {}
    for name in [n for n in store.tables() if n.startswith("chunks_")]:
        old = store.read(name)
        mine = F.col("project") == project
        if old.where(mine).isEmpty():
            continue
        if cancelled():
            return "cancelled"
        new = old.withColumn("vector", F.when(mine, embed(F.col("content"))).otherwise(F.col("vector"))).withColumn("doc_vector", F.when(mine, F.when(F.col("doc").isNotNull(), embed(F.col("doc")))).otherwise(F.col("doc_vector")))
        frames[name] = new
    mine = F.col("name") == project
    frames["indexes"] = indexes.withColumn("embed_model", F.when(mine, model).otherwise(F.col("embed_model"))).withColumn("embed_dim", F.when(mine, dim).otherwise(F.col("embed_dim")))
    store.write(**frames)
    return "swapped" if table.read() is not None else "noop"


def snapshot(reports: DataFrame, findings: DataFrame, project: str) -> DataFrame:
    """reports (project, ts, consistent, findings, needs_review) with the project's row replaced by what a check just found."""
    n = findings.where(F.col("project") == project).agg(F.count(F.when(F.col("band") == "drift", 1)).cast("int").alias("findings"), F.count(F.when(F.col("band") != "drift", 1)).cast("int").alias("needs_review"))
    row = n.select(F.lit(project).alias("project"), F.current_timestamp().alias("ts"), (F.col("findings") == 0).alias("consistent"), "findings", "needs_review")
    return registry.upserted(reports, row, ["project"])


def disk_usage(files: DataFrame, root: str) -> DataFrame:
    """entry, bytes, files of every entry right under root; files: path, size."""
    inside = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    return files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).groupBy(F.split(inside, "/")[0].alias("entry")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def statistics(indexes: DataFrame, chunks: DataFrame, cache: DataFrame, log: DataFrame) -> DataFrame:
    """name, status, files, chunks, vectors, queries of every project; cache: index_name, file_path; log: project, query."""
    rows = chunks.groupBy(F.col("project").alias("name")).agg(F.countDistinct("rec_id").alias("chunks"), F.countDistinct(F.when(F.col("vector").isNotNull(), F.col("rec_id"))).alias("vectors"))
    held = cache.groupBy(F.col("index_name").alias("name")).agg(F.countDistinct("file_path").alias("files"))
    asked = log.where("project is not null").groupBy(F.col("project").alias("name")).agg(F.count("*").alias("queries"))
    out = indexes.select("name", "status").dropDuplicates(["name"]).join(rows, "name", "left").join(held, "name", "left").join(asked, "name", "left")
    return out.fillna(0, ["chunks", "vectors", "files", "queries"]).select("name", "status", "files", "chunks", "vectors", "queries")
