"""The table of chunks: replacing files, deleting, compacting, statistics, indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemill.operators import ranking
from codemill.settings import ANN_ROWS
from codemill.sources.registry import Store

SCHEMA = (
    "id string, project string, filePath string, content string, vector array<float>, language string, symbolName string, symbolType string, "
    "startLine int, endLine int, doc string, doc_vector array<float>, id_terms string"
)
METADATA = ("filePath", "symbolName", "symbolType", "language", "startLine", "endLine")
CONTENT = ("filePath", "content", "symbolName", "symbolType", "language", "startLine", "endLine")
BUCKETS = 64


def metadata_scan(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    return chunks.select(*METADATA).limit(limit) if limit else chunks.select(*METADATA)


def content_scan(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Without vectors. With a limit, truncated says whether rows were left out: one more row than asked for is looked for."""
    rows = chunks.select(*CONTENT)
    if not limit:
        return rows.withColumn("truncated", F.lit(False))
    more = rows.limit(limit + 1).count() > limit
    return rows.limit(limit).withColumn("truncated", F.lit(more))


def by_file(chunks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over the chunks of each whole file, by line: no file is ever split."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return function(part.sort_values(["startLine", "rec_id"], kind="stable"))

    return chunks.groupBy("filePath").applyInPandas(run, schema)


def replaced(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """old without the rows of the files that new has or that files (project, filePath) names, and new. A file named without new
    rows is thereby deleted. Columns that the table has not are left out of new; those that new has not are null."""
    gone = new.select("project", "filePath").distinct()
    if files is not None:
        gone = gone.union(files.select("project", "filePath")).distinct()
    return old.join(gone, ["project", "filePath"], "left_anti").unionByName(known_columns(new, old), allowMissingColumns=True)


def known_columns(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select(*[c for c in new.columns if c in old.columns])


def deleted(old: DataFrame, files: DataFrame) -> DataFrame:
    return old.join(files.select("project", "filePath").distinct(), ["project", "filePath"], "left_anti")


class ChunkTable:
    """Chunks of all projects in a store, in buckets by file, so that a change rewrites only the buckets that it touches."""

    def __init__(self, store: Store, buckets: int = BUCKETS) -> None:
        self.store, self.buckets = store, buckets

    def _name(self, bucket: int) -> str:
        return f"chunks_{bucket:04d}"

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_b", F.pmod(F.xxhash64("project", "filePath"), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame | None:
        paths = [p for n, p in sorted(self.store.tables().items()) if n.startswith("chunks_")]
        return self.store.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def replace(self, new: DataFrame, files: DataFrame | None = None) -> None:
        """As replaced(); all touched buckets change at once. The touched bucket numbers, at most buckets, come to the driver."""
        rows = self._bucket(new).persist()
        gone = self._bucket(files.select("project", "filePath")) if files is not None else None
        touched = {r[0] for r in rows.select("_b").distinct().collect()} | ({r[0] for r in gone.select("_b").distinct().collect()} if gone is not None else set())
        have, frames = self.store.tables(), {}
        for b in sorted(touched):
            part = rows.where(F.col("_b") == b).drop("_b")
            if self._name(b) in have:
                part = replaced(self.store.read(self._name(b)), part, gone.where(F.col("_b") == b).drop("_b") if gone is not None else None)
            frames[self._name(b)] = part
        self.store.write(**frames)
        rows.unpersist()

    def delete(self, files: DataFrame) -> None:
        self.replace(self.store.spark.createDataFrame([], SCHEMA), files)

    def compact(self, rows_per_file: int = 1_000_000) -> dict[str, int]:
        """Rewrites buckets of several files into as few as their rows need; says how many files there were and are."""
        before = self.stats()["files"]
        frames = {}
        for name in self.store.tables():
            df = self.store.read(name)
            if name.startswith("chunks_") and len(df.inputFiles()) > 1:
                frames[name] = df.coalesce(max(1, -(-df.count() // rows_per_file)))
        if frames:
            self.store.write(**frames)
        return {"before": before, "after": self.stats()["files"]}

    def stats(self) -> dict[str, int]:
        """Rows, files, small files (under 1 MB) and bytes of the table."""
        df = self.read()
        if df is None:
            return {"rows": 0, "files": 0, "small_files": 0, "bytes": 0}
        sizes = []
        for path in df.inputFiles():
            fs, p = self.store._fs(path)
            sizes.append(fs.getFileStatus(p).getLen())
        return {"rows": df.count(), "files": len(sizes), "small_files": sum(s < 1 << 20 for s in sizes), "bytes": sum(sizes)}


def text_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of the legs content, doc, id_terms (words) and symbol (trigrams): leg, scope, id, term, tf, dl and leg,
    scope, n, avgdl. Columns that the table lacks have no leg."""
    out: list[DataFrame] = []
    stats: list[DataFrame] = []
    for leg, column, terms in (("content", "content", ranking.words), ("doc", "doc", ranking.words), ("id_terms", "id_terms", ranking.words), ("symbol", "symbolName", ranking.trigrams)):
        if column in chunks.columns:
            docs = chunks.where(F.col(column).isNotNull()).select(F.col("project").alias("scope"), F.col("rec_id").alias("id"), F.col(column).alias("text"))
            out.append(ranking.postings(docs, terms("text")).select(F.lit(leg).alias("leg"), "scope", "id", "term", "tf", "dl"))
            stats.append(ranking.corpus_stats(docs, terms("text")).select(F.lit(leg).alias("leg"), "scope", "n", "avgdl"))
    postings, sizes = out[0], stats[0]
    for p, s in zip(out[1:], stats[1:]):
        postings, sizes = postings.unionByName(p), sizes.unionByName(s)
    return postings, sizes


def vector_index(chunks: DataFrame, column: str = "vector", planes: int = 12, dim: int = 64, seed: int = 7, rows: int = ANN_ROWS) -> DataFrame | None:
    """rec_id, cell of every usable vector: the signs of its products with fixed random planes. None below rows rows or without
    the column: then an exact scan is cheaper."""
    if column not in chunks.columns:
        return None
    usable = chunks.where(F.size(column) == dim)
    if usable.limit(rows).count() < rows:
        return None
    import numpy as np
    import pyarrow as pa

    normal = np.random.default_rng(seed).normal(size=(planes, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).flatten(), np.float64).reshape(-1, dim)
            cell = ((v @ normal.T) > 0) @ (1 << np.arange(planes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int64))], names=["rec_id", "cell"])

    return usable.select("rec_id", F.col(column)).mapInArrow(run, "rec_id long, cell long")
