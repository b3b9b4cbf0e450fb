"""The engine's tools, one method each, over the tables of a session. Results are tables; errors name what there is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codemill.functions.predicates import is_candidate, relative_path, row_filter, symbol_matches
from codemill.functions.signatures import parameters_differ, signature
from codemill.functions.identifiers import is_exported
from codemill.operators import chunking, code_graph, conformance, imports, ranking, reports, search
from codemill.settings import ANCHOR_CANDIDATES, Settings
from codemill.sources import files as trees
from codemill.sources import history, registry
from codemill.sources.chunk_table import ChunkTable
from codemill.sources.registry import Store

REGISTRY = "name string, path string, table_name string, status string, file_count int, chunk_count int, embed_model string, embed_dim int, framing string, note string, last_indexed_at timestamp, created_at timestamp, error string"
LOG = "ts timestamp, project string, query string, mode string, result_count int, latency_ms int"


@dataclass
class Engine:
    """chunks and indexes are tables as in the registry; with a store they are read from it, and index_project writes them.

    embed makes a vector of a text; judge, in search, a probability from columns query and content."""

    spark: SparkSession
    store: Store | None = None
    given_chunks: DataFrame | None = None
    given_indexes: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    embed: Callable[[Column], Column] | None = ranking.hash_embedding

    # tables

    @property
    def chunks(self) -> DataFrame:
        if self.given_chunks is not None:
            return self.given_chunks
        found = ChunkTable(self.store).read() if self.store else None
        if found is None:
            raise ValueError("there is no index yet; index_project makes one")
        return found

    @property
    def indexes(self) -> DataFrame:
        if self.given_indexes is not None:
            return self.given_indexes
        if self.store and "indexes" in self.store.tables():
            return self.store.read("indexes")
        return self.spark.createDataFrame([], REGISTRY)

    @property
    def roots(self) -> DataFrame:
        return self.indexes.select(F.col("name").alias("project"), "path")

    def _scope(self, project: str | None = None, path: str | None = None) -> str | None:
        """The project that is named or that holds the path; None for all. An error names the projects that there are."""
        if path and not project:
            row = reports.project_of(self.spark.createDataFrame([(path,)], "filePath string"), self.indexes).first()
            project = row["project"] if row else None
            if project is None:
                raise ValueError(f"no project holds {path}; projects: {self._names()}")
        elif project and self.indexes.where(F.col("name") == project).isEmpty():
            raise ValueError(f"no project {project}; projects: {self._names()}")
        return project

    def _names(self) -> str:
        return ", ".join(r[0] for r in self.indexes.select("name").distinct().orderBy("name").limit(100).collect()) or "none"

    def _of(self, project: str | None) -> DataFrame:
        return self.chunks.where(F.col("project") == project) if project else self.chunks

    # search

    def search_codebase_batch(self, queries: list[str] | DataFrame, project: str | None = None, limit: int = 5, mode: str = "hybrid", language: str | None = None, symbol_type: str | None = None, path_glob: str | None = None, max_chars: int | None = None, mmr: bool = False, boost: bool = True, doc: bool = True, judge: Column | None = None, expand: Callable[[str], list[str]] | None = None) -> DataFrame:
        """text and the columns of search.search for each distinct, non-blank query. With expand each query's variants are
        searched too and fused with it; a variant counts half."""
        scope = self._scope(project)
        rows = queries if isinstance(queries, DataFrame) else self.spark.createDataFrame([(q,) for q in queries], "query string")
        if "project" not in rows.columns:
            rows = rows.withColumn("project", F.lit(scope).cast("string"))
        asked = search.distinct_queries(rows)
        options = dict(mode=mode, embed=self.embed, where=row_filter(language, symbol_type, path_glob), boost=replace(self.settings.boost, enabled=boost), doc=doc, roots=self.roots, mmr=mmr, judge=judge)
        chunks = self._of(scope)
        hits = search.search(asked, chunks, limit, max_chars=max_chars, **options)
        if expand is not None:
            texts = {r["query_id"]: r for r in asked.collect()}
            more = [(i, n, v) for i, r in texts.items() for n, v in enumerate(expand(r["text"]))]
            if more:
                v = self.spark.createDataFrame(more, "base long, variant int, text string").withColumn("scope", F.lit(scope).cast("string"))
                v = v.withColumn("query_id", F.xxhash64("base", "variant"))
                found = search.search(v, chunks, search.variant_fetch(limit), **options).join(v.select("query_id", "base", "variant"), "query_id")
                merged = search.merged_variants(hits.withColumnRenamed("rec_id", "id"), found.select(F.col("base").alias("query_id"), "variant", "rank", F.col("rec_id").alias("id")), limit)
                info = search.current(chunks, "filePath", "symbolName", "startLine", "endLine", "project")
                hits = merged.withColumnRenamed("id", "rec_id").join(info, "rec_id").select("query_id", "rank", "rec_id", "score", "filePath", "symbolName", "startLine", "endLine", "project")
        return hits.join(asked.select("query_id", "text"), "query_id")

    def search_codebase(self, query: str, project: str | None = None, context_lines: int = 0, blame: DataFrame | None = None, **options) -> DataFrame:
        hits = self.search_codebase_batch([query], project, **options)
        content = search.current(self.chunks, "content", "language").select("rec_id", signature("content", "language").alias("signature"))
        hits = hits.join(content, "rec_id", "left")
        if context_lines:
            hits = with_context(hits, code_graph.chunk_lines(self.chunks), context_lines)
        return history.with_blame(hits, blame) if blame is not None else hits

    def find_symbol(self, name: str, project: str | None = None, limit: int = 20, fuzzy: bool = True) -> DataFrame:
        asked = self.spark.createDataFrame([(1, self._scope(project), name)], "query_id long, scope string, text string")
        return search.find_symbol(asked, self.chunks, limit, fuzzy)

    def get_context_pack(self, query: str, project: str | None = None, limit: int = 5, max_chars: int = 6000, **options) -> DataFrame:
        hits = self.search_codebase_batch([query], project, limit, **options)
        return search.context_pack(hits, self.chunks, imports.import_graph(self._of(project), self.roots), limit, max_chars)

    # symbols and files

    def find_references(self, name: str, project: str | None = None, limit: int = 50, include_docs: bool = True) -> DataFrame:
        asked = self.spark.createDataFrame([(1, self._scope(project), name)], "query_id long, scope string, name string")
        return code_graph.reference_scan(asked, self.chunks, limit, include_docs)

    def get_file_outline(self, path: str) -> DataFrame:
        rows = search.outlines(self.chunks.where(F.col("filePath") == path))
        if rows.isEmpty():
            raise ValueError(f"no chunks of {path}; projects: {self._names()}")
        return rows.orderBy("startLine", "symbolName")

    def get_dependencies(self, path: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        graph = imports.import_graph(self._of(self._scope(path=path)), self.roots)
        return imports.dependencies(graph, self.spark.createDataFrame([(path,)], "filePath string"), limit)

    def get_call_graph(self, symbol: str, project: str | None = None, path: str | None = None, direction: str = "both", depth: int = 3, limit: int = 100) -> dict[str, tuple[DataFrame, DataFrame]]:
        """For callers, callees or both: (tree, totals) as of code_graph.call_paths."""
        if direction not in ("callers", "callees", "both"):
            raise ValueError(f"direction {direction!r} is not callers, callees or both")
        scope = self._scope(project, path)
        chunks = self._of(scope)
        edges = code_graph.call_edges(chunks)
        node = lambda n, f: F.struct(F.col(n).alias("name"), F.col(f).alias("file"))
        roots = code_graph.inventory(chunks).where(symbol_matches("symbolName", F.lit(symbol)))
        if path:
            roots = roots.where(F.col("filePath") == path)
        if roots.isEmpty():
            raise ValueError(f"no symbol {symbol} in {scope or 'any project'}")
        start = roots.select(F.lit(symbol).alias("anchor"), node("symbolName", "filePath").alias("node"))
        down = edges.select(node("caller", "caller_file").alias("src"), node("callee", "callee_file").alias("dst"))
        sides = {"callees": down, "callers": down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
        return {k: code_graph.call_paths(start, e, depth, limit) for k, e in sides.items() if direction in (k, "both")}

    # reports

    def get_repo_overview(self, project: str) -> dict[str, DataFrame]:
        chunks = self._of(self._scope(project))
        return {"languages": reports.language_histogram(chunks).orderBy(F.col("files").desc(), "language"), "symbols": reports.symbol_histogram(chunks), "folders": reports.folder_histogram(chunks, self.roots), "largest": reports.largest_files(chunks), "entry_points": reports.entry_points(chunks)}

    def find_dead_code(self, project: str, min_confidence: int = 0, limit: int = 200, language: str | None = None, symbol_type: str | None = None, scan_all: bool = False) -> DataFrame:
        """As code_graph.dead_code. A filter also narrows the texts that count as referring, unless scan_all."""
        chunks = self._of(self._scope(project))
        kept = row_filter(language, symbol_type)
        rows = code_graph.dead_code(chunks if scan_all else chunks.where(kept), min_confidence)
        if scan_all:
            rows = rows.where(kept)
        return rows.orderBy(F.col("confidence").desc(), "filePath", "startLine", "symbolName").limit(limit)

    def get_coupling(self, project: str, limit: int = 50) -> DataFrame:
        chunks = self._of(self._scope(project))
        return reports.coupling_bands(reports.coupling(chunks.where("filePath is not null").select("project", "filePath"), imports.import_graph(chunks, self.roots)), limit)

    def get_hotspots(self, project: str, churn: DataFrame, limit: int = 20) -> DataFrame:
        """churn: filePath, churn, as of history.churn."""
        chunks = self._of(self._scope(project))
        dead = code_graph.dead_density(chunks, code_graph.dead_code(chunks))
        fans = reports.coupling(chunks.where("filePath is not null").select("project", "filePath"), imports.import_graph(chunks, self.roots))
        return reports.hotspots(reports.file_sizes(chunks), churn.withColumn("project", F.lit(project)), dead, fans, limit)

    def get_change_impact(self, symbol: str, project: str, path: str | None = None, depth: int = 3, limit: int = 25) -> dict[str, DataFrame]:
        chunks = self._of(self._scope(project))
        found = code_graph.inventory(chunks).where(F.col("symbolName") == symbol)
        if path:
            found = found.where(F.col("filePath") == path)
        rows = found.select("symbolName", "filePath").orderBy("filePath").limit(ANCHOR_CANDIDATES + 1).collect()
        if len(rows) != 1:
            raise ValueError(f"no symbol {symbol} in {project}" if not rows else f"{symbol} is ambiguous: {', '.join(r['filePath'] for r in rows[:ANCHOR_CANDIDATES])}")
        anchors = self.spark.createDataFrame([(symbol, project, symbol, rows[0]["filePath"])], "anchor string, project string, symbolName string, filePath string")
        return code_graph.change_impact(anchors, chunks, imports.import_graph(chunks, self.roots), depth, limit)

    def get_api_diff(self, base: DataFrame, head: DataFrame, exported_only: bool = False, include_unchanged: bool = False, limit: int = 200) -> DataFrame:
        """base and head: path, text of the files of each side, as of history.tree."""
        b, h = surface(base), surface(head)
        if exported_only:
            b, h = b.where("exported"), h.where("exported")
        return reports.api_diff(b, h, parameters_differ("base_signature", "head_signature", "language"), limit, include_unchanged)

    def search_commits(self, repo: str, limit: int = 50, **options) -> DataFrame:
        return history.search_commits(history.commits(self.spark, repo, limit=str(limit), **{k: v for k, v in options.items() if v}), limit=limit)

    def check_docs(self, docs: DataFrame, project: str | None = None, manifests: DataFrame | None = None, judge: Column | None = None, limit: int = 100, max_chars: int = 12_000, undocumented_limit: int = 25) -> dict[str, DataFrame]:
        chunks = self._of(self._scope(project))
        claims = conformance.spans(docs)
        rows = conformance.demoted(conformance.verdicts(claims, chunks, self.roots, manifests))
        if judge is not None:
            rows = conformance.judged(rows, judge)
        return {"findings": conformance.findings(rows, limit, max_chars), "skipped": conformance.skip_counts(rows), "undocumented": conformance.undocumented(chunks, claims, undocumented_limit)}

    def doctor(self, **options) -> DataFrame:
        rows = reports.index_health(self.indexes, self.chunks, **options)
        return rows.withColumn("overall", reports.worst(F.col("status")).over(Window.partitionBy(F.lit(1))))

    # registry

    def list_indexes(self) -> DataFrame:
        return self.indexes.orderBy(F.col("created_at").desc(), "name")

    def get_index_status(self, project: str) -> DataFrame:
        self._scope(project)
        rows = self.chunks.where(F.col("project") == project).agg(F.countDistinct("rec_id").alias("rows"), F.countDistinct("filePath").alias("files"))
        return self.indexes.where(F.col("name") == project).join(rows, F.lit(True))

    def index_project(self, path: str, name: str, ignore: str | None = None, extensions: tuple[str, ...] | None = None) -> dict[str, int]:
        """Reads a folder as a project, or brings it up to date: new and changed files are chunked again, deleted ones go. Says how
        many files there were of each kind."""
        if self.store is None:
            raise ValueError("an engine without a store cannot index")
        listed = trees.listing(self.spark, path)
        rows = trees.scanned(listed, path, trees.ignore_rules(ignore), extensions or self.settings.allowed_extensions, max_bytes=self.settings.max_file_bytes)
        taken = rows.where("reason is null").select(F.lit(name).alias("index_name"), F.col("path").alias("file_path"), F.col("mtime_ms").cast("double").alias("mtime_ms")).persist()
        held = self.store.tables()
        cache = self.store.read("file_cache") if "file_cache" in held else self.spark.createDataFrame([], "index_name string, file_path string, mtime_ms double")
        plan = registry.sync_plan(taken, cache.where(F.col("index_name") == name)).persist()
        counts = {r["change"]: r["count"] for r in plan.groupBy("change").count().collect()}
        table = ChunkTable(self.store)
        if any(counts.get(k) for k in ("new", "changed", "deleted")):
            fresh = plan.where(F.col("change").isin("new", "changed")).select(F.col("file_path").alias("path"))
            texts = trees.texts(self.spark, fresh, path).withColumn("project", F.lit(name))
            touched = plan.where("change <> 'unchanged'").select(F.lit(name).alias("project"), F.col("file_path").alias("filePath"))
            table.replace(chunking.records(chunking.chunked(texts), self.embed), touched)
        stats = table.read()
        n = stats.where(F.col("project") == name).agg(F.countDistinct("filePath"), F.count("*")).first() if stats is not None else (0, 0)
        row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(None).cast("string").alias("table_name"), F.lit("ready").alias("status"), F.lit(n[0]).cast("int").alias("file_count"), F.lit(n[1]).cast("int").alias("chunk_count"), F.lit(self.settings.embed_model).alias("embed_model"), F.lit(64).alias("embed_dim"), F.lit(None).cast("string").alias("framing"), F.lit(None).cast("string").alias("note"), F.current_timestamp().alias("last_indexed_at"), F.current_timestamp().alias("created_at"), F.lit(None).cast("string").alias("error"))
        self.store.write(file_cache=cache.where(F.col("index_name") != name).unionByName(taken), indexes=self.indexes.where(F.col("name") != name).unionByName(row))
        taken.unpersist()
        plan.unpersist()
        return counts

    sync_project = index_project

    def delete_project(self, name: str) -> None:
        self._scope(name)
        table = ChunkTable(self.store)
        table.delete(self.chunks.where(F.col("project") == name).select("project", "filePath").distinct())
        cache = self.store.read("file_cache")
        self.store.write(file_cache=cache.where(F.col("index_name") != name), indexes=self.indexes.where(F.col("name") != name))


def surface(files: DataFrame) -> DataFrame:
    """path, symbolType, symbolName, language, startLine, endLine, signature, exported of the symbols of files (path, content)."""
    rows = chunking.chunked(files.select(F.lit("").alias("project"), "path", F.col("content").alias("text")))
    rows = code_graph.inventory(rows.withColumn("rec_id", F.xxhash64("filePath", "n"))).where(is_candidate("symbolType"))
    return rows.select(F.col("filePath").alias("path"), "symbolType", "symbolName", "language", "startLine", "endLine", signature("content", "language").alias("signature"), is_exported("symbolName", "language", "content").alias("exported"))


def with_context(hits: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """hits with contextBefore and contextAfter: the n lines above startLine and below endLine that the index has."""
    own = lines.groupBy("filePath", "line").agg(F.min("text").alias("text"))
    places = hits.select("rec_id", "filePath", "startLine", "endLine").distinct()
    wanted = places.select("rec_id", "filePath", "startLine", F.explode(F.concat(F.sequence(F.col("startLine") - n, F.col("startLine") - 1), F.sequence(F.col("endLine") + 1, F.col("endLine") + n))).alias("line"))
    got = wanted.join(own, ["filePath", "line"])
    sorted_ = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("line", "text")))), lambda x: x["text"])
    both = got.groupBy("rec_id").agg(sorted_(F.col("line") < F.col("startLine")).alias("contextBefore"), sorted_(F.col("line") >= F.col("startLine")).alias("contextAfter"))
    return hits.join(both, "rec_id", "left")


def relative_files(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    rows = chunks.where("filePath is not null").select("project", "filePath").distinct().join(roots.select("project", F.col("path").alias("_r")), "project", "left")
    return rows.select("project", "filePath", relative_path("filePath", "_r").alias("relative"))
