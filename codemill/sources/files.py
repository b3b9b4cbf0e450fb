"""Source trees and their documents: listing, ignoring, reasons for what is left out, references to documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codemill.functions.predicates import dirname, glob_to_regex, relative_path
from codemill.operators.imports import LANGUAGE_OF

#: Fixed values.
ALWAYS_IGNORED = (".git/", "node_modules/", ".venv/", "__pycache__/", "dist/", "build/", "target/", ".DS_Store")
DOC_DEPTH, DOC_FILES, DOC_WALKED = 6, 200, 10_000


def ignore_rules(*texts: str | None, always: tuple[str, ...] = ALWAYS_IGNORED) -> list[tuple[str, bool]]:
    """(pattern over the relative path, kept) of ignore files, in order of precedence; later rules win."""
    out = []
    for line in [*always, *(x for t in texts for x in (t or "").splitlines())]:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        kept = line.startswith("!")
        line = line[1:] if kept else line.lstrip("\\") if line.startswith(("\\#", "\\!")) else line
        folder, body = line.endswith("/"), line.rstrip("/")
        anchored = "/" in body
        body = re.sub(r"^/", "", body)
        pattern = glob_to_regex(body)[1:-1]
        pattern = ("^" if anchored else "^(?:.*/)?") + pattern + ("/" if folder else "(?:/|$)")
        out.append((pattern, kept))
    return out


def is_ignored(relative: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for pattern, kept in rules:
        out = F.when(relative.rlike(pattern), F.lit(not kept)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """With its dot, as written; '' without one."""
    return F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    """The grammar of a path's ending, '' for none."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.substring(extension(path), F.lit(2), F.lit(20))), F.lit(""))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime_ms, size of every regular file under folder, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"\+", "%2B"))
    return rows.select(path.alias("path"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.col("length").alias("size"))


def scanned(files: DataFrame, root: str, rules: list[tuple[str, bool]], extensions: tuple[str, ...], languages: tuple[str, ...] = (), max_bytes: int = 0, tracked: DataFrame | None = None) -> DataFrame:
    """files (path, size, ...) with reason: null for what is taken, else the first of ignored, extension, language, untracked,
    oversize that holds. Languages restrict only where given; a size of exactly max_bytes is taken, 0 means no bound, an
    unknown size is taken."""
    rows = files
    untracked = F.lit(False)
    if tracked is not None:
        rows = rows.join(tracked.select("path", F.lit(True).alias("_tracked")).distinct(), "path", "left")
        untracked = F.col("_tracked").isNull()
    relative = relative_path("path", F.lit(root))
    reason = (
        F.when(is_ignored(relative, rules), "ignored")
        .when(~extension(F.col("path")).isin(*extensions), "extension")
        .when(~language_of(F.col("path")).isin(*languages) if languages else F.lit(False), "language")
        .when(untracked, "untracked")
        .when((F.col("size") > max_bytes) if max_bytes else F.lit(False), "oversize")
    )
    return rows.withColumn("reason", reason).drop("_tracked")


def scan_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("files"))


def texts(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """path, text of the files of paths under folder; invalid bytes become replacement characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"\+", "%2B"))
    return rows.select(path.alias("path"), F.decode(F.to_binary(F.hex("content"), F.lit("hex")), "UTF-8").alias("text")).join(paths.select("path").distinct(), "path", "left_semi")


def documents(files: DataFrame, root: str, globs: tuple[str, ...] = ("*.md", "docs/**/*.md")) -> DataFrame:
    """path, relative, n of the documents of a project: what the globs match down to DOC_DEPTH folders, the first DOC_FILES."""
    rows = files.select("path", relative_path("path", F.lit(root)).alias("relative")).where(F.size(F.split("relative", "/")) <= DOC_DEPTH + 1)
    rows = rows.orderBy("relative").limit(DOC_WALKED).where(F.col("relative").rlike("|".join(glob_to_regex(g) for g in globs)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("relative"))).where(F.col("n") <= DOC_FILES)


def resolved_references(refs: DataFrame, docs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """ref, status, path of documents that are asked for: outsideRoot, matched (a document), filtered (a file, but none of the
    documents) or missing. refs: ref, a path relative to root or absolute."""
    bad = F.col("ref").rlike(r"(^|/)\.\.(/|$)") | (F.startswith("ref", F.lit("/")) & ~F.startswith("ref", F.lit(root.rstrip("/") + "/")))
    wanted = refs.select("ref", bad.alias("bad"), F.when(F.startswith("ref", F.lit("/")), F.col("ref")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("ref", r"^\./", ""))).alias("path"))
    rows = wanted.join(docs.select("path", F.lit(True).alias("d")), "path", "left").join(files.select("path", F.lit(True).alias("f")), "path", "left")
    status = F.when(F.col("bad"), "outsideRoot").when(F.col("d"), "matched").when(F.col("f"), "filtered").otherwise("missing")
    return rows.select("ref", status.alias("status"), F.when(~F.col("bad") & F.col("f"), F.col("path")).alias("path"))


def manifests(rows: DataFrame) -> DataFrame:
    """path, dependencies, devDependencies, scripts (maps) of package manifests (path, text); malformed ones have empty maps."""
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>>"
    parsed = F.from_json("text", kind, {"mode": "PERMISSIVE"})
    empty = F.create_map().cast("map<string,string>")
    return rows.select("path", *(F.coalesce(parsed[c], empty).alias(c) for c in ("dependencies", "devDependencies", "scripts")))


def root_names(files: DataFrame, root: str) -> DataFrame:
    """Names of the files and folders right under root."""
    relative = relative_path("path", F.lit(root))
    return files.where(dirname("path") != "").select(F.split(relative, "/")[0].alias("name")).distinct()
