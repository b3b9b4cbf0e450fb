"""Import specifiers of source texts and the files that they name."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codemill.operators.search import current

#: What a top-level import looks like in each language; group 1 is the specifier.
PATTERNS = {
    "javascript": [("import", r"^import\s+(?:type\s+)?(?:[^'\";]*?\sfrom\s*)?['\"]([^'\"\n]+)['\"]")],
    "python": [("from", r"^from[ \t]+(\.*[\w.]*)[ \t]+import\b"), ("import", r"^import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)")],
    "rust": [("use", r"^(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+?)(?:::\{|::\*|\s+as\b|;)")],
    "c": [("system", r"^\s*#\s*include\s*<([^>\n]+)>"), ("local", r"^\s*#\s*include\s*\"([^\"\n]+)\"")],
    "java": [("import", r"^import\s+(?:static\s+)?([\w.]+)\s*(?:\.\*)?;")],
    "kotlin": [("import", r"^import\s+([\w.]+)")],
    "go": [("import", r"^import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\""), ("block", r"^import\s*\(([^)]*)\)")],
    "php": [("local", r"^\s*(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)['\"]"), ("external", r"^use\s+([\w\\]+)")],
    "ruby": [("local", r"^\s*require_relative\s*\(?\s*['\"]([^'\"\n]+)['\"]"), ("external", r"^\s*require\s*\(?\s*['\"]([^'\"\n]+)['\"]")],
    "gdscript": [("extends", r"^extends\s+\"(?!uid://)([^\"\n]+)\""), ("load", r"^(?:const|var|onready var|@onready var)[^\n]*?\b(?:pre)?load\(\s*\"(?!uid://)([^\"\n]+)\"")],
    "c_sharp": [("using", r"^using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;")],
    "swift": [("import", r"^(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)")],
    "scala": [("import", r"^import\s+([\w.]+?)(?:\.(?:\{|_|\*)|\s|$)")],
}
PATTERNS["typescript"] = PATTERNS["tsx"] = PATTERNS["javascript"]
PATTERNS["cpp"] = PATTERNS["c"]
_COMPILED = {language: [(kind, re.compile(p, re.M)) for kind, p in rows] for language, rows in PATTERNS.items()}
LANGUAGE_OF = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "kt": "kotlin", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "c_sharp", "php": "php", "rb": "ruby", "swift": "swift", "scala": "scala", "gd": "gdscript"}
_JS_ENDINGS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"]
_JS_INDEX = ["index.js", "index.ts", "index.tsx", "index.mjs", "index.cjs"]


def extract(text: str, language: str) -> list[tuple[str, str, int]]:
    """(specifier, kind, line from 1) of the top-level imports, in order; [] for a language without a pattern."""
    out = []
    for kind, pattern in _COMPILED.get(language, ()):
        for m in pattern.finditer(text):
            line = text.count("\n", 0, m.start()) + 1
            if kind == "block":
                start = m.start(1)
                out += [(q[1], "import", text.count("\n", 0, start + q.start()) + 1) for q in re.finditer(r"\"([^\"\n]+)\"", m[1])]
            elif language == "python" and kind == "import":
                out += [(part.split()[0], kind, line) for part in m[1].split(",") if part.strip()]
            else:
                out.append((m[1], kind, line))
    return sorted(out, key=lambda r: (r[2], r[0]))


def candidates(raw: str, kind: str, language: str, importer: str, root: str) -> tuple[list[tuple[str, str]], str, str]:
    """([(path or suffix, reason)], status, reason): where the specifier can lead, best first, with what holds if nothing is
    there. A suffix begins with "*/" and stands for any path that ends with it."""
    folder = posixpath.dirname(importer)
    join = lambda *parts: posixpath.normpath(posixpath.join(*parts))
    if language in ("javascript", "typescript", "tsx"):
        if not raw.startswith((".", "/")):
            return [], "external", "node_modules"
        base = join(folder, raw)
        return [(p, "exact") for p in [base, *(base + e for e in _JS_ENDINGS), *(join(base, i) for i in _JS_INDEX)]], "unresolved", "no indexed match"
    if language == "python":
        dots = len(raw) - len(raw.lstrip("."))
        module = [s for s in raw[dots:].split(".") if s]
        if not module:
            return [], "unresolved", "no indexed match" if dots else "relative name import"
        base = root
        if dots:
            base = folder
            for _ in range(dots - 1):
                base = posixpath.dirname(base)
        tail = "/".join(module)
        out = [(join(base, tail + ".py"), "exact"), (join(base, tail, "__init__.py"), "exact")]
        out += [("*/" + tail + ".py", "suffix")] if len(module) > 1 else []
        return [*out, ("*/" + tail + "/__init__.py", "suffix")], *(("unresolved", "no indexed match") if dots else ("external", "stdlib / site-packages"))
    if language == "rust":
        parts = [s for s in raw.split("::") if s]
        base = {"crate": root, "super": posixpath.dirname(folder), "self": folder}.get(parts[0] if parts else "")
        if base is None:
            return [], "external", "external crate"
        parts, out = parts[1:], []
        for n in range(len(parts), 0, -1):
            tail = "/".join(parts[:n])
            out += [(join(base, tail + ".rs"), "exact"), (join(base, tail, "mod.rs"), "exact")]
            out += [("*/" + tail + ".rs", "suffix")] if n > 1 else []
            out.append(("*/" + tail + "/mod.rs", "suffix"))
        return out, "unresolved", "no indexed match" if parts else "no path"
    if language in ("c", "cpp"):
        if kind == "system":
            return [], "external", "system header"
        return [(join(folder, raw), "exact"), (join(root, raw), "exact"), *([("*/" + raw, "suffix")] if "/" in raw else [])], "unresolved", "no indexed match"
    if language in ("php", "ruby", "gdscript"):
        name = re.sub(r"^res://", "", raw).replace("\\", "/")
        name += "" if posixpath.splitext(name)[1] else {"php": ".php", "ruby": ".rb", "gdscript": ".gd"}[language]
        bases = [root, folder] if language == "gdscript" else [folder]
        return [*((join(b, name), "exact") for b in bases), *([("*/" + name, "suffix")] if "/" in name else [])], "external" if kind == "external" else "unresolved", "load path / no match" if language != "gdscript" else "no indexed match"
    # names of packages and classes: a file of that base name would be a match, but a suffix of one segment is never looked up
    return [], "external", "namespace / external"


def specs(chunks: DataFrame) -> DataFrame:
    """project, filePath, language, raw, kind, line of the imports of every chunk; line is that of the file. The language of a
    chunk without one is that of the file's ending. Repeated rows count once."""
    rows = current(chunks, "project", "filePath", "language", "content", "startLine").where("content is not null and filePath is not null")
    rows = rows.select("project", "filePath", "language", "content", F.coalesce("startLine", F.lit(1)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for project, path, language, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                known = language if language in _COMPILED else LANGUAGE_OF.get(path.rsplit(".", 1)[-1], "")
                out += [(project, path, known, raw, kind, first + line - 1) for raw, kind, line in extract(text, known)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["project", "filePath", "language", "raw", "kind", "line"])

    return rows.mapInArrow(run, "project string, filePath string, language string, raw string, kind string, line int")


def resolved(specs_: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """project, filePath, language, raw, line, status, reason, path of every import.

    specs_ as of specs; files: project, filePath of the index; roots: project, path. Of all candidates of an import the first
    that the project's index has counts; a suffix leads to the smallest path that ends with it. One join on whole paths, one on
    the last two segments; a project without a root has none of the candidates under it."""
    known = files.select("project", F.col("filePath").alias("path")).distinct()
    rows = specs_.join(roots.select("project", F.col("path").alias("root")).dropDuplicates(["project"]), "project", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["project", "filePath", "language", "raw", "line", "status", "why", "n", "candidate", "how"]
        kinds = (pa.string(),) * 4 + (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            out: list[tuple] = []
            for project, path, language, raw, kind, line, root in zip(*(c.to_pylist() for c in batch.columns)):
                tries, status, why = candidates(raw, kind, language, path, root or "\x00")
                head = (project, path, language, raw, line, status, why)
                out += [(*head, n, c, how) for n, (c, how) in enumerate(tries)] or [(*head, 0, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    tries = rows.select("project", "filePath", "language", "raw", "kind", "line", "root").mapInArrow(
        run, "project string, filePath string, language string, raw string, line int, status string, why string, n int, candidate string, how string"
    )
    key = ["project", "filePath", "language", "raw", "line"]
    exact = tries.where("how = 'exact'").join(known, (F.col("candidate") == F.col("path")) & (tries["project"] == known["project"])).select(*(tries[c] for c in key), "n", "path", "how")
    two = lambda c: F.concat_ws("/", F.slice(F.split(c, "/"), -2, 2))
    ends = known.where(F.size(F.split("path", "/")) >= 2).select(F.col("project").alias("p"), "path", two("path").alias("tail"))
    wanted = tries.where("how = 'suffix'").withColumn("rel", F.substring("candidate", F.lit(3), F.length("candidate"))).withColumn("tail", two(F.col("rel")))
    suffix = wanted.join(ends, (wanted["tail"] == ends["tail"]) & (wanted["project"] == ends["p"])).where(F.endswith("path", F.concat(F.lit("/"), F.col("rel")))).select(*(wanted[c] for c in key), "n", "path", "how")
    best = exact.union(suffix).groupBy(*key).agg(F.min(F.struct("n", "path", "how")).alias("hit"))
    every = tries.groupBy(*key).agg(F.min("status").alias("status"), F.min("why").alias("why"))
    joined = every.alias("e").join(best.alias("b"), [F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left")
    out = [F.col(f"e.{c}").alias(c) for c in key]
    return joined.select(*out, F.when(F.col("hit").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"), F.coalesce("hit.how", "why").alias("reason"), F.col("hit.path").alias("path"))


def import_graph(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """All imports of all files, resolved against the files of their project."""
    return resolved(specs(chunks), chunks.select("project", "filePath").where("filePath is not null").distinct(), roots)


def dependencies(imports: DataFrame, paths: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(forward, imported_by) of some files (filePath): their imports with status, and the files that import them."""
    forward = imports.join(paths.select("filePath").distinct(), "filePath", "left_semi")
    back = imports.where("path is not null").select("path", F.col("filePath").alias("importer")).distinct().join(paths.select(F.col("filePath").alias("path")).distinct(), "path", "left_semi")
    w = Window.partitionBy("filePath").orderBy("line", "raw")
    forward = forward.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    w = Window.partitionBy("path")
    back = back.withColumn("rank", F.row_number().over(w.orderBy("importer"))).withColumn("total", F.count("*").over(w)).where(F.col("rank") <= limit)
    return forward, back
