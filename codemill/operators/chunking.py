"""From files to chunks: symbols by language, pieces of large texts, descriptions, records."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemill.functions.identifiers import identifier_terms
from codemill.functions.scalars import chunk_step, effective_chunk_chars
from codemill.operators.imports import LANGUAGE_OF
from codemill.settings import CHUNK_OVERLAP, DOC_CHARS

#: Kinds of declarations and the symbol type of each.
KINDS = {"interface": "interface", "protocol": "interface", "enum": "enum", "struct": "struct", "union": "struct", "trait": "trait", "impl": "impl", "class": "class", "object": "class", "record": "class", "module": "class", "namespace": "class"}
_MODS = r"(?:(?:export|default|declare|abstract|public|private|protected|internal|static|final|sealed|open|async|override|virtual|readonly|partial|pub(?:\([^)]*\))?|unsafe|extern|inline|const|data|case|implicit|suspend|local|synchronized|native)\s+)*"
_TYPE = re.compile(rf"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*{_MODS}(class|interface|protocol|enum|struct|union|trait|impl|object|record|module|namespace)\s+(?:<[^>]*>\s*)?([\w$]+)")
_FUNCTION = {
    "javascript": re.compile(rf"^\s*{_MODS}(?:function\s*\*?\s*([\w$]+)|(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>))"),
    "go": re.compile(r"^func\s+(?:\(\s*\w*\s*\*?\s*(?P<owner>\w+)[^)]*\)\s*)?(\w+)"),
    "java": re.compile(rf"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]*>\s*)?[\w.<>\[\],? ]+?\s+(\w+)\s*\("),
    "rust": re.compile(rf"^\s*{_MODS}fn\s+(\w+)"),
    "kotlin": re.compile(rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)"),
    "swift": re.compile(rf"^\s*{_MODS}(?:func\s+(\w+)|(init|deinit)\b)"),
    "scala": re.compile(rf"^\s*{_MODS}def\s+(\w+)"),
    "php": re.compile(rf"^\s*{_MODS}function\s+&?(\w+)"),
}
_FUNCTION["typescript"] = _FUNCTION["tsx"] = _FUNCTION["javascript"]
_FUNCTION["c"] = _FUNCTION["cpp"] = _FUNCTION["c_sharp"] = _FUNCTION["java"]
_METHOD = re.compile(rf"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*{_MODS}(?:(?:get|set)\s+)?\*?\s*(?!(?:if|for|while|switch|catch|return|else|do|try|throw|new)\b)(#?[\w$~]+)\s*(?:<[^>]*>)?\(")
_GO_TYPE = re.compile(r"^type\s+(\w+)\s+(struct|interface)\b")
_STRIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)


class Chunk(NamedTuple):
    text: str
    name: str
    kind: str
    start: int
    end: int
    doc: str | None


def _comment_above(lines: list[str], at: int, marks: tuple[str, ...]) -> tuple[int, str | None]:
    """(first line, text) of the run of comments right above the line at; (at, None) without one."""
    i, inside = at, False
    while i > 0:
        line = lines[i - 1].strip()
        if inside or line.endswith("*/") and "/*" in marks:
            inside = not line.startswith("/*")
        elif not (line.startswith(tuple(m for m in marks if m != "/*")) and not line.startswith("#!")) and not line.startswith("@"):
            break
        i -= 1
    while i < at and lines[i].strip().startswith("@"):
        i += 1
    text = "\n".join(line.strip() for line in lines[i:at] if not line.strip().startswith("@"))
    return i, text[:DOC_CHARS] or None


def _python(text: str, most: int) -> list[Chunk] | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return None
    lines = text.split("\n")
    out: list[Chunk] = []
    loose: list[int] = []

    def flush() -> None:
        if loose:
            a, b = min(loose), max(loose)
            body = "\n".join(lines[a - 1 : b])
            if body.strip():
                out.append(Chunk(body, "", "code", a, b, None))
            loose.clear()

    def span(node: ast.stmt) -> tuple[int, int]:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno or node.lineno

    def described(node: ast.stmt, a: int) -> str | None:
        own = ast.get_docstring(node, clean=True)
        return own[:DOC_CHARS] if own else _comment_above(lines, a - 1, ("#",))[1]

    for node in tree.body:
        a, b = span(node)
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            loose += [a, b]
            continue
        flush()
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        body = "\n".join(lines[a - 1 : b])
        methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))] if kind == "class" else []
        if len(body) <= most or not methods:
            out.append(Chunk(body, node.name, kind, a, b, described(node, a)))
            continue
        first = span(methods[0])[0]
        out.append(Chunk("\n".join(lines[a - 1 : first - 1]), node.name, "class", a, first - 1, described(node, a)))
        for m in methods:
            c, d = span(m)
            out.append(Chunk("\n".join(lines[c - 1 : d]), f"{node.name}.{m.name}", "method", c, d, described(m, c)))
    flush()
    return out


def _blanked(text: str) -> str:
    """The text with comments and strings made blank, lines and columns kept."""
    return _STRIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(blank: list[str], at: int) -> int:
    """The line where the declaration that begins at a line ends: that of its closing brace, or of its semicolon or blank line."""
    depth, seen = 0, False
    for i in range(at, len(blank)):
        for c in blank[i]:
            if c in "{([":
                depth += 1
                seen |= c == "{"
            elif c in "})]":
                depth -= 1
        if depth <= 0 and (seen or blank[i].rstrip().endswith((";", ")", ","))):
            return i
    return len(blank) - 1


def _braced(text: str, language: str, most: int) -> list[Chunk] | None:
    lines, blank = text.split("\n"), _blanked(text).split("\n")
    pattern = _FUNCTION.get(language)
    if pattern is None:
        return None
    marks = ("//", "/*", "*")
    out: list[Chunk] = []
    loose: list[int] = []
    i, symbols = 0, 0

    def flush() -> None:
        while loose and not lines[loose[-1]].strip():
            loose.pop()
        while loose and not lines[loose[0]].strip():
            loose.pop(0)
        if loose:
            out.append(Chunk("\n".join(lines[loose[0] : loose[-1] + 1]), "", "code", loose[0] + 1, loose[-1] + 1, None))
        loose.clear()

    def doc_of(at: int) -> str | None:
        return _comment_above(lines, at, marks)[1]

    while i < len(lines):
        t, g, f = _TYPE.match(blank[i]), _GO_TYPE.match(blank[i]) if language == "go" else None, pattern.match(blank[i])
        if not (t or g or f) or blank[i].startswith((" ", "\t")) and not out and not f:
            loose.append(i)
            i += 1
            continue
        end = _end(blank, i)
        start, _ = _comment_above(lines, i, marks)
        while loose and loose[-1] >= start:
            loose.pop()
        flush()
        symbols += 1
        if f and not t and not g:
            name = next(x for x in f.groups()[::-1] if x)
            owner = f.groupdict().get("owner")
            out.append(Chunk("\n".join(lines[i : end + 1]), f"{owner}.{name}" if owner else name, "method" if owner else "function", i + 1, end + 1, doc_of(i)))
            i = end + 1
            continue
        kind, name = (g[2], g[1]) if g else (KINDS[t[1]], t[2])
        body = "\n".join(lines[i : end + 1])
        members = _members(blank, i, end) if len(body) > most else []
        if not members:
            out.append(Chunk(body, name, kind, i + 1, end + 1, doc_of(i)))
        else:
            out.append(Chunk("\n".join(lines[i : members[0][0]]), name, kind, i + 1, members[0][0], doc_of(i)))
            out += [Chunk("\n".join(lines[a : b + 1]), f"{name}.{n}", "method", a + 1, b + 1, doc_of(a)) for a, b, n in members]
        i = end + 1
    flush()
    return out if symbols else None


def _members(blank: list[str], start: int, end: int) -> list[tuple[int, int, str]]:
    """(first line, last line, name) of the methods of a type, at one brace within it."""
    out, depth, i = [], 0, start
    while i <= end:
        if depth == 1 and i > start and (m := _METHOD.match(blank[i])) and "{" in "".join(blank[i : _end(blank, i) + 1]):
            last = min(_end(blank, i), end)
            out.append((i, last, m[1]))
            i = last + 1
            continue
        depth += blank[i].count("{") - blank[i].count("}")
        i += 1
    return out


def pieces(text: str, most: int, step: int, base: int = 1) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of windows of most characters every step; blank ones are left out. One pass over the lines."""
    if len(text) <= most:
        return [(text, base, base + text.count("\n"))] if text.strip() else []
    out, line, seen = [], base, 0
    for at in range(0, len(text), step):
        line += text.count("\n", seen, at)
        seen = at
        part = text[at : at + most]
        if part.strip():
            out.append((part, line, line + part.count("\n")))
    return out


def chunk_text(text: str | None, language: str, most: int | None = None, overlap: int = CHUNK_OVERLAP) -> list[Chunk]:
    """Chunks of a file in order. Symbols stay whole up to most characters; a larger type becomes its head and its methods, any
    other larger text windows that repeat its name and type, of which the first has the description. Texts of no known language,
    that do not parse or have no symbol are cut into windows as they are; blank texts have none."""
    most = most or effective_chunk_chars()
    if not text or not text.strip():
        return []
    found = (_python(text, most) if language == "python" else _braced(text, language, most)) or []
    if not any(c.name for c in found):
        found = [Chunk(text, "", "", 1, text.count("\n") + 1, None)]
    out = []
    for c in found:
        for n, (part, a, b) in enumerate(pieces(c.text, most, chunk_step(most, overlap), c.start)):
            out.append(Chunk(part, c.name, c.kind, a, b, c.doc if n == 0 else None))
    return out


CHUNKS = "project string, filePath string, n int, content string, language string, symbolName string, symbolType string, startLine int, endLine int, doc string"


def chunked(files: DataFrame, most: int | None = None, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The chunks of files (project, path, text), with CHUNKS as columns. Nothing moves between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for project, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                language = LANGUAGE_OF.get((path or "").rsplit(".", 1)[-1], "")
                out += [(project, path, n, c.text, language, c.name, c.kind, c.start, c.end, c.doc) for n, c in enumerate(chunk_text(text, language, most, overlap))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            names = [x.split()[0] for x in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    return files.select("project", "path", "text").mapInArrow(run, CHUNKS)


def windows(texts: DataFrame, most: int | None = None, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """id, n, content, startLine, endLine: windows of texts (id, text) by column expressions alone; blank ones are left out."""
    most = most or effective_chunk_chars()
    step = chunk_step(most, overlap)
    length = F.length("text")
    last = F.when(length <= most, 0).otherwise(F.floor((length - 1) / F.lit(step)).cast("int"))
    rows = texts.where("text is not null").select("id", "text", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    part = F.substring("text", F.col("n") * step + 1, F.lit(most))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    start = 1 + breaks(F.substring("text", F.lit(1), F.col("n") * step))
    return rows.select("id", "n", part.alias("content"), start.alias("startLine"), (start + breaks(part)).alias("endLine")).where(F.col("content").rlike(r"\S"))


def records(chunks: DataFrame, embed: Callable[[Column], Column], frame: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Records of the code table: id, vectors of content and description, identifier terms. A chunk that gets no vector has no
    record; vectors belong to their chunk by its row, whatever other chunks get."""
    rows = chunks.withColumn("id", F.concat_ws("#", "filePath", F.col("n").cast("string"))).withColumn("rec_id", F.xxhash64("project", "id"))
    rows = rows.withColumn("vector", embed(frame(F.col("content")))).withColumn("doc_vector", F.when(F.col("doc").isNotNull(), embed(frame(F.col("doc")))))
    rows = rows.withColumn("id_terms", identifier_terms("content")).withColumn("indexedAt", F.current_timestamp())
    return rows.where("vector is not null").drop("n")
