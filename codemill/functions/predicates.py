"""Predicates over paths, symbols and contents as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codemill.functions.identifiers import Col, _c
from codemill.settings import Boost

#: Fixed values.
CANDIDATE_TYPES = ("function", "method", "class", "interface", "enum", "struct", "trait", "record")
CALLABLE_TYPES = ("function", "method", "constructor")
ENTRY_STEMS = ("main", "index", "app", "cli", "server", "program", "__main__", "mod", "lib", "entry", "bootstrap", "start")
DOC_SUFFIX = r"(?i)\.(md|mdx|xml|rst)$"
GENERATED_SEGMENT = r"(^|/)(gen|dist|build|vendor|node_modules)(/|$)"
GENERATED_SUFFIX = r"\.pb\.go$|\.min\.[a-z0-9]+$"


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def glob_to_like(glob: str) -> str:
    """A path glob as a LIKE pattern with \\ as escape: *, ** and **/ match anything; it matches anywhere in the path unless it
    begins with /; without a wildcard it may stand anywhere."""
    if "*" not in glob:
        return f"%{escape_like(glob)}%"
    body = re.sub(r"\*\*/|\*\*", "*", glob)
    like = "%".join(escape_like(part) for part in body.split("*"))
    return like if glob.startswith("/") or like.startswith("%") else "%" + like


def glob_to_regex(glob: str) -> str:
    """A glob over path segments as an anchored pattern: **/ any folders, ** anything, * and ? within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def path_matches(path: Col, glob: str) -> Column:
    return _c(path).like(glob_to_like(glob))


def row_filter(language: str | None = None, symbol_type: str | None = None, path_glob: str | None = None) -> Column:
    """Conjunction of the filters that are given; empty ones are no filters."""
    out = F.lit(True)
    if language:
        out = out & (F.col("language") == language)
    if symbol_type:
        out = out & (F.col("symbolType") == symbol_type)
    if path_glob:
        out = out & path_matches("filePath", path_glob)
    return out


def symbol_matches(name: Col, wanted: Col) -> Column:
    """Equal to wanted, beginning with it, or with a part behind a dot that begins with it; an empty wanted matches nothing."""
    return (_c(wanted) != "") & (F.startswith(_c(name), _c(wanted)) | F.contains(_c(name), F.concat(F.lit("."), _c(wanted))))


def content_contains(content: Col, term: Col) -> Column:
    return F.contains(_c(content), _c(term))


def basename(path: Col) -> Column:
    return F.element_at(F.split(F.translate(_c(path), "\\", "/"), "/"), -1)


def dirname(path: Col) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def is_document(path: Col) -> Column:
    return _c(path).rlike(DOC_SUFFIX)


def is_test_file(path: Col) -> Column:
    base, norm = F.lower(basename(path)), F.translate(_c(path), "\\", "/")
    return base.rlike(r"^test_|_test\.[a-z0-9]+$|\.(test|spec)\.[a-z0-9]+$") | norm.rlike(r"(^|/)(tests?|__tests?__|spec)/")


def is_entry_point(path: Col) -> Column:
    return F.lower(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")).isin(*ENTRY_STEMS)


def is_candidate(symbol_type: Col) -> Column:
    return _c(symbol_type).isin(*CANDIDATE_TYPES)


def is_callable(symbol_type: Col) -> Column:
    return _c(symbol_type).isin(*CALLABLE_TYPES)


def is_generated_path(path: Col) -> Column:
    norm = F.translate(_c(path), "\\", "/")
    return norm.rlike(GENERATED_SEGMENT) | norm.rlike(GENERATED_SUFFIX)


def relative_path(path: Col, root: Col) -> Column:
    """The path under root; the path itself where it is not under it or root is null or empty."""
    norm = F.translate(_c(path), "\\", "/")
    prefix = F.concat(F.regexp_replace(F.translate(_c(root), "\\", "/"), "/+$", ""), F.lit("/"))
    inside = (F.length(prefix) > 1) & F.startswith(norm, prefix)
    return F.when(F.coalesce(inside, F.lit(False)), F.substring(norm, F.length(prefix) + 1, F.length(norm))).otherwise(norm)


def under_source_root(relative: Col, roots: tuple[str, ...]) -> Column:
    norm = F.regexp_replace(F.translate(_c(relative), "\\", "/"), r"^\./", "")
    out = F.lit(False)
    for raw in roots:
        root = re.sub(r"^\.?/", "", raw.replace("\\", "/")).rstrip("/")
        if root:
            out = out | (norm == root) | F.startswith(norm, F.lit(root + "/"))
    return out


def path_factor(relative: Col, boost: Boost = Boost()) -> Column:
    """The factor of a path on a fused score: short paths, source roots, tests and generated files. 1 for a null path."""
    norm = F.least(F.lit(1.0), F.log1p(F.length(F.translate(_c(relative), "\\", "/"))) / F.log1p(F.lit(boost.norm_chars)))
    factor = 1 + boost.short_path * (1 - norm)
    factor = factor * F.when(under_source_root(relative, boost.source_roots), 1 + boost.source_root).otherwise(1.0)
    factor = factor * F.when(is_test_file(relative), boost.test_demotion).otherwise(1.0)
    factor = factor * F.when(is_generated_path(relative), boost.generated_demotion).otherwise(1.0)
    return F.when(_c(relative).isNull(), 1.0).otherwise(factor)
