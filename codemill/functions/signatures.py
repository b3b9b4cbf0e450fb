"""Signatures of symbols and their parameter lists: line scans that no expression can say, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codemill.functions.identifiers import Col, _c
from codemill.settings import SIGNATURE_CHARS, SIGNATURE_LINES

#: Comment signs by language, and the languages whose symbols may carry decorators, attributes or docstrings.
LINE_COMMENT = {**dict.fromkeys("javascript typescript tsx go java kotlin rust c cpp c_sharp swift scala php".split(), "//"), **dict.fromkeys("python ruby gdscript".split(), "#")}
DECORATED = {"python", "java", "kotlin", "swift", "scala", "gdscript"}
DOCSTRINGS = {"python", "gdscript"}
_OPEN_TAIL = (":", ",", "(", "=")


def _lines(content: str, language: str) -> list[str]:
    """The lines that can belong to a signature, trimmed."""
    comment, out, until = LINE_COMMENT.get(language), [], ""
    for raw in content.split("\n"):
        line = raw.strip()
        if until:
            at = line.find(until)
            if at < 0:
                continue
            line, until = line[at + len(until) :].strip(), ""
        while comment == "//" and line.startswith("/*"):
            at = line.find("*/", 2)
            if at < 0:
                line, until = "", "*/"
            else:
                line = line[at + 2 :].strip()
        if language in DOCSTRINGS and (m := re.match(r"[rRuUbBfF]*(\"\"\"|''')", line)):
            at = line.find(m[1], m.end())
            if at < 0:
                until = m[1]
            continue
        if not line or (comment and line.startswith(comment) and not line.startswith("#[")) or (language == "php" and line.startswith("#")):
            continue
        if language in DECORATED and line.startswith("@") and not re.match(r"@interface\b", line) or language == "c_sharp" and line.startswith("[") or language == "rust" and line.startswith("#["):
            continue
        out.append(line)
        if len(out) == SIGNATURE_LINES:
            break
    return out


def derive_signature(content: str | None, language: str | None) -> str:
    """The head of a symbol as one line: up to its body, at most SIGNATURE_LINES lines and SIGNATURE_CHARS characters (then
    with …). '' for null, empty and comment-only texts."""
    picked: list[str] = []
    for line in _lines(content or "", language or ""):
        before = picked[-1] if picked else ""
        picked.append(line)
        if "{" in line:
            head = line[: line.rindex("{")].rstrip()
            if head.endswith(_OPEN_TAIL) or (not head and before.endswith(_OPEN_TAIL)):
                continue
            break
        if line.endswith((":", "=", ":>", "=>", ")")):
            break
    text = " ".join(" ".join(picked).split())
    for m in re.finditer(r"\{", text):
        if not text[: m.start()].rstrip().endswith((":", "(", "=", ",")):
            text = text[: m.start()]
            break
    text = text.strip()
    if text.endswith((":", "(")):
        text = text[:-1].rstrip()
    return text if len(text) <= SIGNATURE_CHARS else text[:SIGNATURE_CHARS] + "…"


def parameters(signature: str | None, language: str | None) -> list[str] | None:
    """Names of the parameters of a signature, without types, defaults and self; None where no closed list is found. In Go,
    where a receiver stands before the name, the list behind the name counts."""
    text = signature or ""
    start = text.find("(")
    if (language or "") == "go" and (m := re.match(r"\s*func\s*(\([^)]*\)\s*)?\w+\s*(\[[^\]]*\])?", text)):
        start = text.find("(", m.end())
    if start < 0:
        return None
    depth, part, parts, quote = 0, "", [], ""
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            part += c
            quote = "" if c == quote and text[i - 1] != "\\" else quote
            continue
        if c in "\"'`":
            quote = c
        if c in "([{" or c == "<" and depth:
            depth += 1
            if depth == 1:
                continue
        elif c in ")]}" or c == ">" and depth > 1 and text[i - 1] not in "=-":
            depth -= 1
            if not depth:
                parts.append(part)
                break
        elif c == "," and depth == 1:
            parts.append(part)
            part = ""
            continue
        part += c
    else:
        return None
    out = []
    for p in (p.strip() for p in parts):
        p = re.split(r"(?<![=!<>])=(?![=>])", p)[0].strip()
        if not p or p in ("self", "cls", "&self", "&mut self", "mut self", "this", "*", "/"):
            continue
        if ":" in p:
            name = p.split(":")[0].split()[-1:] or [""]
            p = name[0]
        elif (language or "") == "go":
            p = p.split()[0]
        elif (language or "") in ("java", "c", "cpp", "c_sharp", "kotlin", "scala", "php", "swift"):
            p = p.split()[-1]
        out.append(p.lstrip("*&$.").rstrip("?"))
    return out


def params_differ(base: str | None, head: str | None, language: str | None) -> bool:
    """Whether the parameters of two signatures differ; not where a list cannot be read."""
    a, b = parameters(base, language), parameters(head, language)
    return a is not None and b is not None and a != b


def signature(content: Col, language: Col) -> Column:
    @F.pandas_udf("string")
    def run(c: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([derive_signature(x, y) for x, y in zip(c, g)])

    return run(_c(content), _c(language))


def parameters_differ(base: Col, head: Col, language: Col) -> Column:
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([params_differ(x, y, z) for x, y, z in zip(a, b, g)])

    return run(_c(base), _c(head), _c(language))
