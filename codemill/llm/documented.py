"""Problem 6: functions and methods with their descriptions.

Method: comment spans and function spans are extracted independently; an as-of interval join attaches to each function the
nearest comment that ends before it, and rejects it if a statement stands between them. Decorators and annotations belong to
the function. Python docstrings are the string right after the signature. Trivial descriptions are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 5
LANGUAGE = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java"}


class Function(NamedTuple):
    name: str
    start: int  # of its first line's text, decorators included
    body: int  # where the body starts


_C = r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
LEXERS = {
    "python": re.compile(r'(?P<comment>\#[^\n]*)|(?P<string>"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')', re.S),
    "go": re.compile(_C + r"|`[^`]*`)", re.S),
    "java": re.compile(_C.replace('(?P<string>', '(?P<string>""".*?"""|') + ")", re.S),
    "javascript": re.compile(_C + r"|`(?:\\.|[^`\\])*`|(?<=[=(,:?\[] )/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)", re.S),
}
LEXERS["typescript"] = LEXERS["javascript"]

_NOT_A_NAME = r"(?!(?:if|for|while|switch|catch|return|function|new|else|do|try|throw|await|yield|typeof|super|with|synchronized|assert|case|delete|void|in|of)\b)"
HEADS = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M),
    "go": re.compile(r"^func[ \t]+(?:\([^)]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M),
    "java": re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>()]*>[ \t]*)?(?!(?:return|new|else|throw|case)\b)(?:[\w.]+(?:<[^()=;]*>)?(?:\[\])*[ \t]+)?{_NOT_A_NAME}(?P<name>\w+)[ \t]*\(", re.M),
    "javascript": re.compile(
        rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^>()]*>)?\("
        rf"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*[\w$]*[ \t]*)?(?:<[^>()]*>)?\("
        rf"|^[ \t]*(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)[ \t]+)*\*?[ \t]*{_NOT_A_NAME}(?P<method>\#?[\w$]+)[ \t]*(?:<[^>()]*>)?\(",
        re.M,
    ),
}
HEADS["typescript"] = HEADS["javascript"]
AFTER = {
    "python": re.compile(r"\s*(?:->[^\n]*?)?:"),
    "go": re.compile(r"[^{}\n;]*(?:interface\{\}[^{}\n;]*)*\{"),
    "java": re.compile(r"\s*(?:throws\s+[\w.,\s]+?)?\s*\{"),
    "javascript": re.compile(r"\s*(?::[^;{}=\n]+(?:\{[^{}]*\}[^;{}=\n]*)?)?\s*(?:=>\s*[\{(]?|\{)"),
}
AFTER["typescript"] = AFTER["javascript"]
ADORNED = re.compile(r"(?:[ \t]*@[\w.]+[^\n]*\n(?:[ \t]*[)\]}][^\n]*\n)?|[ \t\0]*\n)*\Z")


#: Stands for a character of a comment or string; no pattern of code takes it for space.
BLANK = "\0"


def spans(text: str, language: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], str]:
    """Comment spans, string spans, and the text with both blanked."""
    comments, strings, out, at = [], [], [], 0
    for m in LEXERS[language].finditer(text):
        (comments if m.lastgroup == "comment" else strings).append(m.span())
        own = m.group()
        out += [text[at : m.start()], "\n".join(BLANK * len(line) for line in own.split("\n")) if "\n" in own else BLANK * len(own)]
        at = m.end()
    return comments, strings, "".join([*out, text[at:]])


def _closed(code: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; -1 if none does."""
    depth = 0
    for m in re.compile(r"[()]").finditer(code, at):
        depth += 1 if m.group() == "(" else -1
        if depth == 0:
            return m.end()
    return -1


def functions(code: str, language: str) -> list[Function]:
    """Functions with a body in text whose comments and strings are blanked."""
    found = []
    for m in HEADS[language].finditer(code):
        name = m[m.lastgroup]
        end = _closed(code, m.end() - 1)
        if end < 0:
            continue
        body = AFTER[language].match(code, end)
        if not body or (m.lastgroup == "arrow" and "=>" not in body.group() and "function" not in m.group()) or (m.lastgroup == "method" and "=>" in body.group()):
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        found.append(Function(name, start, body.end()))
    return found


def comment_runs(text: str, comments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Comments that own their lines; neighbouring lines of one kind are joined."""
    runs: list[tuple[int, int]] = []
    for lo, hi in comments:
        if text[text.rfind("\n", 0, lo) + 1 : lo].strip():
            continue  # behind code
        block = text.startswith("/*", lo)
        if runs and not block and not text.startswith("/*", runs[-1][0]) and re.fullmatch(r"[ \t]*\n[ \t]*", text[runs[-1][1] : lo]):
            runs[-1] = (runs[-1][0], hi)
        else:
            runs.append((lo, hi))
    return runs


def attached(text: str, code: str, runs: list[tuple[int, int]], function: Function) -> str:
    """The nearest comment before the function, unless a statement stands between."""
    ends = [hi for _, hi in runs]
    i = bisect_right(ends, function.start) - 1
    if i < 0:
        return ""
    lo, hi = runs[i]
    line = code.rfind("\n", 0, function.start) + 1
    between = code[hi:line].lstrip(" \t")
    between = between[1:] if between.startswith("\n") else between
    return text[lo:hi] if ADORNED.match(between) else ""


def docstring(text: str, strings: list[tuple[int, int]], function: Function) -> str:
    for lo, hi in strings:
        if lo >= function.body:
            prefix = re.fullmatch(r"\s*[rRuUbBfF]{0,2}", text[function.body : lo])
            return text[lo:hi] if prefix else ""
    return ""


MARKER = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//+!?|#+!?|;+|--)|\*+/[ \t]*$")
QUOTE = re.compile(r'^\s*[rRuUbBfF]{0,2}("""|\'\'\'|"|\')|("""|\'\'\'|"|\')\s*$')
TAG = re.compile(r"^\s*(?:[@\\](?:param|returns?|throws?|raises|exception|see|since|version|author|deprecated|type|typedef|template|example|private|public|internal|override|async|default|property|todo|link|yields?|arg|argument|memberof|module|class|function|name)\b|@\w+|:\w+[^:\n]*:)")
SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|Attributes|Notes?|See Also|Usage)\s*:?\s*$", re.I)
_ORDER = (
    r"eslint-(?:disable|enable|env)|eslint\s+[\w-]+\s*:|prettier-ignore|istanbul\s+ignore|c8\s+ignore|@ts-\w|tslint:|jshint\s+[\w-]+\s*:|noqa\b|nolint\b|pylint:|pyright:|mypy:|type:\s*ignore|nosec\b|nosonar\b|go:\w"
    r"|checkstyle[:.]|@?suppress(?:warnings\b|\s*[:(])|noinspection\s+\w+\s*$|pragma(?::|\s+(?:no|once|region|mark|warning)\b)|coding[:=]|codespell:|clang-format\s+o|fmt:\s*o|yapf:|isort:|flake8:|sonar[:\-.]|webpack\w+:|@__pure__|#(?:end)?region"
)
#: A line that begins as an order to a tool or as a notice of rights; and an order behind the prose of a line.
DIRECTIVE = re.compile(rf"(?i)^[\s*\-#]*(?:{_ORDER}|copyright\s*(?:\(c\)|©|\d)|spdx-|[\w .\-]{{0,40}}licen[cs]e, version \S+\s*$)")
TRAILING = re.compile(rf"(?i)\s+(?:#|//)\s*(?:{_ORDER}).*$")
#: A line that is a placeholder as a whole, or begins with the mark of one.
HOLDER = re.compile(
    r"^\s*(?:(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b|(?i:(?:todo|fixme|xxx|hack|tbd|wip)\s*(?:[:(]|$)"
    r"|(?:n/a|none|placeholder|description|missing|undocumented|document (?:this|me)|auto-?generated)(?:\s+(?:text|description|docs?|docstring|comment|documentation|function|method|here|goes here|to be (?:added|written|done)|later|please|stub))*\s*[.:!]*\s*$"
    r"|auto-?generated\s+(?:by|from|code|file|method|constructor|catch)\b))"
)
MARKUP = re.compile(r"```.*?```|~~~.*?~~~|<pre>.*?</pre>|<code>.*?</code>|\{@(?:code|link|linkplain|literal|inheritDoc|value)[^}]*\}|`[^`\n]*`|<[^>\n]+>|https?://\S+|&\w+;", re.S)
CODE_WORD = re.compile(r"\S*(?:[a-z][A-Z]|\w_\w|\w\(|\w\.\w+\(|::|=>|->|[{}\[\];=<>|\\])\S*")
CALL = re.compile(r"[\w.$]+\([^()\n]*\)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def plain(description: str) -> str:
    """The description's own prose: without markers, markup, tags, directives, placeholders and code."""
    text = MARKUP.sub(" ", "\n".join(MARKER.sub("", MARKER.sub("", line)) for line in QUOTE.sub("", QUOTE.sub("", description)).split("\n")))
    kept, tag, section, indent = [], False, False, 0
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            tag = False
            if section and kept:
                kept.append("")
            continue
        depth = len(line) - len(line.lstrip())
        if SECTION.match(line):
            section, indent, tag = True, depth, False
            continue
        if TAG.match(line):
            tag, section = True, False
            continue
        if section:
            if re.fullmatch(r"[\W_]+", bare) or depth > indent or re.match(r"[\w*]+\s*(?:\([^)]*\)|\[[^\]]*\])?\s*(?::|--?)\s", bare):
                continue
            section = False
        if tag and depth > 1:
            continue  # a tag's text goes on
        tag = False
        bare = TRAILING.sub("", bare)
        if DIRECTIVE.match(line) or HOLDER.match(line) or re.search(r"[;{}]\s*$", line):
            continue
        kept.append(bare)
    return " ".join(kept).strip()


def new_words(prose: str, name: str) -> list[str]:
    """Words of the prose that the function's name does not say."""
    own = {p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)}
    said = own | {p + e for p in own for e in ("s", "es", "ed", "d", "ing")} | {name.lower()}
    words = WORD.findall(CODE_WORD.sub(" ", CALL.sub(" ", prose)))
    return [w for w in words if w.lower() not in said]


def documented(text: str | None, path: str | None, symbol: str | None, doc: str | None) -> list[tuple[str, str]]:
    """(bare name, description) of the functions with a description that says more than the name."""
    language = LANGUAGE.get((path or "").rsplit(".", 1)[-1])
    if not text or language is None:
        return []
    own = (symbol or "").rsplit(".", 1)[-1]
    if not doc and not re.search(r"[\"'#]" if language == "python" else r"//|/\*", text):
        return []
    comments, strings, code = spans(text, language)
    found, runs = {}, comment_runs(text, comments)
    for f in functions(code, language):
        options = [docstring(text, strings, f)] if language == "python" else []
        options.append(attached(text, code, runs, f))
        options = [o for o in options if o]
        if not options and doc and f.name == own:
            options = [doc]
        for o in options:
            prose = plain(o)
            if len(new_words(prose, f.name)) >= LEAST_WORDS:
                found.setdefault(f.name, prose)
                break
    return list(found.items())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(rec, name, prose) for rec, *rest in zip(*(c.to_pylist() for c in batch.columns)) for name, prose in documented(*rest)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()))], names=["rec_id", "func_name", "description"])


def documented_functions(chunks: DataFrame) -> DataFrame:
    """rec_id, func_name, description of every function in a chunk whose description has at least five words of its own.

    Null contents, unknown endings and functions without a body have no rows. Where the comment is not in the chunk, the
    column doc is taken for the function that the chunk is named by. Of equal names in a chunk the first counts; repeated
    rows count once."""
    source = chunks.select(F.col("rec_id").cast("long").alias("rec_id"), "content", "filePath", "symbolName", "doc")
    return source.mapInArrow(_extract, "rec_id long, func_name string, description string").distinct()
