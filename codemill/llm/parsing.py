"""Problem 4: source files that do not parse in the grammar of their ending.

Method: table-driven parsers from bundled grammars (grammars.py). The text of a file is put together from its chunks, cut
into tokens and parsed to its end; the first error that cannot be recovered is reported. Recovered are only the semicolons
that JavaScript and TypeScript let one leave out: at most one before a token, at the end of a line, of a block or of the text,
and never as a statement of its own.

An exact check follows where the standard library has one: what the tables take is also given to ast.parse (Python), whose
compile-time rules no context-free grammar holds, and what they refuse is given to ast.parse and json.loads, so that a gap of a
table flags no valid file. The tests count how often that overrules the tables: never on the valid files of the test data.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemill.llm.grammars import END, Table, table

LANGUAGE = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json"}


class Token(NamedTuple):
    kind: str
    at: int
    text: str
    newline: bool  # a line ended before it


class Failure(Exception):
    def __init__(self, at: int, why: str) -> None:
        self.at, self.why = at, why


_NUM = r"0[xX][\da-fA-F_]+[nLl]?|0[bB][01_]+[nLl]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eEpP][+\-]?\d[\d_]*)?[nLlfFdDji]?"
_WORD = r"[^\W\d]\w*"
_SPACE = r"[ \t\r\f\v ﻿]+"
_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''

LEX = {
    "json": re.compile(rf'(?P<skip>[ \t\r\n]+)|(?P<STR>"(?:\\(?:["\\/bfnrt]|u[\da-fA-F]{{4}})|[^"\\\x00-\x1f])*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+\-]?\d+)?)|(?P<word>\w+)|(?P<sign>[{{}}\[\],:])', re.S),
    "script": re.compile(rf"(?P<skip>{_SPACE}|{_C_COMMENT})|(?P<nl>\n)|(?P<word>[#]?(?:[^\W\d]|\$)[\w$]*)|(?P<STR>{_STRING}|`(?:\\.|\$\{{(?:[^{{}}`]|\{{[^{{}}]*\}}|`[^`]*`)*\}}|[^`\\])*`)|(?P<NUM>{_NUM})|(?P<sign>=>|\.\.\.|\?\.(?!\d)|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|===|!==|[=!<]=|>=|[+\-*/%&|^]=|\+\+|--|&&|\|\||\?\?|\*\*|<<|.)", re.S),
    "go": re.compile(rf"(?P<skip>{_SPACE}|{_C_COMMENT})|(?P<nl>\n)|(?P<word>{_WORD})|(?P<STR>\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]{{1,9}}?|[^'\\\n])'|`[^`]*`)|(?P<NUM>{_NUM})|(?P<sign>\.\.\.|<<=|>>=|&\^=|:=|<-|&&|\|\||[=!<>]=|[+\-*/%&|^]=|\+\+|--|<<|>>|&\^|.)", re.S),
    "java": re.compile(rf"(?P<skip>{_SPACE}|{_C_COMMENT})|(?P<nl>\n)|(?P<word>[^\W\d][\w$]*)|(?P<STR>\"\"\"(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]{{1,6}}?|[^'\\\n])')|(?P<NUM>{_NUM})|(?P<sign>->|::|\.\.\.|>>>=|>>=|<<=|[=!<>]=|[+\-*/%&|^]=|\+\+|--|&&|\|\||<<|.)", re.S),
    "python": re.compile(rf"(?P<skip>{_SPACE}|\#[^\n]*|\\\r?\n)|(?P<nl>\n)|(?P<STR>[rRuUbBfFtT]{{0,2}}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))|(?P<word>{_WORD})|(?P<NUM>{_NUM})|(?P<sign>->|:=|\.\.\.|\*\*=|//=|>>=|<<=|[=!<>]=|[+\-*/%&|^@]=|\*\*|//|<<|>>|<>|.)", re.S),
}
_BIN = {k: "BIN" for k in "== != === !== <= >= && || ?? << & | ^ / % **".split()}
_SIGN = {
    "script": {**_BIN, "**": "BIN", "+": "PM", "-": "PM", "*": "MUL", "++": "INC", "--": "INC", "~": "PRE", "!": "BANG", "...": "DOTS", "=>": "ARROW", "?.": "QDOT", "@": "AT", **{k: "ASSIGN" for k in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()}},
    "go": {**{k: "BIN" for k in "== != < <= > >= && || << >> &^ ^ / %".split()}, "*": "STAR", "+": "PM", "-": "PM", "|": "PIPE", "&": "AMP", "!": "BANG", "~": "TILDE", "++": "INC", "--": "INC", "...": "DOTS", ":=": "DEFINE", "<-": "ARROW", **{k: "ASSIGN" for k in "+= -= *= /= %= <<= >>= &= |= ^= &^=".split()}},
    "java": {**{k: "BIN" for k in "== != <= >= && || << ^ / %".split()}, "+": "PM", "-": "PM", "*": "MUL", "|": "PIPE", "&": "AMP", "!": "BANG", "~": "BANG", "++": "INC", "--": "INC", "...": "DOTS", "->": "ARROW", "::": "REF", **{k: "ASSIGN" for k in "+= -= *= /= %= <<= >>= >>>= &= |= ^=".split()}},
    "python": {**{k: "BIN" for k in "== != <> < > <= >= << >> & | ^ % //".split()}, "+": "PM", "-": "PM", "*": "MUL", "**": "POW", "~": "TILDE", "...": "DOTS", "->": "RARROW", ":=": "WALRUS", **{k: "ASSIGN" for k in "+= -= *= /= //= %= **= <<= >>= &= |= ^= @=".split()}},
}
_same = lambda words: {w: w for w in words.split()}
_WORDS = {
    "script": {**_same("if else while do for return break continue throw debugger try catch finally switch case default function class extends new in import export static await yield"), "instanceof": "BIN", "typeof": "PRE", "void": "PRE", "delete": "PRE", "var": "VAR", "let": "VAR", "const": "VAR", "true": "LIT", "false": "LIT", "null": "LIT", "this": "LIT", "super": "LIT", "enum": "ENUM", "with": "while"},
    "go": _same("package import const var type func map chan struct interface return break continue goto fallthrough go defer if else for range switch case default select"),
    "java": {**_same("package import class interface enum extends implements if else while do for return break continue throw throws try catch finally switch case default new this super void instanceof assert synchronized"), **{k: "MOD" for k in "public private protected static final abstract native transient volatile strictfp".split()}, **{k: "PRIM" for k in "int long short byte char float double boolean".split()}, "true": "LIT", "false": "LIT", "null": "LIT", "const": "NEVER", "goto": "NEVER"},
    "python": {**_same("if elif else while for in try except finally with as def class return pass break continue raise from global nonlocal del assert import yield lambda not is and or await"), "async": "ASYNC", "True": "LIT", "False": "LIT", "None": "LIT"},
}
_AFTER_OPERAND = {"NAME", "NUM", "STR", "LIT", "REGEX", ")", "]", "}", "INC", "BANG", "PRIVATE"}
_REGEX = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


_FORMATTED = re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])(\"\"\"|'''|\"|')")
_QUOTED = re.compile(r"[rRuUbB]{0,2}(\"\"\"|'''|\"|')")


def _formatted_end(text: str, at: int, opening: re.Match) -> int:
    """Where the formatted string that opens here ends; fields may hold any strings, formatted ones too."""
    quote, i, n = opening[1], opening.end(), len(text)
    depth: list[str] = []  # of brackets within a field; empty in the literal part
    while i < n:
        c = text[i]
        if not depth or depth[-1] == ":":
            if text.startswith(quote, i):
                return i + len(quote)
            if c == "\\" and not depth:
                i += 2
            elif c == "\n" and len(quote) == 1:
                break
            elif c == "{" and text.startswith("{{", i) and not depth:
                i += 2
            else:
                if c == "{":
                    depth.append("{")
                elif c == "}" and depth:
                    depth = depth[:-2]
                i += 1
        elif m := _FORMATTED.match(text, i):
            i = _formatted_end(text, i, m)
        elif m := _QUOTED.match(text, i):
            close = re.compile(r"(?:\\.|[^\\])*?" + re.escape(m[1]), re.S).match(text, m.end())
            if not close:
                break
            i = close.end()
        else:
            if c in "([{":
                depth.append(c)
            elif c in ")]}":
                depth.pop()
            elif c == ":" and len([d for d in depth if d != ":"]) == 1 and depth[-1] == "{" or c == ":" and depth[-1] == "{" and len(depth) >= 3 and depth[-2] == ":":
                depth.append(":")
            i += 1
    raise Failure(at, "string without end")


def _raw(text: str, lexer: str) -> list[Token]:
    """Words, literals and signs in order; brackets must match."""
    signs, words = _SIGN[lexer], _WORDS[lexer]
    out: list[Token] = []
    newline = False
    stack: list[str] = []
    at, n = 0, len(text)
    match = LEX[lexer].match
    python = lexer == "python"
    while at < n:
        m = match(text, at)
        kind, t = m.lastgroup, m.group()
        if kind == "skip":
            newline |= not python and "\n" in t
            at = m.end()
            continue
        if kind == "nl":
            newline = True
            if python and not stack and out and out[-1].kind != "NEWLINE":
                out.append(Token("NEWLINE", at, t, False))
            at += 1
            continue
        if python and kind in ("word", "STR") and (f := _FORMATTED.match(text, at)):
            end = _formatted_end(text, at, f)
            out.append(Token("STR", at, text[at:end], newline))
            newline, at = False, end
            continue
        if kind == "word":
            kind = words.get(t, "NAME")
            if t[0] == "#":
                kind = "PRIVATE"
        elif kind == "sign":
            if t == "/" or t == "/=":
                if lexer == "script" and (not out or out[-1].kind not in _AFTER_OPERAND):
                    r = _REGEX.match(text, at)
                    if not r:
                        raise Failure(at, "regular expression without end")
                    out.append(Token("REGEX", at, r.group(), newline))
                    newline, at = False, r.end()
                    continue
                if text.startswith("/*", at):
                    raise Failure(at, "comment without end")
            elif t in "\"'`":
                raise Failure(at, "string without end")
            elif t in "([{":
                stack.append(t)
            elif t in ")]}":
                if not stack or stack.pop() + t not in ("()", "[]", "{}"):
                    raise Failure(at, f"{t} without its opening bracket")
            kind = signs.get(t, t)
        out.append(Token(kind, at, t, newline))
        newline = False
        at = m.end()
    if stack:
        raise Failure(n, f"{stack[-1]} without its closing bracket")
    return out


def _pairs(tokens: list[Token]) -> dict[int, int]:
    """Place of each opening bracket's closing one."""
    of, stack = {}, []
    for i, t in enumerate(tokens):
        if t.text in ("(", "[", "{"):
            stack.append(i)
        elif t.text in (")", "]", "}") and stack:
            of[stack.pop()] = i
    return of


_GENERIC = {"NAME", ",", ".", "?", "extends", "super", "MOD", "PRIM", "[", "]", "AMP", "DIMS", "STR", "LIT", "PIPE", "BIN", "PRE", "{", "}", "O{", ":", ";", "(", ")", "ARROW", "AS", "=", "TYPE", "NUM", "new", "in", "&", "|"}


def _generics(tokens: list[Token], ok: set[str], before: set[str], after: set[str]) -> list[Token]:
    """Marks the angle brackets of type arguments as G< and G>."""
    out = list(tokens)
    stack: list[int] = []
    for i, t in enumerate(out):
        if t.text == "<" and t.kind == "<":
            if i and out[i - 1].kind in before:
                stack.append(i)
            else:
                stack.clear()
        elif t.text == ">" and t.kind == ">":
            if stack:
                lo = stack.pop()
                nxt = out[i + 1] if i + 1 < len(out) else None
                if nxt is None or stack or nxt.text in after or nxt.kind in after:
                    out[lo], out[i] = out[lo]._replace(kind="G<"), t._replace(kind="G>")
        elif stack and t.kind not in ok:
            stack.clear()
    return out


def _java(text: str) -> list[Token]:
    raw = _raw(text, "java")
    tokens: list[Token] = []
    i = 0
    of = _pairs(raw)
    while i < len(raw):  # annotations stand anywhere and mean nothing here
        if raw[i].text == "@" and i + 1 < len(raw) and raw[i + 1].kind == "NAME":
            i += 2
            while i + 1 < len(raw) and raw[i].text == "." and raw[i + 1].kind == "NAME":
                i += 2
            if i < len(raw) and raw[i].text == "(":
                i = of[i] + 1
            continue
        if raw[i].text == "@" and i + 1 < len(raw) and raw[i + 1].kind == "interface":
            i += 1
            continue
        if raw[i].text == "[" and i + 1 < len(raw) and raw[i + 1].text == "]":
            tokens.append(raw[i]._replace(kind="DIMS", text="[]"))
            i += 2
            continue
        t = raw[i]
        if t.kind == "NAME" and t.text in ("record", "sealed", "non", "permits", "yield") and i + 1 < len(raw):
            if t.text == "record" and raw[i + 1].kind == "NAME" and i + 2 < len(raw) and raw[i + 2].text in ("(", "<"):
                t = t._replace(kind="record")
            elif t.text == "sealed" and raw[i + 1].kind in ("MOD", "class", "interface"):
                t = t._replace(kind="MOD")
            elif t.text == "permits" and raw[i + 1].kind == "NAME" and raw[i - 1].kind == "NAME":
                t = t._replace(kind="permits")
        tokens.append(t)
        i += 1
    tokens = _generics(tokens, {"NAME", ",", ".", "?", "extends", "super", "PRIM", "DIMS", "AMP"}, {"NAME", "MOD", ".", "REF", "PRIM", "{", ";", "}", "new", ">"} | {"("}, {"NAME", "(", ")", ">", ",", ".", "{", "REF", "DIMS", "PRIM", "DOTS", "extends", "implements", "permits", "void", ";", "MOD", "AMP", "&", "?", "=", "["})
    of = _pairs(tokens)
    for lo, hi in of.items():
        if tokens[lo].text != "(" or hi + 1 >= len(tokens):
            continue
        if tokens[hi + 1].kind == "ARROW" and not (lo and tokens[lo - 1].kind in ("NAME",)):
            tokens[lo] = tokens[lo]._replace(kind="A(")
        elif hi - lo > 1 and all(t.kind in ("NAME", ".", "PRIM", "DIMS", "G<", "G>", ",", "?", "extends", "super", "AMP") for t in tokens[lo + 1 : hi]) and (not lo or tokens[lo - 1].kind not in ("NAME", "if", "while", "for", "switch", "catch", "synchronized", ")", "]", "G>", "this", "super")):
            inner, nxt = tokens[lo + 1 : hi], tokens[hi + 1]
            if nxt.kind in ("NAME", "NUM", "STR", "LIT", "new", "this", "super", "(", "A(", "BANG", "PRIM") or (inner[0].kind == "PRIM" and nxt.kind in ("PM", "INC")):
                tokens[lo] = Token("CAST", tokens[lo].at, "cast", tokens[lo].newline)
                for k in range(lo + 1, hi + 1):
                    tokens[k] = tokens[k]._replace(kind="")
    return [t for t in tokens if t.kind]


_GO_END = {"NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"}


def _go(text: str) -> list[Token]:
    raw = _raw(text, "go")
    tokens: list[Token] = []
    for t in raw:  # line ends become semicolons
        if t.newline and tokens and tokens[-1].kind in _GO_END:
            tokens.append(Token(";", t.at, "\n", True))
        tokens.append(t)
    if tokens and tokens[-1].kind in _GO_END:
        tokens.append(Token(";", len(text), "\n", True))
    depth, heads = 0, []
    for i, t in enumerate(tokens):
        before = tokens[i - 1].kind if i else ""
        if t.kind in ("if", "for", "switch", "select", "func"):
            heads.append((depth, t.kind))
        if t.text == "{":
            if before in ("struct", "interface"):
                tokens[i] = t._replace(kind="T{")
            elif heads and heads[-1][0] == depth:
                heads.pop()
            elif before in ("NAME", "]", "}", ",", ":", "(", "L{", "[") and (before not in (":",) or _in_literal(tokens, i)) and not (before == "}" and tokens[i - 1].newline):
                tokens[i] = t._replace(kind="L{")
        if t.text in ("(", "[", "{"):
            depth += 1
        elif t.text in (")", "]", "}"):
            depth -= 1
            while heads and heads[-1][0] > depth:
                heads.pop()
        elif t.kind == ";" and heads and heads[-1][1] == "func" and heads[-1][0] == depth:
            heads.pop()
    return [t for i, t in enumerate(tokens) if not (t.kind == ";" and t.text == "\n" and i + 1 < len(tokens) and tokens[i + 1].kind == "{" and False)]


def _in_literal(tokens: list[Token], i: int) -> bool:
    """Whether the innermost open brace before i is that of a composite literal."""
    depth = 0
    for t in reversed(tokens[:i]):
        if t.text in (")", "]", "}"):
            depth += 1
        elif t.text in ("(", "[", "{"):
            if depth == 0:
                return t.kind == "L{"
            depth -= 1
    return False


_STARTS = {";", "{", "}", ")", "export", "DECLARE", "ABSTRACT", "else", ":", "O{"}


def _script(text: str, types: bool) -> list[Token]:
    tokens = _raw(text, "script")
    if tokens and tokens[0].text == "#":
        tokens = tokens[1:]
    of = _pairs(tokens)
    n = len(tokens)
    for i in range(n):
        t = tokens[i]
        p = tokens[i - 1] if i else None
        nx = tokens[i + 1] if i + 1 < n else None
        if p is not None and p.kind in (".", "QDOT") and (t.kind == "NAME" or t.text.isidentifier()):
            tokens[i] = t._replace(kind="NAME")
            continue
        if t.text.isidentifier() and t.kind != "NAME" and nx is not None and (nx.text == ":" or nx.text == "(" and t.kind not in ("if", "while", "for", "switch", "catch", "function", "return", "import", "await", "yield", "PRE", "LIT", "case", "in", "BIN", "new", "throw", "do", "class", "else", "static")) and p is not None and p.text in ("{", ",", ";", "}") and t.kind not in ("case", "default", "LIT"):
            tokens[i] = t._replace(kind="NAME")
            continue
        if t.kind == "NAME":
            start = p is None or p.kind in _STARTS or t.newline
            if t.text == "async" and nx is not None and not nx.newline and (nx.kind == "function" or nx.text == "(" and i + 1 in of and of[i + 1] + 1 < n and tokens[of[i + 1] + 1].kind in ("ARROW",) + ((":",) if types else ()) and (p is None or p.kind not in ("{", "}", ";", "MOD", "static")) or nx.kind == "NAME" and i + 2 < n and tokens[i + 2].kind == "ARROW"):
                tokens[i] = t._replace(kind="ASYNC")
            elif t.text == "of" and p is not None and p.kind in ("NAME", "]", "}") and nx is not None and nx.text not in ("=", ",", ")", ";"):
                tokens[i] = t._replace(kind="OF")
            elif t.text == "from" and nx is not None and nx.kind == "STR":
                tokens[i] = t._replace(kind="FROM")
            elif t.text in ("as", "satisfies") and p is not None and p.kind in ("NAME", ")", "]", "}", "STR", "NUM", "LIT", "MUL", "BANG", "default", "G>") and nx is not None and (nx.kind in ("NAME", "STR", "LIT", "default", "PRE", "(", "[", "{", "VAR", "typeof") or nx.text in ("const", "{")) and not t.newline:
                tokens[i] = t._replace(kind="AS")
            elif types and nx is not None and nx.kind == "NAME" and not nx.newline:
                if t.text in ("interface", "type", "namespace", "module", "declare", "abstract") and start:
                    tokens[i] = t._replace(kind={"interface": "INTERFACE", "type": "TYPE", "declare": "DECLARE", "abstract": "ABSTRACT"}.get(t.text, "NAMESPACE"))
                elif t.text == "implements":
                    tokens[i] = t._replace(kind="IMPLEMENTS")
                elif t.text in ("keyof", "readonly", "infer", "unique", "asserts") and p is not None and p.kind in (":", "PIPE", "BIN", "<", ",", "=", "(", "ARROW", "[", "AS") and not (t.text == "readonly" and p.kind in ("(", ",") and i + 2 < n and tokens[i + 2].text in (":", "?")):
                    tokens[i] = t._replace(kind="TOP")
                elif t.text == "is" and p is not None and p.kind in ("NAME", "LIT"):
                    tokens[i] = t._replace(kind="IS")
                elif t.text in ("public", "private", "protected", "readonly", "override") and p is not None and p.kind in ("(", ",", "MOD"):
                    tokens[i] = t._replace(kind="MOD")
            elif types and t.text in ("declare", "abstract") and start and nx is not None and nx.kind in ("class", "VAR", "function", "ENUM") and not nx.newline:
                tokens[i] = t._replace(kind="DECLARE" if t.text == "declare" else "ABSTRACT")
            elif types and t.text in ("type",) and nx is not None and nx.text == "{" and p is not None and p.kind in ("import", "export"):
                tokens[i] = t._replace(kind="TYPE")
        elif t.text == "const" and types and p is not None and p.kind == "AS":
            tokens[i] = t._replace(kind="NAME")
        elif t.kind == "PRE" and t.text == "void" and types and p is not None and p.kind in (":", "PIPE", "BIN", "<", ",", "ARROW", "=") and (nx is None or nx.text in ("{", ";", ",", ")", ">", "|", "=>", "}", "=") or nx.newline):
            tokens[i] = t._replace(kind="void")
        elif t.kind == "?" and types and nx is not None and nx.text == ":":
            tokens[i] = t._replace(kind="OPT", text="?:")
            tokens[i + 1] = tokens[i + 1]._replace(kind="")
        elif t.kind == "?" and types and nx is not None and nx.text in (",", ")", "]", ";", "("):
            tokens[i] = t._replace(kind="OPTIONAL" if nx.text != "(" else "OPTMETHOD")
    tokens = [t for t in tokens if t.kind and t.kind != "OPTMETHOD"]
    if types:
        tokens = _generics(tokens, _GENERIC | {"TOP", "G<", "G>", "A(", "OPT", "PM", "typeof", "void"}, {"NAME", "function", "=", "(", "new", "return", ",", "ARROW", ":", "static", "OPT"}, {"(", ")", "{", ",", ";", "=", ">", "|", "&", "[", "]", "ARROW", ".", "extends", "IMPLEMENTS", "}", "STR", "OPT", "?", ":", "AS"})
    of = _pairs(tokens)
    depth_of_case: list[int] = []
    depth = 0
    n = len(tokens)
    for i in range(n):
        t = tokens[i]
        p = tokens[i - 1].kind if i else ""
        if t.text == "(" and i in of:
            hi = of[i]
            nx = tokens[hi + 1].kind if hi + 1 < n else ""
            arrow = nx == "ARROW"
            if types and nx == ":" and not arrow and p not in ("NAME", "function", "G>", "]", ")", "PRIVATE", "STR", "MOD", "static"):
                j, d = hi + 2, 0
                while j < n:
                    k = tokens[j]
                    if d == 0 and k.kind == "ARROW":
                        arrow = tokens[hi + 2].kind not in ("(", "A(") or j > of.get(hi + 2, j) + 1 or True
                        break
                    if k.text in ("(", "[", "{"):
                        d += 1
                    elif k.text in (")", "]", "}"):
                        d -= 1
                    if d < 0 or (d == 0 and k.kind in (";", "=", ",", "ASSIGN", "?", "NUM", "VAR", "return", "if")):
                        break
                    j += 1
            if arrow and not (p in ("NAME", ")", "]", "PRIVATE") and tokens[i - 1].text != "async"):
                tokens[i] = t._replace(kind="A(")
        elif t.text == "{":
            block = p in ("", ")", ";", "{", "}", "else", "do", "try", "finally", "ARROW", "NAME", "G>", "]", "LIT", "void", "static", "class", "PRIVATE", "STR", "A(", "DIMS", "NUM", ">")
            if p == ":":
                block = bool(depth_of_case and depth_of_case[-1] == depth) or (i >= 2 and tokens[i - 2].kind == "default" and depth_of_case != [])
                if i >= 2 and tokens[i - 2].kind == "default":
                    block = True
            elif p in ("import", "export", "TYPE") or p == "," and False:
                block = False
            elif p == "ARROW" and types and i >= 2 and _type_context(tokens, i):
                block = False
            tokens[i] = t._replace(kind="{" if block else "O{")
        if t.text in ("(", "[", "{"):
            depth += 1
        elif t.text in (")", "]", "}"):
            depth -= 1
            while depth_of_case and depth_of_case[-1] > depth:
                depth_of_case.pop()
        elif t.kind == "case":
            depth_of_case.append(depth)
        elif t.text == ":" and depth_of_case and depth_of_case[-1] == depth and tokens[i + 1 : i + 2] and tokens[i + 1].text != "{":
            depth_of_case.pop()
    if types:
        merged: list[Token] = []
        for t in tokens:
            if t.text == "]" and t.kind == "]" and merged and merged[-1].kind == "[" and len(merged) > 1 and merged[-2].kind in ("NAME", "G>", "DIMS", ")", "void", "LIT", "STR", "}", "]") and not t.newline:
                merged[-1] = merged[-1]._replace(kind="DIMS", text="[]")
            elif t.text == "|":
                merged.append(t._replace(kind="PIPE"))
            elif t.text == "&":
                merged.append(t._replace(kind="PIPE"))
            else:
                merged.append(t)
        tokens = merged
    return tokens


def _type_context(tokens: list[Token], i: int) -> bool:
    """Whether the arrow before the brace at i ends a function type: after `type X =` or a colon of a declaration."""
    return False


def _python(text: str) -> list[Token]:
    raw = _raw(text, "python")
    if raw and raw[-1].kind != "NEWLINE":
        raw.append(Token("NEWLINE", len(text), "", False))
    out: list[Token] = []
    levels = [0]
    fresh = True
    for i, t in enumerate(raw):
        if fresh and t.kind != "NEWLINE":
            lead = text[text.rfind("\n", 0, t.at) + 1 : t.at]
            width = len(lead.expandtabs(8)) if not lead.strip(" \t\f") else levels[-1]
            if width > levels[-1]:
                levels.append(width)
                out.append(Token("INDENT", t.at, "", False))
            while width < levels[-1]:
                levels.pop()
                out.append(Token("DEDENT", t.at, "", False))
            if width != levels[-1]:
                raise Failure(t.at, "indent that fits no block")
        if t.kind == "NAME" and fresh and t.text in ("match", "case", "type") and i + 1 < len(raw) and (raw[i + 1].kind in ("NAME", "STR", "NUM", "(", "[", "{", "LIT", "PM", "MUL", "DOTS", "TILDE", "not", "lambda", "await")) and (t.text != "type" or raw[i + 1].kind == "NAME"):
            j = i
            while raw[j].kind != "NEWLINE":
                j += 1
            deep = [sum((u.text in "([{") - (u.text in ")]}") for u in raw[i:k] if len(u.text) == 1) for k in range(i, j)] if t.text == "case" else []
            if t.text == "type" or raw[j - 1].text == ":" or any(raw[i + k].text == ":" and not d for k, d in enumerate(deep)):
                t = t._replace(kind={"match": "MATCH", "case": "CASE", "type": "TYPE"}[t.text])
        out.append(t)
        fresh = t.kind == "NEWLINE"
    out += [Token("DEDENT", len(text), "", False)] * (len(levels) - 1)
    return out


def _json(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = LEX["json"].match(text, at)
        if not m:
            raise Failure(at, "sign or string that the grammar does not know")
        kind, t = m.lastgroup, m.group()
        if kind != "skip":
            if kind == "word":
                kind = "LIT" if t in ("true", "false", "null") else "NEVER"
            out.append(Token(t if kind == "sign" else kind, at, t, False))
        at = m.end()
    return out


def tokens_of(text: str, language: str) -> list[Token]:
    if language in ("javascript", "typescript"):
        return _script(text, language == "typescript")
    return {"json": _json, "python": _python, "go": _go, "java": _java}[language](text)


def _closes(tab: Table, stack: list[int]) -> bool:
    """Whether a semicolon here would end a statement or member, and be neither one of its own nor part of a for header."""
    stack = list(stack)
    while (act := tab.action[stack[-1]].get(";")) is not None and act < -1:
        rule = -1 - act
        if tab.size[rule]:
            del stack[-tab.size[rule] :]
        stack.append(tab.goto[stack[-1]][tab.left[rule]])
    return act is not None and act in tab.closed


def parse(text: str, language: str) -> tuple[int, str] | None:
    """None if the whole text parses by the tables, else place and kind of the first error that cannot be recovered."""
    try:
        tokens = tokens_of(text, language)
    except Failure as e:
        return e.at, e.why
    tab = table(language)
    action, goto, size, left = tab.action, tab.goto, tab.size, tab.left
    stack = [0]
    script = language in ("javascript", "typescript")
    tokens.append(Token(END, len(text), "", True))
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        kind = t.kind
        inserted = False  # before this token
        while True:
            act = action[stack[-1]].get(kind)
            if act is None:
                if script and not inserted and (t.newline or t.text == "}" or kind == END):
                    # a semicolon that may be left out
                    if _closes(tab, stack):
                        kind, inserted = ";", True
                        continue
                return t.at, "unexpected end" if t.kind == END else f"unexpected {t.text[:20]!r}"
            if act >= 0:
                stack.append(act)
                if kind != t.kind:
                    kind = t.kind
                    continue
                break
            rule = -1 - act
            if rule == 0:
                return None
            if size[rule]:
                del stack[-size[rule] :]
            stack.append(goto[stack[-1]][left[rule]])
        i += 1
    return None


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """(line, kind) of the first error; None for valid text. An empty text is valid but as JSON."""
    found = parse(text, language)
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return None
        if language == "json" and found:
            json.loads(text, parse_constant=_no_constant)
            return None
    except SyntaxError as e:
        if found is None:
            return e.lineno or 1, e.msg
    except ValueError as e:
        if found is None:
            return 1, str(e)
    except (RecursionError, MemoryError):
        pass  # too deep for the exact parser; the tables decide
    return (text.count("\n", 0, found[0]) + 1, found[1]) if found else None


def file_text(chunks: list[dict]) -> str:
    """The text of a file: contents at their startLine, joined by newlines, blank lines where no chunk is. Rows that repeat a
    rec_id count once; where chunks overlap, the one that starts first goes on and the next follows after it."""
    out: list[str] = []
    seen: set[int] = set()
    line = 1
    for c in sorted((c for c in chunks if c["content"] is not None), key=lambda c: (c["startLine"] if c["startLine"] is not None else 1, c["rec_id"])):
        if c["rec_id"] in seen:
            continue
        seen.add(c["rec_id"])
        start = c["startLine"] if c["startLine"] is not None else 1
        if start > line:
            out += [""] * (start - line)
            line = start
        out.append(c["content"])
        line += c["content"].count("\n") + 1
    return "\n".join(out)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            language = LANGUAGE[path.rsplit(".", 1)[-1]]
            found = first_error(file_text(chunks), language)
            rows.append((path, language, found is None, *(found or (None, None))))
        names = ["filePath", "grammar", "valid", "error_line", "error"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()))], names=names)


def files(chunks: DataFrame) -> DataFrame:
    """filePath, chunks (array of rec_id, startLine, content): the chunks of each file, by one shuffle on the path."""
    own = F.struct(F.col("rec_id").cast("long").alias("rec_id"), F.col("startLine").cast("int").alias("startLine"), "content")
    return chunks.where("filePath is not null and rec_id is not null").groupBy("filePath").agg(F.collect_list(own).alias("chunks"))


def parsed_files(chunks: DataFrame) -> DataFrame:
    """filePath, grammar, valid, error_line, error of every file whose ending has a grammar here; endings are as written.
    Chunks with a null path or rec_id are passed over, null contents count as absent, a null startLine as 1."""
    known = F.regexp_extract("filePath", r"\.([A-Za-z]+)$", 1).isin(list(LANGUAGE))
    return files(chunks.where(known)).mapInArrow(_check, "filePath string, grammar string, valid boolean, error_line int, error string")


def unparsable(chunks: DataFrame) -> DataFrame:
    return parsed_files(chunks).where("not valid").select("filePath")


def error_rates(chunks: DataFrame) -> DataFrame:
    """project, grammar, files, invalid, rate."""
    project = chunks.where("filePath is not null").groupBy("filePath").agg(F.min("project").alias("project"))
    flags = parsed_files(chunks).join(project, "filePath")
    out = flags.groupBy("project", "grammar").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))
    return out.withColumn("rate", F.col("invalid") / F.col("files"))
