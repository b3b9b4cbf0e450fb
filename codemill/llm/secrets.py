"""Problem 7: credentials in source code, settings and key files.

Method: settings (env, toml, yaml, json) are parsed into key paths with byte offsets; source text gives names with the
literals that they are set to. A value counts if its key name is sensitive and its shape is that of a secret, or if its shape
alone tells (provider tokens, addresses with a password, authorization headers, private key blocks), or if it stands where a
call or a note about a login has the password. Redactions are spliced into the original bytes, so that everything else stays
as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Entry(NamedTuple):
    path: str
    key: str
    value: str
    spans: list[tuple[int, int]]  # of the value's parts in the text, in characters


class Secret(NamedTuple):
    kind: str
    path: str
    spans: list[tuple[int, int]]


PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Name parts that make a key sensitive, alone or before "key" and "id".
SENSITIVE = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "apikey", "jwt", "bearer", "auth", "authorization", "credential", "credentials", "pat", "pswd", "creds"}
#: The word for a password in other languages, without accents.
SENSITIVE |= {"kennwort", "passwort", "losungswort", "zugangscode", "motdepasse", "passe", "mdp", "contrasena", "contrasenya", "clave", "senha", "parola", "wachtwoord", "losenord", "passord", "adgangskode", "kodeord", "salasana", "haslo", "heslo", "jelszo", "lozinka", "geslo", "sifre", "parol"}
BEFORE_KEY = {"api", "aws", "cloud", "service", "access", "secret", "private", "salt", "signing", "encryption", "master", "storage", "account", "client", "server", "deploy", "session", "cookie", "hmac", "webhook", "stripe", "license", "crypt", "auth", "app", "admin"}
#: A name that ends so speaks about a secret and does not hold one.
NOT_LAST = {"file", "path", "dir", "url", "uri", "name", "type", "length", "len", "count", "ttl", "expiry", "expires", "header", "field", "label", "hint", "prompt", "policy", "hash", "sum", "checksum", "public", "ref", "size", "id", "timeout", "format", "regex", "pattern"}
#: A key that ends so, under a key that holds secrets, is about the secret or its owner.
ABOUT = {"user", "username", "email", "mail", "host", "hostname", "port", "region", "issuer", "audience", "scope", "scopes", "algorithm", "alg", "version", "kid", "date", "time", "at", "created", "updated", "rotated", "integrity", "resolved", "endpoint", "project", "image", "digest", "fingerprint", "prefix", "suffix", "kind", "description", "comment", "note", "owner", "revision", "commit", "provider", "store", "mount"}

STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\\n]|\\.)*`'
LITERAL = re.compile(STRING)
ASSIGNED = re.compile(
    rf"""(?<![\w.$\-])(?P<key>[A-Za-z_$][\w.$\-]*)["'`]?\]?(?:\s*(?::[ \t]*(?P<type>[A-Za-z_][\w<>\[\] |]*?)=|:=|=>|==?|:)\s*|[ \t]*,[ \t]*)(?P<open>\(\s*)?"""
    rf"""(?P<value>(?:{STRING})(?:(?:\s*\+\s*|[ \t]*(?:\\\r?\n[ \t]*)?|(?(open)\s*))(?:{STRING}))*)"""
)
LOOSE = re.compile(r"""(?P<key>[A-Za-z_][\w.\-]*)\s*(?::=|=|:)\s*(?P<value>[^\s"'`(){}\[\];,<>]{8,})""")
COMMENT = re.compile(r"(?:^|\s)(?://|#|\*|--|<!--)\s?")
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9+/_\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abprs]-[A-Za-z0-9\-]{20,}|[sr]k_(?:live|prod)_[A-Za-z0-9]{16,}"
    r"|npm_[A-Za-z0-9]{30,}|glpat-[\w\-]{18,}|AIza[\w\-]{35}|eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{16,})(?![A-Za-z0-9+/_\-=])"
)
ADDRESS = re.compile(r"(?<=[a-z0-9+.\-])://[^\s:/@\"'`<>]*:(?P<value>[^\s/@\"'`<>]+)@[\w.\-]")
HEADER = re.compile(r"(?i)\b(?:basic|bearer|token)[ \t]+(?P<value>[A-Za-z0-9+/=_.\-]{12,})")
#: The password of a call that takes it by position, after a place and an account or after an account.
_ARGUMENT = rf"(?:(?:{STRING})|[\w.$]+)\s*,\s*"
CALL = re.compile(
    rf"(?i)(?:\b|_)(?:(?:re)?connect(?:_?(?:to|async|sync))?|log_?[io]n|sign_?in|auth(?:enticate|orize)?|basic_?auth|credentials?)\(\s*(?P<args>{_ARGUMENT}(?:{_ARGUMENT})?)"
    rf"(?P<value>(?:{STRING})(?:(?:\s*\+\s*|[ \t]+)(?:{STRING}))*)"
)
#: A note of a login: account / password.
LOGIN = re.compile(r"(?i)\b(?:log[ \-]?[io]n|sign[ \-]?in|credentials?|creds)\b[^\n/\"'`]{0,60}?[\w.@\-]+[ \t]+/[ \t]+(?P<value>[^\s\"'`]+)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"(?:\s|\\n|\\r|[\"'`+,;]|[A-Z][\w\-]*:[^\n]*\n)*[A-Za-z0-9+/=]{40,}")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PLACEHOLDER = re.compile(
    r"(?i)^\s*$|[<>]|\$\{|\{\{|\$\(|%\(|^\$|^%\w+%$|^(?:/|\./|\.\./|~/|file:|vault:|env:|secret:|ssm:|arn:|op://|https?://|kms:|sops)|example|sample|placeholder|changeme|change_me|change-me|replace|dummy|redact"
    r"|your[_\-]|insert|todo|fixme|not[_\-]?set|set[_\-]in|xxxx|\*{3}|\.{3}|^(?:none|null|nil|true|false|undefined|empty|test|secret|password|token)$|process\.env|os\.environ|getenv|lookup\(|^data:|^sha\d+[:-]"
)
PLAIN = re.compile(r"^(?:[a-zA-Z]+|[\d.,:]+[a-zA-Z]{0,3}|[a-z]+(?:[ _./\-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*)$")


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall("".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)))]


def sensitive(name: str) -> bool:
    """Whether a key of this name is one that holds a secret."""
    parts = name_parts(name.rsplit(".", 1)[-1])
    if not parts:
        return False
    if parts[-1] == "id" and parts[-2:-1] == ["key"]:
        parts = parts[:-1]  # access_key_id
    if parts[-1].isdigit():
        parts = parts[:-1] or parts
    if parts[-1] in NOT_LAST:
        return False
    if parts[-1] in SENSITIVE or (len(parts) > 1 and parts[-2] == "secret"):
        return True
    return parts[-1] == "key" and any(p in BEFORE_KEY or p in SENSITIVE for p in parts[:-1])


def under_sensitive(path: tuple[str, ...]) -> bool:
    """Whether a value at this path of a settings file is one of a key that holds a secret: its own key or, unless a nearer one
    speaks about a secret, one above it."""
    for name in reversed(path):
        if sensitive(name) or (name[-1:] in ("s", "S") and sensitive(name[:-1])):  # a list has its key in the plural
            return True
        if (parts := name_parts(name.rsplit(".", 1)[-1])) and parts[-1] in NOT_LAST | ABOUT:
            return False
    return False


def _random_key(v: str) -> bool:
    """Whether a value that begins as a path does is base64 of random bytes: no parts that are words, and letters of either
    case and digits in turn."""
    if not re.fullmatch(r"/[A-Za-z0-9+/]{23,}={0,2}", v) or any(re.fullmatch(r"[a-z]{3,}|[A-Z][a-z]{2,}", p) for p in re.split(r"[/+]", v)):
        return False
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in v]
    return {"d", "u", "l"} <= set(kinds) and sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.4 * len(v)


def secret_shape(value: str) -> bool:
    """Whether the value looks random or like a password, and not like a word, number, path, reference or placeholder."""
    v = value.strip()
    if v[:1] == "/" and _random_key(v):
        v = v[1:]
    if len(v) < 8 or PLACEHOLDER.search(v) or PLAIN.match(v) or re.search(r"\s", v):
        return False
    if len(set(v)) < 5:
        return False
    digits, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    if digits and (lower or upper):
        return True
    return len(v) >= 16 and lower and upper and len(set(v)) >= 10 and bool(re.search(r"[+/=_\-]|[a-z][A-Z][a-z]?[A-Z]", v))


def _joined(text: str, lo: int, hi: int) -> tuple[str, list[tuple[int, int]]]:
    spans = [(m.start() + 1, m.end() - 1) for m in LITERAL.finditer(text, lo, hi)]
    return "".join(text[a:b] for a, b in spans), spans


YAML_LINE = re.compile(r"^(?P<lead>[ \t]*(?:-[ \t]+)*)(?:(?P<key>[\w.\-]+|\"[^\"\n]+\"|'[^'\n]+')[ \t]*:(?:[ \t]+(?P<value>[^\n]*?))?|(?P<item>[^\s#\-][^\n]*?|-[^\s\-][^\n]*?))[ \t\r]*$", re.M)
PAIR_LINE = re.compile(r"^[ \t]*(?:export[ \t]+)?(?P<key>[\w.\-]+|\"[^\"\n]+\")[ \t]*=[ \t]*(?P<value>[^\n]*?)[ \t\r]*$|^[ \t]*\[+(?P<section>[^\]\n]+)\]+", re.M)
FLOW = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|(?<!\S)#[^\n]*|[{}\[\],]|[^\s{}\[\],"\']+')
SEPARATOR = {":": re.compile(r"\s*:"), "=": re.compile(r"\s*=")}
BLOCK_SCALAR = re.compile(r"[|>][+\-\d]*(?:\s+#.*)?$")


def _scalar(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The span of a scalar without its quotes and a comment after it."""
    if lo < hi and text[lo] in "\"'":
        end = text.find(text[lo], lo + 1, hi)
        return (lo + 1, end) if end > 0 else (lo + 1, hi)
    m = re.compile(r"\s#").search(text, lo, hi)
    return lo, len(text[: m.start() if m else hi].rstrip()) if m else hi


def _flow(text: str, at: int, path: tuple[str, ...], sign: str, found: list[tuple[tuple[str, ...], int, int]]) -> int:
    """Values of the map or list that begins at `at`, with their key paths; elements of a list have the path of the list. The
    place after its end."""
    stack: list[tuple[str, ...]] = []
    own = path
    for m in FLOW.finditer(text, at):
        t = m.group()
        if t in ("{", "["):
            stack.append(own)
        elif t in ("}", "]"):
            if stack:
                stack.pop()
            if not stack:
                return m.end()
            own = stack[-1]
        elif t == ",":
            own = stack[-1] if stack else path
        elif t == sign or t.startswith("#"):
            continue
        else:
            quoted = t[0] in "\"'"
            lo, hi = (m.start() + 1, m.end() - 1) if quoted else m.span()
            if not quoted and t.endswith(sign):
                own = (stack[-1] if stack else path) + (t[:-1],)
            elif SEPARATOR[sign].match(text, m.end()):
                own = (stack[-1] if stack else path) + (text[lo:hi],)
            else:
                found.append((own, lo, hi))
    return len(text)


def config_entries(text: str, kind: str) -> Iterator[tuple[tuple[str, ...], Entry]]:
    """Key paths of a settings file with the places of their values, elements of lists too. kind: env, toml, yaml, json."""
    found: list[tuple[tuple[str, ...], int, int]] = []
    past = 0
    if kind == "json":
        while past < len(text):
            past = _flow(text, past, (), ":", found)
    elif kind == "yaml":
        levels: list[tuple[int, str]] = []
        open_key = False  # the last key has its value on the lines after it
        for m in YAML_LINE.finditer(text):
            if m.start() < past:
                continue
            indent = len(m["lead"].expandtabs())
            listed = "-" in m["lead"]
            if m["key"]:
                while levels and levels[-1][0] >= indent:
                    levels.pop()
                levels.append((indent, m["key"].strip("\"'")))
                open_key = not m["value"] or m["value"].startswith("#") or bool(BLOCK_SCALAR.match(m["value"]))
                part = "value"
            else:
                while levels and levels[-1][0] >= indent:
                    levels.pop()
                part = "item"
                if not listed and not open_key and m["item"][0] not in "{[":
                    continue
            path = tuple(k for _, k in levels)
            if m["key"] and open_key:
                continue
            if m[part][0] in "{[" and not m[part].startswith("{{"):
                past = _flow(text, m.start(part), path, ":", found)
            else:
                found.append((path, *_scalar(text, m.start(part), m.end(part))))
    else:
        section: tuple[str, ...] = ()
        for m in PAIR_LINE.finditer(text):
            if m.start() < past:
                continue
            if m["section"]:
                section = tuple(m["section"].strip().split("."))
            elif m["value"]:
                path = (*section, m["key"].strip('"'))
                if kind == "toml" and m["value"][0] in "{[":
                    past = _flow(text, m.start("value"), path, "=", found)
                elif kind == "toml" and m["value"][:3] in ('"""', "'''"):
                    end = text.find(m["value"][:3], m.start("value") + 3)
                    past = len(text) if end < 0 else end
                    body = text[m.start("value") + 3 : past]
                    lo = m.start("value") + 3 + len(body) - len(body.lstrip())
                    found.append((path, lo, lo + len(body.strip())))
                else:
                    found.append((path, *_scalar(text, m.start("value"), m.end("value"))))
    for path, lo, hi in found:
        yield path, Entry(".".join(path), path[-1] if path else "", text[lo:hi], [(lo, hi)])


def source_entries(text: str) -> Iterator[Entry]:
    """Names and the literals that they are set to, on their line or after it; loose name = value pairs in comments too."""
    for m in ASSIGNED.finditer(text):
        key = m["key"]
        if m["type"] and not sensitive(key) and sensitive(m["type"].rstrip()):  # if x: token = "..."
            key = m["type"].rstrip()
        if sensitive(key) or "://" in m["value"] or m["value"].count(m["value"][0]) > 2:
            value, spans = _joined(text, m.start("value"), m.end("value"))
            yield Entry(key, key, value, spans)
    done = 0
    for c in COMMENT.finditer(text):
        if c.end() <= done:
            continue
        done = text.find("\n", c.end() - 1)
        done = len(text) if done < 0 else done
        for m in LOOSE.finditer(text, c.end(), done):
            v = m["value"].rstrip(".,")
            yield Entry(m["key"], m["key"], v, [(m.start("value"), m.start("value") + len(v))])


KINDS = {"env": "env", "toml": "toml", "ini": "toml", "cfg": "toml", "properties": "env", "yml": "yaml", "yaml": "yaml", "json": "json"}


def find_secrets(text: str, path: str | None = None) -> list[Secret]:
    """Secrets of a text in order of their place; overlapping finds are one."""
    found: list[Secret] = []
    kind = KINDS.get((path or "").rsplit(".", 1)[-1].lower())
    settings = [(e, under_sensitive(p)) for p, e in config_entries(text, kind)] if kind else []
    for e, tells in [*settings, *((e, sensitive(e.key)) for e in source_entries(text))]:
        if tells and secret_shape(e.value):
            found.append(Secret("named", e.path, e.spans))
        elif len(e.spans) > 1 and (PROVIDER.search(e.value) or ADDRESS.search(e.value)) and not PLACEHOLDER.search(e.value.rpartition("://")[2]):
            found.append(Secret("token", e.path, e.spans))
    for m in PROVIDER.finditer(text):
        if not re.search(r"(?i)example|xxxx|0000000|1234567|abcdefg", m.group()):
            found.append(Secret("token", "", [m.span()]))
    for m in ADDRESS.finditer(text):
        v = m["value"]
        if not (PLACEHOLDER.search(v) or re.match(r"[$%{*]", v) or v.lower() in ("password", "pass", "pwd", "secret", "user") or len(v) < 4):
            found.append(Secret("address", "", [m.span("value")]))
    for m in HEADER.finditer(text):
        if secret_shape(m["value"]):
            found.append(Secret("header", "", [m.span("value")]))
    for m in CALL.finditer(text):
        value, spans = _joined(text, m.start("value"), m.end("value"))
        by_place = "connect" in text[m.start() : m.start("args")].lower()
        if secret_shape(value) and (not by_place or len(re.findall(_ARGUMENT, m["args"])) == 2):
            found.append(Secret("login", "", spans))
    for m in LOGIN.finditer(text):
        v = m["value"].rstrip(".,;)")
        if secret_shape(v):
            found.append(Secret("login", "", [(m.start("value"), m.start("value") + len(v))]))
    for m in PEM.finditer(text):
        if PEM_BODY.match(text, m.end()):
            end = PEM_END.search(text, m.end())
            found.append(Secret("private key", "", [(m.start(), end.end() if end else len(text))]))
    out: list[Secret] = []
    until = -1
    for s in sorted(found, key=lambda s: (s.spans[0][0], -s.spans[-1][1])):
        if s.spans[0][0] >= until:
            out.append(s)
        until = max(until, s.spans[-1][1])
    return out


MASK = b"[REDACTED]"


def redact(text: str, secrets: list[Secret]) -> str:
    """The text with each secret masked, spliced on its bytes. Lines of a private key stay lines; only the first part of a
    value in several parts takes the mask."""
    data, at, out = text.encode(), 0, []
    place = 0
    done = 0
    for s in secrets:
        for n, (lo, hi) in enumerate(s.spans):
            a = place + len(text[done:lo].encode())
            b = a + len(text[lo:hi].encode())
            place, done = b, hi
            out.append(data[at:a])
            if s.kind == "private key":
                lines = data[a:b].split(b"\n")
                out.append(b"\n".join([MASK] + [b""] * (len(lines) - 1)))
            else:
                out.append(MASK if n == 0 else b"")
            at = b
    return b"".join([*out, data[at:]]).decode()


_NAMES = ["rec_id", "line_no", "kind", "key_path", "byte_start", "byte_end"]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rec, path, text, first in zip(*(c.to_pylist() for c in batch.columns)):
            for s in find_secrets(text, path) if text else []:
                lo, hi = s.spans[0][0], s.spans[-1][1]
                start = len(text[:lo].encode())
                rows.append((rec, (1 if first is None else first) + text.count("\n", 0, lo), s.kind, s.path, start, start + len(text[lo:hi].encode())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _TYPES)], names=_NAMES)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rec, path, text = (c.to_pylist() for c in batch.columns)
        found = [find_secrets(t, p) if t else [] for t, p in zip(text, path)]
        clean = [redact(t, f) if f else t for t, f in zip(text, found)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["rec_id", "content", "redactions"])


def _source(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select(F.col("rec_id").cast("long").alias("rec_id"), "filePath", "content", *(F.col(c).cast("int").alias(c) for c in more))


def secrets(chunks: DataFrame) -> DataFrame:
    """rec_id, line_no, kind, key_path, byte_start, byte_end of every secret; the places are in the UTF-8 bytes of content.
    Null and empty contents have none, a null startLine counts as 1, a null path is that of source code. Repeated rows count
    once."""
    found = _source(chunks, "startLine").mapInArrow(_scan, "rec_id long, line_no int, kind string, key_path string, byte_start long, byte_end long")
    return found.distinct()


def secret_lines(chunks: DataFrame) -> DataFrame:
    """rec_id, line_no: lines with a secret; one of several lines counts at its first."""
    return secrets(chunks).select("rec_id", "line_no").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """rec_id, content with secrets masked, redactions: one row for each row of chunks."""
    return _source(chunks).mapInArrow(_mask, "rec_id long, content string, redactions int")
