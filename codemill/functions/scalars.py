"""Small scalar functions: rounding, dates, hashes, sizes, names of tables, budgets, model answers."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codemill.functions.identifiers import Col, _c
from codemill.settings import CHARS_PER_TOKEN, CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_TOKENS, HIT_CHARS, IMPORT_CHARS, OUTLINE_CHARS, PACK_CHARS


def round_up(x: Col, digits: int) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(_c(x) * 10**digits + 0.5) / 10**digits


def day_of_millis(ms: Col) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms).cast("long")), "yyyy-MM-dd")


def content_hash(text: Col) -> Column:
    return F.sha2(_c(text), 256)


def cosine(a: Col, b: Col) -> Column:
    """In double precision; 0 where either norm is 0; null where either is null or the lengths differ."""
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return F.when(F.size(x) == F.size(y), F.when(norm == 0, 0.0).otherwise(dot / norm))


def squared_distance(a: Col, b: Col) -> Column:
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def estimated_tokens(text: Col) -> Column:
    return F.ceil(F.length(_c(text)) / F.lit(CHARS_PER_TOKEN)).cast("int")


def effective_chunk_chars(most: int = CHUNK_CHARS, tokens: int = CHUNK_TOKENS) -> int:
    return min(most, tokens * CHARS_PER_TOKEN) if tokens > 0 else most


def chunk_step(most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> int:
    return max(1, most - overlap)


def table_name(project: Col) -> Column:
    """A project's table: its name with everything but letters, digits and _ made _, behind idx_."""
    return F.concat(F.lit("idx_"), F.regexp_replace(_c(project), "[^A-Za-z0-9_]", "_"))


def stored_table_name(project: Col, stored: Col) -> Column:
    """The name that the registry has, else the derived one."""
    return F.coalesce(F.when(_c(stored) != "", _c(stored)), table_name(project))


def format_bytes(n: Col) -> Column:
    x = _c(n).cast("double")
    unit = lambda d, name: F.concat(F.format_string("%.1f", x / d), F.lit(name))
    return F.when(x < 1024, F.concat(x.cast("long").cast("string"), F.lit(" B"))).when(x < 1024**2, unit(1024, " KB")).when(x < 1024**3, unit(1024**2, " MB")).otherwise(unit(1024**3, " GB"))


def model_tag_present(tag: Col, served: Col) -> Column:
    """A model is served under its tag, or under tag:latest where it has no tag of its own."""
    return F.array_contains(_c(served), _c(tag)) | (~F.contains(_c(tag), F.lit(":")) & F.array_contains(_c(served), F.concat(_c(tag), F.lit(":latest"))))


def joined_length(lines: Col) -> Column:
    """Characters of an array of lines joined by newlines; 0 for null."""
    return F.coalesce(F.length(F.array_join(_c(lines), "\n")), F.lit(0))


def result_size(content: Col, before: Col | None = None, after: Col | None = None) -> Column:
    size = F.coalesce(F.length(_c(content)), F.lit(0)) + HIT_CHARS
    for context in (before, after):
        if context is not None:
            size = size + joined_length(context)
    return size


def outline_size(outline: Col) -> Column:
    """Of an array of structs with symbolName and symbolType."""
    return F.coalesce(F.aggregate(_c(outline), F.lit(0), lambda s, o: s + F.coalesce(F.length(o.symbolName), F.lit(0)) + F.coalesce(F.length(o.symbolType), F.lit(0)) + OUTLINE_CHARS), F.lit(0))


def imports_size(imports: Col) -> Column:
    """Of an array of structs with raw and path."""
    return F.coalesce(F.aggregate(_c(imports), F.lit(0), lambda s, o: s + F.coalesce(F.length(o.raw), F.lit(0)) + F.coalesce(F.length(o.path), F.lit(0)) + IMPORT_CHARS), F.lit(0))


def pack_entry_size(content: Col, outline: Col, imports: Col) -> Column:
    return result_size(content) + outline_size(outline) + imports_size(imports) + PACK_CHARS


def yes_probability(logprobs: Col, otherwise: float | None = 0.5) -> Column:
    """Softmax of the best yes against the best no of array<struct<token, logprob>>; otherwise where neither is there."""
    best = lambda word: F.array_max(F.transform(F.filter(_c(logprobs), lambda t: F.lower(F.trim(t.token)) == word), lambda t: t.logprob))
    yes, no = F.coalesce(F.exp(best("yes")), F.lit(0.0)), F.coalesce(F.exp(best("no")), F.lit(0.0))
    return F.when(yes + no > 0, yes / (yes + no)).otherwise(F.lit(otherwise).cast("double"))


_REF = re.compile(r"^(?!-)(?!.*\.\.)(?!.*@\{)[A-Za-z0-9_][A-Za-z0-9_./@^~+\-]*$")


def safe_git_ref(ref: str) -> str:
    """The ref, if it can be handed to git; else ValueError."""
    if not ref or len(ref) > 255 or not _REF.match(ref):
        raise ValueError(f"not a valid git ref: {ref!r}")
    return ref


def is_within(path: str, folder: str) -> bool:
    path, folder = posixpath.normpath(path), posixpath.normpath(folder)
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def overlap_note(new: str, others: dict[str, str]) -> str | None:
    """Says that a path lies in, or holds, the folder of another project."""
    for name, path in sorted(others.items()):
        if new != path and is_within(new, path):
            return f"{new} lies inside project {name} ({path})"
        if new != path and is_within(path, new):
            return f"{new} contains project {name} ({path})"
    return None


def first_json_object(text: str) -> dict | None:
    """The first balanced {...} of a text that is JSON; braces in strings do not count."""
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, skip = not (c == '"' and not skip), c == "\\" and not skip
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        found = json.loads(text[start : i + 1])
                    except ValueError:
                        break
                    return found if isinstance(found, dict) else None
    return None


def expansion_variants(answer: str, query: str, most: int = 3) -> list[str]:
    """Variants of a query out of a model's answer {"variants": [...]}: trimmed, none equal to the query or to another but for
    case and blanks, at most most; [] for an answer that is not of this form."""
    found = first_json_object(answer) or {}
    seen, out = {" ".join(query.lower().split())}, []
    for v in found.get("variants", []) if isinstance(found.get("variants"), list) else []:
        if isinstance(v, str) and v.strip() and (key := " ".join(v.lower().split())) not in seen:
            seen.add(key)
            out.append(v.strip())
    return out[:most]


def align_to_code_points(text: str) -> str:
    """The text with lone surrogates replaced; cuts are by code points here, so no pair is ever split."""
    return re.sub("[\ud800-\udfff]", "�", text)
