"""Identifiers as column expressions: splitting, terms, names to match, exported symbols, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codemill.settings import ID_TERMS_CHARS

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: A word begins at an upper letter after a lower one or a digit, and at the last upper letter of a run before a lower one;
#: everything that is no cased letter and no number separates.
WORD_BREAK = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[^\p{Ll}\p{Lu}\p{N}]+"
IDENTIFIER = r"(?<![0-9])[\p{L}_$][\p{L}\p{N}_$.]*"
#: Characters that an identifier goes on with when whole identifiers are matched.
RUN = r"[A-Za-z0-9_$]+"


def split_identifier(name: Col) -> Column:
    """Words of an identifier as written; null gives null, a name without letters and digits an empty array."""
    return F.filter(F.split(_c(name), WORD_BREAK), lambda x: x != "")


def identifier_terms(content: Col, limit: int = ID_TERMS_CHARS) -> Column:
    """Each distinct compound identifier of a text, lower-cased, with its words, as far as whole terms fit into limit
    characters; a first term beyond the limit is cut. A text without compound identifiers gives ''."""
    found = F.regexp_extract_all(_c(content), F.lit(f"({IDENTIFIER})"), F.lit(1))
    compound = F.filter(F.transform(found, lambda x: F.struct(x.alias("name"), split_identifier(x).alias("parts"))), lambda x: F.size(x["parts"]) >= 2)
    terms = F.array_distinct(F.transform(compound, lambda x: F.lower(F.concat_ws(" ", x["name"], F.array_join(x["parts"], " ")))))

    def add(acc: Column, term: Column) -> Column:
        joined = F.when(acc.out == "", term).otherwise(F.concat(acc.out, F.lit(" "), term))
        over = F.length(joined) > limit
        out = F.when(acc.full, acc.out).when(over & (acc.out == ""), F.substring(term, 1, limit)).when(over, acc.out).otherwise(joined)
        return F.struct(out.alias("out"), (acc.full | over).alias("full"))

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    return F.when(_c(content).isNull(), F.lit("")).otherwise(F.aggregate(terms, start, add, lambda acc: acc.out))


def query_parts(query: Col) -> Column:
    """Lower-cased words of all identifiers of a query."""
    words = F.filter(F.split(_c(query), r"\s+"), lambda x: x != "")
    parts = F.flatten(F.transform(words, split_identifier))
    return F.coalesce(F.transform(F.filter(parts, lambda x: x.rlike(r"\p{L}|\p{N}")), F.lower), F.array().cast("array<string>"))


def wants_identifier_leg(query: Col, has_column: bool = True) -> Column:
    return F.lit(has_column) & (F.size(query_parts(query)) >= 2)


def bare_name(name: Col) -> Column:
    return F.element_at(F.split(_c(name), r"\."), -1)


def match_names(name: Col) -> Column:
    """The full name and its last segment, once each."""
    return F.array_distinct(F.array(_c(name), bare_name(name)))


def identifier_runs(text: Col) -> Column:
    """Maximal runs of identifier characters, in order, with repeats."""
    return F.regexp_extract_all(_c(text), F.lit(f"({RUN})"), F.lit(1))


def dotted_runs(text: Col) -> Column:
    """Maximal dotted chains of runs (a.b.c), in order, with repeats."""
    return F.regexp_extract_all(_c(text), F.lit(rf"({RUN}(?:\.{RUN})*)"), F.lit(1))


def identifier_lines(content: Col, name: Col, start_line: Col | int = 1) -> Column:
    """array<struct<line, text>> of the lines that hold name as a whole identifier; text is trimmed."""
    lines = F.split(_c(content), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + (F.lit(start_line) if isinstance(start_line, int) else _c(start_line))).cast("int").alias("line"), F.trim(F.regexp_replace(x, "[\r\t]", " ")).alias("text"), x.alias("raw")))
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), F.replace(_c(name), F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![A-Za-z0-9_$])"))
    return F.transform(F.filter(numbered, lambda x: F.regexp_like(x.raw, pattern)), lambda x: F.struct(x.line.alias("line"), x.text.alias("text")))


#: What a chunk begins with in each language when its symbol is visible outside.
EXPORTED = {
    ("javascript", "typescript", "tsx"): r"(^|\n)\s*export(\s+default|\s+type|\s+\*|\s+const|\s+function|\s+class|\s+abstract|\s+interface|\s+enum|\s+async|\s+\{)?\b",
    ("rust",): r"\bpub(\([^)]*\))?\s+(fn|struct|enum|trait|mod|const|static|type)\b",
    ("java", "c_sharp"): r"\bpublic\b",
    ("gdscript",): r"@export\b|\bclass_name\b",
}


def is_exported(name: Col, language: Col, content: Col) -> Column:
    """Whether the first 300 characters show a symbol that is visible outside; a capital in Go; false where text does not tell."""
    head = F.substring(_c(content), 1, 300)
    out = F.when(_c(language) == "go", F.coalesce(_c(name).rlike("^[A-Z]"), F.lit(False)))
    for languages, pattern in EXPORTED.items():
        out = out.when(_c(language).isin(*languages), F.coalesce(head.rlike(pattern), F.lit(False)))
    return out.otherwise(F.lit(False))


def normal_identifier(name: Col) -> Column:
    return F.lower(F.regexp_replace(_c(name), r"[_$\-]", ""))


def edit_distance(a: Col, b: Col, longest: int = 64) -> Column:
    """Levenshtein distance; null (no distance) where either has more than longest characters."""
    return F.when((F.length(_c(a)) <= longest) & (F.length(_c(b)) <= longest), F.levenshtein(_c(a), _c(b)))


def similarity(a: Col, b: Col) -> Column:
    """1 - distance / longer length; 1 for two empty names, 0 where there is no distance."""
    most = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.coalesce(F.when(most == 0, F.lit(1.0)).otherwise(1 - edit_distance(a, b) / most), F.lit(0.0))


def to_camel(name: Col) -> Column:
    """snake_case and kebab-case to camelCase."""
    parts = F.filter(F.split(_c(name), r"[_\-]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000)))), "")
