"""The scalar functions under names for SQL. Those that are expressions stay expressions: the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from codemill.functions.predicates import DOC_SUFFIX, ENTRY_STEMS, GENERATED_SEGMENT, GENERATED_SUFFIX
from codemill.functions.identifiers import IDENTIFIER, RUN, WORD_BREAK
from codemill.functions.signatures import derive_signature, parameters

_TEST = r"^test_|_test\.[a-z0-9]+$|\.(test|spec)\.[a-z0-9]+$"


def _text(pattern: str) -> str:
    return "r'" + pattern + "'"


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and gives their names."""
    base = r"element_at(split(translate(path, '\\', '/'), '/'), -1)"
    expressions = {
        "split_identifier(name STRING) RETURNS ARRAY<STRING>": f"filter(split(name, {_text(WORD_BREAK)}), x -> x <> '')",
        "identifiers(content STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(content, {_text('(' + IDENTIFIER + ')')}, 1)",
        "identifier_runs(content STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(content, {_text('(' + RUN + ')')}, 1)",
        "bare_name(name STRING) RETURNS STRING": r"element_at(split(name, '\\.'), -1)",
        "normal_identifier(name STRING) RETURNS STRING": f"lower(regexp_replace(name, {_text('[_$-]')}, ''))",
        "is_test_file(path STRING) RETURNS BOOLEAN": f"lower({base}) rlike {_text(_TEST)} or translate(path, '\\\\', '/') rlike '(^|/)(tests?|__tests?__|spec)/'",
        "is_entry_point(path STRING) RETURNS BOOLEAN": f"lower(regexp_replace({base}, {_text('(?<=.)[.][^.]*$')}, '')) in ({', '.join(repr(s) for s in ENTRY_STEMS)})",
        "is_generated_path(path STRING) RETURNS BOOLEAN": f"path rlike {_text(GENERATED_SEGMENT)} or path rlike {_text(GENERATED_SUFFIX)}",
        "is_document(path STRING) RETURNS BOOLEAN": f"path rlike {_text(DOC_SUFFIX)}",
        "round_up(x DOUBLE, digits INT) RETURNS DOUBLE": "floor(x * power(10, digits) + 0.5) / power(10, digits)",
        "content_hash(content STRING) RETURNS STRING": "sha2(content, 256)",
    }
    for head, body in expressions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("derive_signature", derive_signature, "string")
    spark.udf.register("signature_parameters", parameters, "array<string>")
    return sorted([*(h.split("(")[0] for h in expressions), "derive_signature", "signature_parameters"])
