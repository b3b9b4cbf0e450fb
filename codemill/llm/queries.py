"""The registered queries of the problems of TESTDATA.md, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codemill.llm import documented, handwritten, leakage, near_duplicates, nearest_vectors, parsing, secrets, splitting, tokenizing, toxicity
from codemill.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def _on_chunks(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "code_records"))


def _on_documents(operator: Callable[..., DataFrame], *more: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in ("documents", *more)))


QUERIES: dict[str, Query] = {
    "p1_found": _on_chunks(near_duplicates.near_duplicate_pairs),
    "p2_found": _on_chunks(splitting.oversized),
    "p3_found": _on_chunks(handwritten.not_handwritten),
    "p4_found": _on_chunks(parsing.unparsable),
    "p4_rates": _on_chunks(parsing.error_rates),
    "p5_found": _on_chunks(nearest_vectors.neighbour_pairs),
    "p6_found": _on_chunks(lambda chunks: documented.documented_functions(chunks).select("rec_id", "func_name").distinct()),
    "p7_found": _on_chunks(secrets.secret_lines),
    "p8_ids": _on_documents(tokenizing.encode),
    "p9_found": _on_documents(leakage.leaked, "eval_items"),
    "p10_found": _on_documents(toxicity.toxic, "doc_labels"),
    "p10_rates": _on_documents(toxicity.rates, "doc_labels"),
}


_P1 = """
WITH toks AS (SELECT rec_id, regexp_extract_all(lower(any_value(content)), '[a-z0-9_]+') AS t FROM code_records WHERE content IS NOT NULL GROUP BY rec_id),
sh AS (SELECT DISTINCT rec_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS s FROM (SELECT rec_id, t, unnest(range(1, len(t) - 1)) AS i FROM toks WHERE len(t) >= 30)),
n AS (SELECT rec_id, count(*) AS k FROM sh GROUP BY rec_id),
both_ AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.rec_id < b.rec_id GROUP BY 1, 2)
SELECT rec_a, rec_b FROM both_ JOIN n na ON na.rec_id = rec_a JOIN n nb ON nb.rec_id = rec_b WHERE both_.k / (na.k + nb.k - both_.k) >= 0.6
"""

_P2 = "SELECT DISTINCT rec_id FROM code_records WHERE length(content) > 1500"

_P5 = """
WITH v AS (
  SELECT DISTINCT 'vector' AS field, rec_id, CAST(vector AS DOUBLE[]) AS x FROM code_records WHERE len(vector) = 64
  UNION ALL SELECT DISTINCT 'doc_vector', rec_id, CAST(doc_vector AS DOUBLE[]) FROM code_records WHERE len(doc_vector) = 64),
u AS (SELECT field, rec_id, x::DOUBLE[64] AS x FROM v WHERE list_sum(list_transform(x, lambda y: abs(y))) > 0),
r AS (SELECT a.field, a.rec_id AS a, b.rec_id AS b, row_number() OVER (PARTITION BY a.field, a.rec_id ORDER BY array_cosine_similarity(a.x, b.x) DESC, b.rec_id) AS k
  FROM u a JOIN u b ON a.field = b.field AND a.rec_id <> b.rec_id)
SELECT DISTINCT field, least(a, b) AS rec_a, greatest(a, b) AS rec_b FROM r WHERE k <= 5
"""

_P9 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(t[i : i + 7], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM d WHERE len(t) >= 8)),
er AS (SELECT DISTINCT item_id, array_to_string(t[i : i + 7], ' ') AS run FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM e WHERE len(t) >= 8))
SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (run)
"""

SQL: dict[str, str] = {"p1_found": _P1, "p2_found": _P2, "p5_found": _P5, "p9_found": _P9}
