"""The registered queries over the engine's operators, each over whole tables, and SQL that gives the same rows.

Where SQL cannot say what an operator does there is none; tests compare those with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemill.functions import identifiers, predicates, scalars, signatures
from codemill.operators import chunking, code_graph, conformance, imports, ranking, reports, search
from codemill.sources import chunk_table, history, registry
from codemill.storage import table
from codemill.streaming import operators as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of (table by name) under a name."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return function

    return register


#: SQL of repeated rows once.
_ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY indexedAt DESC) AS _n FROM code_records WHERE rec_id IS NOT NULL) WHERE _n = 1)"
_ASKED = "(SELECT DISTINCT project AS scope, trim(query) AS text FROM query_log WHERE trim(query) <> '')"


def _bm25_sql(name: str, column: str, asked: str = "asked", text: str = "text", tokens: str = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')") -> str:
    own, terms = tokens.format(column), tokens.format(text)
    return f"""
{name}_d AS (SELECT project AS scope, rec_id AS id, t, len(t) AS dl FROM (SELECT project, rec_id, {own} AS t FROM c WHERE {column} IS NOT NULL) WHERE len(t) > 0),
{name}_p AS (SELECT scope, id, dl, term, count(*) AS tf FROM (SELECT scope, id, dl, unnest(t) AS term FROM {name}_d) GROUP BY ALL),
{name}_s AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM {name}_d GROUP BY scope),
{name}_f AS (SELECT scope, term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_q AS (SELECT DISTINCT q_scope, text, term FROM (SELECT scope AS q_scope, text, unnest({terms}) AS term FROM {asked})),
{name} AS (SELECT q_scope, q.text, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_q q JOIN {name}_p p ON p.term = q.term AND (q_scope IS NULL OR q_scope = p.scope) JOIN {name}_f f ON f.scope = p.scope AND f.term = p.term JOIN {name}_s s ON s.scope = p.scope GROUP BY ALL)"""


_C = f"c AS (SELECT * FROM {_ONCE}), asked AS (SELECT * FROM {_ASKED})"


def _chunks(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("code_records")


@_query("bm25_search", f"WITH {_C},{_bm25_sql('b', 'content')} SELECT q_scope AS scope, text, id AS rec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_scope, text ORDER BY round(score, 9) DESC, id) AS rank FROM b) WHERE rank <= 10")
def _bm25(t):
    asked = search.distinct_queries(t("query_log"))
    docs = search.current(_chunks(t), "project", "content").where("content is not null").select(F.col("project").alias("scope"), F.col("rec_id").alias("id"), F.col("content").alias("text"))
    hits = ranking.top(ranking.bm25(asked, docs), 10, F.round("score", 9).desc())
    return hits.join(asked, "query_id").select("scope", "text", F.col("id").alias("rec_id"), "rank", F.round("score", 6).alias("score"))


_LEG = "SELECT q_scope, text, '{0}' AS leg, {1} AS leg_ord, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY q_scope, text ORDER BY round(score, 9) DESC, id) AS rank FROM {0}) WHERE rank <= 15"
_SPLIT = "regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
_PARTS = f"asked2 AS (SELECT scope, text, array_to_string(regexp_extract_all(lower({_SPLIT}), '[a-z0-9]+'), ' ') AS parts FROM asked WHERE len(regexp_extract_all({_SPLIT}, '[a-zA-Z0-9]+')) >= 2)"
_FACTOR = """((1 + 0.1 * (1 - least(1.0, ln(1 + length(rel)) / ln(161))))
  * CASE WHEN regexp_matches(rel, '^(src|lib|app)(/|$)') THEN 1.05 ELSE 1.0 END
  * CASE WHEN regexp_matches(lower(regexp_extract(rel, '[^/]*$')), '^test_|_test\\.[a-z0-9]+$|\\.(test|spec)\\.[a-z0-9]+$') OR regexp_matches(rel, '(^|/)(tests?|__tests?__|spec)/') THEN 0.85 ELSE 1.0 END
  * CASE WHEN regexp_matches(rel, '(^|/)(gen|dist|build|vendor|node_modules)(/|$)|\\.pb\\.go$|\\.min\\.[a-z0-9]+$') THEN 0.8 ELSE 1.0 END)"""
_REL = "CASE WHEN starts_with(filePath, path || '/') THEN substr(filePath, length(path) + 2) ELSE filePath END"


@_query(
    "hybrid_search",
    f"""WITH {_C}, {_PARTS},{_bm25_sql('content', 'content')},{_bm25_sql('doc', 'doc')},{_bm25_sql('id_terms', 'id_terms', 'asked2', 'parts')},
legs AS ({_LEG.format('content', 1)} UNION ALL {_LEG.format('doc', 3)} UNION ALL {_LEG.format('id_terms', 4)}),
native AS (SELECT q_scope, text, id, max(score) AS score FROM (SELECT * FROM content UNION ALL SELECT * FROM doc UNION ALL SELECT * FROM id_terms) GROUP BY ALL),
alive AS (SELECT q_scope, text, count(DISTINCT leg) AS alive FROM legs GROUP BY ALL),
f AS (SELECT q_scope, text, id, sum(1.0 / (60 + rank)) AS score, min(leg_ord * 1000 + rank) AS first, bool_or(leg = 'doc') AS doc_hit FROM legs GROUP BY ALL),
g AS (SELECT f.q_scope, f.text, f.id, f.first, f.doc_hit, alive > 1 AS is_rrf, {_REL} AS rel, f.score AS rrf, n.score AS nat FROM f JOIN alive a ON a.q_scope IS NOT DISTINCT FROM f.q_scope AND a.text = f.text
  JOIN native n ON n.q_scope IS NOT DISTINCT FROM f.q_scope AND n.text = f.text AND n.id = f.id JOIN c ON c.rec_id = f.id LEFT JOIN (SELECT name, any_value(path) AS path FROM project_indexes GROUP BY name) r ON r.name = c.project),
h AS (SELECT *, CASE WHEN is_rrf THEN rrf * {_FACTOR} ELSE nat END AS score FROM g)
SELECT q_scope AS scope, text, id AS rec_id, rank, round(score, 6) AS score, doc_hit FROM (SELECT *, row_number() OVER (PARTITION BY q_scope, text ORDER BY round(score, 12) DESC, first, id) AS rank FROM h) WHERE rank <= 5""",
)
def _hybrid(t):
    asked = search.distinct_queries(t("query_log"))
    roots = t("project_indexes").select(F.col("name").alias("project"), "path")
    hits = search.search(asked, search.current(_chunks(t), "project", "content", "doc", "id_terms", "filePath", "symbolName", "startLine", "endLine"), roots=roots)
    return hits.join(asked, "query_id").select("scope", "text", "rec_id", "rank", F.round("score", 6).alias("score"), "doc_hit")


@_query(
    "vector_nearest",
    f"""WITH c AS (SELECT rec_id, vector::DOUBLE[64] AS v FROM {_ONCE} WHERE len(vector) = 64), q AS (SELECT * FROM c WHERE rec_id % 50 = 0),
r AS (SELECT q.rec_id AS query_id, c.rec_id AS id, list_sum(list_transform(list_zip(q.v::DOUBLE[], c.v::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)) AS d FROM q, c)
SELECT query_id, id, rank, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM r) WHERE rank <= 10""",
)
def _nearest(t):
    rows = search.current(_chunks(t), "vector")
    asked = rows.where("rec_id % 50 = 0").select(F.col("rec_id").alias("query_id"), "vector")
    return ranking.nearest(asked, rows.select(F.col("rec_id").alias("id"), "vector"), 10).select("query_id", "id", "rank", F.round("distance", 5).alias("distance"))


@_query("embeddings_cosine", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM q, embeddings e)
SELECT query_id, id, rank, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM r) WHERE rank <= 10""")
def _cosine(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return ranking.nearest(asked, e, 10, "cosine").select("query_id", "id", "rank", F.round("distance", 5).alias("distance"))


@_query("diverse_nearest")
def _mmr(t):
    rows = search.current(_chunks(t), "vector")
    asked = rows.where("rec_id % 50 = 0").select(F.col("rec_id").alias("query_id"), "vector")
    pool = ranking.nearest(asked, rows.select(F.col("rec_id").alias("id"), "vector"), 20)
    pool = pool.join(rows.select(F.col("rec_id").alias("id"), "vector"), "id").withColumn("relevance", -F.col("distance"))
    return ranking.diversified(pool, 5)


_HEADS = f"s AS (SELECT * FROM (SELECT project, filePath, symbolName, startLine, rec_id, row_number() OVER (PARTITION BY project, filePath, symbolName ORDER BY startLine NULLS FIRST, rec_id) AS _h FROM {_ONCE} WHERE symbolName <> '') WHERE _h = 1)"
_NAMES = f"asked AS (SELECT DISTINCT project AS scope, regexp_extract(symbolName, '[^.]*$') AS text FROM {_ONCE} WHERE rec_id % 50 = 0 AND regexp_extract(symbolName, '[^.]*$') <> '' UNION SELECT DISTINCT project, substr(regexp_extract(symbolName, '[^.]*$'), 2) FROM {_ONCE} WHERE rec_id % 50 = 0 AND length(regexp_extract(symbolName, '[^.]*$')) > 1)"


@_query(
    "find_symbol",
    f"""WITH {_HEADS}, {_NAMES},
strict AS (SELECT scope, text, s.*, row_number() OVER (PARTITION BY scope, text ORDER BY CASE WHEN symbolName = text THEN 0 WHEN starts_with(symbolName, text) THEN 1 ELSE 2 END, symbolName, filePath, startLine, rec_id) AS rank
  FROM asked JOIN s ON (scope IS NULL OR scope = project) AND (starts_with(symbolName, text) OR contains(symbolName, '.' || text))),
missed AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM strict x WHERE x.scope IS NOT DISTINCT FROM a.scope AND x.text = a.text)),
g AS (SELECT project, rec_id, symbolName, unnest(flatten(list_transform(regexp_extract_all(lower(symbolName), '[\\p{{L}}\\p{{N}}]{{3,}}'), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))) AS term FROM s),
d AS (SELECT project, rec_id, count(*) AS dl FROM g GROUP BY ALL), p AS (SELECT project, rec_id, term, count(*) AS tf FROM g GROUP BY ALL),
st AS (SELECT project, count(*) AS n, avg(dl) AS avgdl FROM d GROUP BY project), fr AS (SELECT project, term, count(*) AS df FROM p GROUP BY ALL),
qt AS (SELECT DISTINCT scope, text, term FROM (SELECT scope, text, unnest(flatten(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{3,}}'), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))) AS term FROM missed)),
fz AS (SELECT scope, text, p.rec_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN p ON p.term = qt.term AND (scope IS NULL OR scope = p.project)
  JOIN d ON d.rec_id = p.rec_id JOIN st ON st.project = p.project JOIN fr ON fr.project = p.project AND fr.term = p.term GROUP BY ALL),
fr2 AS (SELECT scope, text, s.rec_id, s.symbolName, score, row_number() OVER (PARTITION BY scope, text ORDER BY round(score, 9) DESC, s.symbolName, s.rec_id) AS rank FROM fz JOIN s ON s.rec_id = fz.rec_id)
SELECT scope, text, rec_id, symbolName, rank, false AS fuzzy, NULL::DOUBLE AS score FROM strict WHERE rank <= 20 UNION ALL SELECT scope, text, rec_id, symbolName, rank, true, round(score, 6) FROM fr2 WHERE rank <= 20""",
)
def _find_symbol(t):
    rows = search.current(_chunks(t), "project", "symbolName")
    bare = identifiers.bare_name("symbolName")
    names = rows.where("rec_id % 50 = 0").select("project", bare.alias("text"))
    asked = names.union(names.where(F.length("text") > 1).select("project", F.substring("text", F.lit(2), F.length("text")))).where("text <> ''")
    asked = search.distinct_queries(asked, "text", "project")
    return search.find_symbol(asked, _chunks(t)).join(asked, "query_id").select("scope", "text", "rec_id", "symbolName", "rank", "fuzzy", F.round("score", 6).alias("score"))


@_query(
    "find_references",
    f"""WITH c AS (SELECT * FROM {_ONCE} WHERE content IS NOT NULL), q AS (SELECT DISTINCT project AS scope, regexp_extract(symbolName, '[^.]*$') AS name FROM c WHERE rec_id % 50 = 0 AND regexp_matches(symbolName, '[A-Za-z0-9_$]$')),
l AS (SELECT project, filePath, coalesce(startLine, 1) + i - 1 AS line, unnest(list_distinct(regexp_extract_all(s[i], '[A-Za-z0-9_$]+'))) AS name FROM (SELECT project, filePath, startLine, string_split(content, chr(10)) AS s, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM c)),
h AS (SELECT DISTINCT scope, name, filePath, line FROM q JOIN l USING (name) WHERE scope = project)
SELECT scope, name, filePath, line::INT AS line, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY scope, name ORDER BY filePath, line) AS rank, count(*) OVER (PARTITION BY scope, name) AS total FROM h) WHERE rank <= 50""",
)
def _find_references(t):
    rows = search.current(_chunks(t), "project", "symbolName", "content").where("rec_id % 50 = 0 and content is not null").where(F.col("symbolName").rlike("[A-Za-z0-9_$]$"))
    asked = rows.select(F.col("project").alias("scope"), identifiers.bare_name("symbolName").alias("name")).distinct().withColumn("query_id", F.xxhash64("scope", "name"))
    hits = code_graph.reference_scan(asked, _chunks(t))
    return hits.join(asked.select("query_id", "scope", "name"), "query_id").select("scope", "name", "filePath", "line", "rank", "total")


_EXPORTED = "CASE WHEN language = 'go' THEN regexp_matches(symbolName, '^[A-Z]') WHEN language IN ('javascript', 'typescript', 'tsx') THEN regexp_matches(h, '(^|\\n)\\s*export(\\s+default|\\s+type|\\s+\\*|\\s+const|\\s+function|\\s+class|\\s+abstract|\\s+interface|\\s+enum|\\s+async|\\s+\\{)?\\b') WHEN language = 'java' THEN regexp_matches(h, '\\bpublic\\b') ELSE false END"
_DEMOTED = "(regexp_matches(lower(regexp_extract(filePath, '[^/]*$')), '^test_|_test\\.[a-z0-9]+$|\\.(test|spec)\\.[a-z0-9]+$') OR regexp_matches(filePath, '(^|/)(tests?|__tests?__|spec)/') OR list_contains(['main', 'index', 'app', 'cli', 'server', 'program', '__main__', 'mod', 'lib', 'entry', 'bootstrap', 'start'], lower(regexp_replace(regexp_extract(filePath, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))))"
_INVENTORY = f"""inv AS (SELECT project, symbolName, filePath, min(startLine) AS startLine, max(endLine) AS endLine, arg_max(content, (length(coalesce(content, '')), -rec_id)) AS content, arg_max(symbolType, (length(coalesce(content, '')), -rec_id)) AS symbolType,
  arg_max(coalesce(language, '?'), (length(coalesce(content, '')), -rec_id)) AS language FROM {_ONCE} WHERE symbolName <> '' AND filePath IS NOT NULL AND startLine IS NOT NULL AND endLine IS NOT NULL GROUP BY project, symbolName, filePath)"""


def _found_sql(texts: str) -> str:
    """names (of the table syms) and hits: where they stand in texts, chains read from the left, the longer of two spans first.
    The test data has names of one and of two segments."""
    return f"""names AS (SELECT DISTINCT project, unnest([symbolName, regexp_extract(symbolName, '[^.]*$')]) AS name, symbolName, filePath, startLine FROM syms), n AS (SELECT DISTINCT project, name FROM names WHERE name <> ''),
lines AS (SELECT project, filePath, symbolName AS owner, rec_id, coalesce(startLine, 1) + i - 1 AS line, s[i] AS text FROM (SELECT project, filePath, symbolName, rec_id, startLine, string_split(content, chr(10)) AS s, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {texts} WHERE content IS NOT NULL)),
chains AS (SELECT row_number() OVER () AS id, * FROM (SELECT project, filePath, owner, rec_id, line, string_split(unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+(?:\\.[A-Za-z0-9_$]+)*')), '.') AS segs FROM lines)),
walk AS (SELECT id, 1 AS pos, NULL::VARCHAR AS name FROM chains UNION ALL
  SELECT w.id, CASE WHEN b.name IS NOT NULL THEN w.pos + 2 ELSE w.pos + 1 END, coalesce(b.name, a.name) FROM walk w JOIN chains c USING (id) LEFT JOIN n a ON a.project = c.project AND a.name = c.segs[w.pos] LEFT JOIN n b ON b.project = c.project AND b.name = c.segs[w.pos] || '.' || c.segs[w.pos + 1] WHERE w.pos <= len(c.segs)),
hits AS (SELECT c.project, c.filePath, c.owner, c.rec_id, c.line, w.name FROM walk w JOIN chains c USING (id) WHERE w.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM names d WHERE d.project = c.project AND d.name = w.name AND d.filePath = c.filePath AND d.startLine = c.line))"""


_CANDIDATES = "('function', 'method', 'class', 'interface', 'enum', 'struct', 'trait', 'record')"
_COUNTS = "per AS (SELECT project, name, count(*) AS n FROM hits GROUP BY ALL), counts AS (SELECT m.project, m.symbolName, m.filePath, coalesce(sum(p.n), 0)::BIGINT AS refs FROM names m LEFT JOIN per p ON p.project = m.project AND p.name = m.name GROUP BY ALL)"


@_query("reference_counts", f"WITH RECURSIVE {_INVENTORY}, syms AS (SELECT * FROM inv WHERE symbolType IN {_CANDIDATES}), {_found_sql(_ONCE)}, {_COUNTS} SELECT project, symbolName, filePath, refs AS \"references\" FROM counts")
def _reference_counts(t):
    return code_graph.reference_counts(code_graph.inventory(_chunks(t)).where(predicates.is_candidate("symbolType")), _chunks(t))


@_query("call_edges", f"WITH RECURSIVE {_INVENTORY}, syms AS (SELECT * FROM inv WHERE symbolType IN ('function', 'method', 'constructor')), bodies AS (SELECT * FROM {_ONCE} WHERE symbolType IN ('function', 'method', 'constructor') AND symbolName <> ''), {_found_sql('bodies')} SELECT DISTINCT h.project, h.owner AS caller, h.filePath AS caller_file, m.symbolName AS callee, m.filePath AS callee_file FROM hits h JOIN names m ON m.project = h.project AND m.name = h.name")
def _call_edges(t):
    return code_graph.call_edges(_chunks(t))


@_query("callers")
def _callers(t):
    """Everything that reaches a function of a chunk whose id is divisible by 50, up to three calls away."""
    edges = code_graph.call_edges(_chunks(t))
    node = lambda n, f: F.concat_ws("|", "project", n, f)
    edges = edges.select(node("callee", "callee_file").alias("src"), node("caller", "caller_file").alias("dst"))
    start = search.current(_chunks(t), "project", "symbolName", "filePath", "symbolType").where("rec_id % 50 = 0").where(predicates.is_callable("symbolType"))
    return code_graph.reach(start.select(F.col("rec_id").alias("anchor"), node("symbolName", "filePath").alias("node")), edges, 3)


@_query(
    "part_supplier_reach",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 31 % 4999 AS src, l_partkey % 4999 AS dst FROM lineitem WHERE l_linenumber = 1 AND l_suppkey * 31 % 4999 <> l_partkey % 4999),
a AS (SELECT DISTINCT src AS anchor FROM e WHERE src % 50 = 0), w AS (SELECT anchor, anchor AS node, 0 AS depth FROM a UNION SELECT anchor, dst, depth + 1 FROM w JOIN e ON e.src = node WHERE depth < 3)
SELECT anchor, node, min(depth)::INT AS depth FROM w WHERE node <> anchor GROUP BY ALL""",
)
def _reach(t):
    e = t("lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") * 31 % 4999).alias("src"), (F.col("l_partkey") % 4999).alias("dst")).where("src <> dst").distinct()
    start = e.where("src % 50 = 0").select(F.col("src").alias("anchor"), F.col("src").alias("node")).distinct()
    return code_graph.reach(start, e, 3)


_DEAD = f"""d AS (SELECT s.*, regexp_extract(s.symbolName, '[^.]*$') AS bare, c.refs, count(*) OVER (PARTITION BY s.project, regexp_extract(s.symbolName, '[^.]*$')) > 3 AS common FROM syms s JOIN counts c USING (project, symbolName, filePath)),
e AS (SELECT d.*, coalesce(o.refs > 0, false) AND contains(d.symbolName, '.') AS owned FROM d LEFT JOIN counts o ON o.project = d.project AND o.filePath = d.filePath AND o.symbolName = string_split(d.symbolName, '.')[1] WHERE d.refs = 0),
f AS (SELECT *, coalesce({_EXPORTED}, false) AS x, symbolType = 'method' AND owned AS ow, symbolType IN ('trait', 'interface') OR coalesce(regexp_matches(substr(content, 1, 400), '@Override\\b|\\boverride\\b|\\bvirtual\\b|\\bimplements\\b|\\bextends\\b|\\babstract\\b'), false) AS poly,
  regexp_matches(bare, '(?i)^(init|initialize|constructor|new|ctor|__init__|create|setup|__new)$') AS ctor, list_contains([{', '.join(f"'{n}'" for n in code_graph.HOOK_NAMES)}], bare) OR regexp_matches(bare, '^(handle|command|do|on|run|get|set|is|has|can|should|visit|accept)([A-Z_])') AS hook,
  language = 'python' AND regexp_matches(bare, '^_([^_]|$)') AS private FROM (SELECT *, substr(content, 1, 300) AS h FROM e)),
g AS (SELECT *, greatest(0, least(100, 80 - CASE WHEN x THEN 30 ELSE 0 END - CASE WHEN ow THEN 20 ELSE 0 END - CASE WHEN poly THEN 35 ELSE 0 END - CASE WHEN ctor THEN 30 WHEN hook THEN 25 ELSE 0 END - CASE WHEN common THEN 15 ELSE 0 END + CASE WHEN private THEN 10 ELSE 0 END)) AS confidence,
  array_to_string(list_filter([CASE WHEN x THEN 'exported' END, CASE WHEN ow THEN 'owner-class-referenced' END, CASE WHEN poly THEN 'polymorphic' END, CASE WHEN ctor THEN 'constructor-like' END, CASE WHEN hook AND NOT ctor THEN 'dynamic-hook-name' END, CASE WHEN common THEN 'common-name' END, CASE WHEN private THEN 'private-by-convention' END], lambda v: v IS NOT NULL), ',') AS signals FROM f)"""


@_query("dead_code", f"WITH RECURSIVE {_INVENTORY}, syms AS (SELECT * FROM inv WHERE symbolType IN {_CANDIDATES} AND NOT {_DEMOTED}), {_found_sql(_ONCE)}, {_COUNTS}, {_DEAD} SELECT project, symbolName, symbolType, filePath, startLine, endLine, confidence, CASE WHEN confidence >= 70 THEN 'likely dead' WHEN confidence >= 40 THEN 'uncertain' ELSE 'review' END AS category, signals FROM g")
def _dead_code(t):
    return code_graph.dead_code(_chunks(t)).withColumn("signals", F.array_join("signals", ",")).drop("language")


@_query(
    "symbol_inventory",
    f"""WITH c AS (SELECT * FROM {_ONCE} WHERE symbolName <> '' AND filePath IS NOT NULL AND startLine IS NOT NULL AND endLine IS NOT NULL)
SELECT project, symbolName, filePath, min(startLine) AS startLine, max(endLine) AS endLine, max(length(coalesce(content, ''))) AS longest FROM c GROUP BY ALL""",
)
def _inventory(t):
    return code_graph.inventory(_chunks(t)).select(*code_graph.KEY, "startLine", "endLine", F.length(F.coalesce("content", F.lit(""))).cast("long").alias("longest"))




@_query("exported_symbols", f"SELECT rec_id, coalesce({_EXPORTED}, false) AS exported FROM (SELECT *, substr(content, 1, 300) AS h FROM {_ONCE}) WHERE symbolName <> ''")
def _exported(t):
    rows = search.current(_chunks(t), "symbolName", "language", "content").where("symbolName <> ''")
    return rows.select("rec_id", identifiers.is_exported("symbolName", "language", "content").alias("exported"))


@_query("identifier_terms")
def _identifier_terms(t):
    return search.current(_chunks(t), "content").select("rec_id", identifiers.identifier_terms("content").alias("terms"))


_ROOTS = "(SELECT name, any_value(path) AS path FROM project_indexes GROUP BY name)"
_SPECS = rf"""c0 AS (SELECT project, filePath, content, CASE WHEN language IN ('javascript', 'typescript', 'tsx', 'python', 'go', 'java') THEN language ELSE CASE regexp_extract(filePath, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' ELSE '' END END AS lang FROM {_ONCE} WHERE content IS NOT NULL AND filePath IS NOT NULL),
specs AS (SELECT DISTINCT project, filePath, lang, raw FROM (
  SELECT project, filePath, lang, unnest(regexp_extract_all(content, '(?m)^import\s+(?:type\s+)?(?:[^''";]*?\sfrom\s*)?[''"]([^''"\n]+)[''"]', 1)) AS raw FROM c0 WHERE lang IN ('javascript', 'typescript', 'tsx')
  UNION ALL SELECT project, filePath, lang, unnest(regexp_extract_all(content, '(?m)^from[ \t]+(\.*[\w.]*)[ \t]+import\b', 1)) FROM c0 WHERE lang = 'python'
  UNION ALL SELECT project, filePath, lang, unnest(flatten(list_transform(regexp_extract_all(content, '(?m)^import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)', 1), lambda x: list_transform(string_split(x, ','), lambda y: regexp_extract(trim(y), '^[\w.]+'))))) FROM c0 WHERE lang = 'python'
  UNION ALL SELECT project, filePath, lang, unnest(regexp_extract_all(content, '(?m)^import\s+(?:[\w.]+\s+)?"([^"\n]+)"', 1)) FROM c0 WHERE lang = 'go'
  UNION ALL SELECT project, filePath, lang, unnest(flatten(list_transform(regexp_extract_all(content, '(?m)^import\s*\(([^)]*)\)', 1), lambda x: regexp_extract_all(x, '"([^"\n]+)"', 1)))) FROM c0 WHERE lang = 'go'
  UNION ALL SELECT project, filePath, lang, unnest(regexp_extract_all(content, '(?m)^import\s+(?:static\s+)?([\w.]+)\s*(?:\.\*)?;', 1)) FROM c0 WHERE lang = 'java')),
files AS (SELECT DISTINCT project, filePath AS path FROM code_records WHERE filePath IS NOT NULL),
tries AS (SELECT s.*, r.path AS root, regexp_replace(s.filePath, '/[^/]*$', '') AS dir FROM specs s LEFT JOIN {_ROOTS} r ON r.name = s.project),
cand AS (SELECT project, filePath, lang, raw, false AS tail, dir || '/' || substr(raw, 3) || unnest(['', '.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts', '/index.js', '/index.ts', '/index.tsx', '/index.mjs', '/index.cjs']) AS p, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14], 1) AS k FROM tries WHERE lang IN ('javascript', 'typescript', 'tsx') AND starts_with(raw, './')
  UNION ALL SELECT project, filePath, lang, raw, x.tail, x.p, x.k FROM (SELECT *, unnest([{{'tail': false, 'p': root || '/' || replace(raw, '.', '/') || '.py', 'k': 1}}, {{'tail': false, 'p': root || '/' || replace(raw, '.', '/') || '/__init__.py', 'k': 2}}, {{'tail': true, 'p': CASE WHEN contains(raw, '.') THEN '/' || replace(raw, '.', '/') || '.py' END, 'k': 3}}, {{'tail': true, 'p': '/' || replace(raw, '.', '/') || '/__init__.py', 'k': 4}}]) AS x FROM tries WHERE lang = 'python' AND NOT starts_with(raw, '.'))),
hit AS (SELECT c.project, c.filePath, c.lang, c.raw, arg_min(f.path, (k, f.path)) AS path FROM cand c JOIN files f ON f.project = c.project AND (CASE WHEN tail THEN ends_with(f.path, p) ELSE f.path = p END) GROUP BY ALL),
imp AS (SELECT s.project, s.filePath, s.lang AS language, s.raw, CASE WHEN h.path IS NOT NULL THEN 'resolved' WHEN s.lang IN ('javascript', 'typescript', 'tsx') AND regexp_matches(s.raw, '^[./]') OR s.lang = 'python' AND starts_with(s.raw, '.') THEN 'unresolved' ELSE 'external' END AS status, h.path FROM specs s LEFT JOIN hit h USING (project, filePath, lang, raw))"""


@_query("imports", f"WITH {_SPECS} SELECT * FROM imp")
def _imports(t):
    """Each import of a file once, whatever lines it stands on. The SQL knows paths that begin with ./, as all in the test data do."""
    roots = t("project_indexes").select(F.col("name").alias("project"), "path")
    return imports.import_graph(_chunks(t), roots).select("project", "filePath", "language", "raw", "status", "path").distinct()


@_query(
    "coupling",
    f"""WITH {_SPECS}, e AS (SELECT DISTINCT project, filePath AS a, path AS b FROM imp WHERE path IS NOT NULL AND path <> filePath), x AS (SELECT project, filePath, count(*) AS externalImports FROM imp WHERE status = 'external' GROUP BY ALL),
g AS (SELECT project, f AS filePath, sum(i)::BIGINT AS fanIn, sum(o)::BIGINT AS fanOut FROM (SELECT project, path AS f, 0 AS i, 0 AS o FROM files UNION ALL SELECT project, a, 0, 1 FROM e UNION ALL SELECT project, b, 1, 0 FROM e) GROUP BY ALL)
SELECT g.*, CASE WHEN fanIn + fanOut > 0 THEN floor(fanOut::DOUBLE / (fanIn + fanOut) * 1000 + 0.5) / 1000 END AS instability, coalesce(externalImports, 0) AS externalImports FROM g LEFT JOIN x USING (project, filePath)""",
)
def _coupling(t):
    roots = t("project_indexes").select(F.col("name").alias("project"), "path")
    graph = imports.import_graph(_chunks(t), roots)
    external = graph.where("status = 'external'").groupBy("project", "filePath").agg(F.countDistinct("language", "raw").alias("externalImports"))
    return reports.coupling(_chunks(t).where("filePath is not null").select("project", "filePath"), graph, external)


_EDGES = "e AS (SELECT DISTINCT l_returnflag AS project, 'f' || (l_suppkey % 300) AS a, 'f' || (l_partkey % 300) AS b FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 300 <> l_partkey % 300)"
_FANS = f"{_EDGES}, r AS (SELECT project, f AS filePath, sum(i)::BIGINT AS fanIn, sum(o)::BIGINT AS fanOut FROM (SELECT project, a AS f, 0 AS i, 1 AS o FROM e UNION ALL SELECT project, b, 1, 0 FROM e) GROUP BY ALL)"
_BANDS = " UNION ALL ".join(
    f"SELECT project, '{n}' AS band, row_number() OVER (PARTITION BY project ORDER BY {o}, filePath) AS rank, filePath, fanIn, fanOut, floor(fanOut::DOUBLE / (fanIn + fanOut) * 1000 + 0.5) / 1000 AS instability, count(*) OVER (PARTITION BY project) AS total, count(*) OVER (PARTITION BY project) > 50 AS truncated FROM r WHERE {w}"
    for n, w, o in (("topFanIn", "fanIn > 0", "fanIn DESC"), ("changeMagnets", "fanIn >= 2 AND fanOut >= 2", "fanIn + fanOut DESC, fanIn DESC"), ("unstableLeaves", "fanIn = 0 AND fanOut > 0", "fanOut DESC"))
)


@_query("coupling_bands", f"WITH {_FANS} SELECT * FROM ({_BANDS}) WHERE rank <= 50")
def _coupling_bands(t):
    rows = t("lineitem").where("l_linenumber = 1").select(F.col("l_returnflag").alias("project"), F.concat(F.lit("f"), (F.col("l_suppkey") % 300).cast("string")).alias("filePath"), F.concat(F.lit("f"), (F.col("l_partkey") % 300).cast("string")).alias("path"))
    return reports.coupling_bands(reports.coupling(rows.select("project", "filePath").where("false"), rows))


_SIZES = f"sizes AS (SELECT project, filePath, count(*) AS chunks, count(DISTINCT nullif(symbolName, '')) AS symbols FROM {_ONCE} WHERE filePath IS NOT NULL GROUP BY ALL)"


@_query(
    "hotspot_bands",
    f"""WITH {_SIZES}, churn AS (SELECT index_name AS project, file_path AS filePath, count(*) AS churn FROM file_cache GROUP BY ALL), x AS (SELECT s.*, coalesce(churn, 0) AS churn FROM sizes s LEFT JOIN churn USING (project, filePath)),
y AS (SELECT *, {_DEMOTED} AS demoted, 100 * ln(1 + churn) / ln(21) * ln(1 + chunks + symbols) / ln(41) AS s FROM x), z AS (SELECT *, floor((CASE WHEN demoted THEN least(greatest(0, least(100, s)), 20) ELSE greatest(0, least(100, s)) END) * 10 + 0.5) / 10 AS score FROM y),
b AS (SELECT *, CASE WHEN demoted OR score < 25 THEN 'review' WHEN score >= 50 THEN 'critical' ELSE 'warm' END AS band FROM z WHERE score <> 0)
SELECT * FROM (SELECT project, band, row_number() OVER (PARTITION BY project, band ORDER BY score DESC, churn DESC, filePath) AS rank, filePath, score, churn, chunks, symbols, count(*) OVER (PARTITION BY project, band) AS total FROM b) WHERE rank <= 20""",
)
def _hotspot_bands(t):
    churn = t("file_cache").groupBy(F.col("index_name").alias("project"), F.col("file_path").alias("filePath")).agg(F.count("*").alias("churn"))
    sizes = reports.file_sizes(_chunks(t))
    none = sizes.select("project", "filePath", *(F.lit(0).cast("long").alias(c) for c in ("dead", "candidates", "fanIn", "fanOut"))).where("false")
    return reports.hotspots(sizes, churn, none, none).select("project", "band", "rank", "filePath", "score", "churn", "chunks", "symbols", "total")


@_query(
    "hotspots",
    f"""WITH RECURSIVE {_INVENTORY}, syms AS (SELECT * FROM inv WHERE symbolType IN {_CANDIDATES} AND NOT {_DEMOTED}), {_found_sql(_ONCE)}, {_COUNTS}, {_DEAD}, {_SPECS}, {_SIZES},
ce AS (SELECT DISTINCT project, filePath AS a, path AS b FROM imp WHERE path IS NOT NULL AND path <> filePath), fans AS (SELECT project, f AS filePath, sum(i)::BIGINT AS fanIn, sum(o)::BIGINT AS fanOut FROM (SELECT project, a AS f, 0 AS i, 1 AS o FROM ce UNION ALL SELECT project, b, 1, 0 FROM ce) GROUP BY ALL),
churn AS (SELECT index_name AS project, file_path AS filePath, count(*) AS churn FROM file_cache GROUP BY ALL), cnd AS (SELECT project, filePath, count(*) AS candidates FROM syms GROUP BY ALL), ded AS (SELECT project, filePath, count(*) AS dead FROM g WHERE confidence >= 40 GROUP BY ALL),
x AS (SELECT s.*, coalesce(churn, 0) AS churn, coalesce(dead, 0) AS dead, coalesce(candidates, 0) AS candidates, coalesce(fanIn, 0) AS fanIn, coalesce(fanOut, 0) AS fanOut FROM sizes s LEFT JOIN churn USING (project, filePath) LEFT JOIN cnd USING (project, filePath) LEFT JOIN ded USING (project, filePath) LEFT JOIN fans USING (project, filePath)),
y AS (SELECT *, {_DEMOTED} AS demoted, CASE WHEN candidates > 0 THEN dead / candidates::DOUBLE ELSE 0 END AS density, 100 * ln(1 + churn) / ln(21) * ln(1 + chunks + symbols) / ln(41) + CASE WHEN dead > 0 THEN 15 * least(1, dead / candidates::DOUBLE / 0.5) ELSE 0 END + 15 * least(1, (fanIn + fanOut) / 8.0) AS s FROM x),
z AS (SELECT *, floor((CASE WHEN demoted THEN least(greatest(0, least(100, s)), 20) ELSE greatest(0, least(100, s)) END) * 10 + 0.5) / 10 AS score FROM y), b AS (SELECT *, CASE WHEN demoted OR score < 25 THEN 'review' WHEN score >= 50 THEN 'critical' ELSE 'warm' END AS band FROM z WHERE score <> 0 OR dead > 0)
SELECT * FROM (SELECT project, band, row_number() OVER (PARTITION BY project, band ORDER BY score DESC, churn DESC, filePath) AS rank, filePath, score, churn, chunks, symbols, dead AS deadSymbols, CASE WHEN density > 0 THEN floor(density * 10000 + 0.5) / 10000 END AS deadDensity, fanIn, fanOut, count(*) OVER (PARTITION BY project, band) AS total, count(*) OVER (PARTITION BY project, band) > 20 AS truncated FROM b) WHERE rank <= 20""",
)
def _hotspots(t):
    """All feeds from the tables: rows of file_cache as changes, dead symbols, imports."""
    chunks = _chunks(t)
    churn = t("file_cache").groupBy(F.col("index_name").alias("project"), F.col("file_path").alias("filePath")).agg(F.count("*").alias("churn"))
    dead = code_graph.dead_density(chunks, code_graph.dead_code(chunks))
    graph = imports.import_graph(chunks, t("project_indexes").select(F.col("name").alias("project"), "path"))
    fans = reports.coupling(chunks.where("filePath is not null").select("project", "filePath"), graph)
    return reports.hotspots(reports.file_sizes(chunks), churn, dead, fans)


@_query("language_histogram", f"SELECT project, coalesce(language, '') AS language, count(DISTINCT filePath) AS files, count(CASE WHEN coalesce(symbolName, '') <> '' THEN 1 END) AS symbols FROM {_ONCE} GROUP BY 1, 2")
def _languages(t):
    return reports.language_histogram(_chunks(t))


@_query("symbol_histogram", f"SELECT project, CASE WHEN coalesce(symbolType, '') = '' THEN 'code' ELSE symbolType END AS symbolType, count(*) AS chunks FROM {_ONCE} GROUP BY 1, 2")
def _symbols(t):
    return reports.symbol_histogram(_chunks(t))




@_query("folder_histogram", f"WITH f AS (SELECT DISTINCT project, filePath FROM code_records WHERE filePath IS NOT NULL), g AS (SELECT project, {_REL} AS rel FROM f LEFT JOIN {_ROOTS} r ON r.name = project), h AS (SELECT project, CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] ELSE '.' END AS folder, count(*) AS files FROM g GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY files DESC, folder) AS rank FROM h) WHERE rank <= 12")
def _folders(t):
    return reports.folder_histogram(_chunks(t), t("project_indexes").select(F.col("name").alias("project"), "path"))


@_query("largest_files", "SELECT * FROM (SELECT project, filePath, count(DISTINCT symbolName) AS symbols, row_number() OVER (PARTITION BY project ORDER BY count(DISTINCT symbolName) DESC, filePath) AS rank FROM code_records WHERE symbolName <> '' AND filePath IS NOT NULL GROUP BY project, filePath) WHERE rank <= 10")
def _largest(t):
    return reports.largest_files(_chunks(t))


@_query("entry_points", f"SELECT * FROM (SELECT project, filePath, row_number() OVER (PARTITION BY project ORDER BY filePath) AS rank FROM (SELECT DISTINCT project, filePath FROM code_records WHERE list_contains(['main', 'index', 'app', 'cli', 'server', 'program', '__main__', 'mod', 'lib', 'entry', 'bootstrap', 'start'], lower(regexp_replace(regexp_extract(filePath, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))))) WHERE rank <= 20")
def _entries(t):
    return reports.entry_points(_chunks(t))


@_query("file_outline", f"SELECT project, filePath, symbolType, symbolName, min(startLine) AS startLine, max(endLine) AS endLine FROM {_ONCE} WHERE symbolName <> '' GROUP BY ALL")
def _outline(t):
    return search.outlines(_chunks(t))


@_query("context_pack")
def _pack(t):
    asked = search.distinct_queries(t("query_log"))
    chunks = _chunks(t)
    docs = search.current(chunks, "project", "id_terms").select(F.col("project").alias("scope"), F.col("rec_id").alias("id"), F.col("id_terms").alias("text")).where("text is not null")
    hits = ranking.top(ranking.bm25(asked, docs), 5, F.round("score", 9).desc()).withColumnRenamed("id", "rec_id")
    graph = imports.import_graph(chunks, t("project_indexes").select(F.col("name").alias("project"), "path"))
    return search.context_pack(hits, chunks, graph).select("query_id", "rank", "rec_id", F.size("outline").alias("outline"), F.coalesce(F.size("imports"), F.lit(0)).alias("imports"), "size", "omitted")


@_query("char_budget", f"WITH c AS (SELECT rec_id, filePath, startLine, length(content) + 120 AS size FROM {_ONCE} WHERE content IS NOT NULL AND filePath IS NOT NULL), w AS (SELECT *, sum(size) OVER (PARTITION BY filePath ORDER BY startLine, rec_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY filePath ORDER BY startLine, rec_id) AS n FROM c) SELECT rec_id, filePath, size, omitted FROM (SELECT *, (count(*) FILTER (WHERE NOT (n = 1 OR used <= 4000)) OVER (PARTITION BY filePath)) AS omitted FROM w) WHERE n = 1 OR used <= 4000")
def _budget(t):
    rows = search.current(_chunks(t), "filePath", "startLine", "content").where("content is not null and filePath is not null").withColumn("place", F.struct(F.col("startLine"), F.col("rec_id")))
    kept = ranking.within_budget(rows.withColumn("size", scalars.result_size("content")), F.col("size"), 4000, "filePath", "place")
    return kept.select("rec_id", "filePath", "size", "omitted")


@_query("path_boost", f"SELECT filePath, round({_FACTOR}, 9) AS factor FROM (SELECT filePath, {_REL} AS rel FROM (SELECT DISTINCT project, filePath FROM code_records WHERE filePath IS NOT NULL) LEFT JOIN {_ROOTS} r ON r.name = project)")
def _path_boost(t):
    files = _chunks(t).where("filePath is not null").select("project", "filePath").distinct().join(t("project_indexes").select(F.col("name").alias("project"), "path").dropDuplicates(["project"]), "project", "left")
    return files.select("filePath", F.round(predicates.path_factor(predicates.relative_path("filePath", "path")), 9).alias("factor"))


@_query("path_filter", "SELECT DISTINCT filePath FROM code_records WHERE language = 'python' AND symbolType = 'method' AND filePath LIKE '%/src/%\\_%.py' ESCAPE '\\'")
def _path_filter(t):
    return _chunks(t).where(predicates.row_filter("python", "method", "**/src/**_*.py")).select("filePath").distinct()


@_query("file_kinds", f"SELECT filePath, regexp_matches(lower(regexp_extract(filePath, '[^/]*$')), '^test_|_test\\.[a-z0-9]+$|\\.(test|spec)\\.[a-z0-9]+$') OR regexp_matches(filePath, '(^|/)(tests?|__tests?__|spec)/') AS test, regexp_matches(filePath, '(^|/)(gen|dist|build|vendor|node_modules)(/|$)|\\.pb\\.go$|\\.min\\.[a-z0-9]+$') AS generated, regexp_matches(filePath, '(?i)\\.(md|mdx|xml|rst)$') AS document FROM (SELECT DISTINCT filePath FROM code_records WHERE filePath IS NOT NULL)")
def _kinds(t):
    files = _chunks(t).where("filePath is not null").select("filePath").distinct()
    return files.select("filePath", predicates.is_test_file("filePath").alias("test"), predicates.is_generated_path("filePath").alias("generated"), predicates.is_document("filePath").alias("document"))


@_query("project_of_file", f"WITH f AS (SELECT DISTINCT filePath FROM code_records WHERE filePath IS NOT NULL) SELECT filePath, project FROM (SELECT filePath, name AS project, row_number() OVER (PARTITION BY filePath ORDER BY length(path) DESC, name DESC) AS n FROM f LEFT JOIN project_indexes ON filePath = path OR starts_with(filePath, path || '/')) WHERE n = 1")
def _project_of(t):
    return reports.project_of(_chunks(t).where("filePath is not null"), t("project_indexes"))


@_query("index_health", """WITH r AS (SELECT project, count(DISTINCT rec_id) AS n FROM code_records WHERE rec_id IS NOT NULL GROUP BY 1), j AS (SELECT i.name AS project, i.status AS state, file_count, chunk_count, n, n IS NOT NULL AS there, coalesce(i.status = 'indexing', false) AS busy FROM project_indexes i LEFT JOIN r ON r.project = i.name),
f AS (SELECT project, 'fail' AS status, 'index is in error' AS finding FROM j WHERE state = 'error' UNION ALL SELECT project, 'fail', 'table missing' FROM j WHERE NOT there UNION ALL SELECT project, 'warn', 'no vector index' FROM j WHERE there AND n >= 50000
 UNION ALL SELECT project, 'warn', 'row count differs from the registry' FROM j WHERE there AND NOT busy AND n <> chunk_count UNION ALL SELECT project, 'warn', 'no files but rows' FROM j WHERE there AND NOT busy AND file_count = 0)
SELECT * FROM f UNION ALL SELECT project, 'ok', 'healthy' FROM j WHERE project NOT IN (SELECT project FROM f)""")
def _health(t):
    return reports.index_health(t("project_indexes"), _chunks(t))


@_query("query_log_summary", "SELECT project, count(*) AS total, count(DISTINCT query) AS distinct_queries, round(avg(latency_ms), 6) AS avg_latency, max(latency_ms) AS max_latency, floor((count(*) - count(DISTINCT query))::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS repeat_rate FROM query_log GROUP BY project")
def _log_summary(t):
    return reports.query_log_summary(t("query_log"), "project")


@_query("top_queries", "SELECT query, n, avg_results, row_number() OVER (ORDER BY n DESC, query) AS rank FROM (SELECT query, count(*) AS n, floor(avg(result_count) * 100 + 0.5) / 100 AS avg_results FROM query_log GROUP BY query ORDER BY n DESC, query LIMIT 10)")
def _top_queries(t):
    return reports.top_queries(t("query_log"))


@_query("zero_hit_queries", "SELECT query, count(*) AS n FROM query_log WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 10")
def _zero(t):
    return reports.zero_hit_queries(t("query_log"))


@_query(
    "api_diff",
    """WITH b AS (SELECT o_custkey % 400 AS p, o_orderpriority AS k, o_orderstatus AS n, min(o_totalprice) AS s, min(o_orderkey) AS l, count(*) % 2 = 0 AS e FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY ALL),
h AS (SELECT o_custkey % 400 AS p, o_orderpriority AS k, o_orderstatus AS n, min(o_totalprice) AS s, min(o_orderkey) AS l, count(*) % 2 = 0 AS e FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL)
SELECT coalesce(b.p, h.p)::VARCHAR AS path, coalesce(b.k, h.k) AS symbolType, coalesce(b.n, h.n) AS symbolName, CASE WHEN h.p IS NULL THEN 'removed' WHEN b.p IS NULL THEN 'added' WHEN b.e AND NOT h.e THEN 'visibility-narrowed' WHEN b.s > h.s THEN 'signature-changed' ELSE 'unchanged' END AS kind
FROM b FULL JOIN h ON b.p = h.p AND b.k = h.k AND b.n = h.n""",
)
def _api_diff(t):
    def side(rows):
        by = rows.groupBy((F.col("o_custkey") % 400).cast("string").alias("path"), F.col("o_orderpriority").alias("symbolType"), F.col("o_orderstatus").alias("symbolName"))
        return by.agg(F.min("o_totalprice").alias("signature"), F.min("o_orderkey").alias("startLine"), (F.count("*") % 2 == 0).alias("exported")).withColumn("language", F.lit(""))

    day = F.lit("1995-01-01").cast("timestamp")
    out = reports.api_diff(side(t("orders").where(F.col("o_orderdate") < day)), side(t("orders").where(F.col("o_orderdate") >= day)), F.col("base_signature") > F.col("head_signature"), None, True)
    return out.select("path", "symbolType", "symbolName", "kind")


# chunks, registry, history, documents, streams


@_query(
    "chunk_windows",
    """WITH d AS (SELECT doc_id AS id, text, unnest(CASE WHEN length(text) <= 1500 THEN [0] ELSE range(0, (length(text) - 1) // 1300 + 1) END) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT id, n, substr(text, n * 1300 + 1, 1500) AS content, substr(text, 1, n * 1300) AS before FROM d)
SELECT id, n::INT AS n, length(content) AS size, (1 + length(before) - length(replace(before, chr(10), '')))::INT AS startLine, (1 + length(before) - length(replace(before, chr(10), '')) + length(content) - length(replace(content, chr(10), '')))::INT AS endLine FROM w WHERE regexp_matches(content, '[^ \\t\\n\\x0B\\f\\r]')""",
)
def _windows(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    return chunking.windows(docs).select("id", "n", F.length("content").cast("long").alias("size"), "startLine", "endLine")


@_query("file_chunks")
def _file_chunks(t):
    """The chunker over whole files, put together from the chunks of the table."""
    rows = search.current(_chunks(t), "project", "filePath", "content", "startLine").where("content is not null and filePath is not null")
    files = rows.groupBy("project", "filePath").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("startLine", "rec_id", "content"))), lambda x: x["content"]), "\n").alias("text"))
    return chunking.chunked(files.select("project", F.col("filePath").alias("path"), "text")).drop("content", "doc")


@_query("signatures")
def _signatures(t):
    rows = search.current(_chunks(t), "symbolName", "language", "content").where("symbolName <> ''")
    return rows.select("rec_id", signatures.signature("content", "language").alias("signature"))


@_query("file_times", "SELECT index_name, file_path, max(mtime_ms) AS mtime_ms FROM file_cache GROUP BY ALL")
def _file_times(t):
    return registry.file_times(t("file_cache"))


@_query("deleted_files", "SELECT DISTINCT index_name, file_path FROM file_cache EXCEPT SELECT project, filePath FROM code_records")
def _deleted(t):
    return registry.deleted_files(t("file_cache"), _chunks(t).select(F.col("project").alias("index_name"), F.col("filePath").alias("file_path")))


@_query(
    "sync_plan",
    """WITH l AS (SELECT project AS index_name, filePath AS file_path, epoch_ms(max(indexedAt)) AS now FROM code_records WHERE filePath IS NOT NULL GROUP BY ALL), c AS (SELECT index_name, file_path, max(mtime_ms) AS was FROM file_cache GROUP BY ALL)
SELECT index_name, file_path, CASE WHEN now IS NULL THEN 'deleted' WHEN was IS NULL THEN 'new' WHEN now::DOUBLE <> was THEN 'changed' ELSE 'unchanged' END AS change FROM l FULL JOIN c USING (index_name, file_path)""",
)
def _sync_plan(t):
    listed = _chunks(t).where("filePath is not null").select(F.col("project").alias("index_name"), F.col("filePath").alias("file_path"), F.unix_millis("indexedAt").cast("double").alias("mtime_ms"))
    return registry.sync_plan(listed, t("file_cache"))


@_query(
    "replaced_files",
    f"""WITH c AS (SELECT rec_id, project, filePath, content, symbolType FROM {_ONCE}), n AS (SELECT rec_id + 1000000000 AS rec_id, project, filePath, 'x' || content AS content FROM c WHERE filePath IN (SELECT filePath FROM c WHERE rec_id % 50 = 0) AND symbolType = 'function'),
g AS (SELECT DISTINCT project, filePath FROM c WHERE rec_id % 50 = 0)
SELECT rec_id, project, filePath, length(content) AS size FROM c WHERE (project, filePath) NOT IN (SELECT (project, filePath) FROM g) UNION ALL SELECT rec_id, project, filePath, length(content) FROM n""",
)
def _replaced(t):
    c = search.current(_chunks(t), "project", "filePath", "content", "symbolType")
    files = c.where("rec_id % 50 = 0").select("project", "filePath").distinct()
    new = c.join(files.select("filePath").distinct(), "filePath", "left_semi").where("symbolType = 'function'").select((F.col("rec_id") + 1_000_000_000).alias("rec_id"), "project", "filePath", F.concat(F.lit("x"), "content").alias("content"))
    return chunk_table.replaced(c.select("rec_id", "project", "filePath", "content"), new, files).select("rec_id", "project", "filePath", F.length("content").cast("long").alias("size"))


_NOW = "j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 ELSE 2 END DESC, created_at DESC, type DESC) AS n FROM index_jobs) WHERE n = 1)"


@_query("jobs_now", f"WITH {_NOW} SELECT id, status, priority FROM j")
def _jobs(t):
    return registry.jobs_now(t("index_jobs")).select("id", "status", "priority")


@_query("job_claims", f"WITH {_NOW} SELECT id, priority, row_number() OVER (ORDER BY priority DESC, created_at, id) AS place FROM j WHERE status = 'pending'")
def _claims(t):
    return registry.claim_order(registry.jobs_now(t("index_jobs"))).select("id", "priority", "place")


@_query("interrupted_jobs", f"WITH {_NOW} SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted by a restart' ELSE error END AS error FROM j")
def _interrupted(t):
    return registry.interrupted(registry.jobs_now(t("index_jobs"))).select("id", "status", "error")


@_query("jobs_of_projects", f"WITH {_NOW} SELECT CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.project') END AS project, count(*) AS jobs FROM j GROUP BY 1")
def _job_projects(t):
    return registry.jobs_now(t("index_jobs")).groupBy(F.when(F.try_parse_json("payload").isNotNull(), registry.job_project()).alias("project")).agg(F.count("*").alias("jobs"))


@_query("query_log_kept", "SELECT id, project, query FROM query_log ORDER BY id DESC, ts DESC LIMIT 500")
def _kept(t):
    return registry.kept_newest(t("query_log"), 500, "id", "ts").select("id", "project", "query")


@_query("embedding_cache", f"WITH c AS (SELECT sha256(content) AS hash, vector, row_number() OVER (PARTITION BY sha256(content) ORDER BY rec_id) AS n FROM {_ONCE} WHERE content IS NOT NULL AND vector IS NOT NULL) SELECT count(*) AS entries, sum(len(vector) * 4)::BIGINT AS bytes FROM c WHERE n = 1")
def _cache(t):
    rows = search.current(_chunks(t), "content", "vector").where("content is not null and vector is not null")
    first = rows.groupBy(scalars.content_hash("content").alias("hash")).agg(F.min_by("vector", "rec_id").alias("vector"))
    return registry.cache_stats(first)


@_query("hash_embeddings", f"SELECT rec_id, list_transform(range(0, 64), lambda i: round(((('0x' || substr(sha256(content), 2 * (i % 32) + 1, 2))::INT - 127.5) / 127.5)::FLOAT::DOUBLE, 5)) AS vector FROM {_ONCE} WHERE content IS NOT NULL")
def _hash_embeddings(t):
    rows = search.current(_chunks(t), "content").where("content is not null")
    return rows.select("rec_id", F.transform(ranking.hash_embedding(F.col("content")), lambda x: F.round(x.cast("double"), 5)).alias("vector"))


_LOGGED = "l AS (SELECT DISTINCT o_custkey % 500 AS repo, sha1(o_orderkey::VARCHAR) AS hash, o_orderpriority AS author, epoch(o_orderdate)::BIGINT * 1000 AS timestamp, o_orderkey FROM orders)"


@_query("commit_log", f"WITH {_LOGGED}, f AS (SELECT l_orderkey, list_sort(list(DISTINCT 'src/p' || (l_partkey % 50) || '.ts')) AS files FROM lineitem GROUP BY 1) SELECT 'r' || repo AS repo, hash, author, timestamp, 'order ' || o_orderkey AS subject, array_to_string(coalesce(files, []), ',') AS files FROM l LEFT JOIN f ON l_orderkey = o_orderkey")
def _commit_log(t):
    """Raw logs, as git writes them, made of the orders and read again."""
    return _commits(t).select("repo", "hash", "author", "timestamp", "subject", F.array_join("files", ",").alias("files"))


def _commits(t):
    files = t("lineitem").select("l_orderkey", F.concat(F.lit("src/p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".ts")).alias("f")).distinct().groupBy("l_orderkey").agg(F.sort_array(F.collect_list("f")).alias("files"))
    o = t("orders").join(files, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    head = F.concat_ws("\x1f", F.sha1(key), F.substring(F.sha1(key), 1, 7), F.col("o_orderpriority"), F.lit("a@b"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.unix_timestamp("o_orderdate").cast("string"), F.concat(F.lit("order "), key), F.lit(""))
    names = F.array_join(F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda x, i: F.when(i == 0, F.concat(F.lit("\n"), x)).otherwise(x)), "\x00")
    raw = o.select(F.concat(F.lit("r"), (F.col("o_custkey") % 500).cast("string")).alias("repo"), "o_orderkey", F.concat_ws("\x00", head, F.when(names != "", names)).alias("token"))
    return history.parse_log(raw.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "token"))), lambda x: x["token"]), "\x00").alias("raw")))


@_query("commit_churn", "WITH n AS (SELECT o_orderkey FROM (SELECT *, sha1(o_orderkey::VARCHAR) AS h FROM orders) ORDER BY epoch(o_orderdate)::BIGINT DESC, h LIMIT 5000) SELECT 'src/p' || (l_partkey % 50) || '.ts' AS filePath, count(DISTINCT l_orderkey) AS churn FROM lineitem JOIN n ON o_orderkey = l_orderkey GROUP BY 1")
def _churn(t):
    return history.churn(_commits(t))


@_query("commit_search", "SELECT sha1(o_orderkey::VARCHAR) AS hash, 'order ' || o_orderkey AS subject FROM orders WHERE regexp_matches('order ' || o_orderkey, '(?i)ORDER .*77') AND regexp_matches(o_orderpriority, '(?i)urgent|high') ORDER BY epoch(o_orderdate)::BIGINT DESC, hash LIMIT 50")
def _commit_search(t):
    return history.search_commits(_commits(t), "ORDER .*77", "urgent|high").select("hash", "subject")


@_query(
    "blame_summary",
    """WITH l AS (SELECT l_partkey % 200 AS f, l_linenumber AS line, sha1((l_orderkey % 3000)::VARCHAR) AS sha, l_shipmode AS author, epoch(l_shipdate)::BIGINT * 1000 AS author_time FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY author_time DESC, line DESC, author DESC, sha DESC) AS n FROM l)
SELECT f::VARCHAR AS filePath, strftime(make_timestamp(max(CASE WHEN n = 1 THEN author_time END) * 1000), '%Y-%m-%d') AS lastCommitDate, least(count(DISTINCT sha), 10) AS distinctCommits, count(DISTINCT sha) > 10 AS distinctTruncated FROM r GROUP BY f""",
)
def _blame(t):
    lines = t("lineitem").select((F.col("l_partkey") % 200).cast("string").alias("filePath"), F.col("l_linenumber").alias("line"), F.sha1((F.col("l_orderkey") % 3000).cast("string")).alias("sha"), F.concat("l_returnflag", "l_linestatus").alias("author"), (F.unix_timestamp("l_shipdate") * 1000).alias("author_time"))
    return history.blame_summary(lines, "filePath").drop("lastAuthor")


def _documents(t):
    return t("documents").where("text is not null").select("project", F.concat_ws("/", F.lit("docs"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("doc"), "text")


@_query("doc_claims")
def _doc_claims(t):
    claims = conformance.spans(_documents(t))
    return claims.withColumn("class", conformance.span_class(F.col("token"))).where("class is not null")


@_query("doc_findings")
def _doc_findings(t):
    roots = t("project_indexes").select(F.col("name").alias("project"), "path")
    rows = conformance.demoted(conformance.verdicts(conformance.spans(_documents(t)), _chunks(t), roots))
    return conformance.findings(rows)


@_query("undocumented_symbols")
def _undocumented(t):
    return conformance.undocumented(_chunks(t), conformance.spans(_documents(t)))


_BARE = f"s AS (SELECT DISTINCT project, regexp_extract(symbolName, '[^.]*$') AS name FROM {_ONCE} WHERE symbolName <> '')"


@_query(
    "nearest_names",
    f"""WITH {_BARE}, t AS (SELECT DISTINCT project, regexp_extract(symbolName, '[^.]*$') || 'x' AS token FROM {_ONCE} WHERE rec_id % 50 = 0 AND symbolName <> ''),
p AS (SELECT project, token, name, lower(regexp_replace(token, '[_$-]', '', 'g')) AS a, lower(regexp_replace(name, '[_$-]', '', 'g')) AS b FROM t JOIN s USING (project)), q AS (SELECT *, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS sim FROM p WHERE length(a) BETWEEN 2 AND 64 AND length(b) BETWEEN 2 AND 64 AND abs(length(a) - length(b)) <= 3)
SELECT project, token, name AS suggestion, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY project, token ORDER BY sim DESC, name) AS n FROM q WHERE sim > 0.6) WHERE n = 1""",
)
def _nearest_names(t):
    rows = search.current(_chunks(t), "project", "symbolName").where("symbolName <> ''").withColumn("name", identifiers.bare_name("symbolName"))
    return conformance.nearest_names(rows.where("rec_id % 50 = 0").select("project", F.concat("name", F.lit("x")).alias("token")), rows)


_CONST = r"""^[ \t]*(export\s+)?const\s+[A-Za-z_$][\w$]*\s*(:[^=\n]+)?=\s*("[^"\n]{1,100}"|'[^'\n]{1,100}')|^[A-Z][A-Z0-9_]{1,63}\s*=\s*("[^"\n]{1,100}"|'[^'\n]{1,100}')""".replace("'", "''")
_LINES = f"(SELECT project, filePath, coalesce(startLine, 1) + i - 1 AS line, s[i] AS text FROM (SELECT project, filePath, startLine, string_split(content, chr(10)) AS s, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {_ONCE} WHERE content IS NOT NULL))"
_NAME = r"^[ \t]*(?:export\s+)?(?:const\s+)?([A-Za-z_$][\w$]*)"
_VALUES = (r'=\s*"([^"\n]{1,100})"', r"=\s*''([^''\n]{1,100})''")


@_query(
    "string_constants",
    f"WITH l AS (SELECT *, regexp_extract(text, '{_NAME}', 1) AS name, regexp_extract(text, '{_VALUES[0]}', 1) AS a, regexp_extract(text, '{_VALUES[1]}', 1) AS b FROM {_LINES} WHERE regexp_matches(text, '{_CONST}')), "
    "d AS (SELECT DISTINCT project, name, CASE WHEN a <> '' THEN a ELSE b END AS value, filePath, line FROM l) SELECT project, name, value, filePath, line::INT AS line FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY filePath, line, name) AS n FROM d WHERE value <> '') WHERE n <= 2000",
)
def _constants(t):
    return conformance.constants(_chunks(t))


@_query(
    "session_ttl",
    """WITH b AS (SELECT coalesce(project, '*') AS project, ts, ts - lag(ts) OVER (PARTITION BY coalesce(project, '*') ORDER BY ts) AS gap FROM query_log), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM b)
SELECT project, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS session_end, count(*) AS beats FROM s GROUP BY project, n""",
)
def _sessions(t):
    rows = streams.sessions(t("query_log").withColumn("project", F.coalesce("project", F.lit("*"))), "ts", "project")
    return rows.select("project", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "beats")


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@_query("event_windows", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def _tumbling(t):
    return streams.counts_by_window(_events(t), "ts", "event_type", "1 hour").withColumn("window_start", F.unix_millis("window_start"))


@_query("event_sliding_windows", "SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k) AS window_start, event_type, count(*) AS events FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def _sliding(t):
    return streams.counts_by_window(_events(t), "ts", "event_type", "1 hour", "30 minutes").withColumn("window_start", F.unix_millis("window_start"))


@_query("event_ring", "SELECT event_id AS id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 512) WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def _ring(t):
    rows = t("events").select(F.col("event_id").alias("id"), "event_type")
    last = rows.agg(F.max("id")).first()[0]
    return streams.ring(rows, last - 100)


@_query("last_changes", "SELECT user_id::VARCHAR AS project, event_type AS filePath, max(epoch_us(ts)) AS ts, count(*) > 0 AS there FROM events GROUP BY ALL")
def _coalesced(t):
    rows = _events(t).select(F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("filePath"), F.lit("change").alias("event"), F.unix_micros("ts").alias("ts"))
    return streams.coalesced(rows).select("project", "filePath", "ts", F.lit(True).alias("there"))


@_query("table_names", "SELECT name, CASE WHEN coalesce(table_name, '') <> '' THEN table_name ELSE 'idx_' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') END AS table_name FROM project_indexes")
def _table_names(t):
    return t("project_indexes").select("name", scalars.stored_table_name("name", "table_name").alias("table_name"))


@_query("orphan_tables", "SELECT DISTINCT 'idx_' || project AS table_name FROM code_records WHERE 'idx_' || project NOT IN (SELECT table_name FROM project_indexes WHERE table_name IS NOT NULL)")
def _orphans(t):
    return reports.orphan_tables(_chunks(t).where("project is not null").select(scalars.table_name("project").alias("table_name")), t("project_indexes").where("table_name is not null"))


@_query("corpus_stats", f"WITH d AS (SELECT project AS scope, len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS dl FROM {_ONCE} WHERE content IS NOT NULL) SELECT scope, count(*) AS n, round(avg(dl), 6) AS avgdl FROM d WHERE dl > 0 GROUP BY scope")
def _stats(t):
    docs = search.current(_chunks(t), "project", "content").select(F.col("project").alias("scope"), F.col("rec_id").alias("id"), F.col("content").alias("text"))
    return ranking.corpus_stats(docs, ranking.words("text")).withColumn("avgdl", F.round("avgdl", 6))


@_query("worst_health", """WITH f AS (SELECT i.name AS project, CASE WHEN i.status = 'error' OR r.n IS NULL THEN 2 WHEN i.status IS DISTINCT FROM 'indexing' AND (r.n <> chunk_count OR file_count = 0) OR r.n >= 50000 THEN 1 ELSE 0 END AS s FROM project_indexes i LEFT JOIN (SELECT project, count(DISTINCT rec_id) AS n FROM code_records GROUP BY 1) r ON r.project = i.name)
SELECT project, CASE s WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM f""")
def _worst(t):
    return reports.index_health(t("project_indexes"), _chunks(t)).groupBy("project").agg(reports.worst(F.col("status")).alias("status"))
