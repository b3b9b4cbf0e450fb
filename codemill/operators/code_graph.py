"""References, call edges, traversals, dead code, change impact: what symbols and texts say of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemill.functions.identifiers import bare_name, dotted_runs, identifier_lines, is_exported, match_names
from codemill.functions.predicates import content_contains, is_callable, is_candidate, is_document, is_entry_point, is_test_file
from codemill.operators.search import current
from codemill.settings import FANOUT_SAMPLE, REFERENCE_SAMPLES
from codemill.storage import staged

#: Names that are called by convention.
HOOK_NAMES = (
    "toString valueOf toJSON toLocaleString then catch finally call apply bind render componentDidMount componentWillUnmount mount unmount useEffect "
    "main __main__ run start stop __init__ init initialize constructor new ctor create destroy dispose close finalize del "
    "setup teardown setUp tearDown beforeEach afterEach _init _ready _enter_tree _exit_tree _process _physics_process _input _input_event "
    "_shortcut_input _unhandled_input _unhandled_key_input _draw _gui_input _clips_input _notification _get _set _get_property_list "
    "_get_minimum_size _validate_property _to_string"
).split()
HOOK_PREFIX = r"^(handle|command|do|on|run|get|set|is|has|can|should|visit|accept)([A-Z_])"
CONSTRUCTOR_LIKE = r"(?i)^(init|initialize|constructor|new|ctor|__init__|create|setup|__new)$"
POLYMORPHIC = r"@Override\b|\boverride\b|\bvirtual\b|\bimplements\b|\bextends\b|\babstract\b"

KEY = ["project", "symbolName", "filePath"]


def inventory(chunks: DataFrame) -> DataFrame:
    """project, symbolName, filePath, symbolType, language, startLine, endLine, content: each symbol of a file once, with its
    first and last line and its longest content (ties: the first chunk). Chunks without both lines are passed over."""
    rows = current(chunks, *KEY, "symbolType", "language", "startLine", "endLine", "content").where("symbolName <> '' and filePath is not null and startLine is not null and endLine is not null")
    best = F.max_by(F.struct("content", "symbolType", "language"), F.struct(F.length(F.coalesce("content", F.lit(""))), -F.col("rec_id"))).alias("b")
    return rows.groupBy(*KEY).agg(F.min("startLine").alias("startLine"), F.max("endLine").alias("endLine"), best).select(*KEY, "startLine", "endLine", "b.*")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """project, filePath, rec_id, owner (symbolName), symbolType, line, text of every line of every chunk."""
    rows = current(chunks, "project", "filePath", "symbolName", "symbolType", "startLine", "content").where("content is not null")
    rows = rows.select("project", "filePath", "rec_id", F.col("symbolName").alias("owner"), "symbolType", F.coalesce("startLine", F.lit(1)).alias("first"), F.posexplode(F.split("content", "\n")).alias("n", "text"))
    return rows.select("project", "filePath", "rec_id", "owner", "symbolType", (F.col("first") + F.col("n")).alias("line"), "text")


def occurrences(lines: DataFrame, names: DataFrame) -> DataFrame:
    """project, filePath, rec_id, owner, line, name: every place in lines where a name (project, name) stands as a whole.

    A chain a.b.c is read from the left; where several spans of it are names, the longest counts, and reading goes on behind it.
    Chains of one segment, most of them, never leave their row; of longer ones only spans that are names are brought together."""
    names = names.select("project", "name").distinct()
    runs = lines.select("project", "filePath", "rec_id", "owner", "line", F.posexplode(dotted_runs("text")).alias("run", "chain"))
    single = runs.where(~F.contains("chain", F.lit("."))).select("project", "filePath", "rec_id", "owner", "line", F.col("chain").alias("name")).join(names, ["project", "name"])
    parts = runs.where(F.contains("chain", F.lit("."))).withColumn("parts", F.split("chain", r"\."))
    n = F.size("parts")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("at"), (-j).alias("end"), F.array_join(F.slice("parts", i + 1, j - i), ".").alias("name"))))
    )
    spread = parts.select("project", "filePath", "rec_id", "owner", "line", "run", F.inline(spans)).join(names, ["project", "name"])
    found = spread.groupBy("project", "filePath", "rec_id", "owner", "line", "run").agg(F.sort_array(F.collect_list(F.struct("at", "end", "name"))).alias("spans"))
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("names"))
    greedy = F.aggregate(
        "spans",
        empty,
        lambda acc, s: F.when(s["at"] >= acc["next"], F.struct((-s["end"]).alias("next"), F.concat(acc["names"], F.array(s["name"])).alias("names"))).otherwise(acc),
        lambda acc: acc["names"],
    )
    chained = found.select("project", "filePath", "rec_id", "owner", "line", F.explode(greedy).alias("name"))
    cols = ["project", "filePath", "rec_id", "owner", "line", "name"]
    return single.select(cols).union(chained.select(cols))


def names_of(symbols: DataFrame) -> DataFrame:
    """project, name, symbolName, filePath, startLine: each name that a symbol can be referred to by."""
    return symbols.select(*KEY, "startLine", F.explode(match_names("symbolName")).alias("name")).where("name <> ''")


def references(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, filePath, rec_id, owner, line, name: occurrences of the symbols' names but on lines that declare the name there."""
    names = names_of(symbols)
    found = occurrences(chunk_lines(chunks), names)
    declared = names.select("project", "name", "filePath", F.col("startLine").alias("line")).distinct()
    return found.join(declared, ["project", "name", "filePath", "line"], "left_anti")


def reference_counts(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, symbolName, filePath, references: of every symbol, none too. Symbols that share a name share its matches."""
    per = references(symbols, chunks).groupBy("project", "name").agg(F.count("*").alias("n"))
    return names_of(symbols).join(per, ["project", "name"], "left").groupBy(*KEY).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("references"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """project, caller, caller_file, callee, callee_file: a callable symbol's chunks hold a name of a callable symbol, but not
    where that declares itself. Recursion is an edge of a symbol to itself."""
    symbols = inventory(chunks).where(is_callable("symbolType"))
    bodies = chunks.where(is_callable("symbolType") & (F.col("symbolName") != ""))
    found = references(symbols, bodies).select("project", F.col("owner").alias("caller"), F.col("filePath").alias("caller_file"), "name").distinct()
    owners = names_of(symbols).select("project", "name", F.col("symbolName").alias("callee"), F.col("filePath").alias("callee_file"))
    return found.join(owners, ["project", "name"]).select("project", "caller", "caller_file", "callee", "callee_file").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("project", F.col("callee").alias("caller"), F.col("callee_file").alias("caller_file"), F.col("caller").alias("callee"), F.col("caller_file").alias("callee_file"))


def reach(anchors: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """anchor, node, depth: what each anchor (anchor, node) reaches over edges (src, dst) in at most depth steps, at the least
    depth. The anchor itself is none of it, cycles end; each level is written to the shared folder."""
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    seen = anchors.select("anchor", "node").distinct().withColumn("depth", F.lit(0))
    level, out = seen, None
    for d in range(1, depth + 1):
        step = level.join(edges, level["node"] == edges["src"]).select("anchor", F.col("dst").alias("node")).distinct()
        level = staged(step.join(seen, ["anchor", "node"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        out = level if out is None else out.unionByName(level)
        seen = seen.unionByName(level)
        if level.isEmpty():
            break
    return out if out is not None else seen.where("false")


def call_paths(anchors: DataFrame, edges: DataFrame, depth: int = 3, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(tree, totals). tree: anchor, path (nodes from the anchor on), depth, cyclic - the call tree of each anchor in order of
    depth first, at most limit nodes; a node that stands in its own path is a leaf and cyclic; equal nodes on different paths
    stay apart. totals: anchor, nodes, truncated."""
    edges = edges.select("src", "dst").distinct()
    level = anchors.select("anchor", F.array("node").alias("path"), F.lit(False).alias("cyclic")).distinct()
    out = level
    for _ in range(depth):
        open_ = level.where("not cyclic")
        step = open_.join(edges, F.element_at("path", -1) == F.col("src"))
        level = step.select("anchor", F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cyclic"))
        level = staged(level.withColumn("_n", F.row_number().over(Window.partitionBy("anchor").orderBy("path"))).where(F.col("_n") <= limit + 1).drop("_n"), "call-paths")
        out = out.unionByName(level)
        if level.isEmpty():
            break
    w = Window.partitionBy("anchor").orderBy("path")
    ranked = out.withColumn("n", F.row_number().over(w)).withColumn("depth", F.size("path") - 1)
    tree = ranked.where(F.col("n") <= limit).select("anchor", "path", "depth", "cyclic")
    totals = ranked.groupBy("anchor").agg(F.least(F.count("*"), F.lit(limit)).alias("nodes"), (F.count("*") > limit).alias("truncated"))
    return tree, totals


def reference_scan(queries: DataFrame, chunks: DataFrame, limit: int | None = 50, include_docs: bool = True) -> DataFrame:
    """query_id, filePath, line, text, rank, total: lines that hold the name of a query (query_id, scope, name) as a whole
    identifier, each line of a file once, by file and line; total counts before the limit."""
    rows = current(chunks, "project", "filePath", "startLine", "content").where("content is not null and filePath is not null")
    if not include_docs:
        rows = rows.where(~is_document("filePath"))
    asked = queries.where("name <> ''")
    # a chunk is joined with the queries whose first identifier run it holds; the exact test follows
    key = F.coalesce(F.try_element_at(F.regexp_extract_all("name", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)), F.lit(1)), F.lit(""))
    runs = rows.select("rec_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))).alias("key"))
    hit = runs.join(asked.withColumn("key", key).where("key <> ''"), "key").select("query_id", "scope", "name", "rec_id").distinct()
    pairs = hit.join(rows, "rec_id").where(F.col("scope").isNull() | (F.col("scope") == F.col("project"))).where(content_contains("content", "name"))
    lines = pairs.select("query_id", "filePath", F.inline(identifier_lines("content", "name", F.coalesce("startLine", F.lit(1)))))
    lines = lines.groupBy("query_id", "filePath", "line").agg(F.min("text").alias("text"))
    w = Window.partitionBy("query_id")
    ranked = lines.withColumn("rank", F.row_number().over(w.orderBy("filePath", "line"))).withColumn("total", F.count("*").over(w))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def dead_score(exported: Column, owner_referenced: Column, common: Column) -> tuple[Column, Column]:
    """(confidence, signals) of a symbol without references, from columns symbolName, symbolType, language, content."""
    bare = bare_name("symbolName")
    polymorphic = F.col("symbolType").isin("trait", "interface") | F.coalesce(F.substring("content", 1, 400).rlike(POLYMORPHIC), F.lit(False))
    constructor = bare.rlike(CONSTRUCTOR_LIKE)
    hook = ~constructor & (bare.isin(*HOOK_NAMES) | bare.rlike(HOOK_PREFIX))
    rules = [
        ("exported", exported, -30),
        ("owner-class-referenced", (F.col("symbolType") == "method") & owner_referenced, -20),
        ("polymorphic", polymorphic, -35),
        ("constructor-like", constructor, -30),
        ("dynamic-hook-name", hook, -25),
        ("common-name", common, -15),
        ("private-by-convention", (F.col("language") == "python") & bare.rlike("^_(?!_)"), 10),
        ("signal-handler-convention", (F.col("language") == "gdscript") & bare.rlike("^_on_"), -25),
    ]
    score, signals = F.lit(80), []
    for name, holds, points in rules:
        holds = F.coalesce(holds, F.lit(False))
        score = score + F.when(holds, points).otherwise(0)
        signals.append(F.when(holds, F.lit(name)))
    return F.greatest(F.lit(0), F.least(F.lit(100), score)), F.filter(F.array(*signals), lambda s: s.isNotNull())


def dead_code(chunks: DataFrame, min_confidence: int = 0) -> DataFrame:
    """project, symbolName, symbolType, filePath, startLine, endLine, language, confidence, category, signals of all symbols
    that nothing refers to. Test files and entry points have no candidates; their texts count as referring."""
    symbols = inventory(chunks).where(is_candidate("symbolType") & ~is_test_file("filePath") & ~is_entry_point("filePath"))
    counts = reference_counts(symbols, chunks)
    rows = symbols.join(counts, KEY)
    shared = F.count("*").over(Window.partitionBy("project", bare_name("symbolName")))
    rows = rows.withColumn("common", shared > 3)
    owners = counts.select("project", "filePath", F.col("symbolName").alias("owner"), (F.col("references") > 0).alias("owner_used"))
    rows = rows.where("references = 0").withColumn("owner", F.when(F.contains("symbolName", F.lit(".")), F.split("symbolName", r"\.")[0]))
    rows = rows.join(owners, ["project", "filePath", "owner"], "left")
    confidence, signals = dead_score(is_exported("symbolName", "language", "content"), F.coalesce("owner_used", F.lit(False)), F.col("common"))
    scored = rows.withColumn("confidence", confidence).withColumn("signals", signals).where(F.col("confidence") >= min_confidence)
    category = F.when(F.col("confidence") >= 70, "likely dead").when(F.col("confidence") >= 40, "uncertain").otherwise("review")
    return scored.select("project", "symbolName", "symbolType", "filePath", "startLine", "endLine", "language", "confidence", category.alias("category"), "signals")


def dead_density(chunks: DataFrame, dead: DataFrame, floor: int = 40) -> DataFrame:
    """project, filePath, dead, candidates: dead symbols of at least the floor's confidence among the candidates of each file."""
    symbols = inventory(chunks).where(is_candidate("symbolType") & ~is_test_file("filePath") & ~is_entry_point("filePath"))
    found = dead.where(F.col("confidence") >= floor).groupBy("project", "filePath").agg(F.count("*").alias("dead"))
    return symbols.groupBy("project", "filePath").agg(F.count("*").alias("candidates")).join(found, ["project", "filePath"], "left").select("project", "filePath", F.coalesce("dead", F.lit(0)).alias("dead"), "candidates")


def change_impact(anchors: DataFrame, chunks: DataFrame, imports: DataFrame, depth: int = 3, limit: int = 25) -> dict[str, DataFrame]:
    """What a change of symbols (anchors: anchor, project, symbolName, filePath) can touch.

    callers: anchor, symbolName, filePath, depth - at least depth, no tests; importers: anchor, filePath, alsoReferences - files
    that import the anchor's, those that refer to it too first; references: anchor, filePath, line, text, rank - lines that name
    it; coveredBy: anchor, filePath, via - test files by call, import or reference, the first that holds; fan_out: anchor,
    calls (all), sample. counts: anchor, references (tests included), files. imports: filePath, path."""
    node = lambda name, file: F.concat_ws("\x00", "project", name, file)
    edges = call_edges(chunks).select(node("caller", "caller_file").alias("src"), node("callee", "callee_file").alias("dst"))
    start = anchors.select("anchor", node("symbolName", "filePath").alias("node"))
    up = reach(start, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth)
    up = up.select("anchor", F.split("node", "\x00")[1].alias("symbolName"), F.split("node", "\x00")[2].alias("filePath"), "depth")
    targets = anchors.select("anchor", "project", F.col("symbolName").alias("_s"), F.col("filePath").alias("_f"))
    names = targets.join(inventory(chunks).select("project", F.col("symbolName").alias("_s"), F.col("filePath").alias("_f"), "startLine"), ["project", "_s", "_f"], "left")
    names = names.select("anchor", "project", "_f", "startLine", F.explode(match_names("_s")).alias("name"))
    lines = chunk_lines(chunks)
    found = occurrences(lines, names).select("project", "filePath", "line", "name").distinct().join(names, ["project", "name"])
    found = found.where(~((F.col("filePath") == F.col("_f")) & (F.col("line") == F.col("startLine")))).select("anchor", "project", "filePath", "line").distinct()
    texts = lines.groupBy("project", "filePath", "line").agg(F.min("text").alias("text"))
    refs = found.join(texts, ["project", "filePath", "line"]).select("anchor", "filePath", "line", F.trim("text").alias("text"))
    test = is_test_file("filePath")
    imp = imports.select("filePath", F.col("path").alias("_f")).distinct().join(targets.select("anchor", "_f"), "_f").where("filePath <> _f").select("anchor", "filePath").distinct()
    mention = found.select("anchor", "filePath", F.lit(True).alias("alsoReferences")).distinct()
    importers = imp.join(mention, ["anchor", "filePath"], "left").withColumn("alsoReferences", F.coalesce("alsoReferences", F.lit(False)))
    covered = up.where(test).select("anchor", "filePath", F.lit(0).alias("o"), F.lit("call").alias("via")).union(imp.where(test).select("anchor", "filePath", F.lit(1), F.lit("import"))).union(found.where(test).select("anchor", "filePath", F.lit(2), F.lit("reference")))
    w = Window.partitionBy("anchor")
    cut = lambda rows, *order: rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w)).where(F.col("rank") <= limit)
    out_edges = start.join(edges, F.col("node") == F.col("src")).where("src <> dst").select("anchor", "dst").distinct()
    return {
        "callers": cut(up.where(~test), "depth", "filePath", "symbolName"),
        "importers": cut(importers.where(~test), F.col("alsoReferences").desc(), "filePath"),
        "references": refs.where(~test).withColumn("rank", F.row_number().over(w.orderBy("filePath", "line"))).where(F.col("rank") <= REFERENCE_SAMPLES),
        "coveredBy": covered.groupBy("anchor", "filePath").agg(F.min_by("via", "o").alias("via")),
        "fan_out": out_edges.groupBy("anchor").agg(F.count("*").alias("calls"), F.slice(F.sort_array(F.collect_set("dst")), 1, FANOUT_SAMPLE).alias("sample")),
        "counts": found.groupBy("anchor").agg(F.count("*").alias("references"), F.countDistinct("filePath").alias("files")),
    }
