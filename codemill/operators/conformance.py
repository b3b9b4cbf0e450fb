"""Whether documents say what the code says: claims in backticks, what they claim, and what of it the code has."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemill.functions.identifiers import bare_name, is_exported, normal_identifier, similarity
from codemill.functions.predicates import CANDIDATE_TYPES, glob_to_regex, is_document, is_entry_point, is_test_file, relative_path
from codemill.operators.code_graph import HOOK_NAMES, inventory
from codemill.operators.ranking import within_budget
from codemill.operators.search import current

#: Vocabularies and patterns that the classes of claims depend on.
COMMANDS = "bun bunx npm npx pnpm yarn node deno tsx git godot ollama curl wget docker python python3 pip pip3 uv cargo go make cmake brew apt apt-get pacman systemctl ssh scp rsync tar jq yq grep sed awk find".split()
EXTERNAL_FLAGS = "help version verbose quiet silent force yes dry-run watch all json no-color color".split()
EXTERNAL_ENV = "CUDA_ NV_ VK_ GL_ DISPLAY XDG_ GIO_ GTK_ QT_ DBUS_ LC_ LANG TERM SHELL USER LOGNAME PWD TMPDIR HTTP_PROXY HTTPS_PROXY NO_PROXY SSH_ GPG_ WSL_ WINDOWID PATH HOME EDITOR VISUAL PAGER MANPAGER BROWSER OLLAMA_".split()
OPTIONAL_FILES = "config.yml config.yaml .env .npmrc tsconfig.json bunfig.toml".split()
EXTENSIONS = "ts tsx js jsx mjs cjs py go rs java kt kts swift scala sc rb php cs c cc cpp h hpp gd gdshader md mdx json yml yaml toml xml rst txt sh bash zsh bat ps1 sql html css scss vue svelte tscn tres godot wasm lockb".split()
ACRONYMS = "MCP RRF FTS ANN LSP API CLI HTTP HTTPS JSON YAML TOML XML SQL SSE URI URL SDK NPM GIT CPU GPU RAM VRAM MMR TTL UTC PID WASM AST DOM IDE UI UX AI LLM SSH SSL TLS TCP UDP DNS RPC CRUD IEEE ASCII UTF POSIX EOF TODO".split()
ARTIFACT_FOLDER = r"(^|/)(node_modules|dist|build|out|target|coverage|\.next|\.nuxt|\.cache|\.venv|__pycache__|vendor)(/|$)"
ARTIFACT_ENDING = r"(?i)\.(min\.js|min\.css|map|lock|log|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot|mp[34]|pdf|zip|gz|tgz|bz2|xz|7z|rar|jar|class|pyc|o|so|dll|exe|bin)$"
HISTORICAL = r"(?i)(^|/)(changelog|changes|release-?notes|history|proposals?|roadmap|drafts?)(\.|$)"
PLANNED = r"\b(proposal|proposals|proposed|planned|roadmap|not yet|in progress|todo|draft|wip|future)\b|💡|🚧|🏗"
EXAMPLE = r"(?i)(^|[(\s])(e\.g\.|i\.e\.|for example|for instance|such as|sample:|example:)"
UNIT = r"(?i)\.(?:service|socket|timer|target|mount|automount|swap|path|slice|scope|device)$"
IGNORE_MARKER = "<!-- doccheck-ignore -->"
EXCERPT, EVIDENCE, CONSTANTS = 160, 3, 2000


def spans(docs: DataFrame) -> DataFrame:
    """project, doc, line, pos, token, region, excerpt of the backtick spans of documents (project, doc, text).

    region: historical for documents whose name says so, example within fences, planned below a heading that says so, else
    current. Fence and heading lines have no spans; an ignore marker takes its own line and the next. The state runs along the
    lines of a document, so each document is read once, in Arrow batches."""
    historical, planned = re.compile(HISTORICAL), re.compile(PLANNED, re.I)
    fence, heading, tick = re.compile(r"^\s*(```|~~~)"), re.compile(r"^(\s*)(#{1,6})\s+(.*)$"), re.compile(r"`([^`\n]+)`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for project, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                old, inside, upcoming, skip = bool(historical.search(doc or "")), "", False, 0
                for n, raw in enumerate((text or "").split("\n"), 1):
                    if n == skip:
                        continue
                    if IGNORE_MARKER in raw:
                        skip = n + 1
                        continue
                    if not old and (m := fence.match(raw)):
                        inside = m[1] if not inside else "" if m[1] == inside else inside
                        continue
                    if not inside and (m := heading.match(raw)):
                        upcoming = bool(planned.search(m[3]))
                        continue
                    if "`" in raw:
                        region = "historical" if old else "example" if inside else "planned" if upcoming else "current"
                        out += [(project, doc, n, m.start(), m[1].strip(), region, raw.strip()[:EXCERPT]) for m in tick.finditer(raw) if m[1].strip()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=["project", "doc", "line", "pos", "token", "region", "excerpt"])

    return docs.select("project", "doc", "text").mapInArrow(run, "project string, doc string, line int, pos int, token string, region string, excerpt string")


def span_class(token: Column) -> Column:
    """The class of a claim; null for an empty one and for more than 200 characters. The order of the rules is their meaning."""
    t = F.trim(token)
    word = F.lower(F.split(t, r"\s+")[0])
    ending = F.lower(F.regexp_extract(t, r"\.([A-Za-z0-9]{1,6})$", 1))
    slash, colon, dot = F.contains(t, F.lit("/")), F.contains(t, F.lit(":")), F.contains(t, F.lit("."))
    return (
        F.when((t == "") | (F.length(t) > 200), None)
        .when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), "external")
        .when(t.rlike(ARTIFACT_FOLDER) | t.rlike(ARTIFACT_ENDING), "artifact")
        .when(t.rlike(r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/\S*$"), "endpoint")
        .when(t.rlike(r"^(@[\w.-]+/[\w.-]+|\w[\w.-]*)@[\w.^~><=*+,-]+$"), "dep")
        .when(t.rlike(r"^-{1,2}[a-zA-Z][\w-]*$"), "flag")
        .when(t.rlike("^[A-Z][A-Z0-9_]*$") & F.contains(t, F.lit("_")) & (F.length(t) >= 6), "env")
        .when(t.rlike(r"^\S+\s*(?:→|->)\s*\S+$"), "composite")
        .when(t.rlike(r"^[A-Za-z_$][\w.$-]*\s*=\s*\S.{0,120}$") | t.rlike(r"^[A-Za-z_$][\w.$-]*\s*:\s+\S.{0,120}$"), "kv")
        .when(t.rlike(r"\s") & word.isin(*COMMANDS), "cmd")
        .when(t.rlike(r"\s"), "opaque")
        .when(t.rlike(r"^v?\d+(\.\d+)+$|^\d"), "opaque")
        .when(slash & colon, "external")
        .when(t.rlike("[<>]"), "external")
        .when(~colon & t.rlike(r"\d") & F.contains(t, F.lit("-")) & dot & ~t.rlike("[A-Z]"), "opaque")
        .when(t.rlike(r"^[A-Za-z][\w.-]*:[\w.-]+$") & ~slash, "model-tag")
        .when(slash | ending.isin(*EXTENSIONS), "path")
        .when(dot & t.rlike(r"^[a-z][\w-]*(\.[a-z][\w-]*)+$"), "config-path")
        .when(dot, "identifier")
        .when(t.rlike(r"^[A-Za-z_$][\w$]*$"), "identifier")
        .otherwise("opaque")
    )


def constants(chunks: DataFrame) -> DataFrame:
    """project, name, value, filePath, line of string constants of 1 to 100 characters at the head of a line, the first CONSTANTS
    of each project by file and line."""
    rows = current(chunks, "project", "filePath", "content", "startLine").where("content is not null")
    pattern = r"""(?m)^[ \t]*(?:(?:export\s+)?const\s+)([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:"[^"\n]{1,100}"|'[^'\n]{1,100}')|^[A-Z][A-Z0-9_]{1,63}\s*=\s*(?:"[^"\n]{1,100}"|'[^'\n]{1,100}')"""
    lines = rows.select("project", "filePath", F.coalesce("startLine", F.lit(1)).alias("first"), F.posexplode(F.split("content", "\n")).alias("n", "text"))
    lines = lines.where(F.col("text").rlike(pattern))
    name = F.regexp_extract("text", r"^[ \t]*(?:export\s+)?(?:const\s+)?([A-Za-z_$][\w$]*)", 1)
    value = F.regexp_extract("text", r"""=\s*(?:"([^"\n]{1,100})"|'([^'\n]{1,100})')""", 1)
    other = F.regexp_extract("text", r"""=\s*'([^'\n]{1,100})'""", 1)
    out = lines.select("project", name.alias("name"), F.when(value != "", value).otherwise(other).alias("value"), "filePath", (F.col("first") + F.col("n")).alias("line")).where("value <> ''").distinct()
    w = Window.partitionBy("project").orderBy("filePath", "line", "name")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= CONSTANTS).drop("n")


def identifier_hits(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, token, evidence of identifiers (project, token) that stand whole in code: at most EVIDENCE places by path and line."""
    lines = _code_lines(chunks).select("project", "filePath", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))).alias("token"))
    return _evidence(lines.join(tokens.select("project", "token").distinct(), ["project", "token"]).select("project", "token", "filePath", "line"))


def literal_hits(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """As identifier_hits for any text: it stands where neither end goes on as a word. Lines are found by the first identifier run
    of the text; texts without one have no hit."""
    key = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit("([A-Za-z0-9_$]+)"), F.lit(1)), F.lit(1))
    wanted = tokens.select("project", "token").distinct().withColumn("key", key(F.col("token"))).where("key is not null")
    lines = _code_lines(chunks)
    runs = lines.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))))
    near = runs.join(wanted, ["project", "key"]).where(F.contains("text", F.col("token")))
    whole = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace("token", F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![A-Za-z0-9_])"))
    return _evidence(near.where(F.regexp_like("text", whole)).select("project", "token", "filePath", "line"))


def _code_lines(chunks: DataFrame) -> DataFrame:
    rows = current(chunks, "project", "filePath", "content", "startLine").where("content is not null").where(~is_document("filePath"))
    rows = rows.select("project", "filePath", F.coalesce("startLine", F.lit(1)).alias("first"), F.posexplode(F.split("content", "\n")).alias("n", "text"))
    return rows.select("project", "filePath", (F.col("first") + F.col("n")).alias("line"), "text")


def _evidence(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("project", "token").orderBy("filePath", "line")
    first = rows.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= EVIDENCE)
    return first.groupBy("project", "token").agg(F.sort_array(F.collect_list(F.struct(F.col("filePath").alias("path"), "line"))).alias("evidence"))


def nearest_names(tokens: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """project, token, suggestion: the most similar name, by normal form, above least; ties to the smaller name.

    Names of a length within three are met by blocks: only names are measured whose normal forms share a pair of characters,
    which that similarity makes certain."""
    t = tokens.select("project", "token").distinct().withColumn("a", normal_identifier("token")).where(F.length("a").between(2, 64))
    n = names.select("project", "name").distinct().withColumn("b", normal_identifier("name")).where(F.length("b").between(2, 64))
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, 2))
    # above 0.6 two names share a pair of characters, unless neither has more than three: then a character
    grams = lambda c: F.array_distinct(F.concat(pairs(c), F.when(F.length(c) <= 3, F.split(c, "")).otherwise(F.array().cast("array<string>"))))
    shared = t.withColumn("g", F.explode(grams(F.col("a")))).join(n.withColumn("g", F.explode(grams(F.col("b")))), ["project", "g"])
    shared = shared.where(F.abs(F.length("a") - F.length("b")) <= 3).groupBy("project", "token", "a", "name", "b").agg(F.count("*").alias("same"))
    scored = shared.withColumn("s", similarity("a", "b")).where(F.col("s") > least)
    w = Window.partitionBy("project", "token").orderBy(F.col("s").desc(), "name")
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").select("project", "token", F.col("name").alias("suggestion"), F.round("s", 6).alias("similarity"))


def verdicts(claims: DataFrame, chunks: DataFrame, roots: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """claims (as spans) with class, status (ok, missing, review, skipped), confidence, reason, suggestion and evidence.

    roots: project, path; manifests: project, dependencies, scripts (maps). Claims that are not current are skipped by region.
    Every distinct token of a project is looked up once; what it claims decides which lookups count."""
    rows = claims.withColumn("class", span_class(F.col("token"))).where("class is not null")
    live = rows.where("region = 'current'").select("project", "doc", "token", "class").distinct()
    plain = F.regexp_replace("token", r"\(\)$", "")
    verbless = F.regexp_replace(F.regexp_replace("token", r"^\S+\s+", ""), r"\?.*$", "")
    name = F.regexp_replace("token", r"^-+", "")
    camel = F.array_join(F.transform(F.split(name, "-"), lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")
    parts = (
        F.when(F.col("class") == "identifier", F.filter(F.split(plain, r"\."), lambda x: x != ""))
        .when(F.col("class") == "endpoint", F.filter(F.split(verbless, "/"), lambda x: (x != "") & ~x.rlike(r"^[{:*<]")))
        .when(F.col("class") == "flag", F.filter(F.split(name, "-"), lambda x: x != ""))
        .when(F.col("class") == "kv", F.filter(F.split(F.regexp_extract("token", r"^([\w.$:-]+?)\s*[=:]\s*\S", 1), r"[.:]"), lambda x: x != ""))
        .when(F.col("class") == "cmd", F.filter(F.slice(F.split("token", r"\s+"), 2, 200), lambda x: ~F.startswith(x, F.lit("-")) & (F.length(x) > 1) & ~x.rlike(UNIT)))
        .when(F.col("class") == "model-tag", F.array(F.split("token", ":")[0]))
        .when(F.col("class") == "composite", F.array(F.regexp_extract("token", r"(?:→|->)\s*(\S+)$", 1)))
        .otherwise(F.array(F.col("token")))
    )
    live = live.withColumn("parts", parts)
    key = ["project", "doc", "token"]
    # identifiers: the parts, the token itself, and a flag's name in camel case
    words = live.select(*key, F.explode(F.array_distinct(F.concat("parts", F.array(plain, camel)))).alias("w")).where(F.col("w").rlike(r"^[A-Za-z0-9_$]+$"))
    hits = identifier_hits(words.select("project", F.col("w").alias("token")), chunks)
    words = words.join(hits.select("project", F.col("token").alias("w"), "evidence"), ["project", "w"])
    found = words.groupBy(*key).agg(F.collect_set("w").alias("idents"), F.max_by("evidence", "w").alias("ident_evidence"))
    literals = live.where(F.col("class").isin("identifier", "endpoint", "flag", "model-tag", "cmd")).select(*key, F.explode(F.array_distinct(F.concat(F.array(plain, name), F.transform("parts", lambda x: x), F.transform("parts", lambda x: F.concat(F.lit("/"), x))))).alias("w")).where("w <> ''")
    lit = literal_hits(literals.select("project", F.col("w").alias("token")), chunks)
    literals = literals.join(lit.select("project", F.col("token").alias("w"), "evidence"), ["project", "w"]).groupBy(*key).agg(F.collect_set("w").alias("literals"), F.max_by("evidence", "w").alias("literal_evidence"))
    symbols = inventory(chunks).select("project", "symbolName", "filePath", "startLine")
    names = symbols.select("project", F.explode(F.array_distinct(F.array("symbolName", bare_name("symbolName")))).alias("name")).distinct()
    known = live.select("project", "token", plain.alias("name")).distinct().join(names, ["project", "name"]).select("project", "token", F.lit(True).alias("is_symbol")).distinct()
    consts = constants(chunks)
    by_value = live.select("project", "token").distinct().join(consts.select("project", F.col("value").alias("token")).distinct(), ["project", "token"]).select("project", "token", F.lit(True).alias("is_value"))
    by_name = live.select("project", "token").distinct().join(consts.select("project", F.col("name").alias("token")).distinct(), ["project", "token"]).select("project", "token", F.lit(True).alias("is_constant"))
    near = nearest_names(live.where("class = 'identifier'").select("project", plain.alias("token")), names)
    paths = _path_claims(live, chunks, roots)
    joined = rows.join(live.select(*key, "parts"), key, "left").join(found, key, "left").join(literals, key, "left").join(known, ["project", "token"], "left").join(by_value, ["project", "token"], "left").join(by_name, ["project", "token"], "left")
    joined = joined.join(paths, key, "left").withColumn("plain", plain).join(near.select("project", F.col("token").alias("plain"), "suggestion"), ["project", "plain"], "left")
    if manifests is not None:
        joined = joined.join(manifests.select("project", "dependencies", "scripts").dropDuplicates(["project"]), "project", "left")
    else:
        joined = joined.withColumn("dependencies", F.create_map().cast("map<string,string>")).withColumn("scripts", F.create_map().cast("map<string,string>"))
    return _decided(joined)


def _path_claims(live: DataFrame, chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """project, doc, token, p_status, p_confidence, target of the claims that name a path (of composites, their left side)."""
    files = chunks.where("filePath is not null").select("project", "filePath").distinct().join(roots.select("project", F.col("path").alias("_r")).dropDuplicates(["project"]), "project", "left")
    files = files.select("project", "filePath", relative_path("filePath", "_r").alias("rel")).distinct()
    left = F.when(F.col("class") == "composite", F.regexp_extract("token", r"^(\S+?)\s*(?:→|->)", 1)).otherwise(F.col("token"))
    claims = live.where(F.col("class").isin("path", "composite")).select("project", "doc", "token", F.regexp_replace(F.regexp_replace(left, r"^\./", ""), r"^/|/$", "").alias("p"), left.alias("raw"))
    folder = F.regexp_replace("doc", r"[^/]*$", "")
    tries = claims.select("project", "doc", "token", F.posexplode(F.array(F.col("p"), F.concat(F.lit("src/"), F.col("p")), F.concat(folder, F.col("p")))).alias("n", "rel"))
    exact = tries.join(files, ["project", "rel"]).groupBy("project", "doc", "token").agg(F.min(F.struct("n", "filePath")).alias("e"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    tails = claims.withColumn("last", last(F.col("p"))).join(files.withColumn("last", last(F.col("rel"))), ["project", "last"]).where(F.endswith("rel", F.concat(F.lit("/"), F.col("p"))))
    suffix = tails.groupBy("project", "doc", "token").agg(F.count("*").alias("s"), F.min("filePath").alias("s_path"))
    parts = F.split("rel", "/")
    folders = files.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("p")).distinct()
    inside = claims.join(folders, ["project", "p"]).select("project", "doc", "token", F.lit(True).alias("dir")).distinct()
    endings = files.select("project", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]{1,6})$", 1)).alias("ending")).distinct()
    globs = claims.where(F.contains("p", F.lit("*")))
    anchor = F.regexp_extract("p", r"\.([A-Za-z0-9]{1,6})$", 1)
    matcher = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("p", r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*\*/", "\x01"), r"\*\*", "\x02"), r"\*", "[^/]*")
    matcher = F.concat(F.lit("^"), F.replace(F.replace(matcher, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*")), F.lit("$"))
    globbed = globs.withColumn("ending", F.lower(anchor)).join(files.withColumn("ending", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]{1,6})$", 1))), ["project", "ending"]).where(F.regexp_like("rel", matcher)).select("project", "doc", "token", F.lit(True).alias("globbed")).distinct()
    rows = claims.withColumn("ending", F.lower(F.regexp_extract("p", r"\.([A-Za-z0-9]{1,6})$", 1))).join(exact, ["project", "doc", "token"], "left").join(suffix, ["project", "doc", "token"], "left").join(inside, ["project", "doc", "token"], "left").join(globbed, ["project", "doc", "token"], "left")
    rows = rows.join(endings.withColumn("seen", F.lit(True)), ["project", "ending"], "left")
    skip = F.col("raw").rlike(r"^~|^\.\./|^\.git(/|$)") | F.col("raw").rlike(r"(?i)^\.[a-z0-9]{1,6}$") | F.col("p").isin(*OPTIONAL_FILES)
    glob = F.contains("p", F.lit("*"))
    status = (
        F.when(skip, "skipped").when(glob & F.col("globbed"), "ok").when(glob, "missing").when(F.col("e").isNotNull(), "ok").when(F.col("s") == 1, "ok").when(F.col("s") > 1, "missing")
        .when(F.col("dir"), "ok").when(F.endswith("raw", F.lit("/")), "missing").when(F.col("raw").rlike(r"^[/.]"), "skipped").otherwise("missing")
    )
    confidence = (
        F.when(skip, 0).when(glob & F.col("globbed"), 90).when(glob, 85).when(F.col("e")["n"] == 0, 100).when(F.col("e").isNotNull(), 95).when(F.col("s") == 1, 90).when(F.col("s") > 1, 70)
        .when(F.col("dir"), 90).when(F.endswith("raw", F.lit("/")), 70).when(F.col("raw").rlike(r"^[/.]"), 0).when(F.col("ending") == "", 70).when(F.col("seen").isNull(), 85).otherwise(95)
    )
    return rows.select("project", "doc", "token", status.alias("p_status"), confidence.alias("p_confidence"), F.coalesce("e.filePath", F.when(F.col("s") == 1, F.col("s_path"))).alias("target")).dropDuplicates(["project", "doc", "token"])


def _decided(rows: DataFrame) -> DataFrame:
    idents, literals, parts = F.coalesce("idents", F.array().cast("array<string>")), F.coalesce("literals", F.array().cast("array<string>")), F.coalesce("parts", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(idents, x)
    lit = lambda x: F.array_contains(literals, x)
    every = F.forall(parts, lambda x: F.array_contains(idents, x) | F.array_contains(literals, x) | F.array_contains(literals, F.concat(F.lit("/"), x)))
    name = F.regexp_replace("token", r"^-+", "")
    camel = F.array_join(F.transform(F.split(name, "-"), lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")
    dotted, last = F.contains("plain", F.lit(".")), F.element_at(F.split("plain", r"\."), -1)
    c = F.col("class")
    yes = lambda col: F.coalesce(F.col(col), F.lit(False))
    version = F.regexp_replace(F.regexp_extract("token", r"@([\w.^~><=*+,-]+)$", 1), r"^[\^~>=v]+", "")
    package = F.regexp_extract("token", r"^(@?[^@]+)@", 1)
    held = F.regexp_replace(F.coalesce(F.try_element_at("dependencies", package), F.lit("")), r"^[\^~>=v]+", "")
    script = F.regexp_extract("token", r"\brun\s+(\S+)", 1)
    rules: list[tuple[Column, str, int, str]] = [
        (F.col("region") != "current", "skipped", 0, "region"),
        (c.isin("artifact", "external", "opaque"), "skipped", 0, "class"),
        ((c == "identifier") & (yes("is_value") | yes("is_symbol") | has(F.col("plain"))), "ok", 100, ""),
        ((c == "identifier") & dotted & lit(F.col("plain")), "ok", 100, ""),
        ((c == "identifier") & dotted & has(last), "ok", 95, ""),
        ((c == "identifier") & dotted & every, "ok", 90, ""),
        ((c == "identifier") & F.col("suggestion").isNotNull(), "missing", 92, "renamed?"),
        ((c == "identifier") & F.col("plain").rlike("^[a-z]{1,7}$"), "skipped", 0, "generic"),
        ((c == "identifier") & ((F.length("plain") <= 3) | F.col("plain").isin(*ACRONYMS)), "skipped", 0, "acronym"),
        ((c == "identifier") & F.col("plain").rlike("^[A-Z0-9]{4,6}$"), "review", 50, "acronym?"),
        (c == "identifier", "missing", 95, "not in the code"),
        ((c == "env") & (has(F.col("token")) | yes("is_constant")), "ok", 100, ""),
        ((c == "env") & F.col("token").rlike("^(" + "|".join(EXTERNAL_ENV) + ")"), "skipped", 0, "platform"),
        (c == "env", "missing", 95, "not in the code"),
        ((c == "endpoint") & (F.size(parts) == 0), "skipped", 0, "no segment"),
        ((c == "endpoint") & every, "ok", 100, ""),
        (c == "endpoint", "missing", 93, "segment not in the code"),
        ((c == "cmd") & (script != "") & F.map_contains_key("scripts", script), "ok", 100, ""),
        ((c == "cmd") & (script != "") & ~script.rlike(r"[/.]"), "missing", 92, "no such script"),
        ((c == "cmd") & (F.size(parts) == 0), "skipped", 0, "no argument"),
        ((c == "cmd") & every, "ok", 90, ""),
        (c == "cmd", "missing", 92, "argument not in the code"),
        ((c == "flag") & ((F.length(name) == 1) | name.isin(*EXTERNAL_FLAGS)), "skipped", 0, "generic"),
        ((c == "flag") & lit(F.col("token")), "ok", 100, ""),
        ((c == "flag") & lit(name), "ok", 95, ""),
        ((c == "flag") & has(camel), "ok", 90, ""),
        ((c == "flag") & every, "ok", 85, ""),
        (c == "flag", "missing", 92, "not in the code"),
        ((c == "dep") & F.map_contains_key("dependencies", package) & F.startswith(held, version), "ok", 100, ""),
        (c == "dep", "missing", 80, "no such dependency or version"),
        ((c == "kv") & F.col("token").rlike("^[A-Z][A-Z0-9]*_[A-Z0-9_]*\\s*[=:]") & has(F.element_at(parts, 1)), "ok", 100, ""),
        ((c == "kv") & F.col("token").rlike("^[A-Z][A-Z0-9]*_[A-Z0-9_]*\\s*[=:]") & F.col("token").rlike("^(" + "|".join(EXTERNAL_ENV) + ")"), "skipped", 0, "platform"),
        ((c == "kv") & F.col("token").rlike("^[A-Z][A-Z0-9]*_[A-Z0-9_]*\\s*[=:]"), "missing", 95, "not in the code"),
        ((c == "kv") & (F.size(parts) > 0) & every, "ok", 90, ""),
        (c == "kv", "missing", 85, "key not in the code"),
        (c == "config-path", "skipped", 0, "generic"),
        ((c == "model-tag") & (lit(F.col("token")) | lit(F.element_at(parts, 1)) | has(F.element_at(parts, 1)) | yes("is_symbol")), "ok", 95, ""),
        (c == "model-tag", "review", 60, "tag not in the code"),
        ((c == "composite") & (F.col("p_status") == "skipped"), "skipped", 0, "path"),
        ((c == "composite") & (F.col("p_status") == "missing"), "missing", 93, "no such file"),
        ((c == "composite") & every, "ok", 100, ""),
        (c == "composite", "missing", 94, "symbol not in the file"),
    ]
    status = F.when(F.col("region") != "current", "skipped").when(c == "path", F.col("p_status"))
    confidence = F.when(F.col("region") != "current", 0).when(c == "path", F.col("p_confidence"))
    reason = F.when(F.col("region") != "current", "region").when(c == "path", F.when(F.col("p_status") == "missing", "no such file").otherwise(""))
    for holds, s, n, why in rules:
        holds = F.coalesce(holds, F.lit(False))
        status, confidence, reason = status.when(holds, s), confidence.when(holds, n), reason.when(holds, why)
    out = rows.withColumn("status", status).withColumn("confidence", confidence).withColumn("reason", reason)
    return out.select("project", "doc", "line", "pos", "token", "class", "region", "excerpt", "status", "confidence", "reason", F.when(F.col("reason") == "renamed?", F.col("suggestion")).alias("suggestion"), F.coalesce("ident_evidence", "literal_evidence").alias("evidence"))


def demoted(rows: DataFrame) -> DataFrame:
    """Claims that are missing or under review but look like examples in prose go to review at 50: a path segment of one
    character, a word that says so on the line, or another claim of the line with the same normal form."""
    w = Window.partitionBy("project", "doc", "line")
    mates = F.collect_set(F.struct(normal_identifier("token").alias("n"), F.col("token").alias("t"))).over(w)
    twin = F.exists(mates, lambda m: (m["n"] == normal_identifier("token")) & (m["t"] != F.col("token")))
    short = (F.col("class") == "path") & F.exists(F.split("token", "/"), lambda s: F.length(s) <= 1)
    example = F.col("status").isin("missing", "review") & (short | F.col("excerpt").rlike(EXAMPLE) | twin)
    return rows.withColumn("example", example).withColumn("status", F.when(F.col("example"), "review").otherwise(F.col("status"))).withColumn("confidence", F.when(F.col("example"), 50).otherwise(F.col("confidence")))


def judged(rows: DataFrame, judge: Column, least: float = 0.8) -> DataFrame:
    """Pending claims (missing or review, no examples) that a judge (probability of being consistent) confirms become ok."""
    sure = F.col("status").isin("missing", "review") & ~F.col("example") & (F.coalesce(judge, F.lit(0.0)) >= least)
    return rows.withColumn("status", F.when(sure, "ok").otherwise(F.col("status")))


def findings(rows: DataFrame, limit: int | None = 100, max_chars: int | None = 12_000) -> DataFrame:
    """project, band (drift for missing at 90 or more, else suspected or review), id, class, doc, line, token, confidence, reason,
    suggestion, total. Equal claims of a line count once; ids number a project's findings in the order of documents and lines;
    the order is by confidence, then by id as text. Whole findings are left out beyond the limit and the budget."""
    open_ = rows.where(F.col("status").isin("missing", "review")).groupBy("project", "doc", "line", "token", "class").agg(F.min("pos").alias("pos"), F.min_by(F.struct("status", "confidence", "reason", "suggestion", "excerpt"), "pos").alias("v"))
    w = Window.partitionBy("project")
    rows = open_.select("project", "doc", "line", "pos", "token", "class", "v.*").withColumn("id", F.concat(F.lit("D-"), F.row_number().over(w.orderBy("doc", "line", "pos", "token")).cast("string")))
    band = F.when((F.col("status") == "missing") & (F.col("confidence") >= 90), "drift").when(F.col("status") == "missing", "suspected").otherwise("review")
    rows = rows.withColumn("band", band).withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("confidence").desc(), "id")))
    if limit:
        rows = rows.where(F.col("rank") <= limit)
    size = F.length("token") + F.length("excerpt") + F.length("reason") + 60
    rows = within_budget(rows, size, max_chars, "project")
    return rows.select("project", "rank", "band", "id", "class", "doc", "line", "token", "confidence", "reason", "suggestion", "total", "omitted")


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'skipped'").groupBy("project", "reason").agg(F.count("*").alias("n"))


def undocumented(chunks: DataFrame, claims: DataFrame, limit: int | None = 25) -> DataFrame:
    """project, symbolName, symbolType, filePath, startLine, rank: visible symbols that no claim of any region names, in full or
    bare, by path and line. Test files, entry points and names that are called by convention are left out."""
    symbols = inventory(chunks).where(F.col("symbolType").isin(*CANDIDATE_TYPES) & ~is_test_file("filePath") & ~is_entry_point("filePath"))
    symbols = symbols.withColumn("bare", bare_name("symbolName")).where(~F.col("bare").isin(*HOOK_NAMES) & is_exported("symbolName", "language", "content"))
    said = claims.select("project", F.regexp_replace("token", r"\(\)$", "").alias("name")).distinct()
    rows = symbols.join(said.withColumnRenamed("name", "symbolName"), ["project", "symbolName"], "left_anti").join(said.withColumnRenamed("name", "bare"), ["project", "bare"], "left_anti")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("filePath", "startLine", "symbolName")))
    return (rows.where(F.col("rank") <= limit) if limit else rows).select("project", "symbolName", "symbolType", "filePath", "startLine", "rank")


def drifted(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose document, or a file of whose evidence, is among the changed files (project, path)."""
    docs = rows.join(changed.select("project", F.col("path").alias("doc")).distinct(), ["project", "doc"], "left_semi")
    if "evidence" not in rows.columns:
        return docs
    places = rows.withColumn("path", F.explode("evidence.path")).join(changed.select("project", "path").distinct(), ["project", "path"], "left_semi").drop("path")
    return docs.unionByName(places).dropDuplicates(["project", "doc", "line", "pos", "token"])


def glob_matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_to_regex(glob))
