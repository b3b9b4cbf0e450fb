"""Problem 3: files that were not written by hand in their project.

Method: a random forest on figures of the text (compression ratio, token entropy, identifier lengths, comment density and the
shape of lines) and on the directories and endings of the path. Its labels are the notices that tools and third parties put
into the head of a file: the head is cut off before anything is measured, so the forest cannot see them. As many tools write
no notice, files without one serve as hand-written examples only if they lie in no telling directory, have no telling ending
and are not mostly literals, and in the second round only if the first forest does not find them suspicious. A notice is
direct evidence: such a file is a case whatever the forest says. An exact check follows for what no notice ever names: source
files whose text is literals by more than BLOB of its characters are data kept as code.

The forest is fitted on at most NOTICED files with a notice and PLAIN without, taken in order of a hash; all files are scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemill.llm.parsing import file_text, files
from codemill.storage import staged

#: Files with and without a notice that train the forest at most.
NOTICED, PLAIN = 4000, 12000
TREES, DEPTH, SEED = 60, 9, 7
#: Files of either kind without which there is no forest.
LEAST = 5
THRESHOLD = 0.5
#: Files without a notice above this probability of the first forest do not train the second one.
SUSPICIOUS = 0.15
#: Share of literals from which a file without a notice does not train, and from which a source file is data kept as code.
DATA, BLOB = 0.4, 0.6
SOURCE = r"\.(?:py|js|mjs|cjs|jsx|ts|tsx|go|java)$"

NOTICE = re.compile(
    r"code generated by\b|\b(?:automatically|auto|machine)[- ]?(?:generated|written|created|produced)\b|@generated\b|<auto-?generated|\bdo not (?:edit|modify)\b|\bgenerated (?:by|from|with) (?!hand)[\w./-]+"
    r"|\bchanges will be (?:lost|overwritten)|\bautomatisch (?:erzeugt|generiert|erstellt)|\bg[ée]n[ée]r[ée]e? automatiquement|\bgenerad[oa] autom[áa]ticamente"
    r"|\bcopied from \S+ v?\d|\bupstream commit\b|^\W*upstream: *\S+|\bspdx-filecopyrighttext: *the \S+ maintainers|\bvendored from\b|\bproject authors, released under\b|^\W*/\*! *\S+ v?\d+\.\d",
    re.I | re.M,
)
#: What tells a statement about such notices from a notice.
NO_NOTICE = re.compile(r"\b(?:used to be|marked as|no longer|not) (?:\w+ )?(?:automatically |auto-?)?generated|\bkept by hand\b|\bemits?\b.*\bgenerated\b", re.I)
_HEAD = re.compile(r"\A(?:\s*(?:#[^\n]*|//[^\n]*|--[^\n]*|/\*.*?\*/|<!--.*?-->)[ \t]*(?:\n|\Z)?)+", re.S)
_BANG = re.compile(r"\A.{0,60}?(/\*!.*?\*/)", re.S)

TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
WORD = re.compile(r"[^\W\d]\w*")
COMMENT = re.compile(r"(?m)^\s*(?:#|//|\*|/\*).*$|//[^\n]*|/\*.*?\*/")
#: Rows of numbers, and unbroken text in quotes or on lines of its own, as data kept as code has them.
LITERAL = re.compile(r"^[\s\[({]*[-+]?(?:0x[\da-fA-F]+|\d[\d.]*(?:e[-+]?\d+)?)(?:[\s,;\])}]+[-+]?(?:0x[\da-fA-F]+|\d[\d.]*(?:e[-+]?\d+)?))*[\s,;\])}]*$|[\"'`][A-Za-z0-9+/=\\_-]{40,}[\"'`]|^[A-Za-z0-9+/=]{50,}$", re.M)
VENDORED = {"vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "external", "extern", "deps", "contrib"}
BUILT = {"dist", "build", "out", "public", "static", "bundle", "bundles", "target", "assets", "min"}
GENERATED = {"gen", "generated", "__generated__", "autogen", "codegen", "generated-sources", "stubs"}
ENDING = re.compile(r"\.(?:min|bundle|gen|generated|pb|g|designer)\.\w+$|_pb2(?:_grpc)?\.\w+$|Grpc\.\w+$|\.[0-9a-f]{8,}\.\w+$|_generated\.\w+$", re.I)
LOCK = re.compile(r"(?:^|[-._/])lock\.(?:json|yaml|yml|toml)$|\.lock$", re.I)

FEATURES = ["compression", "entropy", "entropy_share", "name_length", "short_names", "long_names", "comments", "line_length", "longest_line", "digits", "marks", "blanks", "literals", "shapes", "names_share", "tail_marks", "size", "vendored", "built", "generated", "ending", "lock"]


def head(text: str) -> tuple[str, str]:
    """The comments that a text begins with, and the rest."""
    m = _HEAD.match(text)
    lead = m[0] if m else ""
    rest = text[len(lead) :]
    if bang := _BANG.match(rest):
        return lead + bang[1], rest.replace(bang[1], "", 1)
    return lead, rest


def noticed(text: str) -> bool:
    """Whether the head of a text has a notice of a tool or of a third party."""
    lead = head(text)[0]
    return any(NOTICE.search(line) and not NO_NOTICE.search(line) for line in lead.split("\n"))


def figures(path: str, text: str) -> list[float]:
    """The features of a file, its head cut off."""
    body = head(text)[1]
    raw = body.encode("utf-8", "surrogatepass")
    n = max(1, len(body))
    tokens = Counter(TOKEN.findall(body))
    total = sum(tokens.values())
    entropy = -sum(c / total * math.log2(c / total) for c in tokens.values()) if total else 0.0
    names = [w for w in WORD.findall(body)]
    many = max(1, len(names))
    lines = [line for line in body.split("\n") if line.strip()]
    k = max(1, len(lines))
    lengths = [len(line) for line in lines] or [0]
    shapes = len({re.sub(r"\w+", "w", line) for line in lines})
    digits, marks, blanks = sum(c.isdigit() for c in body), sum(not c.isalnum() and not c.isspace() for c in body), sum(c.isspace() for c in body)
    folders = {s.lower() for s in path.split("/")[:-1]}
    name = path.rsplit("/", 1)[-1]
    return [
        len(zlib.compress(raw, 6)) / max(1, len(raw)),
        entropy,
        entropy / math.log2(total) if total > 1 else 0.0,
        sum(map(len, names)) / many,
        sum(len(w) <= 2 for w in names) / many,
        sum(len(w) >= 20 for w in names) / many,
        sum(len(m[0]) for m in COMMENT.finditer(body)) / n,
        sum(lengths) / k,
        math.log2(1 + max(lengths)),
        digits / n,
        marks / n,
        blanks / n,
        sum(len(m[0]) for m in LITERAL.finditer(body)) / n,
        shapes / k,
        len(names) / max(1, total),
        sum(w.startswith("_") or w.endswith("_") for w in names) / many,
        math.log2(1 + len(body)),
        float(bool(folders & VENDORED)),
        float(bool(folders & BUILT)),
        float(bool(folders & GENERATED)),
        float(bool(ENDING.search(name))),
        float(bool(LOCK.search(name))),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, notices, rows = [], [], []
        for path, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = file_text(chunks)
            paths.append(path)
            notices.append(noticed(text) or bool(LOCK.search(path)))
            rows.append(figures(path, text))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(notices, pa.bool_()), pa.array(rows, pa.list_(pa.float64()))], names=["filePath", "notice", "figures"])


def measured(chunks: DataFrame) -> DataFrame:
    """filePath, notice, figures of every file. A lock of versions is known by its name, which is its notice: such files have no
    head. Chunks with a null path or rec_id are passed over, null contents count as absent."""
    return files(chunks).mapInArrow(_measure, "filePath string, notice boolean, figures array<double>")


def fit(files_: DataFrame) -> RandomForestClassificationModel | None:
    """The forest of the second round; None where there are not LEAST files with and LEAST without a notice."""
    order = F.xxhash64("filePath"), F.col("filePath")
    doubtful = F.lit(False)
    for name in ("vendored", "built", "generated", "ending", "lock"):
        doubtful = doubtful | (F.col("figures")[FEATURES.index(name)] > 0)
    doubtful = doubtful | (F.col("figures")[FEATURES.index("literals")] > DATA)
    some = files_.where("notice").orderBy(*order).limit(NOTICED).union(files_.where(~F.col("notice") & ~doubtful).orderBy(*order).limit(PLAIN))
    some = staged(some.select("filePath", F.col("notice").cast("double").alias("label"), array_to_vector("figures").alias("features")).coalesce(1).sortWithinPartitions("filePath"), "handwritten-sample")
    counts = {r.label: r["count"] for r in some.groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < LEAST:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight")
    some = some.withColumn("weight", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    first = forest.fit(some)
    kept = first.transform(some).where((F.col("label") == 1) | (vector_to_array("probability")[1] < SUSPICIOUS))
    return forest.fit(kept.select("label", "features", "weight")) if kept.where("label = 0").count() >= LEAST else first


def scored_files(chunks: DataFrame) -> DataFrame:
    """filePath, notice, probability (of not being hand-written) of every file, once each.

    Empty files and an empty table are defined: with fewer than LEAST files of a kind to train on, notices and literals decide."""
    rows = staged(measured(chunks), "handwritten-figures")
    blob = F.col("filePath").rlike(SOURCE) & (F.col("figures")[FEATURES.index("literals")] > BLOB)
    model = fit(rows)
    if model is None:
        return rows.select("filePath", "notice", F.when(F.col("notice") | blob, 1.0).otherwise(0.0).alias("probability"))
    out = model.transform(rows.withColumn("features", array_to_vector("figures")))
    return out.select("filePath", "notice", F.when(F.col("notice") | blob, 1.0).otherwise(vector_to_array("probability")[1]).alias("probability"))


def not_handwritten(chunks: DataFrame) -> DataFrame:
    return scored_files(chunks).where(F.col("probability") >= THRESHOLD).select("filePath")
