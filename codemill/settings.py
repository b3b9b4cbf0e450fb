"""Defaults of the engine and of a project: given values < settings file (YAML subset or JSON) < environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: Sizes, weights and limits that results depend on.
RRF_K = 60
VARIANT_WEIGHT = 0.5
VARIANT_FETCH = 10
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_TOKENS, CHARS_PER_TOKEN = 1500, 200, 512, 4
DOC_CHARS, ID_TERMS_CHARS, SIGNATURE_CHARS, SIGNATURE_LINES = 1200, 2000, 200, 6
HIT_CHARS, PACK_CHARS, OUTLINE_CHARS, IMPORT_CHARS = 120, 80, 20, 30
PACK_BUDGET, PACK_LIMIT, PACK_IMPORTS, PACK_OUTLINE, PACK_BELOW = 6000, 5, 10, 12, 4
BLAME_FILES, BLAME_COMMITS = 8, 10
ANN_ROWS = 50_000
EVENT_RING, SESSION_MINUTES, BACKGROUND_PRIORITY = 512, 10, -5
FANOUT_SAMPLE, REFERENCE_SAMPLES, ANCHOR_CANDIDATES = 20, 10, 8


@dataclass(frozen=True)
class Boost:
    enabled: bool = True
    short_path: float = 0.1
    source_root: float = 0.05
    test_demotion: float = 0.85
    generated_demotion: float = 0.8
    source_roots: tuple[str, ...] = ("src", "lib", "app")
    norm_chars: int = 160


@dataclass(frozen=True)
class Settings:
    embed_model: str = "hash"
    allowed_extensions: tuple[str, ...] = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".py", ".rs", ".go", ".java", ".kt", ".c", ".h", ".cpp", ".hpp", ".cs", ".php", ".rb", ".swift", ".scala", ".gd", ".md", ".json", ".yaml", ".yml", ".toml", ".sql", ".sh")
    max_file_bytes: int = 0
    write_batch_files: int = 64
    job_concurrency: int = 2
    query_log_size: int = 10_000
    embedding_cache_size: int = 50_000
    mmr_lambda: float = 0.5
    mmr_top_k: int = 20
    rerank_top_k: int = 20
    expand_variants: int = 3
    doc_budget: int = 12_000
    undocumented_limit: int = 25
    boost: Boost = field(default_factory=Boost)


_PREFIX = "CODEMILL_"


def _as(kind: object, text: object) -> object:
    if isinstance(kind, bool):
        return text if isinstance(text, bool) else str(text).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(kind, int):
        return int(str(text))
    if isinstance(kind, float):
        return float(str(text))
    if isinstance(kind, tuple):
        items = text if isinstance(text, (list, tuple)) else str(text).split(",")
        return tuple(str(x).strip() for x in items if str(x).strip())
    return str(text)


def parse_settings(text: str) -> dict[str, object]:
    """Keys of a settings file: JSON, or lines "key: value" with one level of nesting and "- item" lists."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict[str, object] = {}
    parent: str | None = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        deep, body = line[0].isspace(), line.strip()
        if body.startswith("- ") and parent:
            out[parent] = [*(out[parent] if isinstance(out[parent], list) else []), body[2:].strip("\"' ")]
            continue
        key, _, value = body.partition(":")
        value = value.strip().strip("\"'")
        if deep and parent:
            held = out[parent] if isinstance(out[parent], dict) else {}
            out[parent] = {**held, key.strip(): value}
        else:
            parent = key.strip()
            out[parent] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else value
    return out


def load_settings(text: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Defaults, then the file, then CODEMILL_<NAME>; a value that does not parse is an error that names its key."""
    found = Settings()
    given: dict[str, object] = parse_settings(text) if text else {}
    env = os.environ if env is None else env
    for f in fields(Settings):
        if f.name == "boost":
            boost = found.boost
            for b in fields(Boost):
                part = given.get("boost")
                value = env.get(f"{_PREFIX}BOOST_{b.name.upper()}", part.get(b.name) if isinstance(part, dict) else None)
                if value is not None:
                    boost = replace(boost, **{b.name: _as(getattr(boost, b.name), value)})
            found = replace(found, boost=boost)
            continue
        value = env.get(_PREFIX + f.name.upper(), given.get(f.name))
        if value is None:
            continue
        try:
            found = replace(found, **{f.name: _as(getattr(found, f.name), value)})
        except ValueError as e:
            raise ValueError(f"setting {f.name}: {value!r} is not valid") from e
    return found


@dataclass(frozen=True)
class ProjectSettings:
    """Settings of one project; a field that is not valid is left at its default and named in problems."""

    ignore: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    max_file_bytes: int | None = None
    git_tracked_only: bool = False
    docs: tuple[str, ...] = ("*.md", "docs/**/*.md")
    problems: tuple[str, ...] = ()


def project_settings(text: str | None) -> ProjectSettings:
    if not text or not text.strip():
        return ProjectSettings()
    try:
        raw = json.loads(text)
    except ValueError:
        return ProjectSettings(problems=("not valid JSON",))
    if not isinstance(raw, dict):
        return ProjectSettings(problems=("not an object",))
    out, bad = {}, []
    for f in fields(ProjectSettings):
        if f.name == "problems" or f.name not in raw:
            continue
        value, kind = raw[f.name], f.type
        if "tuple" in str(kind) and isinstance(value, list) and all(isinstance(x, str) for x in value):
            out[f.name] = tuple(value)
        elif "int" in str(kind) and isinstance(value, int) and not isinstance(value, bool) and value >= 0:
            out[f.name] = value
        elif "bool" in str(kind) and isinstance(value, bool):
            out[f.name] = value
        else:
            bad.append(f.name)
    return ProjectSettings(**out, problems=tuple(bad))
