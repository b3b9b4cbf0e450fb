"""Stages of the corpus pipeline, if the operators over training data are there."""

from __future__ import annotations

try:
    from codemill.llm.pipeline import STAGES
except ModuleNotFoundError as missing:
    if missing.name not in ("codemill.llm", "codemill.llm.pipeline"):
        raise
    STAGES = []
