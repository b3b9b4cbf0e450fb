"""Problem 6: descriptions in plain quotes, and prose that only names a tool or begins like a placeholder."""

import pytest

from codemill.llm.documented import documented


@pytest.mark.parametrize("quote", ['"', "'"])
def test_docstring_in_plain_quotes(quote):
    assert [n for n, _ in documented(f"def f(a):\n    {quote}Collects open invoices of every tenant once.{quote}\n    return a\n", "a.py", "f", None)] == ["f"]


@pytest.mark.parametrize(
    "prose",
    [
        "Suppress repeated alerts of a tenant within one window",
        "Missing keys are filled from the profile defaults",
        "Description lines are joined before the report is sent",
        "None of the callers may hold the lock here",
        "Returns the sonar distance of every buoy in metres",
        "Reads the pragma table and keeps its rows sorted  # noqa: E501",
    ],
)
def test_prose_is_kept(prose):
    assert [n for n, _ in documented(f"# {prose}\ndef f(a):\n    return a\n", "a.py", "f", None)] == ["f"]


@pytest.mark.parametrize(
    "line",
    ["TODO: document this for all of the callers", "FIXME write more words about it later on", "eslint-disable-next-line no-unused-vars for all of the callers", "pylint: disable=all of the many open warnings", "Copyright (c) 2014 the kestrelbay contributors and friends", "Harbour License, version 4.", "Missing documentation.", "Auto-generated by the table compiler from alerts", "-*- coding: utf-8 -*- and five more words here"],
)
def test_trivial_is_dropped(line):
    assert not documented(f"# {line}\ndef f(a):\n    return a\n", "a.py", "f", None)
