"""Problem 7: secrets that do not stand on the line of their key, in lists, and under a telling path."""

import pytest

from codemill.llm.secrets import find_secrets, redact

V = "k7Qx9vTz2LmP4sWd"
CASES = [
    ("a.py", f'api_key = (\n    "{V}"\n)\n', 2),
    ("a.js", f'const apiKey =\n  "{V}";\n', 2),
    ("a.py", "url = 'ftp://bob:hunter@db'\n", 1),
    ("a.txt", "ftp://bob:hunter@db\n", 1),
    ("a.py", f'AZURE_PAT = "{V}"\n', 1),
    ("a.env", f"AZURE_PAT={V}\n", 1),
    ("a.json", f'{{\n"tokens": [\n"{V}"\n]\n}}\n', 3),
    ("a.json", f'{{"credentials": {{"value": "{V}"}}}}\n', 1),
    ("a.yaml", f"credentials:\n  value: {V}\n", 2),
    ("a.yaml", f"api_keys:\n  - {V}\n", 2),
    ("a.yaml", f"db: {{user: bob, password: {V}}}\n", 1),
    ("a.toml", f'[credentials]\nvalue = "{V}"\n', 2),
    ("a.toml", f'api_keys = ["{V}"]\n', 1),
]


@pytest.mark.parametrize("path, text, line", CASES)
def test_found_and_masked(path, text, line):
    found = find_secrets(text, path)
    assert [text.count("\n", 0, s.spans[0][0]) + 1 for s in found] == [line]
    clean = redact(text, found)
    assert V not in clean and "hunter" not in clean and clean.count("\n") == text.count("\n")


def test_value_of_several_lines_is_masked_whole():
    text = f'const token = "{V}" +\n  "{V[::-1]}" +\n  "tail5end9";\nnext();\n'
    assert redact(text, find_secrets(text, "a.js")) == 'const token = "[REDACTED]" +\n  "" +\n  "";\nnext();\n'


@pytest.mark.parametrize(
    "path, text",
    [
        ("a.yaml", "credentials:\n  file: /etc/app/cred9.json\n  secretName: vault-app-01\n"),
        ("a.json", '{"token": {"type": "bearer2go", "expires": "2024-01-01T00:00:00Z"}}'),
        ("a.py", f'key = lookup\nname = "{V}"\n'),
        ("a.yaml", f"checksum:\n  - {V}\n"),
        ("package-lock.json", f'{{"packages": {{"token-kit": {{"integrity": "{V}"}}}}}}'),
    ],
)
def test_no_case(path, text):
    assert not find_secrets(text, path)
