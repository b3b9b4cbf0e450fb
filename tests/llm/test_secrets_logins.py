"""Problem 7: secrets that only their place in a call or a note tells, names in other languages, and keys that begin as paths do."""

import pytest

from codemill.llm.secrets import find_secrets, redact

V = "h4rbour-lantern-731qz"
KEY = "/NAHwQ4Rk8MlseaUCnzuMnHLlIE7YGQ5CovNj2Pe"


@pytest.mark.parametrize(
    "path, text, line",
    [
        ("a.py", f'import db\nconnect("db.example", "pier_svc", "{V}")\n', 2),
        ("a.ts", f'connect(\n  host,\n  "pier_svc",\n  "{V[:6]}" + "{V[6:]}",\n);\n', 4),
        ("a.go", f'smtp.Login("pier_svc", "{V}")\n', 1),
        ("a.js", f"next();\n// old login was pier / {V}\n", 2),
        ("a.py", "# old login was pier / ^X+6cgyI04rs7\n", 1),
        ("a.go", f'kennwort := "{V}"\n', 1),
        ("a.yaml", f"db_kennwort: '{V}'\n", 1),
        ("a.py", f'contraseña = "{V}"\n', 1),
        ("a.java", f'options.put("hmac_secret", "{KEY}");\n', 1),
        ("a.py", f'for item in backlog:\n    webhook_secret = "{V[:6]}" + "{V[6:]}"\n', 2),
        ("a.py", f'if item: token = "{V}"\n', 1),
    ],
)
def test_found_and_masked(path, text, line):
    found = find_secrets(text, path)
    assert [text.count("\n", 0, s.spans[0][0]) + 1 for s in found] == [line]
    clean = redact(text, found)
    assert clean.count("\n") == text.count("\n") and not any(v in clean for v in (V, V[6:], KEY, "^X+6cgyI04rs7"))


@pytest.mark.parametrize(
    "text",
    [
        'connect("db.example", "pier_svc", "${PASSWORD}")',
        'connect("db.example", "shard_17_svc9")',
        'secret = "/srv/code/Pier2/lib/Quay7/state"',
        '# the login page is src / pages',
        'const kennwort = "vault:kv/pier#kennwort";',
        'const commit = "196908f81a14dc8a02448855f8acd3bce4eee836";',
    ],
)
def test_no_case(text):
    assert not find_secrets(text, "a.py")
