"""Problem 4: texts that the tables took or never finished."""

import signal

import pytest

from codemill.llm.parsing import first_error


@pytest.fixture(autouse=True)
def ends():
    signal.alarm(20)
    yield
    signal.alarm(0)


@pytest.mark.parametrize("language", ["javascript", "typescript"])
@pytest.mark.parametrize(
    "text",
    ["x;\n<<<<<<< HEAD\ny;\n", "trail;\n<<<<<<< HEAD\n", "foo() bar()", "const x = f(1) 5", "if (a) b() c()", "a b", "for (;;) x y", "for (a\nb; c) d", "if (a)\nelse b"],
)
def test_invalid_script(language, text):
    assert first_error(text, language)


@pytest.mark.parametrize("language", ["javascript", "typescript"])
@pytest.mark.parametrize("text", ["a\nb", "foo()\nbar()", "do x(); while (y) z()", "do { x() } while (y) z()", "function f() { return 1 }", "x = { a: 1 }\ny", "if (a) b()\nelse c()", "let a\nlet b = f(1)\n", ""])
def test_valid_script(language, text):
    assert first_error(text, language) is None


@pytest.mark.parametrize("text", ["try:\n    pass\nexcept A, e:\n    pass\n", "f(a=1, b)\n", "def f(a=1, b):\n    pass\n", "return = 1\n", "print 'x'\n", "x = 08\n", "1 = x\n", "f() = 2\n", "def f():\n    x = 1\n\ty = 2\n"])
def test_invalid_python(text):
    assert first_error(text, "python")


@pytest.mark.parametrize("text", ["def f(a, b=1, *, c):\n    return a\n", "x = 1\n", "match x:\n    case 1:\n        pass\n", ""])
def test_valid_python(text):
    assert first_error(text, "python") is None


@pytest.mark.parametrize(
    "language, text",
    [
        ("javascript", "export class A {\n  x = 1;\n  f() { return 2 }\n}\n"),
        ("javascript", "class A extends B {}\nvar x = class { f() {} }\n"),
        ("javascript", "function d(c){return c}var x=1"),
        ("javascript", "!function(e){function k(c){return c}for(;;){}}()"),
        ("typescript", "export abstract class A<T> implements B {\n  private x: number = 1;\n}\n"),
        ("typescript", "function f(a: string): void\nfunction f(a: any) {}\n"),
        ("go", 'package a\n\nimport (\n    "b"\n)\n\ntype T struct {\n    a int\n}\n\nfunc F(a string, b *T) (int, error) {\n    return 1, nil\n}\n'),
        ("go", "package a\n\nvar f = func(a int) int { return a }\n"),
        ("java", "class A { void f() { b |= 1; c += 2; d = e; g[0] ^= 3; this.h = i; Runnable r = (Runnable) () -> f(); } }"),
        ("java", "package a;\npublic class A {\n  private int x = 1;\n  public static double f(Map<String, Long> b, String c) { return 1; }\n  A(int y) { }\n  public <T> T g(T t) { return t; }\n}\n"),
    ],
)
def test_valid_declarations(language, text):
    assert first_error(text, language) is None


@pytest.mark.parametrize("language, text", [("go", "package a\n\nfunc F( {\n}\n"), ("go", "package a\n\nfunc F() int {\n    return 1\n"), ("java", "class A { int f() { return 1 } }"), ("java", "class A { int f( { return 1; } }"), ("javascript", "export class A { f( }")])
def test_invalid_declarations(language, text):
    assert first_error(text, language)


VALID = """
import os, sys as s
from . import (a, b as c,)
x: int = 1
y = z = *a, b
for i, *j in d: print(i, *j, sep="", **k)
while (n := f(1)) and not n in x[1:2, ::3, a:]: pass
g = [i for i in y if i if not j for k in (a if b else c)]
h = {**a, "b": 1} | {k: v for k, v in x.items()} | {1, *t}
l = lambda a, *b, c=1, **d: (yield)
async def q(a, /, b: int = 2, *args: str, c, **kw) -> list[int]:
    async with a as b, c: await d
    return *a, b
with (open(x) as f, open(y) as g): pass
class A[T: int, *Ts, **P](B, metaclass=C): ...
type X[T] = list[T]
match x, y:
    case {"k": [A(b=1) as c, *_], **rest} if c > 1: pass
    case 1 | -2 | None as z: pass
w = f"{a!r:>{width}} {'q' if b else f'{c['d']}'} {{"
try: pass
except* (A, B) as e: raise C from e
else: pass
finally: del x[0], y.z
"""


def test_python_table_takes_what_the_interpreter_takes():
    import ast

    from codemill.llm.parsing import parse

    ast.parse(VALID)
    assert parse(VALID, "python") is None


def test_exact_check_overrules_no_table_on_the_test_data(spark):
    """Of the files that ast and json take, the tables refuse none, and of those that they refuse the tables take none."""
    import ast
    import json

    from codemill.llm.parsing import LANGUAGE, file_text, files, parse

    counts = {}
    rows = files(spark.read.parquet("/root/testdata/sf0.01/code_records.parquet").where("filePath like '%.py' or filePath like '%.json'")).collect()
    for r in rows:
        text, language = file_text([c.asDict() for c in r.chunks]), LANGUAGE[r.filePath.rsplit(".", 1)[-1]]
        try:
            ast.parse(text) if language == "python" else json.loads(text)
            exact = True
        except ValueError:
            exact = False
        except SyntaxError:
            exact = False
        key = (exact, parse(text, language) is None)
        counts[key] = counts.get(key, 0) + 1
    assert counts.get((True, False), 0) == 0 and counts.get((False, True), 0) == 0 and counts[(True, True)] > 80
