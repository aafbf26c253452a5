"""Imports, references and class members of small sources, with literal expected rows."""

from quarryline.functions import text
from quarryline.operators import extract, graph, references

from .conftest import rows

SCRIPT = """
import { a, b } from './x';
import {
  c,
  d,
} from "./many";
import type { T } from './types'
import './side';
export * from '../all';
export { e as f } from './some';
const g = require('h');
const text = 'import z from "no"';
class A extends base.B<string> implements C, D {
  constructor(x) { super(x); this.run(x, () => y(1)); }
  async run(a, b = f(2)) {
    if (a) { return new Thing(a).go(); }
  }
  get size() { return 1 }
  field = make();
}
function outer() { return inner(/* no() */ "no()") }
"""
PYTHON = '''"""import fake"""
import os, sys as s
import a.b
from .pkg import x, y
from . import z
class K(base.M, Generic[T], metaclass=Meta):
    def f(self):
        import late
        return self.g(h(1))[0](2)
'''


def texts(spark, *pairs):
    return spark.createDataFrame([(k, "r", p, t) for k, (p, t) in enumerate(pairs)], "file_id long, repo string, path string, content string")


def test_imports(spark):
    df = texts(spark, ("a.ts", SCRIPT), ("b.py", PYTHON), ("c.py", "import ok\ndef ("), ("d.py", ""), ("e.js", None))
    assert rows(extract.script_imports(df), "module") == sorted([("./x",), ("./many",), ("./types",), ("./side",), ("../all",), ("./some",), ("h",)])
    got = rows(extract.python_imports(df), "file_id", "module")
    assert got == sorted([(1, "os"), (1, "sys"), (1, "a.b"), (1, ".pkg"), (1, "."), (1, "late"), (2, "ok")], key=str)


def test_references(spark):
    df = texts(spark, ("a.ts", SCRIPT), ("b.py", PYTHON), ("c.md", "x()"), ("e.js", None))
    got = rows(references.code_references(df), "file_id", "kind", "name")
    script = [("extends", "B"), ("implements", "C"), ("implements", "D")] + [("calls", n) for n in ("require", "run", "y", "f", "go", "make", "inner")]
    python = [("extends", "M"), ("extends", "Generic"), ("calls", "g"), ("calls", "h")]
    assert got == sorted([(0, *x) for x in script] + [(1, *x) for x in python], key=str)


def test_class_members(spark):
    got = rows(references.class_members(texts(spark, ("a.ts", SCRIPT))), "qualified_name", "signature", "start_line", "end_line")
    assert got == sorted([
        ("A.constructor", "constructor(x)", 14, 14), ("A.run", "run(a, b = f(2))", 15, 17), ("A.size", "size()", 18, 18),
    ], key=str)


def test_redaction_forms(spark):
    cases = ["sk-" + "a1" * 8, "bearer: abcdefgh1", "my_token = abcdefgh", "token = abcdefgh", "eyJab.cd.ef", "ghp_" + "a" * 20, "sk-short"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(text.redacted("t")).collect()
    assert [r[0] for r in got] == ["[REDACTED]", "[REDACTED]", "my_token = abcdefgh", "[REDACTED]", "eyJab.cd.ef", "[REDACTED]", "sk-short"]


def test_snippets(spark):
    body = "\n".join(f"l{k}" for k in range(1, 301))
    df = spark.createDataFrame([(body, 2, 4), (body, 1, 201), (body, 299, 400), (body, 5, 4)], "c string, a int, b int")
    got = [r[0] for r in df.select(text.snippet("c", "a", "b")).collect()]
    assert got[0] == "l2\nl3\nl4" and got[1].endswith("l200\n... (truncated)") and got[2] == "l299\nl300" and got[3] == ""


def test_component_suggestions(spark):
    comps = spark.createDataFrame(
        [("r", "app/core/a.py", "app/core/a.py"), ("r", "app/core/x/b.py", "app/core/a.py"), ("r", "lib/z.py", "a.py"), ("r", "a.py", "a.py"), ("r", "app/core/q.py", "app/core/m.py"), ("r", "app/core/m.py", "app/core/m.py")],
        "repo string, node string, component string",
    )
    got = rows(graph.component_suggestions(comps), "component", "files", "id", "name")
    assert got == [("a.py", 2, "connected-a-py", "Connected A.Py"), ("app/core/a.py", 2, "app-core", "App/Core"), ("app/core/m.py", 2, "app-core-2", "App/Core")]
