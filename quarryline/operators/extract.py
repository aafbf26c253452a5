"""Symbols, imports and references of source files: one file in, many rows out.

Spark splits the files and joins the results; Python only walks the syntax tree of one file at a time. Files that
don't parse still give the definitions that their lines show.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import materialize, norm_path
from quarryline.functions.text import language_of, symbol_id
from quarryline.operators import references

SYMBOLS = "file_id long, repo string, path string, status string, name string, qualified_name string, kind string, signature string, start_line int, end_line int"
#: Ways in which a module may be a file, in the order in which they are tried.
PYTHON_ENDS = (".py", "/__init__.py")
SCRIPT_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")
_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([\w.]+))", re.M)
_DEFINED = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)


def _python_tree(text: str) -> list[tuple]:
    """(name, qualified, kind, signature, start, end) of classes, functions, methods and module variables.

    Blocks are descended into, bodies of functions are not; an assigned name in capitals is a constant; decorators
    belong to what they decorate.
    """
    lines = text.split("\n")
    out: list[tuple] = []

    def add(node: ast.stmt, name: str, owner: tuple[str, ...], kind: str) -> None:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        head = "" if kind in ("constant", "variable") else " ".join(x.strip() for x in lines[node.lineno - 1 : node.body[0].lineno - 1] or [lines[node.lineno - 1]])
        signature = head.split(":\n")[0].rstrip(" :") if head else None
        out.append((name, ".".join([*owner, name]), kind, signature, first, node.end_lineno or node.lineno))

    def walk(body: list[ast.stmt], owner: tuple[str, ...], in_class: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                add(node, node.name, owner, "class")
                walk(node.body, (*owner, node.name), True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                add(node, node.name, owner, "method" if in_class else "function")
            elif isinstance(node, ast.Assign | ast.AnnAssign) and not owner:
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        add(node, t.id, owner, "constant" if t.id.isupper() else "variable")
            else:
                for field in ("body", "orelse", "finalbody"):
                    walk(getattr(node, field, None) or [], owner, in_class)
                for h in getattr(node, "handlers", []):
                    walk(h.body, owner, in_class)

    walk(ast.parse(text).body, (), False)
    return out


def _python_lines(text: str) -> list[tuple]:
    """What the lines of a file that does not parse define, without ends."""
    out, open_ = [], []
    for m in _DEFINED.finditer(text):
        depth, kind, name = len(m.group(1).expandtabs(8)), m.group(2), m.group(3)
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        owner = [o[1] for o in open_]
        in_class = bool(open_) and open_[-1][2]
        line = text.count("\n", 0, m.start()) + 1
        out.append((name, ".".join([*owner, name]), "class" if kind == "class" else "method" if in_class else "function", m.group().strip(), line, line))
        open_.append((depth, name, kind == "class"))
    return out


def python_symbols(texts: DataFrame) -> DataFrame:
    """Symbols of Python files; ``texts``: (file_id, repo, path, content). Null texts give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        for b in batches:
            rows = []
            for f, r, p, t in zip(*(b.column(c).to_pylist() for c in ("file_id", "repo", "path", "content")), strict=True):
                try:
                    status, got = "ok", _python_tree(t)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    status, got = "parse_error", _python_lines(t)
                rows += [(f, r, p, status, *x) for x in got]
            kinds = (pa.int64(), *[pa.string()] * 7, pa.int32(), pa.int32())
            names = [x.split()[0] for x in SYMBOLS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)

    py = texts.where((language_of("path") == "python") & F.col("content").isNotNull())
    got = py.select("file_id", "repo", "path", "content").mapInArrow(run, SYMBOLS)
    return got.withColumn("symbol_id", symbol_id("path", "qualified_name", "kind"))


def with_paths(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """(file_id, repo, path, content) of the files that have text; a file that is listed twice comes once."""
    listed = files.groupBy("file_id").agg(F.min(F.struct("repo", norm_path("path").alias("path"))).alias("f"))
    return file_text.where("content is not null").join(listed, "file_id").select("file_id", "f.repo", "f.path", "content")


def script_symbols(texts: DataFrame) -> DataFrame:
    """(file_id, repo, path, name, kind, start_line): what the lines of JavaScript and TypeScript files define.

    Top-level classes, functions, interfaces, types and variables (a constant that holds an arrow function is a
    function), found with expressions alone. Members of classes are not listed.
    """
    rx = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(class|function\*?|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)(.*)$"
    lines = texts.where(language_of("path").isin("javascript", "typescript")).select("file_id", "repo", "path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("k", "line"))
    hit = lines.where(F.col("line").rlike(rx))
    word, rest = F.regexp_extract("line", rx, 1), F.regexp_extract("line", rx, 3)
    arrow = rest.rlike(r"=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|[\w$]+\s*=>)")
    kind = (
        F.when(word.isin("class", "interface", "type"), word).when(word == "enum", "type").when(word.startswith("function"), "function")
        .when(arrow, "function").when(word == "const", "constant").otherwise("variable")
    )
    return hit.select("file_id", "repo", "path", F.regexp_extract("line", rx, 2).alias("name"), kind.alias("kind"), (F.col("k") + 1).alias("start_line"))


def script_imports(texts: DataFrame) -> DataFrame:
    """(file_id, repo, path, module): modules that JavaScript and TypeScript files import, once for each place.

    An import or export may go over several lines; strings elsewhere are none.
    """
    rx = (
        r"""(?m)^[ \t]*(?:import\s+(?:(?:type\s+)?[\w$*{}\s,]+?\sfrom\s*|(?:type\s*)?\{[^}'"]*\}\s*from\s*)?|export\s+(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^}'"]*\})\s*from\s*)"""
        r"""['"]([^'"\n]+)['"]|\brequire\(\s*['"]([^'"\n]+)['"]\s*\)"""
    )
    scripts = texts.where(language_of("path").isin("javascript", "typescript"))
    named = F.concat(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), F.regexp_extract_all("content", F.lit(rx), F.lit(2)))
    return scripts.select("file_id", "repo", "path", F.explode(F.filter(named, lambda x: x != "")).alias("module"))


def python_imports(texts: DataFrame) -> DataFrame:
    """(file_id, repo, path, module): modules that Python files import (not the names taken from them), once for each place.

    Files that don't parse give the imports that begin their lines.
    """

    def modules(_: str, t: str) -> list[tuple]:
        found = references.python_modules(t)
        if not found and references.parses(t):
            return []
        return [(m,) for m, _ in found] or [(m.group(1) or m.group(2),) for m in _IMPORT.finditer(t)]

    return references.each_file(texts.where(language_of("path") == "python"), modules, "module string")


def collapsed(path: Column) -> Column:
    """A path without ``.`` and ``..``; null if it leaves the repository."""
    step = lambda acc, x: (
        F.when(x.isin(".", ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", F.array(F.lit("\0"))).otherwise(F.concat(acc, F.array(x)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, "\0"), F.array_join(parts, "/"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, repo, path, module, target): the file of the repository that an import means, null for none.

    The candidates of a module are tried in order (``PYTHON_ENDS``, ``SCRIPT_ENDS``); packages without a path and
    paths out of the repository stay open. Imports are bags: one row for each place.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    dotted = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/")
    python = F.when((dots > 0) & (dotted == ""), None).when(dots > 0, F.concat(folder, F.lit("/"), up, dotted)).otherwise(dotted)
    script = F.when(F.col("module").rlike(r"^\.\.?/"), F.concat(folder, F.lit("/"), F.col("module")))
    is_python = language_of("path") == "python"
    base = collapsed(F.when(is_python, python).otherwise(script))
    ends = F.when(is_python, F.array(*map(F.lit, PYTHON_ENDS))).otherwise(F.array(*map(F.lit, SCRIPT_ENDS)))
    # read twice below; the files are gone through once
    rows = materialize(imports.withColumn("base", base), "imports")
    tried = rows.where("base is not null").select("file_id", "repo", "base", F.posexplode(ends).alias("n", "end")).distinct()
    tried = tried.select("repo", "base", "n", F.concat("base", "end").alias("target")).distinct()
    listed = files.select("repo", norm_path("path").alias("target")).where("target is not null").distinct()
    best = tried.join(listed, ["repo", "target"]).groupBy("repo", "base").agg(F.min(F.struct("n", "target")).alias("b"))
    return rows.join(best.select("repo", "base", F.col("b.target").alias("target")), ["repo", "base"], "left").select("file_id", "repo", "path", "module", "target")
