"""What code refers to, and the members of script classes: one file in, many rows out.

Spark splits the files; Python only goes through the tokens or the syntax tree of one file at a time.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import language_of

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<text>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)|"""
    r"""(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|[^\s\w])"""
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# Words that stand before a bracket without being called.
NO_CALLS = frozenset("if for while switch catch return typeof function new delete void await yield in of instanceof import super constructor with do else throw case extends async".split())


def _tokens(text: str) -> list[tuple[str, int]]:
    """(token, offset) of a script without comments; strings and expressions of patterns become one mark."""
    out: list[tuple[str, int]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup != "skip":
            t = m.group()
            if t == "/" and (not out or out[-1][0] in ("(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "return", "=>")) and (r := _REGEX.match(text, at)):
                out.append(("''", at))
                at = r.end()
                continue
            out.append(("''" if m.lastgroup == "text" else t, m.start()))
        at = m.end()
    return out


def _is_name(t: str) -> bool:
    return t[0].isalpha() or t[0] in "_$"


def _last_name(toks: list[tuple[str, int]], k: int) -> tuple[str | None, int]:
    """The rightmost name of a dotted name at ``k``, and where it ends, type arguments left out."""
    name = None
    while k < len(toks) and _is_name(toks[k][0]):
        name = toks[k][0]
        if k + 2 < len(toks) and toks[k + 1][0] == "." and _is_name(toks[k + 2][0]):
            k += 2
            continue
        k += 1
        break
    depth = 0
    while k < len(toks) and (depth or toks[k][0] == "<"):
        depth += {"<": 1, ">": -1}.get(toks[k][0], 0)
        k += 1
    return name, k


class _Lines:
    """Line numbers of growing offsets."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.line = text, 0, 1

    def of(self, offset: int) -> int:
        self.line += self.text.count("\n", self.at, offset)
        self.at = offset
        return self.line


def script_references(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of calls (the rightmost name), extended and implemented classes of a script, in order."""
    toks, lines, out = _tokens(text), _Lines(text), []
    depth, bodies, pending = 0, [], False
    for k, (t, at) in enumerate(toks):
        nxt = toks[k + 1][0] if k + 1 < len(toks) else ""
        before = toks[k - 1][0] if k else ""
        if t == "class" and before != ".":
            pending = True
            j = k + 2 if _is_name(nxt) and nxt not in ("extends", "implements") else k + 1
            if j < len(toks) and toks[j][0] == "<":
                _, j = _last_name(toks, j)
            while j < len(toks) and toks[j][0] in ("extends", "implements", ","):
                kind = toks[j][0] if toks[j][0] != "," else kind  # noqa: F821
                name, end = _last_name(toks, j + 1)
                if name is None:
                    break
                out.append((kind, name, lines.of(at)))
                j = end
        elif t in "{([":
            if t == "{" and pending:
                bodies.append(depth + 1)
                pending = False
            depth += 1
        elif t in "})]":
            if bodies and bodies[-1] == depth:
                bodies.pop()
            depth -= 1
        elif nxt == "(" and _is_name(t) and t not in NO_CALLS and before not in ("function", "new", "get", "set") and not (bodies and bodies[-1] == depth and before != "=" and before != "."):
            j, chain = k, before
            while chain in (".", "?.") and j >= 2:
                j -= 2
                chain = toks[j - 1][0] if j else ""
            if chain != "new":
                out.append(("calls", t, lines.of(at)))
    return out


def script_members(text: str) -> list[tuple[str, str, int, int]]:
    """(qualified name, signature, first line, last line) of the methods of the classes of a script."""
    toks, out = _tokens(text), []
    starts = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(starts, at) + 1
    depth, owner, pending, open_ = 0, [], None, []
    for k, (t, at) in enumerate(toks):
        nxt = toks[k + 1][0] if k + 1 < len(toks) else ""
        before = toks[k - 1][0] if k else ""
        if t == "class" and before != ".":
            pending = nxt if _is_name(nxt) and nxt != "extends" else ""
        elif t in "{([":
            depth += 1
            if t == "{" and pending is not None:
                owner.append((depth, pending))
                pending = None
            elif t == "{" and open_ and open_[-1][0] == depth - 1 and open_[-1][4] is None:
                open_[-1][4] = at
        elif t in "})]":
            if open_ and open_[-1][0] == depth - 1 and t == "}" and open_[-1][4] is not None:
                d, name, first, _, body = open_.pop()
                out.append((name, " ".join(text[first:body].split()), line(first), line(at)))
            if owner and owner[-1][0] == depth:
                owner.pop()
            depth -= 1
        elif nxt == "(" and _is_name(t) and owner and owner[-1][0] == depth and before not in (".", "=", "@", "new"):
            names = [o for _, o in owner if o]
            open_.append([depth, ".".join([*names, t]), at, k, None])
        elif t == ";" and open_ and open_[-1][0] == depth and open_[-1][4] is None:
            open_.pop()  # a signature without body
    return sorted(out, key=lambda x: (x[2], x[0]))


def _name(node: ast.expr) -> str | None:
    if isinstance(node, ast.Subscript):
        return _name(node.value)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def parses(text: str) -> bool:
    """Whether a Python file parses."""
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def python_references(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of calls and of base classes (their rightmost names) of a Python file; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and (name := _name(node.func)):
            out.append(("calls", name, node.lineno))
        elif isinstance(node, ast.ClassDef):
            out += [("extends", name, node.lineno) for b in node.bases if (name := _name(b))]
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def python_modules(text: str) -> list[tuple[str, int]]:
    """(module, line) of all import statements, wherever they stand; relative ones with their dots."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(("." * node.level + (node.module or ""), node.lineno))
    return sorted(out, key=lambda x: (x[1], x[0]))


def each_file(texts: DataFrame, make: Callable[[str, str], list[tuple]], columns: str) -> DataFrame:
    """(file_id, repo, path) and ``columns`` for every tuple that ``make`` gives for a language and text; null texts give nothing."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    names = [c.split()[0] for c in columns.split(", ")]
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        for b in batches:
            rows = []
            for f, r, p, lang, t in zip(*(b.column(c).to_pylist() for c in ("file_id", "repo", "path", "lang", "content")), strict=True):
                rows += [(f, r, p, *x) for x in make(lang, t)]
            every = (pa.int64(), pa.string(), pa.string(), *types)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(every)], names=["file_id", "repo", "path", *names])

    known = texts.withColumn("lang", language_of("path")).where("lang is not null and content is not null").select("file_id", "repo", "path", "lang", "content")
    return known.mapInArrow(run, f"file_id long, repo string, path string, {columns}")


def code_references(texts: DataFrame) -> DataFrame:
    """(file_id, repo, path, kind, name, line): what every file calls, extends and implements, once for each place."""
    return each_file(texts, lambda lang, t: python_references(t) if lang == "python" else script_references(t), "kind string, name string, line int")


def class_members(texts: DataFrame) -> DataFrame:
    """(file_id, repo, path, qualified_name, signature, start_line, end_line): the methods of script classes."""
    return each_file(texts, lambda lang, t: [] if lang == "python" else script_members(t), "qualified_name string, signature string, start_line int, end_line int")
