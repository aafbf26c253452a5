"""Texts that parse and texts that don't, judged by the grammars alone, against Python's own readers where it has them."""

from __future__ import annotations

import ast
import tomllib

import pytest

from quarryline.llm import syntax

VALID = {"ts":["let a: typeof import('x')","let x = a as T || b\nexport {}","x! = 1","(a as any) = 2","declare const x: number","namespace N { const x: number }","const x: number = 1, y = 2"],
    "js":["if (a)\n b\nelse\n c","do\n x()\nwhile (y)","a()\nwhile (b) { c() }","if (a) { b } else { c }","if (a) b; else c; d","do x; while (y); z","a ?? (b || c)","(-1) ** 2","2 ** -1","await x","a.b = c[d] = 1","[a, b] = [b, a]","({a, b} = c)","for (a.b of c) {}","for (const x of y) z","x = /a(b)[)]/gi.test(y)","++a.b; c[0]--","delete a.b","import x from 'y' with {type: 'json'}","with (a) b","x = 010","a = b ? c : d ? e : f","while (x)\n y++","let a, b = 1","async () => { await f(x) }","`"+"${`"*3000+"`}"*3000+"`","/a{2}+?/","/a{2,}?b*?/","try {} catch {}","a = function* () { yield 1; yield* b }","class A { #x = 1; has(o) { return #x in o } }","for (;;) {}","x = a\n? b\n: c","(a) = 1","for (var i = 0, n = 5; i < n; i++) {}","var x\nvar y","export const a = 1","-(2 ** 3)","!(a in b)","typeof x === 'y' && z"],
    "jsx":["x = "+"<a>"*3000+"b"+"</a>"*3000],
    "py":["a = b = 1","(a, b) = c","[a, *b] = c","a.b[0]: int = 1","x += 1","for a, (b, c) in d: pass","with a as (b, c): pass","del a, b[0], (c, d)","f(*a, b=1, *c, **d)","f(a for a in b)","f(**k, x=1)","def f(a, /, b=1, *, c, d=2, **e): pass","lambda a, b=1, *c, d, **e: 0","lambda *, a: 0","lambda: 0","x = yield","print(*a)","(yield)","f((a for a in b), 1)","def f(a=lambda x, y=1: x, *b): pass","a[b:=1]","x = *a, b","for x in *a, b: pass","f(a)(b).c = 1","(a) = 1","(a).b += 1","def f(*, a): pass","[x for x.y in z]","del (a)","del [a]", "x: int","async def f():\n  async with a as b, c: pass\n  return [x async for x in y]","while (n := f()) > 1: pass","match = 1\nmatch.x()\nmatch(x)\nprint(match)","type X = int","case = {1: 2}"],
    "json":["["*20000+"]"*20000,'{"a":1,"a":2}'],"toml":["a.b = 1\na.c = 2\n[d]\n[d.e]\n[[f]]\nx = 1\n[[f]]\nx = 2\n[f.g]\ny = 1","[a.b]\n[a]\nc = 1","a = {b = 1, c = {d = 2}}\n[x]\ny.z = 1","a = [{b = 1}, {b = 2}]",'"a.b" = 1\na.b = 2',"a = 1979-05-27T07:32:00Z","a = [1, 2,]","x = '''a'''"]}
INVALID = {"js":["1 = 2","f() = 1","const x;","a ?? b || c","-1 ** 2","/a(/","x = /*/","x = /a/gg","f()++","++1","let {a};","import a from 'b'\nx = 010","if (a) b else c","a +","typeof","for (f() of x) {}","(a + b) = 1","else {}","{ else }"],
    "ts":["const x;","1 = 2","f() = 3"],
    "py":["f() = 1","def f(a=1, b): pass","f(**k, *a)","del f()","def f(*): pass","f(a=1, b)","f(x for x in y, 1)","a + b = c","f() += 1","def f(*a, *b): pass","def f(**a, b): pass","lambda a=1, b: 0","lambda *: 0","1 = x","None = 1","for f() in x: pass","with a as f(): pass","x = (*a)","def f(a, /, b, /): pass","(a, b): int = 1","(a, b) += 1","[x for f() in y]","'a' = 1"],
    "json":["["*20000,'{"a":}'],"toml":["a = 1\na = 2","[a]\n[a]","a.b = 1\na = 2","a = {b = 1, b = 2}","[a]\nb = 1\n[a.b]","a = {}\na.b = 1","[[a]]\n[a]","a = [1]\n[[a]]","[a]\n[[a]]",'"a" = 1\na = 2',"a = [{b = 1, b = 2}]"]}


@pytest.mark.parametrize("ext", sorted(VALID))
def test_valid(ext):
    assert [t for t in VALID[ext] if syntax.invalid(ext, t)] == []


@pytest.mark.parametrize("ext", sorted(INVALID))
def test_invalid(ext):
    assert [t for t in INVALID[ext] if not syntax.invalid(ext, t)] == []


def test_the_lists_agree_with_pythons_readers():
    def fails(read, t):
        try:
            read(t)
        except (ValueError, SyntaxError):
            return True
        return False

    assert [t for t in VALID["py"] if fails(ast.parse, t)] == [] and [t for t in INVALID["py"] if not fails(ast.parse, t)] == []
    assert [t for t in VALID["toml"] if fails(tomllib.loads, t)] == [] and [t for t in INVALID["toml"] if not fails(tomllib.loads, t)] == []
