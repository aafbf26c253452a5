"""Operators over a repository index: small cases, text helpers, extraction, sources and plans."""

import ast
import sys
from datetime import datetime as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text
from quarryline.operators import extract, graph, indexing, lifecycle, membership, retrieval, revisions
from quarryline.sources import tree

from .conftest import rows

MEMORY = (
    "feed_seq long, op string, record_id string, revision int, repo string, type string, status string, content string, severity string, persistence_mode string, "
    "critical boolean, scopes array<string>, files array<string>, symbols array<string>, created_at string, expires_at string"
)


def rev(seq, rid, n, kind="decision", status="active", content="", severity=None, scopes=None, op="insert", mode=None, files=None, critical=False):
    return (seq, op, rid, n, "r", kind, status, content, severity, mode, critical, scopes, files, None, "2025-01-01T00:00:00Z", None)


def test_current_is_not_the_last_visible(spark):
    log = [rev(1, "A", 1), rev(2, "a", 2, status="inactive"), rev(3, "b", 1), rev(4, "b", 2, op="delete", status=None), rev(5, "c", 1), rev(6, "c ", 1, status="stale")]
    vers = revisions.versions(spark.createDataFrame(log, MEMORY))
    cur = revisions.current(vers)
    assert rows(cur, "rid", "revision", "status") == [("a", 2, "inactive"), ("c", 1, "stale")]
    assert rows(revisions.visible(cur), "rid") == []
    assert rows(revisions.history(vers)) == [("a", "active>inactive"), ("b", "active>-"), ("c", "stale")]
    assert rows(revisions.conflicts(spark.createDataFrame(log, MEMORY))) == [("c", 1, 2)]


def test_search_ranks_and_history(spark):
    log = [
        rev(1, "m1", 1, "constraint", content="Keep the Order", severity="MUST"), rev(2, "m2", 1, "constraint", content="the order!", severity="MUST", scopes=["s"]),
        rev(3, "d", 1, content="the order (old)"), rev(4, "d", 2, content="THE_ORDER"), rev(5, "i", 1, "constraint", content="the order", severity="INFO"),
        rev(6, "h", 1, content="the order", status="inactive"), rev(7, "n", 1, content="the ordering of others"), rev(8, "x", 1, content=None),
    ]
    vers = revisions.versions(spark.createDataFrame(log, MEMORY))
    assert rows(retrieval.search(vers, "the order"), "rank", "rid", "revision") == [(1, "m1", 1), (2, "m2", 1), (3, "d", 2), (4, "i", 1)]
    past = retrieval.search(vers, "the order", past=True).where("rank = 8")
    assert rows(past, "rid", "revision", "warning") == [("d", 1, "superseded"), ("h", 1, "inactive")]
    assert rows(retrieval.search(vers, '"'), "rid") == []
    assert retrieval.best(retrieval.search(vers, "the order"), 0).count() == 0
    with pytest.raises(ValueError):
        retrieval.best(vers, -1)


def test_text_helpers(spark):
    one = lambda c, **k: spark.createDataFrame([tuple(k.values())], list(k)).select(c).first()[0]
    for s in ("src/api v2x-ön", "", "don't STOP"):
        assert one(text.title_name("s"), s=s) == s.title()
    assert one(text.scope_id("s"), s="Src/My_pkg.x/") == "src-my-pkg-x"
    assert one(text.token_estimate("s"), s="abcde") == 2
    assert one(text.redacted("s"), s="k = sk-abcdefghijklmnopqrstuv; password: hunter2hunter2") == "k = [REDACTED]; [REDACTED]"
    assert one(text.patch_paths("s"), s="*** Add File: a.py\n+x\n*** Move to: b.py\ndiff --git a/c.py b/d.py") == ["a.py", "b.py", "c.py", "d.py"]
    assert one(text.tool_path("s"), s='{"path": "p", "filePath": "f"}') == "f"
    assert one(text.embedded_json("s"), s='so: {"a": 1} done') == '{"a": 1}'
    assert one(text.embedded_json("s"), s="none") is None
    assert one(text.status_paths("s"), s=" M a.py\0R  new.py\0old.py\0?? c.py\0") == ["a.py", "new.py", "c.py"]
    assert one(text.language_of("s"), s="x/y.TSX") == "typescript"
    for glob, yes, no in (("**/x.py", ["x.py", "a/b/x.py"], ["ax.py"]), ("a/*.py", ["a/b.py"], ["a/b/c.py"]), ("a/**/z?.ts", ["a/z1.ts", "a/q/z2.ts"], ["a/z.ts"]), (".g*", [".git"], ["xgit"])):
        df = spark.createDataFrame([(p,) for p in yes + no], ["p"])
        assert [r.p for r in df.where(text.matches_globs("p", [glob], [])).collect()] == yes


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [("hub", f"n{k:02d}") for k in range(0, 60, 9)]
    edges = [("r", "imports", a, b) for a, b in pairs] + [("r", "imports", "x", "x"), ("r", "calls", None, "y")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            up[find(a)] = find(b)
    least = {}
    for x in list(up):
        least[find(x)] = min(least.get(find(x), x), x)
    df = spark.createDataFrame(edges, "repo string, edge_type string, source_file string, target_file string")
    assert rows(graph.components(graph.file_links(df)), "node", "component") == sorted((x, least[find(x)]) for x in up)
    assert rows(graph.components(graph.file_links(df.limit(0)))) == []


def test_locked_files_link_nothing(spark):
    df = spark.createDataFrame([("r", "calls", "a", "b"), ("r", "calls", "b", "c"), ("r", "imports", "c", "d"), ("q", "calls", "a", "b")], "repo string, edge_type string, source_file string, target_file string")
    locked = spark.createDataFrame([("r", "b")], "repo string, path string")
    got = rows(graph.components(graph.file_links(df, without=locked)), "repo", "node", "component")
    assert got == [("q", "a", "a"), ("q", "b", "a"), ("r", "c", "c"), ("r", "d", "c")]


def test_changes_and_blind_paths(spark):
    now = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "n", "3")], "repo string, path string, hash string")
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "gone", "4"), ("r", "blind", "5")], "repo string, path string, hash string")
    got = indexing.compared(now, old, spark.createDataFrame([("r", "blind")], "repo string, path string"))
    assert rows(got, "path", "change") == [("a", "unchanged"), ("b", "modified"), ("gone", "deleted"), ("n", "added")]
    prints = [indexing.fingerprint(d).first()["print"] for d in (now, now.repartition(3).orderBy(F.desc("path")), old)]
    assert prints[0] == prints[1] != prints[2]


def test_running_sum_over_ranges(spark):
    df = spark.createDataFrame([("h" if k % 3 else None, k * 700, k) for k in range(40)], "g string, o long, a long")
    got = {(r.g, r.o): r.used for r in indexing.running_before(df, "g", "o", "a").collect()}
    seen = {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        assert got[(r.g, r.o)] == seen.get(r.g, 0)
        seen[r.g] = seen.get(r.g, 0) + r.a


SCOPES = "id string, repo string, locked boolean, members struct<files:array<string>,symbols:array<string>>, removed_at timestamp, description string"
SYMBOLS = "symbol_id string, repo string, file string, name string, qualified_name string, kind string, start_line int, end_line int, removed_at timestamp"


def test_assignment_by_imports(spark):
    scopes = spark.createDataFrame(
        [("s1", "r", False, (["a.py"], ["SYM"]), None, ""), ("s2", "r", False, (["b.py"], None), None, ""), ("s3", "r", True, (["c.py"], None), None, ""), ("old", "r", False, (["d.py"], None), D(2025, 1, 1), ""), ("nul", "r", None, None, None, None)],
        SCOPES,
    )
    symbols = spark.createDataFrame([("sym", "r", "own.py", "f", "f", "function", 1, 5, None)], SYMBOLS)
    edges = [("one.py", "a.py"), ("two.py", "a.py"), ("two.py", "./b.py"), ("locked.py", "c.py"), ("old.py", "d.py"), ("self.py", "own.py"), ("none.py", None)]
    sure = [("r", "imports", s, t, 1.0) for s, t in edges] + [("r", "imports", "one.py", "b.py", 0.6)]  # a guess is no evidence
    e = spark.createDataFrame(sure, "repo string, edge_type string, source_file string, target_file string, confidence double")
    files = spark.createDataFrame([("r", p) for p in ("a.py", "own.py", *{s for s, _ in edges})], "repo string, path string")
    got = lifecycle.assignments(files, e, scopes, symbols)
    assert rows(got, "path", "verdict", "scope") == [
        ("locked.py", "none", None), ("none.py", "none", None), ("old.py", "none", None), ("one.py", "auto", "s1"), ("self.py", "auto", "s1"), ("two.py", "ambiguous", None),
    ]
    assert rows(membership.dangling(scopes, files, symbols)) == [("s2", "file", "b.py"), ("s3", "file", "c.py")]


def test_moved_ground_is_idempotent(spark):
    log = [
        rev(1, "gone", 1, scopes=["nope"]), rev(2, "file", 4, files=["lost.py"]), rev(3, "both", 1, scopes=["nope"], files=["lost.py"]), rev(4, "settled", 1, status="orphaned", scopes=["nope"]),
        rev(5, "src", 1, "constraint", mode="source_bound", files=["m.py"]), rev(6, "keep", 1, "constraint", mode="persistent", scopes=["nope"]), rev(7, "fine", 1, scopes=["s1"]),
    ]
    cur = revisions.current(revisions.versions(spark.createDataFrame(log, MEMORY)))
    scopes = spark.createDataFrame([("s1", "r", False, None, None, "")], SCOPES)
    files = spark.createDataFrame([("r", "m.py")], "repo string, path string")
    changes = spark.createDataFrame([("r", "m.py", "modified")], "repo string, path string, change string")
    got = lifecycle.moved_ground(cur, scopes, files, spark.createDataFrame([], SYMBOLS), changes)
    assert rows(got) == [("both", 2, "orphaned"), ("file", 5, "review_required"), ("gone", 2, "orphaned"), ("src", 2, "stale")]
    after = cur.join(got.select("rid", F.col("status").alias("s2")), "rid", "left").withColumn("status", F.coalesce("s2", "status")).drop("s2")
    assert rows(lifecycle.moved_ground(after, scopes, files, spark.createDataFrame([], SYMBOLS), changes)) == []


PY = '''import os.path
from .services import UserService

LIMIT = 3
name = "x"

@deco
class A(Base):
    def m(self, a):
        def inner(): pass
        return a

    async def n(self): ...

if True:
    def guarded(): return 1
else:
    other = 2
'''


def test_extraction(spark):
    texts = spark.createDataFrame(
        [(1, "r", "app/a.py", PY), (2, "r", "app/bad.py", "class B:\n    def m(self):\n        x = (\n"), (3, "r", "src/i.ts", "import x from './u';\nexport const f = (a) => a;\nexport class C {}\nconst q = require('../app/z');\n"), (4, "r", "n.py", None)],
        "file_id long, repo string, path string, content string",
    )
    got = extract.python_symbols(texts)
    assert rows(got.where("file_id = 1"), "qualified_name", "kind", "start_line", "end_line") == sorted([
        ("LIMIT", "constant", 4, 4), ("name", "variable", 5, 5), ("A", "class", 7, 13), ("A.m", "method", 9, 11), ("A.n", "method", 13, 13),
        ("guarded", "function", 16, 16), ("other", "variable", 18, 18),
    ], key=str)
    assert rows(got.where("file_id = 2"), "qualified_name", "kind", "status") == [("B", "class", "parse_error"), ("B.m", "method", "parse_error")]
    assert rows(extract.script_symbols(texts), "name", "kind", "start_line") == [("C", "class", 3), ("f", "function", 2), ("q", "constant", 4)]
    files = spark.createDataFrame([("r", p) for p in ("app/services.py", "src/u.ts", "app/z/index.ts", "os/path.py")], "repo string, path string")
    imports = extract.script_imports(texts).unionByName(extract.python_imports(texts))
    assert rows(extract.resolved_imports(imports, files), "module", "target") == [("../app/z", "app/z/index.ts"), ("./u", "src/u.ts"), (".services", "app/services.py"), ("os.path", "os/path.py")]


def test_own_sources_as_a_tree(spark):
    root = str(Path(__file__).parent.parent / "quarryline")
    got = tree.scan(spark, root, exclude=["llm/**"])
    want = {str(p.relative_to(root)) for p in Path(root).rglob("*.py") if "llm" not in p.parts}
    assert {r.path for r in got.where("readable").select("path").collect()} == want
    syms = extract.python_symbols(got.select(F.lit(1).cast("long").alias("file_id"), F.lit("r").alias("repo"), "path", "content"))
    defined = sum(isinstance(n, ast.FunctionDef) for p in want for n in ast.parse(Path(root, p).read_text()).body)
    assert syms.where("kind = 'function'").count() >= defined


def test_cache_versions(spark, tmp_path):
    base = str(tmp_path / "cache")
    with pytest.raises(tree.UnusableCache):
        tree.read_cache(spark, base)
    tree.write_cache({"t": spark.range(3)}, base)
    opened = tree.read_cache(spark, base)["t"]
    tree.write_cache({"t": spark.range(5)}, base)
    assert (opened.count(), tree.read_cache(spark, base)["t"].count()) == (3, 5)
    log = str(tmp_path / "log")
    tree.append_records(spark.range(2), log)
    tree.append_records(spark.range(2, 4), log)
    assert rows(tree.read_records(spark, log, "id long")) == [(0,), (1,), (2,), (3,)]


def test_nothing_outside_needs_llm():
    from quarryline.plans import general, repository  # noqa: F401

    root = Path(__file__).parent.parent / "quarryline"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "quarryline.llm" not in p.read_text(), p
    assert sys.modules
