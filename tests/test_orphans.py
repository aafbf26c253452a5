"""Orphan references on small tables."""

from datetime import datetime as D

from pyspark.sql import functions as F

from quarryline.common import hot_keys, lookup_join
from quarryline.operators import orphans

from .conftest import rows

EDGES = "edge_id long, repo string, source_symbol string, target_symbol string, indexed_at timestamp, extra string"
MEMORY = "feed_seq long, repo string, record_id string, revision int, created_at string, scopes array<string>, files array<string>, symbols array<string>"
SYMBOLS = "symbol_id string, repo string, file string, first_seen_at timestamp, removed_at timestamp"
SCOPES = "id string, repo string, members struct<files:array<string>,symbols:array<string>>, created_at timestamp, removed_at timestamp"


def tables(spark, edges=(), memory=(), symbols=(), scopes=(), files=(), snap=()):
    make = spark.createDataFrame
    return (make(list(edges), EDGES), make(list(memory), MEMORY), make(list(symbols), SYMBOLS), make(list(scopes), SCOPES), make(list(files), "repo string, path string"), make(list(snap), "repo string, path string"))


def test_reasons(spark):
    edges = [
        (1, "r", None, " ABC ", D(2025, 3, 5), ""), (1, "r", None, " ABC ", D(2025, 3, 5), ""), (2, "r", None, "abc", D(2025, 6, 1), ""),
        (3, "r", None, "abc", D(2024, 1, 1), ""), (4, "r", None, "nope", D(2025, 3, 5), ""), (5, "r", None, "  ", D(2025, 3, 5), ""), (6, "r", None, None, D(2025, 3, 5), ""),
        (7, "r", None, "abc", D(2025, 8, 1), ""), (8, "r", None, "nope", None, ""), (9, "r", None, "abc", None, ""),
    ]
    symbols = [("abc", "r", "a.py", D(2025, 1, 1), D(2025, 5, 1)), ("ABC", "r", "a.py", D(2025, 7, 1), None)]
    memory = [
        (1, "r", "M1", 1, "2025-02-03T00:00:00Z", ["s1", "s1 ", "gone", None, ""], ["./a//b.py", "lost\\c.py", "never.py"], None),
        (2, "r", "m1 ", 1, "2025-02-03T00:00:00Z", ["s1", "later"], ["a/b.py", "lost/c.py"], []),
    ]
    scopes = [("s1", "r", None, D(2025, 1, 1), None), ("later", "r", None, D(2025, 9, 1), None)]
    got = orphans.direct_orphans(orphans.orphan_references(*tables(spark, edges, memory, symbols, scopes, [("r", "a/b.py")], [("r", ".\\lost\\c.py"), ("x", "never.py")])))
    assert rows(got, *orphans.FOUND) == sorted([
        ("edges", "2", "target_symbol", "abc", "deleted", "2025-06"), ("edges", "3", "target_symbol", "abc", "late", "2024-01"),
        ("edges", "4", "target_symbol", "nope", "missing", "2025-03"), ("edges", "8", "target_symbol", "nope", "missing", None),
        ("memory_rev", "m1#1", "scopes", "later", "late", "2025-02"), ("memory_rev", "m1#1", "files", "lost/c.py", "deleted", "2025-02"),
    ], key=str)


def test_empty_tables(spark):
    assert rows(orphans.orphan_references(*tables(spark))) == []


def test_inherited_orphans(spark):
    t = D(2025, 3, 1)
    edges = [(1, "r", "s1", "s2", t, ""), (2, "r", None, "s2", t, "")]
    symbols = [("s1", "r", "gone.py", D(2025, 1, 1), None), ("s2", "r", "a.py", D(2025, 1, 1), None), ("s3", "r", "gone.py", D(2025, 1, 1), D(2025, 2, 1))]
    scopes = [("c", "r", {"files": ["a.py"], "symbols": ["s1"]}, D(2025, 2, 1), None)]
    memory = [(1, "r", "m", 1, "2025-03-03T00:00:00Z", ["c"], None, None)]
    got = rows(orphans.orphan_references(*tables(spark, edges, memory, symbols, scopes, [("r", "a.py")], [("r", "gone.py")])), "src", "src_key", "field", "ref", "reason", "depth")
    assert got == [
        ("edges", "1", "source_symbol", "s1", None, 1), ("memory_rev", "m#1", "scopes", "c", None, 2),
        ("scopes", "c", "members.symbols", "s1", None, 1), ("symbols", "s1", "file", "gone.py", "deleted", 0),
    ]


REFS = "src string, src_key string, field string, ref string, t timestamp, repo string, parent string, reason string"


def made(spark, links):
    return spark.createDataFrame([(a, b, "f", d, None, "r", c, why) for a, b, c, d, why in links], REFS)


def test_cascade_ends_in_cycles(spark):
    links = [("a", "0", "x", "-", "missing"), ("a", "1", "a", "0", None), ("a", "2", "a", "1", None), ("a", "1", "a", "2", None), ("b", "9", "a", "2", None), ("b", "8", "a", "7", None)]
    got = orphans.cascade(made(spark, links).union(made(spark, links[:2])))
    assert rows(got, "src", "src_key", "ref", "depth") == [("a", "0", "-", 0), ("a", "1", "0", 1), ("a", "1", "2", 3), ("a", "2", "1", 2), ("b", "9", "2", 3)]


def test_cascade_has_no_bound_on_depth(spark):
    links = [("a", "0", "x", "-", "late"), *(("a", str(k), "a", str(k - 1), None) for k in range(1, 13))]
    assert rows(orphans.cascade(made(spark, links).coalesce(1)).agg(F.max("depth"), F.count("ref"))) == [(12, 13)]


def test_lookup_join_of_hot_and_null_keys(spark):
    left = spark.createDataFrame([("hot", k) for k in range(3000)] + [("cold", 1), (None, 2), ("none", 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("cold", "C")], "k string, w string")
    assert [r.k for r in hot_keys(left, ["k"]).collect()] == ["hot"]
    got = lookup_join(left, right, ["k"]).groupBy("w").count().collect()
    assert {r.w: r["count"] for r in got} == {"H": 3000, "C": 1, None: 2}
