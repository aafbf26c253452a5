"""Queries of the general data problems (snapshots, change feeds, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.common import table
from quarryline.operators import changefeed, orphans, snapshots


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Changes between consecutive snapshots, per path."""
    return snapshots.changed_between(table(spark, base, "files_snap"), table(spark, base, "scan_results"))


def p2_change_counts(spark: SparkSession, base: str) -> DataFrame:
    """Changes per snapshot, repository and kind."""
    return snapshots.change_counts(p2_found(spark, base))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Present state of every record of the feed."""
    return changefeed.apply_feed(table(spark, base, "memory_rev"))


def _tables(spark: SparkSession, base: str) -> list[DataFrame]:
    return [table(spark, base, t) for t in ("edges", "memory_rev", "symbols", "scopes", "files", "files_snap")]


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """References without their record."""
    return orphans.direct_orphans(orphans.orphan_references(*_tables(spark, base)))


def p6_by_period(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references per table, field, reason and month."""
    return orphans.by_table_and_period(p6_found(spark, base))


def p6_cascade(spark: SparkSession, base: str) -> DataFrame:
    """Direct and inherited orphan references per table, field and month."""
    return orphans.direct_and_inherited(orphans.orphan_references(*_tables(spark, base)))


QUERIES = {f.__name__: f for f in (p2_found, p2_change_counts, p5_found, p6_found, p6_by_period, p6_cascade)}

_NPATH = "nullif(nullif(regexp_replace(regexp_replace(replace(trim({0}), '\\', '/'), '/{{2,}}', '/', 'g'), '^(\\./)+', ''), ''), '.')"


def _npath(c: str) -> str:
    return _NPATH.format(c)


_P2 = f"""
WITH won AS (
  SELECT *, row_number() OVER (PARTITION BY repo, coalesce(root, ''), snapshot_no ORDER BY delivered_at DESC, scan_id DESC) k
  FROM scan_results),
ord AS (
  SELECT scan_id, snapshot_no, repo, coalesce(root, '') root, unreadable_paths,
    row_number() OVER (PARTITION BY repo, coalesce(root, '') ORDER BY snapshot_no) idx FROM won WHERE k = 1),
listed AS (
  SELECT o.repo, o.root, o.idx, {_npath("s.path")} path, regexp_replace(lower(trim(s.content_hash)), '^sha256:', '') h, s.indexed_at
  FROM files_snap s JOIN ord o USING (scan_id)),
blind AS (SELECT DISTINCT repo, root, idx, {_npath("u")} path FROM (SELECT repo, root, idx, unnest(unreadable_paths) u FROM ord)),
one AS (
  SELECT repo, root, idx, path, h FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, root, idx, path ORDER BY indexed_at DESC, h IS NULL, h) k FROM listed)
  WHERE k = 1),
seen AS (
  SELECT repo, root, idx, path, CASE WHEN b.path IS NULL THEN one.h END h
  FROM one LEFT JOIN blind b USING (repo, root, idx, path)
  UNION ALL SELECT repo, root, idx, path, NULL FROM blind ANTI JOIN one USING (repo, root, idx, path)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY repo, root, path ORDER BY idx) run FROM seen),
st AS (
  SELECT repo, root, idx, path, last_value(h IGNORE NULLS) OVER (PARTITION BY repo, root, path, run ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) h FROM runs),
live AS (SELECT * FROM st WHERE h IS NOT NULL),
pairs AS (
  SELECT coalesce(c.repo, p.repo) repo, coalesce(c.root, p.root) root, coalesce(c.idx, p.idx + 1) idx, coalesce(c.path, p.path) path, p.h old, c.h new
  FROM live c FULL JOIN live p ON c.repo = p.repo AND c.root = p.root AND c.path = p.path AND c.idx = p.idx + 1)
SELECT o.snapshot_no, o.repo, path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM pairs JOIN ord o USING (repo, root, idx) WHERE idx > 1 AND old IS DISTINCT FROM new
"""

_P5 = """
SELECT record_id, revision, status FROM (
  SELECT lower(trim(record_id)) record_id, revision, status, lower(trim(op)) op,
    row_number() OVER (PARTITION BY lower(trim(record_id)) ORDER BY revision DESC, feed_seq DESC) k FROM memory_rev)
WHERE k = 1 AND op <> 'delete'
"""

_P6 = f"""
WITH mem AS (
  SELECT rid || '#' || revision src_key, repo, scopes, files, symbols, created_at::timestamp t FROM (
    SELECT *, lower(trim(record_id)) rid, row_number() OVER (PARTITION BY lower(trim(record_id)), revision ORDER BY feed_seq DESC) k FROM memory_rev)
  WHERE k = 1),
refs AS (
  SELECT 'edges' src, edge_id::varchar src_key, 'target_symbol' field, lower(trim(target_symbol)) ref, indexed_at::timestamp t FROM edges
  UNION SELECT 'memory_rev', src_key, 'symbols', lower(trim(r)), t FROM (SELECT src_key, t, unnest(symbols) r FROM mem)
  UNION SELECT 'memory_rev', src_key, 'scopes', trim(r), t FROM (SELECT src_key, t, unnest(scopes) r FROM mem)),
lives AS (
  SELECT 'symbol' kind, lower(trim(symbol_id)) ref, first_seen_at s, removed_at e FROM symbols
  UNION SELECT 'scope', trim(id), created_at, removed_at FROM scopes),
j AS (
  SELECT r.*, count(l.ref) n, coalesce(bool_or(l.s <= t AND (l.e IS NULL OR t < l.e)), false) alive, coalesce(bool_or(l.e <= t), false) ended
  FROM refs r LEFT JOIN lives l ON l.ref = r.ref AND l.kind = CASE WHEN r.field = 'scopes' THEN 'scope' ELSE 'symbol' END
  WHERE r.ref <> '' GROUP BY ALL),
f AS (
  SELECT DISTINCT src_key, repo, {_npath("r")} ref, t FROM (SELECT src_key, repo, t, unnest(files) r FROM mem)),
now_ AS (SELECT DISTINCT repo, {_npath("path")} ref FROM files), once AS (SELECT DISTINCT repo, {_npath("path")} ref FROM files_snap)
SELECT src, src_key, field, ref, CASE WHEN n = 0 THEN 'missing' WHEN ended THEN 'deleted' ELSE 'late' END reason, strftime(t, '%Y-%m') period
FROM j WHERE NOT alive
UNION ALL
SELECT 'memory_rev', src_key, 'files', f.ref, CASE WHEN o.ref IS NULL THEN 'missing' ELSE 'deleted' END, strftime(t, '%Y-%m')
FROM f ANTI JOIN now_ n ON n.repo = f.repo AND n.ref = f.ref LEFT JOIN once o ON o.repo = f.repo AND o.ref = f.ref WHERE f.ref IS NOT NULL
"""

_P6_CASCADE = f"""
WITH RECURSIVE mem AS (
  SELECT rid || '#' || revision k, repo, scopes, files, symbols, created_at::timestamp t FROM (
    SELECT *, lower(trim(record_id)) rid, row_number() OVER (PARTITION BY lower(trim(record_id)), revision ORDER BY feed_seq DESC) n FROM memory_rev) WHERE n = 1),
sc AS (SELECT trim(id) k, repo, created_at::timestamp t, members FROM scopes WHERE removed_at IS NULL),
refs AS (SELECT DISTINCT * FROM (
  SELECT 'edges' src, edge_id::varchar k, 'target_symbol' field, 'symbols' parent, lower(trim(target_symbol)) ref, repo, indexed_at::timestamp t FROM edges
  UNION ALL SELECT 'edges', edge_id::varchar, 'source_symbol', 'symbols', lower(trim(source_symbol)), repo, indexed_at::timestamp FROM edges
  UNION ALL SELECT 'memory_rev', k, 'symbols', 'symbols', lower(trim(r)), repo, t FROM (SELECT k, repo, t, unnest(symbols) r FROM mem)
  UNION ALL SELECT 'memory_rev', k, 'scopes', 'scopes', trim(r), repo, t FROM (SELECT k, repo, t, unnest(scopes) r FROM mem)
  UNION ALL SELECT 'memory_rev', k, 'files', 'files', {_npath("r")}, repo, t FROM (SELECT k, repo, t, unnest(files) r FROM mem)
  UNION ALL SELECT 'scopes', k, 'members.symbols', 'symbols', lower(trim(r)), repo, t FROM (SELECT k, repo, t, unnest(members.symbols) r FROM sc)
  UNION ALL SELECT 'scopes', k, 'members.files', 'files', {_npath("r")}, repo, t FROM (SELECT k, repo, t, unnest(members.files) r FROM sc)
  UNION ALL SELECT 'symbols', lower(trim(symbol_id)), 'file', 'files', {_npath("file")}, repo, first_seen_at::timestamp FROM symbols WHERE removed_at IS NULL)
  WHERE ref <> '' AND k <> ''),
lives AS (
  SELECT 'symbols' parent, lower(trim(symbol_id)) ref, first_seen_at s, removed_at e FROM symbols
  UNION SELECT 'scopes', trim(id), created_at, removed_at FROM scopes),
timed AS (
  SELECT r.src, r.k, r.field, r.parent, r.ref, r.t, coalesce(bool_or(l.s <= t AND (l.e IS NULL OR t < l.e)), false) sound
  FROM refs r LEFT JOIN lives l ON l.ref = r.ref AND l.parent = r.parent WHERE r.parent <> 'files' GROUP BY ALL),
now_ AS (SELECT DISTINCT repo, {_npath("path")} ref, true sound FROM files),
j AS (
  SELECT src, k, field, parent, ref, t, sound FROM timed
  UNION ALL SELECT r.src, r.k, r.field, r.parent, r.ref, r.t, coalesce(n.sound, false) FROM refs r LEFT JOIN now_ n ON n.repo = r.repo AND n.ref = r.ref WHERE r.parent = 'files'),
orphan(parent, ref, depth) AS (
  SELECT DISTINCT src, k, 0 FROM j WHERE NOT sound
  UNION SELECT j.src, j.k, o.depth + 1 FROM j JOIN orphan o ON j.parent = o.parent AND j.ref = o.ref WHERE j.sound),
least AS (SELECT parent, ref, min(depth) depth FROM orphan GROUP BY 1, 2),
cases AS (
  SELECT DISTINCT src, k, field, ref, strftime(t, '%Y-%m') period, 0 depth FROM j WHERE NOT sound
  UNION SELECT DISTINCT j.src, j.k, j.field, j.ref, strftime(j.t, '%Y-%m'), l.depth + 1 FROM j JOIN least l ON l.parent = j.parent AND l.ref = j.ref WHERE j.sound)
SELECT src, field, period, count(*) FILTER (depth = 0) AS direct, count(*) FILTER (depth > 0) AS inherited, max(depth) AS deepest FROM cases GROUP BY 1, 2, 3
"""

ORACLE = {
    "p2_found": _P2,
    "p2_change_counts": f"SELECT snapshot_no, repo, change, count(*) AS n FROM ({_P2}) GROUP BY ALL",
    "p5_found": _P5,
    "p6_found": _P6,
    "p6_cascade": _P6_CASCADE,
    "p6_by_period": f"SELECT src, field, reason, period, count(*) AS n FROM ({_P6}) GROUP BY ALL",
}
