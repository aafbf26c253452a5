"""Queries over the tables of a repository index, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import materialize, norm_path, table
from quarryline.functions import text
from quarryline.operators import extract, graph, indexing, lifecycle, membership, references, retrieval, revisions
from quarryline.plans.general import _npath
from quarryline.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Phrases and limits that the registered queries use.
PHRASE, DOC_PHRASE, BUDGET, START_BUDGET, CAP, TOP = "second revision", "a rename was read", 150_000, 3_000, 20, 50


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL where SQL can express it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


class Tables:
    """The tables of one folder, each read where it is used."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)

    def versions(self) -> DataFrame:
        return revisions.versions(self.memory_rev)

    def current(self) -> DataFrame:
        return revisions.current(self.versions())

    def changes(self) -> DataFrame:
        return indexing.compared(indexing.indexed(self.files), indexing.last_listing(self.files_snap))


_CUR = """
vers AS (SELECT * EXCLUDE (k) FROM (
  SELECT lower(trim(record_id)) rid, * EXCLUDE (record_id, op), lower(trim(op)) op,
    row_number() OVER (PARTITION BY lower(trim(record_id)), revision ORDER BY feed_seq DESC) k FROM memory_rev) WHERE k = 1),
tops AS (SELECT rid, max(revision) top, arg_max(op, revision) last_op FROM vers GROUP BY rid),
cur AS (SELECT v.* FROM vers v JOIN tops t ON v.rid = t.rid AND v.revision = t.top WHERE v.op <> 'delete'),
policy(type, status, warning) AS (VALUES ('constraint', 'active', NULL), ('constraint', 'review_required', 'review_required'), ('constraint', 'stale', 'stale'),
  ('decision', 'active', NULL), ('decision', 'review_required', 'review_required'), ('note', 'active', NULL), ('note', 'stale', 'stale')),
shown AS (SELECT c.*, p.warning FROM cur c JOIN policy p USING (type, status)),
bind AS (SELECT DISTINCT rid, trim(s) scope FROM (SELECT rid, unnest(scopes) s FROM cur) WHERE trim(s) <> ''),
live AS (SELECT * FROM scopes WHERE removed_at IS NULL),
unscoped AS (SELECT * FROM shown WHERE rid NOT IN (SELECT rid FROM bind))
"""
_MEMBERS = f"""
mf AS (SELECT DISTINCT id scope, repo, locked, {_npath("m")} path FROM (SELECT trim(id) id, repo, locked, unnest(members.files) m FROM scopes WHERE removed_at IS NULL) WHERE {_npath("m")} IS NOT NULL),
ms AS (SELECT DISTINCT id scope, repo, locked, lower(trim(m)) symbol FROM (SELECT trim(id) id, repo, locked, unnest(members.symbols) m FROM scopes WHERE removed_at IS NULL) WHERE trim(m) <> ''),
sy AS (SELECT DISTINCT lower(trim(symbol_id)) symbol, repo, {_npath("file")} path, name, qualified_name, kind, start_line, end_line FROM symbols WHERE removed_at IS NULL),
sp AS (SELECT DISTINCT scope, repo, path FROM mf UNION SELECT ms.scope, ms.repo, sy.path FROM ms JOIN sy USING (symbol))
"""
_H = "nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '')"
_CHANGES = f"""
now_ AS (SELECT repo, path, arg_max(h, o) hash FROM (SELECT repo, {_npath("path")} path, {_H} h, indexed_at || coalesce({_H}, '') o FROM files) WHERE path IS NOT NULL GROUP BY 1, 2),
before_ AS (SELECT repo, path, arg_max(h, o) hash FROM (SELECT repo, {_npath("path")} path, coalesce({_H}, '-') h, indexed_at || coalesce({_H}, '') o FROM files_snap s
  WHERE snapshot_no = (SELECT max(snapshot_no) FROM files_snap t WHERE t.repo = s.repo)) WHERE path IS NOT NULL GROUP BY 1, 2),
chg AS (SELECT coalesce(n.repo, b.repo) repo, coalesce(n.path, b.path) path,
  CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.hash IS DISTINCT FROM nullif(b.hash, '-') THEN 'modified' ELSE 'unchanged' END change
  FROM now_ n FULL JOIN before_ b ON n.repo = b.repo AND n.path = b.path)
"""
_WORDS = "' ' || array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"
_TOKENS = "CAST(floor((length({0}) + 3) / 4) AS BIGINT)"


# ------------------------------------------------------------------ revision logs
@query(f"WITH {_CUR} SELECT rid, type AS kind, revision, status FROM cur")
def current_revision(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).current().select("rid", F.col("type").alias("kind"), "revision", "status")


@query(f"WITH {_CUR} SELECT rid, type AS kind, status, warning FROM shown")
def visible_records(spark: SparkSession, base: str) -> DataFrame:
    return revisions.visible(Tables(spark, base).current()).select("rid", F.col("type").alias("kind"), "status", "warning")


@query(f"WITH {_CUR} SELECT rid, string_agg(coalesce(status, '-'), '>' ORDER BY revision) AS statuses FROM vers GROUP BY rid")
def history_list(spark: SparkSession, base: str) -> DataFrame:
    return revisions.history(Tables(spark, base).versions())


@query("SELECT lower(trim(record_id)) AS rid, revision, count(DISTINCT feed_seq) AS deliveries FROM memory_rev GROUP BY 1, 2 HAVING count(DISTINCT feed_seq) > 1")
def revision_conflict(spark: SparkSession, base: str) -> DataFrame:
    return revisions.conflicts(Tables(spark, base).memory_rev)


@query(f"WITH {_CUR} SELECT type AS kind, count(DISTINCT rid) AS records, count(*) AS revisions FROM vers GROUP BY type")
def record_counts(spark: SparkSession, base: str) -> DataFrame:
    v = Tables(spark, base).versions().select("type", "rid", "revision")
    return v.groupBy(F.col("type").alias("kind")).agg(F.count_distinct("rid").alias("records"), F.count(F.lit(1)).alias("revisions"))


@query(f"WITH {_CUR} SELECT v.rid, v.revision, v.revision = t.top AS is_current FROM vers v JOIN tops t USING (rid)")
def superseded_revisions(spark: SparkSession, base: str) -> DataFrame:
    v = Tables(spark, base).versions().select("rid", "revision")
    top = v.groupBy("rid").agg(F.max("revision").alias("top"))
    return v.join(top, "rid").select("rid", "revision", (F.col("revision") == F.col("top")).alias("is_current"))


@query(f"WITH {_CUR} SELECT repo, rid FROM unscoped WHERE type = 'constraint' AND severity = 'MUST'")
def global_must(spark: SparkSession, base: str) -> DataFrame:
    shown = revisions.visible(Tables(spark, base).current())
    return revisions.unscoped(shown).where("type = 'constraint' and severity = 'MUST'").select("repo", "rid")


@query(f"WITH {_CUR} SELECT rid, severity, persistence_mode FROM unscoped WHERE type = 'constraint' AND persistence_mode <> 'persistent'")
def passing_global_constraints(spark: SparkSession, base: str) -> DataFrame:
    shown = revisions.unscoped(revisions.visible(Tables(spark, base).current()))
    return shown.where("type = 'constraint' and persistence_mode <> 'persistent'").select("rid", "severity", "persistence_mode")


@query(f"""WITH {_CUR} SELECT repo, kind, rid FROM (SELECT repo, type AS kind, rid, row_number() OVER (PARTITION BY repo, type ORDER BY rid) k FROM shown) WHERE k <= {CAP}""")
def related_context_cap(spark: SparkSession, base: str) -> DataFrame:
    shown = revisions.visible(Tables(spark, base).current()).select("repo", F.col("type").alias("kind"), "rid")
    return retrieval.capped(shown, ["repo", "kind"], ["rid"], CAP)


# ------------------------------------------------------------------ search
_SEARCH = f"""
hit AS (SELECT v.*, t.top, p.type IS NOT NULL AND v.revision = t.top AS now, p.warning, EXISTS (SELECT 1 FROM (SELECT unnest(v.scopes) s) WHERE trim(s) <> '') scoped
  FROM vers v JOIN tops t USING (rid) LEFT JOIN policy p ON p.type = v.type AND p.status = v.status
  WHERE t.last_op <> 'delete' AND v.op <> 'delete' AND contains({_WORDS.format("content")}, ' {PHRASE} ')),
found AS (SELECT CAST(CASE WHEN NOT now THEN 8 WHEN type = 'constraint' AND severity = 'MUST' AND NOT scoped THEN 1 WHEN type = 'constraint' AND severity = 'MUST' THEN 2
  WHEN type = 'decision' THEN 3 WHEN type = 'constraint' THEN 4 WHEN status = 'active' THEN 6 ELSE 7 END AS INT) AS rank,
  rid, type AS kind, revision, status, CASE WHEN revision <> top THEN 'superseded' WHEN now THEN warning ELSE status END AS warning FROM hit)
"""


@query(f"WITH {_CUR}, {_SEARCH} SELECT * FROM found WHERE rank < 8")
def search_ranked(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.search(Tables(spark, base).versions(), PHRASE)


@query(f"WITH {_CUR}, {_SEARCH} SELECT * FROM found")
def search_with_history(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.search(Tables(spark, base).versions(), PHRASE, past=True)


@query(f"WITH {_CUR}, {_SEARCH} SELECT * FROM found WHERE rank < 8 ORDER BY rank, rid, kind, revision LIMIT {TOP}")
def search_top(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.best(retrieval.search(Tables(spark, base).versions(), PHRASE), TOP)


@query(f"SELECT doc_id FROM documents WHERE contains({_WORDS.format('text')}, ' {DOC_PHRASE} ')")
def phrase_search_documents(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).documents.where(text.has_phrase("text", DOC_PHRASE)).select("doc_id")


@query(f"""WITH {_MEMBERS} SELECT symbol, path, name, qualified_name, kind, start_line FROM sy WHERE contains(lower(name), 'merge') AND kind = 'function' AND contains(lower(path), 'core')
ORDER BY repo, path, start_line, symbol LIMIT {TOP}""")
def symbol_search_like(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.symbol_search(Tables(spark, base).symbols, name="Merge", kind="function", path="core", limit=TOP)


@query(f"""WITH {_MEMBERS} SELECT symbol, path, name, qualified_name, kind, start_line FROM sy
WHERE (contains({_WORDS.format("name")}, ' merge ') OR contains({_WORDS.format("qualified_name")}, ' merge ')) ORDER BY repo, path, start_line, symbol LIMIT {TOP}""")
def symbol_search_phrase(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.symbol_search(Tables(spark, base).symbols, query="merge", limit=TOP)


@query(f"""WITH {_MEMBERS}, t AS (SELECT repo, path, string_split(content, chr(10)) ls FROM (SELECT file_id, min(repo) repo, min({_npath("path")}) path FROM files GROUP BY file_id) f JOIN file_text USING (file_id) WHERE content IS NOT NULL)
SELECT y.symbol, y.repo, y.path, y.start_line, md5(array_to_string(list_slice(ls, greatest(start_line, 1), greatest(start_line, 1) + greatest(least(end_line - start_line + 1, 200), 0) - 1), chr(10))
  || CASE WHEN end_line - start_line + 1 > 200 THEN chr(10) || '... (truncated)' ELSE '' END) AS digest
FROM (SELECT DISTINCT symbol, repo, path, start_line, end_line FROM sy) y JOIN t ON t.repo = y.repo AND t.path = y.path""")
def symbol_snippets(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    s = membership.present_symbols(t.symbols).select("symbol", "repo", "path", "start_line", "end_line").distinct()
    listed = t.files.groupBy("file_id").agg(F.min("repo").alias("repo"), F.min(norm_path("path")).alias("path"))
    texts = t.file_text.where("content is not null").join(listed, "file_id").select("repo", "path", "content")
    return s.join(texts, ["repo", "path"]).select("symbol", "repo", "path", "start_line", F.md5(text.snippet("content", "start_line", "end_line")).alias("digest"))


# ------------------------------------------------------------------ changes and freshness
@query(f"WITH {_CHANGES} SELECT change, count(*) AS n FROM chg GROUP BY change")
def change_detect(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).changes().groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CHANGES}, held AS (SELECT repo, count(DISTINCT symbol_id) n FROM symbols WHERE removed_at IS NULL GROUP BY repo)
SELECT r.repo, r.files, coalesce(h.n, 0) AS symbols, c.added, c.modified, c.deleted, c.added + c.modified + c.deleted = 0 AS fresh
FROM (SELECT repo, count(*) files FROM now_ GROUP BY repo) r JOIN (SELECT repo, count(*) FILTER (change = 'added') added, count(*) FILTER (change = 'modified') modified,
count(*) FILTER (change = 'deleted') deleted FROM chg GROUP BY repo) c USING (repo) LEFT JOIN held h USING (repo)""")
def status_freshness(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return indexing.freshness(t.files, t.files_snap, t.symbols)


_HEX = "('0x' || substr(d, {0}, 15))::BIGINT"


@query(f"""WITH {_CHANGES}, d AS (SELECT repo, sha256(path || chr(0) || coalesce(hash, '-')) d FROM now_)
SELECT repo, count(*) AS files, concat_ws('-', bit_xor({_HEX.format(1)}), bit_xor({_HEX.format(16)}), bit_xor({_HEX.format(31)}), bit_xor({_HEX.format(46)})) AS print FROM d GROUP BY repo""")
def fingerprint(spark: SparkSession, base: str) -> DataFrame:
    return indexing.fingerprint(indexing.indexed(Tables(spark, base).files))


@query(f"""WITH {_CHANGES}, first_ AS (SELECT DISTINCT repo, {_npath("path")} path FROM files_snap s WHERE snapshot_no = (SELECT min(snapshot_no) FROM files_snap t WHERE t.repo = s.repo))
SELECT f.repo, count(*) AS gone FROM first_ f ANTI JOIN now_ n ON n.repo = f.repo AND n.path = f.path GROUP BY f.repo""")
def gone_since_first_snapshot(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    low = t.files_snap.groupBy("repo").agg(F.min("snapshot_no").alias("snapshot_no"))
    first = t.files_snap.join(low, ["repo", "snapshot_no"], "left_semi").select("repo", norm_path("path").alias("path")).distinct()
    return first.join(indexing.indexed(t.files).select("repo", "path"), ["repo", "path"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("gone"))


# ------------------------------------------------------------------ scopes
@query(f"WITH {_MEMBERS} SELECT scope, repo, path FROM sp")
def membership_union(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return membership.scope_paths(t.scopes, t.symbols)


@query(f"""WITH {_MEMBERS}, fl AS (SELECT DISTINCT repo, {_npath("path")} path FROM files)
SELECT scope, 'file' AS kind, path AS member FROM mf ANTI JOIN fl USING (repo, path) UNION ALL SELECT scope, 'symbol', symbol FROM ms ANTI JOIN sy USING (symbol)""")
def dangling_members(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return membership.dangling(t.scopes, t.files, t.symbols)


_PART = "coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), lambda x: '{1}' || chr(0) || x || chr(10)), ''), '')"


@query(f"""SELECT trim(id) AS scope, 'sha256:' || sha256({_PART.format("members.files", "f")} || {_PART.format("members.symbols", "s")}) AS digest FROM scopes WHERE removed_at IS NULL""")
def membership_hash(spark: SparkSession, base: str) -> DataFrame:
    return membership.membership_hash(Tables(spark, base).scopes)


@query(f"""WITH {_CUR}, s AS (SELECT trim(id) scope, coalesce(len(list_filter(list_distinct(members.files), lambda x: x IS NOT NULL)), 0) files,
  coalesce(len(list_filter(list_distinct(members.symbols), lambda x: x IS NOT NULL)), 0) symbols FROM live),
n AS (SELECT scope, count(*) FILTER (type = 'decision') d, count(*) FILTER (type = 'constraint') c FROM bind JOIN shown USING (rid) GROUP BY scope)
SELECT s.scope, CAST(s.files AS INT) AS files, CAST(s.symbols AS INT) AS symbols, coalesce(n.d, 0) AS decisions, coalesce(n.c, 0) AS constraints FROM s LEFT JOIN n USING (scope)""")
def scope_read(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return retrieval.scope_read(t.current(), t.scopes)


@query(f"""WITH {_CUR} SELECT b.scope, s.rid, s.severity FROM shown s JOIN bind b USING (rid) SEMI JOIN live l ON trim(l.id) = b.scope
WHERE s.type = 'constraint' AND s.severity IN ('MUST', 'SHOULD')""")
def scope_for(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return retrieval.scope_for(t.current(), t.scopes, t.symbols)


@query(f"""WITH {_CUR}, {_MEMBERS}, {_CHANGES}, ch AS (SELECT repo, path FROM chg WHERE change <> 'unchanged'),
c AS (SELECT * FROM shown WHERE type = 'constraint'),
ev AS (SELECT rid FROM bind WHERE scope IN (SELECT scope FROM sp SEMI JOIN ch USING (repo, path))
  UNION SELECT rid FROM (SELECT rid, repo, {_npath("f")} path FROM (SELECT rid, repo, unnest(files) f FROM c)) SEMI JOIN ch USING (repo, path)
  UNION SELECT rid FROM (SELECT rid, lower(trim(s)) symbol FROM (SELECT rid, unnest(symbols) s FROM c)) WHERE symbol IN (SELECT symbol FROM sy SEMI JOIN ch USING (repo, path))
  UNION SELECT rid FROM unscoped WHERE severity = 'MUST' AND repo IN (SELECT repo FROM ch))
SELECT rid, severity, status, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT trim(u) x FROM (SELECT unnest(c.scopes) u)) WHERE x <> ''), '') AS scopes,
  CAST(CASE WHEN severity = 'MUST' THEN 0 ELSE 3 END + CASE status WHEN 'active' THEN 0 WHEN 'review_required' THEN 1 ELSE 2 END AS INT) AS priority FROM c WHERE rid IN (SELECT rid FROM ev)""")
def check_constraints(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    # both are read several times
    changed = materialize(t.changes().where("change != 'unchanged'").select("repo", "path"), "changed")
    return retrieval.bound_constraints(materialize(t.current().where("type = 'constraint'"), "current"), t.scopes, t.symbols, changed)


@query(f"""WITH {_MEMBERS}, {_CHANGES} SELECT scope, count(*) AS changed FROM sp JOIN (SELECT repo, path FROM chg WHERE change <> 'unchanged') USING (repo, path) GROUP BY scope""")
def changed_scopes(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    changed = t.changes().where("change != 'unchanged'").select("repo", "path")
    return membership.scope_paths(t.scopes, t.symbols).join(changed, ["repo", "path"]).groupBy("scope").agg(F.count(F.lit(1)).alias("changed"))


_HARD = f"""hard AS (SELECT repo, rid, type AS kind, {_TOKENS.format("content")} AS tokens FROM unscoped
WHERE type = 'constraint' AND severity = 'MUST' AND persistence_mode = 'persistent' OR type = 'decision' AND coalesce(critical, false))"""


@query(f"WITH {_CUR}, {_HARD} SELECT * FROM hard")
def hard_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.hard_start(Tables(spark, base).current())


@query(f"WITH {_CUR}, {_HARD} SELECT repo, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) > {START_BUDGET} AS over FROM hard GROUP BY repo")
def hard_bootstrap_budget(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.over_budget(retrieval.hard_start(Tables(spark, base).current()), START_BUDGET)


@query(f"""WITH {_CUR} SELECT repo, rid AS id, 'decision' AS kind, {_TOKENS.format("content")} AS tokens FROM unscoped WHERE type = 'decision' AND NOT coalesce(critical, false)
UNION ALL SELECT repo, id, 'scope', coalesce({_TOKENS.format("description")}, 0) FROM live""")
def soft_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return retrieval.soft_start(t.current(), t.scopes)


@query(f"""WITH {_MEMBERS} SELECT y.repo, count(*) AS symbols, count(*) FILTER (m.symbol IS NOT NULL OR f.path IS NOT NULL) AS covered
FROM (SELECT DISTINCT repo, symbol, path FROM sy) y LEFT JOIN (SELECT DISTINCT symbol FROM ms) m USING (symbol) LEFT JOIN (SELECT DISTINCT repo, path FROM mf) f ON f.repo = y.repo AND f.path = y.path GROUP BY y.repo""")
def coverage_ratio(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return lifecycle.coverage(t.scopes, t.symbols)


_EVIDENCE = f"""
fl AS (SELECT DISTINCT repo, {_npath("path")} path FROM files),
held AS (SELECT sp.* FROM sp WHERE scope IN (SELECT trim(id) FROM scopes WHERE removed_at IS NULL AND NOT coalesce(locked, false))),
im AS (SELECT DISTINCT repo, {_npath("source_file")} path, {_npath("target_file")} t FROM edges WHERE edge_type = 'imports' AND confidence = 1.0),
ev AS (SELECT im.repo, im.path, count(DISTINCT held.scope) n, min(held.scope) scope FROM im JOIN held ON held.repo = im.repo AND held.path = im.t GROUP BY 1, 2),
verdicts AS (SELECT f.repo, f.path, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'auto' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN ev.scope END AS scope
  FROM (SELECT * FROM fl ANTI JOIN sp USING (repo, path)) f LEFT JOIN ev USING (repo, path))
"""


@query(f"WITH {_MEMBERS}, {_EVIDENCE} SELECT * FROM verdicts")
def reconcile_classify(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return lifecycle.assignments(t.files, t.edges, t.scopes, t.symbols)


@query(f"""WITH {_MEMBERS}, {_EVIDENCE} SELECT repo, count(*) FILTER (verdict = 'auto') AS auto, count(*) FILTER (verdict = 'none') AS none,
count(*) FILTER (verdict = 'ambiguous') AS ambiguous, count(*) FILTER (verdict = 'auto') > 20 AS suspicious FROM verdicts GROUP BY repo""")
def reconcile_counts(spark: SparkSession, base: str) -> DataFrame:
    return lifecycle.assignment_counts(reconcile_classify(spark, base))


@query(f"""WITH {_CUR}, {_MEMBERS}, {_CHANGES},
op_ AS (SELECT * FROM cur WHERE coalesce(status, '') NOT IN ('orphaned', 'review_required', 'inactive') AND coalesce(persistence_mode, '') <> 'persistent'),
nf AS (SELECT rid, repo, {_npath("f")} path FROM (SELECT rid, repo, unnest(files) f FROM op_) WHERE {_npath("f")} IS NOT NULL),
rules AS (SELECT rid, 1 r FROM bind SEMI JOIN op_ USING (rid) ANTI JOIN live ON trim(live.id) = bind.scope
  UNION SELECT rid, 2 FROM nf ANTI JOIN now_ USING (repo, path)
  UNION SELECT rid, 2 FROM (SELECT rid, lower(trim(s)) symbol FROM (SELECT rid, unnest(symbols) s FROM op_) WHERE trim(s) <> '') ANTI JOIN sy USING (symbol)
  UNION SELECT rid, 3 FROM nf SEMI JOIN (SELECT * FROM chg WHERE change = 'modified') c USING (repo, path)
    WHERE rid IN (SELECT rid FROM op_ WHERE type = 'constraint' AND persistence_mode = 'source_bound' AND coalesce(status, '') <> 'stale'))
SELECT o.rid, o.revision + 1 AS revision, CASE m.r WHEN 1 THEN 'orphaned' WHEN 2 THEN 'review_required' ELSE 'stale' END AS status
FROM op_ o JOIN (SELECT rid, min(r) r FROM rules GROUP BY rid) m USING (rid)""")
def stale_transitions(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return lifecycle.moved_ground(t.current(), t.scopes, t.files, t.symbols, t.changes())


# ------------------------------------------------------------------ code graph
_LINKS = f"""lk AS (SELECT DISTINCT repo, path FROM (SELECT repo, path FROM mf WHERE locked UNION ALL SELECT ms.repo, sy.path FROM ms JOIN sy USING (symbol) WHERE ms.locked)),
e0 AS (SELECT DISTINCT repo, least(s, t) a, greatest(s, t) b FROM (SELECT repo, {_npath("source_file")} s, {_npath("target_file")} t FROM edges
  WHERE edge_type IN ('imports', 'calls', 'extends', 'implements')) x WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t
  AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.repo = x.repo AND lk.path IN (s, t)))"""
_COMPONENTS = f"""WITH RECURSIVE {_MEMBERS}, {_LINKS}, e AS (SELECT repo, a, b FROM e0 UNION SELECT repo, b, a FROM e0),
r(repo, n, m) AS (SELECT repo, a, a FROM e UNION SELECT r.repo, r.n, e.b FROM r JOIN e ON r.repo = e.repo AND r.m = e.a),
comps AS (SELECT repo, n AS node, min(m) AS component FROM r GROUP BY 1, 2)"""


def _links(t: Tables) -> DataFrame:
    locked = membership.live(t.scopes).where("locked")
    return graph.file_links(t.edges, without=membership.scope_paths(locked, t.symbols).select("repo", "path").distinct())


@query(f"{_COMPONENTS} SELECT repo, node, component FROM comps")
def connected_components(spark: SparkSession, base: str) -> DataFrame:
    return graph.components(_links(Tables(spark, base)))


@query(f"""{_COMPONENTS}, c AS (SELECT repo, component, count(*) files, string_split(min(node), '/') low, string_split(max(node), '/') high FROM comps GROUP BY 1, 2 HAVING count(*) > 1),
d AS (SELECT *, array_to_string(low[:len(list_filter(range(1, len(low)), lambda k: low[:k] = high[:k]))], '/') parent, array_to_string(low, '/') first_ FROM c),
l AS (SELECT *, CASE WHEN parent <> '' THEN parent ELSE 'connected-' || first_ END label FROM d),
b AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}-]', '-', 'g'), '-'), ''), 'connected-component') base FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, base ORDER BY first_) n FROM b)
SELECT repo, component, files, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id,
array_to_string(list_transform(regexp_extract_all(translate(label, '-_', '  '), '\\p{{L}}+|[^\\p{{L}}]+'), lambda p: upper(p[1]) || lower(p[2:])), '') AS name FROM n""")
def component_suggestions(spark: SparkSession, base: str) -> DataFrame:
    return graph.component_suggestions(graph.components(_links(Tables(spark, base))))


@query(f"""SELECT repo, split_part(path, '/', 1) AS folder, count(*) AS files FROM (SELECT DISTINCT repo, {_npath("path")} path FROM files) WHERE path LIKE '%/%' GROUP BY 1, 2 HAVING count(*) >= 2""")
def path_groups(spark: SparkSession, base: str) -> DataFrame:
    return graph.folder_groups(Tables(spark, base).files)


@query(f"""WITH g AS (SELECT repo, split_part(path, '/', 1) folder FROM (SELECT DISTINCT repo, {_npath("path")} path FROM files) WHERE path LIKE '%/%' GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT *, trim(regexp_replace(lower(folder), '[^\\p{{L}}\\p{{N}}-]', '-', 'g'), '-') base FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY repo, base ORDER BY folder) n FROM b)
SELECT repo, folder, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id,
array_to_string(list_transform(regexp_extract_all(folder, '\\p{{L}}+|[^\\p{{L}}]+'), lambda p: upper(p[1]) || lower(p[2:])), '') AS name FROM n""")
def scope_suggestions(spark: SparkSession, base: str) -> DataFrame:
    return graph.suggestions(graph.folder_groups(Tables(spark, base).files))


@query(f"""WITH {_MEMBERS}, p AS (SELECT DISTINCT symbol pid, repo, path, start_line line FROM sy WHERE kind IN ('method', 'function')),
c AS (SELECT DISTINCT symbol, repo, path, start_line, end_line FROM sy WHERE kind IN ('class', 'function')),
m AS (SELECT p.pid, c.symbol, row_number() OVER (PARTITION BY p.pid ORDER BY c.end_line - c.start_line, c.symbol) k
  FROM p JOIN c ON c.repo = p.repo AND c.path = p.path AND p.line BETWEEN c.start_line AND c.end_line AND c.symbol <> p.pid)
SELECT p.pid, m.symbol FROM p LEFT JOIN m ON m.pid = p.pid AND m.k = 1""")
def enclosing_interval(spark: SparkSession, base: str) -> DataFrame:
    s = membership.present_symbols(Tables(spark, base).symbols)
    points = s.where("kind in ('method', 'function')").select(F.col("symbol").alias("pid"), "repo", "path", F.col("start_line").alias("line")).distinct()
    return graph.enclosing(points, s.where("kind in ('class', 'function')").select("symbol", "repo", "path", "start_line", "end_line").distinct())


_REFS = f"""
rf AS (SELECT DISTINCT e.edge_id AS ref, e.repo, {_npath("e.source_file")} path, sy.name FROM edges e JOIN (SELECT DISTINCT symbol, name FROM sy) sy ON sy.symbol = lower(trim(e.target_symbol))
  WHERE e.edge_type IN ('calls', 'extends', 'implements')),
im AS (SELECT DISTINCT repo, {_npath("source_file")} path, {_npath("target_file")} target FROM edges WHERE edge_type = 'imports' AND target_file IS NOT NULL),
cand AS (SELECT rf.ref, 1 tier, sy.path place, start_line, symbol FROM rf JOIN sy USING (repo, path, name)
  UNION ALL SELECT rf.ref, 2, im.target, start_line, symbol FROM rf JOIN im USING (repo, path) JOIN sy ON sy.repo = rf.repo AND sy.path = im.target AND sy.name = rf.name),
b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY tier, place, start_line, symbol) k FROM cand)
"""


@query(f"""WITH {_MEMBERS}, {_REFS} SELECT r.ref, b.symbol, CASE b.tier WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM (SELECT DISTINCT ref FROM rf) r LEFT JOIN b ON b.ref = r.ref AND b.k = 1""")
def priority_reference(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    s = membership.present_symbols(t.symbols)
    e = t.edges.where("edge_type in ('calls', 'extends', 'implements')")
    e = e.select(F.col("edge_id").alias("ref"), "repo", norm_path("source_file").alias("path"), F.lower(F.trim("target_symbol")).alias("symbol"))
    refs = e.join(s.select("symbol", "name").distinct(), "symbol").select("ref", "repo", "path", "name").distinct()
    imports = t.edges.where("edge_type = 'imports' and target_file is not null")
    imports = imports.select("repo", norm_path("source_file").alias("path"), norm_path("target_file").alias("target")).distinct()
    return graph.resolved_names(refs, s.select("symbol", "repo", "path", "name", "start_line"), imports)


@query(f"""SELECT repo, symbol, CAST(sum(n) AS BIGINT) AS edges, count(s) AS files FROM (SELECT repo, lower(trim(target_symbol)) symbol, {_npath("source_file")} s, count(DISTINCT edge_id) n
FROM edges WHERE trim(target_symbol) <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def incoming_references(spark: SparkSession, base: str) -> DataFrame:
    return graph.incoming(Tables(spark, base).edges)


@query(f"""WITH fl AS (SELECT DISTINCT repo, {_npath("path")} path FROM files), e AS (SELECT DISTINCT edge_id, repo, edge_type, {_npath("target_file")} t FROM edges)
SELECT e.repo, e.edge_type, count(fl.path) AS kept, count(*) - count(fl.path) AS open FROM e LEFT JOIN fl ON fl.repo = e.repo AND fl.path = e.t GROUP BY 1, 2""")
def dangling_null_out(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    listed = t.files.select("repo", norm_path("path").alias("target")).where("target is not null").distinct().withColumn("there", F.lit(1))
    e = t.edges.select("edge_id", "repo", "edge_type", norm_path("target_file").alias("target")).distinct()
    nulled = e.join(listed, ["repo", "target"], "left")
    return nulled.groupBy("repo", "edge_type").agg(F.count("there").alias("kept"), (F.count(F.lit(1)) - F.count("there")).alias("open"))


# ------------------------------------------------------------------ budgets, metrics, scalars
@query(f"""SELECT doc_id, coalesce(sum(tok) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {BUDGET} AS attempted
FROM (SELECT doc_id, source, coalesce({_TOKENS.format("text")}, 0) tok FROM documents)""")
def token_budget(spark: SparkSession, base: str) -> DataFrame:
    d = Tables(spark, base).documents.select("doc_id", "source", F.coalesce(text.token_estimate("text"), F.lit(0)).alias("tok"))
    return indexing.running_before(d, "source", "doc_id", "tok").select("doc_id", (F.col("used") < BUDGET).alias("attempted"))


@query(f"SELECT source, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tok, sum({_TOKENS.format('text')}) > {START_BUDGET} AS overflow FROM documents GROUP BY source")
def token_overflow(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).documents.groupBy("source").agg(F.sum(text.token_estimate("text")).alias("tok")).withColumn("overflow", F.col("tok") > START_BUDGET)


@query("""SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS error_rate,
round(coalesce(sum(CASE WHEN event_type = 'click' THEN value END) / nullif(sum(value), 0), 0), 9) AS click_share FROM events GROUP BY user_id""")
def run_metrics(spark: SparkSession, base: str) -> DataFrame:
    share = F.coalesce(F.try_divide(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.nullif(F.sum("value"), F.lit(0.0))), F.lit(0.0))
    error = F.avg((F.col("event_type") == "error").cast("double"))
    return Tables(spark, base).events.groupBy("user_id").agg(error.alias("error_rate"), F.round(share, 9).alias("click_share"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_SECRET_FORMS = (
    "sk-or-v1-[[:alnum:]]{16,}", "sk-[[:alnum:]]{16,}", "AKIA[0-9A-Z]{16}", "gh[pousr]_[[:alnum:]]{20,}", "eyJ[-_[:alnum:]]{10,}[.][-_[:alnum:]]{10,}[.][-_[:alnum:]]{10,}",
    "(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    "(?i)\\b(?:api_key|api-key|apikey|secret|token|password|bearer)\\b[ \\t\\r\\n\\f\\v]*[:=][ \\t\\r\\n\\f\\v]*[\"'']?[-_/+=[:alnum:]]{8,}[\"'']?",
)


def _redact_sql() -> str:
    out = "text"
    for p in _SECRET_FORMS:
        out = f"regexp_replace({out}, '{p}', '[REDACTED]', 'g')"
    return f"SELECT doc_id, md5({out}) AS digest FROM documents"


@query(_redact_sql())
def redact_documents(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).documents.select("doc_id", F.md5(text.redacted("text")).alias("digest"))


@query("SELECT DISTINCT path, trim(regexp_replace(lower(path), '[^\\p{L}\\p{N}-]', '-', 'g'), '-') AS id FROM files")
def scope_id_for_path(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).files.select("path", text.scope_id("path").alias("id")).distinct()


@query("""SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, count(*) AS n FROM files WHERE regexp_matches(path, '^(?:.*/)?core/[^/]*\\.[^/]*$') GROUP BY 1""")
def glob_files(spark: SparkSession, base: str) -> DataFrame:
    f = Tables(spark, base).files.where(text.matches_globs("path", ["**/core/*.*"], []))
    return f.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_id, 'sha256:' || sha256(content) AS hash FROM file_text WHERE content IS NOT NULL")
def content_hashes(spark: SparkSession, base: str) -> DataFrame:
    return Tables(spark, base).file_text.where("content is not null").select("file_id", text.content_hash(F.col("content").cast("binary")).alias("hash"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) k FROM events) WHERE k = 1""")
def first_activation(spark: SparkSession, base: str) -> DataFrame:
    e = Tables(spark, base).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return e.select("user_id", "event_id", "event_type")


# ------------------------------------------------------------------ health
@query(f"""WITH {_CUR}, {_MEMBERS}, fl AS (SELECT DISTINCT repo, {_npath("path")} path FROM files),
n AS (SELECT 'repeated revisions' AS name, (SELECT count(*) FROM (SELECT 1 FROM memory_rev GROUP BY lower(trim(record_id)), revision HAVING count(DISTINCT feed_seq) > 1)) AS n
UNION ALL SELECT 'dangling members', (SELECT count(*) FROM mf ANTI JOIN fl USING (repo, path)) + (SELECT count(*) FROM ms ANTI JOIN sy USING (symbol))
UNION ALL SELECT 'passing global constraints', (SELECT count(*) FROM unscoped WHERE type = 'constraint' AND persistence_mode <> 'persistent')
UNION ALL SELECT 'newer schema', (SELECT count(*) FROM memory_rev WHERE schema_version > 1)
UNION ALL SELECT 'files without text', (SELECT count(DISTINCT file_id) FROM file_text WHERE content IS NULL))
SELECT name, n, CASE WHEN n = 0 THEN 'ok' WHEN name = 'newer schema' THEN 'error' ELSE 'warn' END AS level FROM n""")
def doctor(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)

    def check(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    rows = (
        check("repeated revisions", revisions.conflicts(t.memory_rev))
        .unionByName(check("dangling members", membership.dangling(t.scopes, t.files, t.symbols)))
        .unionByName(check("passing global constraints", passing_global_constraints(spark, base)))
        .unionByName(check("newer schema", t.memory_rev.where("schema_version > 1")))
        .unionByName(check("files without text", t.file_text.where("content is null").select("file_id").distinct()))
    )
    level = F.when(F.col("n") == 0, "ok").when(F.col("name") == "newer schema", "error").otherwise("warn")
    return rows.withColumn("level", level)


# ------------------------------------------------------------------ extraction and streams
def _texts(spark: SparkSession, base: str) -> DataFrame:
    t = Tables(spark, base)
    return extract.with_paths(t.files, t.file_text)


@query(None)
def python_symbols(spark: SparkSession, base: str) -> DataFrame:
    return extract.python_symbols(_texts(spark, base)).select("file_id", "symbol_id", "name", "qualified_name", "kind", "status", "start_line", "end_line")


_LISTED = f"lt AS (SELECT t.file_id, f.path, t.content FROM file_text t JOIN (SELECT file_id, {_npath('min(path)')} path FROM files GROUP BY file_id) f USING (file_id) WHERE t.content IS NOT NULL)"
_DEFINES = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(class|function\*?|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)(.*)$"
_ARROW = r"=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|[\w$]+\s*=>)"


@query(f"""WITH {_LISTED}, l AS (SELECT file_id, unnest(ls) line, generate_subscripts(ls, 1) k FROM (SELECT file_id, string_split_regex(content, '\r\n|\n|\r') ls FROM lt
WHERE regexp_matches(path, '\\.(js|jsx|mjs|cjs|ts|tsx)$'))), d AS (SELECT *, regexp_extract(line, '{_DEFINES}', 1) w FROM l WHERE regexp_matches(line, '{_DEFINES}'))
SELECT file_id, regexp_extract(line, '{_DEFINES}', 2) AS name, CASE WHEN w IN ('class', 'interface', 'type') THEN w WHEN w = 'enum' THEN 'type' WHEN w LIKE 'function%' THEN 'function'
WHEN regexp_matches(regexp_extract(line, '{_DEFINES}', 3), '{_ARROW}') THEN 'function' WHEN w = 'const' THEN 'constant' ELSE 'variable' END AS kind, CAST(k AS INT) AS start_line FROM d""")
def script_symbols(spark: SparkSession, base: str) -> DataFrame:
    return extract.script_symbols(_texts(spark, base)).select("file_id", "name", "kind", "start_line")


_SCRIPT_RX = (
    r"""(?m)^[ \t]*(?:import\s+(?:(?:type\s+)?[\w$*{}\s,]+?\sfrom\s*|(?:type\s*)?\{[^}''"]*\}\s*from\s*)?|export\s+(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^}''"]*\})\s*from\s*)"""
    r"""[''"]([^''"\n]+)[''"]|\brequire\(\s*[''"]([^''"\n]+)[''"]\s*\)"""
)


@query(f"""WITH {_LISTED}, x AS (SELECT file_id, unnest(regexp_extract_all(content, '{_SCRIPT_RX}', 1) || regexp_extract_all(content, '{_SCRIPT_RX}', 2)) module FROM lt
WHERE regexp_matches(path, '\\.(js|jsx|mjs|cjs|ts|tsx)$')) SELECT file_id, module FROM x WHERE module <> ''""")
def import_extract(spark: SparkSession, base: str) -> DataFrame:
    return extract.script_imports(_texts(spark, base)).select("file_id", "module")


@query(None)
def python_import_extract(spark: SparkSession, base: str) -> DataFrame:
    return extract.python_imports(_texts(spark, base)).select("file_id", "module")


@query(None)
def code_references(spark: SparkSession, base: str) -> DataFrame:
    return references.code_references(_texts(spark, base)).select("file_id", "kind", "name", "line")


@query(None)
def class_members(spark: SparkSession, base: str) -> DataFrame:
    return references.class_members(_texts(spark, base)).select("file_id", "qualified_name", "signature", "start_line", "end_line")


@query(None)
def import_resolution(spark: SparkSession, base: str) -> DataFrame:
    texts = _texts(spark, base)
    imports = extract.script_imports(texts).unionByName(extract.python_imports(texts))
    return extract.resolved_imports(imports, Tables(spark, base).files).select("file_id", "module", "target")


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS revision, event_type FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) k FROM events) WHERE k = 1""")
def stream_current_state(spark: SparkSession, base: str) -> DataFrame:
    as_feed = lambda d: d.withColumns({"user_id": F.col("user_id").cast("string"), "op": F.lit("update"), "revision": F.col("event_id")})
    return feeds.streamed_state(spark, f"{base}/events.parquet", "user_id", "revision", "event_id", "op", ["event_type"], as_feed)
