"""Ranked search over revisions, records that a change touches, and what a session starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import norm_key, norm_path
from quarryline.functions.text import has_phrase, holds, token_estimate
from quarryline.operators import membership, revisions


def search(vers: DataFrame, phrase: str, past: bool = False) -> DataFrame:
    """(rank, rid, kind, revision, status, warning): revisions that hold the phrase, best first by rank and rid.

    Ranks: 1 global MUST, 2 scoped MUST, 3 decision, 4 other constraint, 6 note, 7 stale note, 8 past. ``past`` adds
    superseded revisions and current ones that are not shown. The phrase is looked for before anything is joined.
    """
    top = vers.groupBy("rid").agg(F.max(F.struct("revision", "op")).alias("t")).select("rid", F.col("t.revision").alias("top"), F.col("t.op").alias("last_op"))
    hits = vers.where(has_phrase("content", phrase) & (F.col("op") != "delete"))
    hits = hits.select("rid", "revision", "type", "status", "severity", "scopes").join(top, "rid").where("last_op != 'delete'")
    kept = hits.join(revisions.policy(vers.sparkSession).withColumn("shown", F.lit(True)), ["type", "status"], "left")
    now = (F.col("revision") == F.col("top")) & F.coalesce("shown", F.lit(False))
    is_global = ~F.coalesce(F.exists("scopes", lambda x: F.trim(x) != ""), F.lit(False))
    must = (F.col("type") == "constraint") & (F.coalesce("severity", F.lit("")) == "MUST")
    rank = (
        F.when(~now, 8).when(must & is_global, 1).when(must, 2).when(F.col("type") == "decision", 3)
        .when(F.col("type") == "constraint", 4).when(F.col("status") == "active", 6).otherwise(7)
    )
    warning = F.when(F.col("revision") != F.col("top"), "superseded").when(now, F.col("warning")).otherwise(F.col("status"))
    out = kept.select(rank.alias("rank"), "rid", F.col("type").alias("kind"), "revision", "status", warning.alias("warning"))
    return out if past else out.where("rank < 8")


def best(results: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` results; ties are ordered by kind and revision, so the cut is the same every time."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return results.orderBy("rank", "rid", "kind", "revision").limit(limit)


def bound_constraints(cur: DataFrame, scopes: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(rid, severity, status, scopes, priority): visible constraints that a change of files touches, with all their scopes.

    In order of ``priority`` and rid MUST comes first, and active before review_required before stale.

    ``changed`` is (repo, path). Evidence: a scope that holds the file, the file itself, a symbol in it, or a MUST of
    the repository that is bound to no scope. Without a change in the repository there are none.
    """
    shown = revisions.visible(cur).where("type = 'constraint'")
    by_scope = membership.scope_paths(scopes, symbols).join(changed, ["repo", "path"], "left_semi").select("scope").distinct()
    from_scope = membership.scope_bindings(shown).join(by_scope, "scope", "left_semi").select("rid")
    files = shown.select("rid", "repo", F.explode("files").alias("raw"))

    from_file = files.select("rid", "repo", norm_path("raw").alias("path")).join(changed, ["repo", "path"], "left_semi").select("rid")
    touched = membership.present_symbols(symbols).join(changed, ["repo", "path"], "left_semi").select("symbol").distinct()
    syms = shown.select("rid", F.explode("symbols").alias("raw")).select("rid", norm_key("raw").alias("symbol"))
    from_symbol = syms.join(touched, "symbol", "left_semi").select("rid")
    repos = changed.select("repo").distinct()
    everywhere = revisions.unscoped(shown).where("severity = 'MUST'").join(repos, "repo", "left_semi").select("rid")
    evidence = from_scope.unionByName(from_file).unionByName(from_symbol).unionByName(everywhere).distinct()
    scope_ids = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("scopes", F.array()), lambda x: F.trim(x)), lambda x: x != "")))
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "review_required", 1).otherwise(2)
    priority = F.when(F.coalesce("severity", F.lit("")) == "MUST", 0).otherwise(3) + rank
    return shown.join(evidence, "rid", "left_semi").select("rid", "severity", "status", F.array_join(scope_ids, ",").alias("scopes"), priority.alias("priority"))


def symbol_search(
    symbols: DataFrame, name: str | None = None, qualified_name: str | None = None, kind: str | None = None, path: str | None = None,
    query: str | None = None, limit: int = 50,
) -> DataFrame:
    """(symbol, path, name, qualified_name, kind, start_line): present symbols that fit all that is given, in order of place.

    Names and paths hold the text (A to Z in either case), the kind is equal, the names or signature hold the phrase.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = membership.present_symbols(symbols)
    for column, part in (("name", name), ("qualified_name", qualified_name), ("path", path)):
        rows = rows if part is None else rows.where(holds(column, part))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows if query is None else rows.where(has_phrase("name", query) | has_phrase("qualified_name", query))
    return rows.orderBy("repo", "path", "start_line", "symbol").limit(limit).select("symbol", "path", "name", "qualified_name", "kind", "start_line")


def hard_start(cur: DataFrame) -> DataFrame:
    """(repo, rid, kind, tokens): global persistent MUST constraints and critical global decisions that are shown."""
    shown = revisions.unscoped(revisions.visible(cur))
    must = (F.col("type") == "constraint") & (F.col("severity") == "MUST") & (F.col("persistence_mode") == "persistent")
    critical = (F.col("type") == "decision") & F.coalesce("critical", F.lit(False))
    return shown.where(must | critical).select("repo", "rid", F.col("type").alias("kind"), token_estimate("content").alias("tokens"))


def soft_start(cur: DataFrame, scopes: DataFrame) -> DataFrame:
    """(repo, id, kind, tokens): other global decisions, and the live scopes by their descriptions."""
    shown = revisions.unscoped(revisions.visible(cur)).where("type = 'decision' and not coalesce(critical, false)")
    decisions = shown.select("repo", F.col("rid").alias("id"), F.lit("decision").alias("kind"), token_estimate("content").alias("tokens"))
    described = membership.live(scopes).select("repo", "id", F.lit("scope").alias("kind"), F.coalesce(token_estimate("description"), F.lit(0)).alias("tokens"))
    return decisions.unionByName(described)


def over_budget(items: DataFrame, budget: int) -> DataFrame:
    """(repo, tokens, over): sum of the estimates per repository; nothing is dropped."""
    return items.groupBy("repo").agg(F.sum("tokens").alias("tokens")).withColumn("over", F.col("tokens") > budget)


def scope_for(cur: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scope, rid, severity): visible MUST and SHOULD constraints of each live scope."""
    shown = revisions.visible(cur).where("type = 'constraint' and severity in ('MUST', 'SHOULD')").select("rid", "severity", "scopes")
    ids = membership.live(scopes).select(F.trim("id").alias("scope"))
    return membership.scope_bindings(shown).join(ids, "scope", "left_semi").join(shown.select("rid", "severity"), "rid")


def scope_read(cur: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, files, symbols, decisions, constraints): members and visible records of every live scope, 0 for none."""
    shown = revisions.visible(cur)
    bound = membership.scope_bindings(shown).join(shown.select("rid", "type"), "rid")
    n = bound.groupBy("scope").agg(F.count_if(F.col("type") == "decision").alias("decisions"), F.count_if(F.col("type") == "constraint").alias("constraints"))
    size = lambda c: F.coalesce(F.size(F.filter(F.array_distinct(c), lambda x: x.isNotNull())), F.lit(0))
    rows = membership.live(scopes).select(F.trim("id").alias("scope"), size("members.files").alias("files"), size("members.symbols").alias("symbols"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(n, "scope", "left").select("scope", "files", "symbols", zero("decisions"), zero("constraints"))


def capped(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of every group; Spark keeps no more than that of a group in a task (window group limit)."""

    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
