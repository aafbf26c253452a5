"""What follows from a change: assignment of files to scopes, and records whose ground has moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import norm_path
from quarryline.operators import membership


def import_evidence(edges: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, scopes, scope): files that surely import members of unlocked scopes, with the number of those scopes and the least."""
    unlocked = membership.live(scopes).where("not coalesce(locked, false)")
    held = membership.scope_paths(unlocked, symbols).select("repo", F.col("path").alias("t"), "scope")
    e = edges.where("edge_type = 'imports' and confidence = 1.0").select("repo", norm_path("source_file").alias("path"), norm_path("target_file").alias("t"))
    pairs = e.where("path is not null and t is not null").distinct().join(held, ["repo", "t"]).select("repo", "path", "scope").distinct()
    return pairs.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("scopes"), F.min("scope").alias("scope"))


def assignments(files: DataFrame, edges: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, verdict, scope): what to do with each file that is in no scope.

    ``auto`` where its imports point to exactly one unlocked scope, else ``none`` or ``ambiguous``. All files are
    judged against the members as they are, so the order of files does not matter.
    """
    listed = files.select("repo", norm_path("path").alias("path")).where("path is not null").distinct()
    free = listed.join(membership.scope_paths(scopes, symbols).select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    rows = free.join(import_evidence(edges, scopes, symbols), ["repo", "path"], "left")
    verdict = F.when(F.col("scopes").isNull(), "none").when(F.col("scopes") == 1, "auto").otherwise("ambiguous")
    return rows.select("repo", "path", verdict.alias("verdict"), F.when(F.col("scopes") == 1, F.col("scope")).alias("scope"))


def assignment_counts(rows: DataFrame, threshold: int = 20) -> DataFrame:
    """Per repository: files by verdict, and whether so many would be assigned that the change looks wrong."""
    n = [F.count_if(F.col("verdict") == v).alias(v) for v in ("auto", "none", "ambiguous")]
    return rows.groupBy("repo").agg(*n).withColumn("suspicious", F.col("auto") > threshold)


def coverage(scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, symbols, covered): present symbols, and those that a live scope names itself or through their file."""
    here = membership.present_symbols(symbols).select("repo", "symbol", "path").distinct()
    by_file = membership.member_files(scopes).select("repo", "path").distinct().withColumn("f", F.lit(1))
    by_name = membership.member_symbols(scopes).select("symbol").distinct().withColumn("s", F.lit(1))
    rows = here.join(by_file, ["repo", "path"], "left").join(by_name, "symbol", "left")
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.coalesce("f", "s").isNotNull()).alias("covered"))


def moved_ground(cur: DataFrame, scopes: DataFrame, files: DataFrame, symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """(rid, revision, status): the next revision of records whose scopes, files or symbols changed under them.

    A missing scope makes a record ``orphaned``, a missing file or symbol ``review_required``; a constraint bound to
    its source becomes ``stale`` when one of its files was modified. Records already settled are left alone, so the
    operator gives nothing new when it is run on its own result. ``changes``: (repo, path, change).
    """
    open_ = cur.where("coalesce(status, '') not in ('orphaned', 'review_required', 'inactive')").where("coalesce(persistence_mode, '') != 'persistent'")
    live_ids = membership.live(scopes).select(F.trim("id").alias("scope")).distinct()
    no_scope = membership.scope_bindings(open_).join(live_ids, "scope", "left_anti").select("rid", F.lit(1).alias("rule"))
    named = open_.select("rid", "repo", F.explode("files").alias("raw")).select("rid", "repo", norm_path("raw").alias("path")).where("path is not null")
    listed = files.select("repo", norm_path("path").alias("path")).distinct()
    no_file = named.join(listed, ["repo", "path"], "left_anti").select("rid", F.lit(2).alias("rule"))
    syms = open_.select("rid", F.explode("symbols").alias("raw")).select("rid", F.lower(F.trim("raw")).alias("symbol")).where("symbol != ''")
    no_symbol = syms.join(membership.present_symbols(symbols).select("symbol").distinct(), "symbol", "left_anti").select("rid", F.lit(2).alias("rule"))
    bound = open_.where("type = 'constraint' and persistence_mode = 'source_bound' and coalesce(status, '') != 'stale'").select("rid")
    changed = changes.where("change = 'modified'").select("repo", "path")
    modified = named.join(changed, ["repo", "path"], "left_semi").join(bound, "rid", "left_semi").select("rid", F.lit(3).alias("rule"))
    first = no_scope.unionByName(no_file).unionByName(no_symbol).unionByName(modified).groupBy("rid").agg(F.min("rule").alias("rule"))
    status = F.when(F.col("rule") == 1, "orphaned").when(F.col("rule") == 2, "review_required").otherwise("stale")
    return open_.join(first, "rid").select("rid", (F.col("revision") + 1).alias("revision"), status.alias("status"))
