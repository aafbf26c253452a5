"""Scopes and what belongs to them: files, directly or by their symbols, and the records bound to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import cut, norm_key, norm_path


def live(scopes: DataFrame) -> DataFrame:
    """Scopes that were not removed."""
    return scopes.where("removed_at is null")


def member_files(scopes: DataFrame) -> DataFrame:
    """(scope, repo, path): the files that scopes name."""
    rows = live(scopes).select(cut("id").alias("scope"), "repo", "locked", F.explode("members.files").alias("m"))
    return rows.select("scope", "repo", "locked", norm_path("m").alias("path")).where("path is not null").distinct()


def member_symbols(scopes: DataFrame) -> DataFrame:
    """(scope, repo, symbol): the symbols that scopes name."""
    rows = live(scopes).select(cut("id").alias("scope"), "repo", "locked", F.explode("members.symbols").alias("m"))
    return rows.select("scope", "repo", "locked", norm_key("m").alias("symbol")).where("symbol is not null").distinct()


def present_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol, repo, path, name, kind, start_line, end_line) of the symbols that are still there."""
    rows = symbols.where("removed_at is null")
    return rows.select(
        norm_key("symbol_id").alias("symbol"), "repo", norm_path("file").alias("path"), "name", "qualified_name", "kind", "start_line", "end_line"
    ).distinct()


def scope_paths(scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scope, repo, path): files of a scope, named themselves or holding a symbol that is."""
    owner = present_symbols(symbols).select("symbol", "path")
    by_symbol = member_symbols(scopes).join(owner, "symbol").select("scope", "repo", "path")
    return member_files(scopes).select("scope", "repo", "path").unionByName(by_symbol).distinct()


def dangling(scopes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scope, kind, member): members that no listing has."""
    listed = files.select("repo", norm_path("path").alias("path")).distinct()
    f = member_files(scopes).join(listed, ["repo", "path"], "left_anti").select("scope", F.lit("file").alias("kind"), F.col("path").alias("member"))
    s = member_symbols(scopes).join(present_symbols(symbols).select("symbol").distinct(), "symbol", "left_anti")
    return f.unionByName(s.select("scope", F.lit("symbol").alias("kind"), F.col("symbol").alias("member")))


def membership_hash(scopes: DataFrame) -> DataFrame:
    """(scope, digest): changes with any member, not with their order; the arrays lie in one row, nothing is gathered."""
    # A mark, a zero and a line end around each member, files before symbols.
    lines = lambda c, mark: F.array_join(F.transform(F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))), lambda x: F.concat(F.lit(f"{mark}\0"), x, F.lit("\n"))), "")
    text = F.concat(F.coalesce(lines("members.files", "f"), F.lit("")), F.coalesce(lines("members.symbols", "s"), F.lit("")))
    return live(scopes).select(cut("id").alias("scope"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("digest"))


def edited(files: Column | str, add: Column | str, remove: Column | str) -> Column:
    """Members after an edit: sorted, each once."""
    return F.array_sort(F.array_except(F.array_union(files, add), remove))


def scope_bindings(rows: DataFrame) -> DataFrame:
    """(rid, scope) of records."""
    e = rows.select("rid", F.explode("scopes").alias("raw")).select("rid", cut("raw").alias("scope"))
    return e.where("scope is not null and scope != ''").distinct()
