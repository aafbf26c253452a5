"""The code graph: components, groups by folder, resolution of names and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import materialize, norm_path
from quarryline.functions.text import scope_id, title_name


def file_links(edges: DataFrame, types: tuple[str, ...] = ("imports", "calls", "extends", "implements"), without: DataFrame | None = None) -> DataFrame:
    """(repo, a, b): pairs of files with an edge between them, each once, a < b; files linked to themselves fall away.

    Links of files in ``without`` (repo, path), as those of locked scopes, are left out.
    """
    e = edges.where(F.col("edge_type").isin(*types)).select("repo", norm_path("source_file").alias("s"), norm_path("target_file").alias("t"))
    e = e.where("s is not null and t is not null and s != t")
    pairs = e.select("repo", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    if without is not None:
        for end in ("a", "b"):
            pairs = pairs.join(without.select("repo", F.col("path").alias(end)), ["repo", end], "left_anti")
    return pairs


def components(links: DataFrame) -> DataFrame:
    """(repo, node, component): the least node of every node's connected component.

    Alternates large-star and small-star rounds (links are only ever replaced, so their number does not grow) until
    nothing changes; links only ever move to lesser nodes, so that ends. Hubs are reduced map side to their least
    neighbour, their joins are left to Spark's splitting of skewed partitions; rounds are written to the shared folder.
    """
    links = materialize(links, "links")
    before, changed, k = None, True, 0
    while changed:
        both = links.unionByName(links.select("repo", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("repo", "a").agg(F.min("b").alias("m")).select("repo", "a", F.least("a", "m").alias("m"))
        large = both.join(low, ["repo", "a"]).where("b > a").select("repo", F.col("m").alias("a"), "b").where("a != b").distinct()
        down = large.select("repo", F.greatest("a", "b").alias("n"), F.least("a", "b").alias("v"))
        least = down.groupBy("repo", "n").agg(F.min("v").alias("m"))
        small = down.join(least, ["repo", "n"]).select("repo", F.col("m").alias("a"), F.explode(F.array("v", "n")).alias("b")).where("a != b").distinct()
        links = materialize(small, f"links{k}")
        # distinct links: the same number with the same digests is the same set
        digest = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("repo", "a", "b")), F.sum(F.xxhash64("b", "a", "repo") % 1_000_003)).first()
        before, changed, k = digest, digest != before, k + 1
    star = links.select("repo", F.col("b").alias("node"), F.col("a").alias("component"))
    return star.unionByName(links.select("repo", F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def folder_groups(files: DataFrame, least: int = 2) -> DataFrame:
    """(repo, folder, files): top folders with at least ``least`` files below them."""
    rows = files.select("repo", norm_path("path").alias("path")).where("path like '%/%'").distinct()
    return rows.groupBy("repo", F.split("path", "/")[0].alias("folder")).agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= least)


def component_suggestions(comps: DataFrame) -> DataFrame:
    """(repo, component, files, id, name): a name for every component of two files and more, after the folder that holds them all.

    The first and last path of a component share what all share. Identifiers that come twice are numbered.
    """
    span = comps.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("files"), F.min("node").alias("low"), F.max("node").alias("high")).where("files >= 2")
    low, high = F.split("low", "/"), F.split("high", "/")
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.size(low) - 1, F.lit(1))), lambda k: F.slice(low, F.lit(1), k) == F.slice(high, F.lit(1), k))
    depth = F.when(F.size(low) > 1, F.size(F.filter(same, lambda x: x))).otherwise(0)
    parent = F.array_join(F.slice(low, F.lit(1), depth), "/")
    named = span.withColumn("label", F.when(parent != "", parent).otherwise(F.concat(F.lit("connected-"), "low")))
    base = F.when(scope_id("label") != "", scope_id("label")).otherwise("connected-component")
    n = F.row_number().over(Window.partitionBy("repo", "base").orderBy("low"))
    rows = named.withColumn("base", base).withColumn("n", n)
    ident = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n"))
    return rows.select("repo", "component", "files", ident.alias("id"), title_name(F.translate("label", "-_", "  ")).alias("name"))


def suggestions(groups: DataFrame) -> DataFrame:
    """(repo, folder, id, name): an identifier and a name for every group; groups with one identifier are numbered."""
    base = groups.select("repo", "folder", scope_id("folder").alias("base"), title_name("folder").alias("name"))
    n = F.row_number().over(Window.partitionBy("repo", "base").orderBy("folder"))
    return base.withColumn("n", n).select("repo", "folder", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("id"), "name")


def enclosing(points: DataFrame, intervals: DataFrame, width: int = 64) -> DataFrame:
    """The innermost interval around every point: (point id, symbol).

    ``points``: (pid, repo, path, line), ``intervals``: (symbol, repo, path, start_line, end_line). Intervals are cut
    into ranges of ``width`` lines, so a point only meets the intervals of its own range of its own file; of those
    around it the shortest counts, then the least identifier. Points within none have a null symbol.
    """
    cut = intervals.where("end_line >= start_line").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    near = points.withColumn("_b", F.floor(F.col("line") / width)).join(cut, ["repo", "path", "_b"])
    inside = near.where("line between start_line and end_line and symbol != pid")
    best = inside.groupBy("pid").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "symbol")).alias("m"))
    return points.select("pid").join(best.select("pid", F.col("m.symbol").alias("symbol")), "pid", "left")


def resolved_names(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, symbol, confidence): the symbol that a name refers to.

    ``refs``: (ref, repo, path, name); ``symbols``: (symbol, repo, path, name, start_line); ``imports``: (repo, path,
    target). A symbol of the same file counts first (0.8), then one of an imported file in path order (0.6), in source
    order within the file; a name without either stays unresolved (0.3).
    """
    named = symbols.select("repo", F.col("path").alias("at"), "name", F.struct("start_line", "symbol").alias("s"))
    firsts = named.groupBy("repo", "at", "name").agg(F.min("s").alias("s"))
    own = refs.withColumn("at", F.col("path")).join(firsts, ["repo", "at", "name"]).select("ref", F.struct(F.lit(1).alias("tier"), "at", "s").alias("c"))
    far = refs.join(imports, ["repo", "path"]).withColumnRenamed("target", "at").join(firsts, ["repo", "at", "name"])
    found = own.unionByName(far.select("ref", F.struct(F.lit(2).alias("tier"), "at", "s").alias("c"))).groupBy("ref").agg(F.min("c").alias("c"))
    rows = refs.select("ref").distinct().join(found, "ref", "left")
    confidence = F.when(F.col("c.tier") == 1, F.lit(0.8)).when(F.col("c.tier") == 2, F.lit(0.6)).otherwise(F.lit(0.3))
    return rows.select("ref", F.col("c.s.symbol").alias("symbol"), confidence.alias("confidence"))


def incoming(edges: DataFrame) -> DataFrame:
    """(repo, symbol, edges, files): how many edges, and how many files, refer to each symbol."""
    e = edges.select("repo", F.lower(F.trim("target_symbol")).alias("symbol"), norm_path("source_file").alias("s"), "edge_id").where("symbol != ''")
    one = e.groupBy("repo", "symbol", "s").agg(F.count_distinct("edge_id").alias("n"))
    return one.groupBy("repo", "symbol").agg(F.sum("n").alias("edges"), F.count("s").alias("files"))
