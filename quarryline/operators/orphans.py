"""References to records that are missing, deleted or arrive later, and what hangs on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import cut, hot_keys, lookup_join, materialize, new_folder, norm_key, norm_path, write

FOUND = ["src", "src_key", "field", "ref", "reason", "period"]


def lifetimes(rows: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """(ref, lives): the distinct lifetimes of each key as an array of structs (s, e).

    Repeated rows fall away map side, before any key is gathered; a key keeps as many entries as it has lifetimes.
    """
    lives = rows.select(key.alias("ref"), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("life"))
    return lives.where("ref is not null").distinct().groupBy("ref").agg(F.collect_set("life").alias("lives"))


def judged(lives: Column, t: Column) -> Column:
    """Reason for a reference made at ``t``: missing, deleted, late, or null (no orphan).

    An unknown start counts as always, an unknown end as never. Without a time only ``missing`` can be told.
    """
    covers = F.exists(lives, lambda x: (x.s.isNull() | (x.s <= t)) & (x.e.isNull() | (t < x.e)))
    ended = F.exists(lives, lambda x: x.e <= t)
    return (
        F.when(lives.isNull(), "missing").when(t.isNull() | covers, None).when(ended, "deleted").otherwise("late")
    )


def memory_versions(memory: DataFrame) -> DataFrame:
    """One row per (record, revision): the delivery with the highest feed number."""
    cols = ["feed_seq", "repo", "created_at", "scopes", "files", "symbols"]
    return (
        memory.select(norm_key("record_id").alias("rid"), "revision", F.struct(*cols).alias("v"))
        .where("rid is not null and revision is not null")
        .groupBy("rid", "revision").agg(F.max("v").alias("v"))
        .select(
            F.concat_ws("#", "rid", F.col("revision").cast("string")).alias("src_key"), "v.repo", "v.scopes", "v.files",
            "v.symbols", F.expr("try_to_timestamp(v.created_at)").alias("t"),
        )
    )


REFS = ["src", "src_key", "field", "ref", "t", "repo", "parent"]


def references(edges: DataFrame, memory: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """All references as REFS: ``parent`` is the table that ``ref`` is a key of. Blank ones are none.

    Edges refer to two symbols, memory records (each revision) to scopes, symbols and files, scopes to their members and
    symbols to their file. Removed scopes and symbols are no records any more.
    """

    def made(rows: DataFrame, src: str, field: str, parent: str, ref: Column) -> DataFrame:
        lits = [F.lit(x).alias(n) for n, x in (("src", src), ("field", field), ("parent", parent))]
        return rows.select(*lits, "src_key", ref.alias("ref"), "t", "repo").select(*REFS).where("src_key is not null and ref is not null")

    def exploded(rows: DataFrame, src: str, column: str, field: str, parent: str, ref: Column) -> DataFrame:
        return made(rows.select("src_key", "repo", "t", F.explode(column).alias("raw")), src, field, parent, ref)

    mem = memory_versions(memory)
    edge = edges.select(F.col("edge_id").cast("string").alias("src_key"), "repo", F.col("indexed_at").cast("timestamp").alias("t"), "source_symbol", "target_symbol")
    scope = scopes.where("removed_at is null").select(cut("id").alias("src_key"), "repo", F.col("created_at").cast("timestamp").alias("t"), "members")
    symbol = symbols.where("removed_at is null").select(norm_key("symbol_id").alias("src_key"), "repo", F.col("first_seen_at").cast("timestamp").alias("t"), "file")
    named = F.when(cut("raw") != "", cut("raw"))
    return reduce(DataFrame.unionByName, [
        made(edge, "edges", "target_symbol", "symbols", norm_key("target_symbol")), made(edge, "edges", "source_symbol", "symbols", norm_key("source_symbol")),
        exploded(mem, "memory_rev", "symbols", "symbols", "symbols", norm_key("raw")), exploded(mem, "memory_rev", "scopes", "scopes", "scopes", named),
        exploded(mem, "memory_rev", "files", "files", "files", norm_path("raw")), exploded(scope, "scopes", "members.symbols", "members.symbols", "symbols", norm_key("raw")),
        exploded(scope, "scopes", "members.files", "members.files", "files", norm_path("raw")), made(symbol, "symbols", "file", "files", norm_path("file")),
    ])


def judged_references(refs: DataFrame, symbols: DataFrame, scopes: DataFrame, files: DataFrame, files_snap: DataFrame) -> DataFrame:
    """REFS with ``reason``: missing, deleted, late, or null where the record is there.

    Symbols and scopes are judged at the time of the reference, files against ``files`` as it stands. References to hot
    targets are never shuffled (``lookup_join``).
    """
    scope_key = cut("id")
    known = lifetimes(symbols, norm_key("symbol_id"), "first_seen_at", "removed_at").withColumn("parent", F.lit("symbols"))
    known = known.unionByName(lifetimes(scopes, F.when(scope_key != "", scope_key), "created_at", "removed_at").withColumn("parent", F.lit("scopes")))
    timed = lookup_join(refs.where("parent != 'files'"), known, ["parent", "ref"]).withColumn("reason", judged(F.col("lives"), F.col("t"))).drop("lives")
    # one row per path: whether it is listed now, or was in any listing
    path = lambda rows, now: rows.select("repo", norm_path("path").alias("ref"), F.lit(now).alias("now")).where("ref is not null and repo is not null")
    seen = path(files, True).unionByName(path(files_snap, False)).groupBy("repo", "ref").agg(F.max("now").alias("now"))
    state = F.when(F.col("now"), None).when(F.col("now").isNull(), "missing").otherwise("deleted")
    filed = lookup_join(refs.where("parent = 'files'"), seen, ["repo", "ref"]).withColumn("reason", state).drop("now")
    return timed.unionByName(filed)


def cascade(refs: DataFrame, leaves: tuple[str, ...] = ()) -> DataFrame:
    """Orphan references as (src, src_key, field, ref, t, reason, depth); depth 0 is direct, others are inherited.

    ``refs`` holds all references (REFS and reason). A record with an orphan reference is an orphan itself, so what
    refers to it is one level deeper. Each round semi-joins the sound references with the last round's new records and
    ends when there are none, however deep the tables hang together; cycles end too. Rounds are written to the shared
    folder, and read back as one table, so that no plan grows. Of hot records only the key is sent, their references
    are never shuffled. Null keys refer to nothing; a reference that is there several times is one.
    """
    refs = materialize(refs.where("src_key is not null and ref is not null"), "judged")
    shown = ["src", "src_key", "field", "ref", "t", "reason"]
    spark = refs.sparkSession
    home = new_folder(spark)
    sound = refs.where("reason is null")
    hot = materialize(hot_keys(sound, ["parent", "ref"]), "hot")
    found = refs.where("reason is not null")
    records = found.select(F.col("src").alias("parent"), F.col("src_key").alias("ref")).where(~F.col("parent").isin(list(leaves))).distinct()
    write(records, f"{home}/records/depth=0")
    depth = 0
    levels = spark.read.schema("parent string, ref string, depth int").option("basePath", f"{home}/records")
    last = levels.parquet(f"{home}/records/depth=0").drop("depth")
    inherited = f"{home}/inherited"
    schema = "src string, src_key string, field string, ref string, t timestamp, reason string"
    while not last.isEmpty():
        depth += 1
        write(lookup_join(sound, last, ["parent", "ref"], "left_semi", hot=hot).select(*shown), f"{inherited}/depth={depth}")
        below = spark.read.schema(schema).parquet(f"{inherited}/depth={depth}")
        new = below.select(F.col("src").alias("parent"), F.col("src_key").alias("ref")).where(~F.col("parent").isin(list(leaves))).distinct()
        known = levels.parquet(f"{home}/records").select("parent", "ref")
        write(new.join(known, ["parent", "ref"], "left_anti"), f"{home}/records/depth={depth}")
        last = levels.parquet(f"{home}/records/depth={depth}").drop("depth")
    direct = found.select(*shown, F.lit(0).alias("depth"))
    found = direct if not depth else direct.unionByName(spark.read.schema(f"{schema}, depth int").parquet(inherited))
    return found.distinct()


def orphan_references(
    edges: DataFrame, memory: DataFrame, symbols: DataFrame, scopes: DataFrame, files: DataFrame, files_snap: DataFrame
) -> DataFrame:
    """FOUND and ``depth`` of all orphan references of all tables: direct ones (0), and those that hang on an orphan.

    Rows with null keys, empty lists and empty tables give no cases (an empty target table makes all its references
    missing). Inherited ones have no reason of their own.
    """
    # read by all joins below
    refs = materialize(references(edges, memory, symbols, scopes), "references")
    cases = cascade(judged_references(refs, symbols, scopes, files, files_snap), ("edges", "memory_rev"))
    return cases.withColumn("period", F.date_format("t", "yyyy-MM")).select(*FOUND, "depth").distinct()


def direct_orphans(cases: DataFrame) -> DataFrame:
    """The direct orphans of the reported references: what edges point to, and what memory records name."""
    return cases.where("depth = 0 and (src = 'memory_rev' or field = 'target_symbol')").select(*FOUND)


def by_table_and_period(cases: DataFrame) -> DataFrame:
    """Number of orphan references per table, field, reason and month."""
    return cases.groupBy("src", "field", "reason", "period").agg(F.count(F.lit(1)).alias("n"))


def direct_and_inherited(cases: DataFrame) -> DataFrame:
    """Per table, field and month: direct and inherited orphan references, and the longest way down from a direct one."""
    n = [F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("inherited"), F.max("depth").alias("deepest")]
    return cases.groupBy("src", "field", "period").agg(*n)
