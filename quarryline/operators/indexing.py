"""State of an index against what was scanned last: changes, freshness, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import norm_path


def _digest(c: str) -> Column:
    d = F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")
    return F.when(d != "", d)


def indexed(files: DataFrame) -> DataFrame:
    """(repo, path, hash): files as they stand; of a path that is listed twice the last reading counts."""
    rows = files.select("repo", norm_path("path").alias("path"), F.struct("indexed_at", _digest("content_hash").alias("h")).alias("r"))
    return rows.where("path is not null").groupBy("repo", "path").agg(F.max("r").alias("r")).select("repo", "path", F.col("r.h").alias("hash"))


def last_listing(snap: DataFrame) -> DataFrame:
    """(repo, path, hash): what each repository's last snapshot lists (the greatest snapshot number that it has)."""
    top = snap.groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    rows = snap.join(top, ["repo", "snapshot_no"], "left_semi")
    rows = rows.select("repo", norm_path("path").alias("path"), F.struct("indexed_at", _digest("content_hash").alias("h")).alias("r"))
    return rows.where("path is not null").groupBy("repo", "path").agg(F.max("r").alias("r")).select("repo", "path", F.col("r.h").alias("hash"))


def compared(now: DataFrame, before: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(repo, path, change): added, modified, unchanged or deleted, by content alone.

    Paths that could not be read (``unreadable``: repo, path) don't count as deleted.
    """
    b = before.select("repo", "path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    a = now.select("repo", "path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    both = a.join(b, ["repo", "path"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    out = both.select("repo", "path", change.alias("change"))
    if unreadable is None:
        return out
    blind = unreadable.select("repo", "path").distinct()
    return out.where("change != 'deleted'").unionByName(out.where("change = 'deleted'").join(blind, ["repo", "path"], "left_anti"))


def fingerprint(listing: DataFrame) -> DataFrame:
    """(repo, files, print): a digest of a listing that does not depend on order.

    Digests of (path, hash) are combined by exclusive or, so every task sends one row per repository however many
    files it has; the reference's digest of one sorted text would gather all of them in one place.
    """
    d = F.sha2(F.concat_ws("\0", "path", F.coalesce("hash", F.lit("-"))), 256)
    parts = [F.conv(F.substring(d, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"x{k}") for k in range(4)]
    folded = listing.select("repo", *parts).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(4)])
    return folded.select("repo", "files", F.concat_ws("-", *[F.col(f"x{k}").cast("string") for k in range(4)]).alias("print"))


def freshness(files: DataFrame, snap: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, files, symbols, added, modified, deleted, fresh): one row per repository that has files."""
    now = indexed(files)
    n = compared(now, last_listing(snap)).groupBy("repo").agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "deleted")])
    held = symbols.where("removed_at is null").select("repo", "symbol_id").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"))
    rows = now.groupBy("repo").agg(F.count(F.lit(1)).alias("files")).join(n, "repo", "left").join(held, "repo", "left")
    return rows.select("repo", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), "added", "modified", "deleted", (F.col("added") + F.col("modified") + F.col("deleted") == 0).alias("fresh"))


def running_before(rows: DataFrame, group: str, order: str, amount: str, width: int = 4096) -> DataFrame:
    """Adds ``used``: the sum of the amounts of the group's rows that come before in the order.

    Two levels: sums of ranges of ``width`` order values are added up first, then rows within their range, so a group
    with a third of all rows is spread over as many tasks as it has ranges.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = ranged.groupBy(group, "_range").agg(F.sum(amount).alias("_s"))
    w = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group), "_range", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    joined = within.withColumn("_g", F.col(group)).join(offsets.withColumnRenamed(group, "_g2").withColumnRenamed("_range", "_r2"), F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_range") == F.col("_r2")))
    return joined.withColumn("used", F.col("_before") + F.col("_in")).drop("_range", "_before", "_in", "_g", "_g2", "_r2")
