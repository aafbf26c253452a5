"""Rebuilding a table from a feed of inserts, updates and deletes.

Every delivery is a patch: a function from the state of one record to its next state. An insert or a delete makes the
record anew, an update sets some of its fields. A patch is written down as the place (revision, delivery number) of the
last delivery, the place from which on the record is new, and for each field the place and value it was last set to.
Two patches compose to the greater of each part, so any stretch of deliveries, in any order and repeated, has one patch.
The composition is associative: patches are reduced map side, per range chunk of the feed (which splits hot records
too), per record, and last onto the base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import norm_key

#: Width of a range chunk of delivery numbers.
CHUNK = 1 << 16


def patches(feed: DataFrame, key: str, revision: str, seq: str, op: str, fields: list[str], partial: bool = False) -> DataFrame:
    """Feed rows as (``_key``, ``_seq``, ``_patch``).

    Keys are trimmed and in lower case. Rows without a key or a revision can't be ordered and are left out; a null
    delivery number counts as earlier than all others; an op other than ``delete`` (also null) sets the record. A
    delivery carries the whole record, with null fields as they are; if ``partial``, only inserts do, and the null
    fields of others are left as they were.
    """
    does = F.lower(F.trim(F.coalesce(F.col(op), F.lit(""))))
    place = [F.col(revision).alias("revision"), F.col(seq).alias("seq")]
    whole = does.isin("insert", "delete") if partial else F.lit(True)
    sets = [F.when(whole | F.col(f).isNotNull(), F.struct(*place, F.col(f).alias("value"))).alias(f"f{i}") for i, f in enumerate(fields)]
    patch = F.struct(F.struct(*place, (does == "delete").alias("gone")).alias("last"), F.when(whole, F.struct(*place)).alias("anew"), *sets)
    rows = feed.select(norm_key(key).alias("_key"), F.col(seq).alias("_seq"), patch.alias("_patch"))
    return rows.where(F.col("_key").isNotNull() & F.col("_patch.last.revision").isNotNull())


def composed(p: DataFrame, *by: object) -> DataFrame:
    """One patch for each group of patches."""
    parts = p.schema["_patch"].dataType.names
    got = p.groupBy(*by).agg(*[F.max(f"_patch.{x}").alias(x) for x in parts])
    return got.select(*[c for c in got.columns if c not in parts], F.struct(*parts).alias("_patch"))


def compose(p: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """Tree reduction of patches: one per (record, range chunk), then one per record.

    ``chunk_rows`` is the width of a range of delivery numbers: a record with a third of all deliveries is reduced in
    as many tasks as the feed has ranges, and each range sends one patch on.
    """
    chunk = F.floor(F.coalesce(F.col("_seq"), F.lit(0)) / F.lit(chunk_rows))
    return composed(composed(p, "_key", chunk.alias("_chunk")), "_key")


def applied(p: DataFrame, key: str, revision: str, fields: list[str]) -> DataFrame:
    """The records that one patch each makes of nothing: (key, revision, *fields); deleted ones fall away.

    A field that was last set before the record was made anew is null.
    """
    anew = F.col("_patch.anew")
    value = lambda i: F.when(anew.isNull() | (F.struct(f"_patch.f{i}.revision", f"_patch.f{i}.seq") >= anew), F.col(f"_patch.f{i}.value"))
    state = p.where(~F.col("_patch.last.gone"))
    return state.select(F.col("_key").alias(key), F.col("_patch.last.revision").alias(revision), *[value(i).alias(f) for i, f in enumerate(fields)])


def apply_feed(
    feed: DataFrame,
    key: str = "record_id",
    revision: str = "revision",
    seq: str = "feed_seq",
    op: str = "op",
    fields: tuple[str, ...] = ("status",),
    base: DataFrame | None = None,
    chunk_rows: int = CHUNK,
    partial: bool = False,
) -> DataFrame:
    """Present state after the feed: (key, revision, *fields), one row per record that is not deleted.

    ``base`` (same columns) holds an older state; where base and feed have the same revision the feed counts. An empty
    feed gives the base; repeated and disordered deliveries don't change the result. Other columns of the feed,
    whatever their names, are not read. ``partial``: updates set only the fields that they carry.
    """
    every = patches(feed, key, revision, seq, op, list(fields), partial)
    if base is not None:
        older = base.select(key, revision, *fields).withColumns({"__seq": F.lit(None).cast("long"), "__op": F.lit("insert")})
        every = every.unionByName(patches(older, key, revision, "__seq", "__op", list(fields)))
    return applied(compose(every, chunk_rows), key, revision, list(fields))
