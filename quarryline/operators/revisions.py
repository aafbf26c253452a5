"""Revision logs: what is current, what may be shown, and how records came about.

The current revision of a record is the one with the greatest number, whatever its status; whether it may be shown is
a later question. Filtering first would let an older revision come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import norm_key

FIELDS = ["repo", "type", "status", "content", "severity", "persistence_mode", "critical", "scopes", "files", "symbols", "created_at", "expires_at"]
# The statuses in which a current record is shown, and the warning that goes with them.
POLICY = [
    ("constraint", "active", None), ("constraint", "review_required", "review_required"), ("constraint", "stale", "stale"),
    ("decision", "active", None), ("decision", "review_required", "review_required"),
    ("note", "active", None), ("note", "stale", "stale"),
]


def versions(memory: DataFrame) -> DataFrame:
    """One row per (rid, revision): its last delivery. Deliveries are reduced map side; null keys are left out."""
    rows = memory.select(norm_key("record_id").alias("rid"), "revision", F.struct("feed_seq", "op", *FIELDS).alias("v"))
    rows = rows.where("rid is not null and revision is not null").groupBy("rid", "revision").agg(F.max("v").alias("v"))
    return rows.select("rid", "revision", "v.feed_seq", F.lower(F.trim("v.op")).alias("op"), *[f"v.{f}" for f in FIELDS])


def current(vers: DataFrame) -> DataFrame:
    """The greatest revision of each record, if it isn't a delete."""
    last = vers.groupBy("rid").agg(F.max_by(F.struct(*[c for c in vers.columns if c != "rid"]), "revision").alias("v"))
    return last.select("rid", "v.*").where("op != 'delete'")


def policy(spark: SparkSession) -> DataFrame:
    """The table of what may be shown (a few fixed rows, so it is broadcast)."""
    return F.broadcast(spark.createDataFrame(POLICY, "type string, status string, warning string"))


def visible(cur: DataFrame) -> DataFrame:
    """Current records that may be shown, with their warning."""
    return cur.join(policy(cur.sparkSession), ["type", "status"])


def history(vers: DataFrame) -> DataFrame:
    """(rid, statuses): the statuses of a record in the order of its revisions, a dash where there is none."""
    pairs = F.array_sort(F.collect_list(F.struct("revision", F.coalesce("status", F.lit("-")).alias("s"))))
    return vers.groupBy("rid").agg(F.array_join(F.transform(pairs, lambda x: x.s), ">").alias("statuses"))


def conflicts(memory: DataFrame) -> DataFrame:
    """(rid, revision, deliveries): revisions that were delivered more than once under different numbers."""
    keyed = memory.select(norm_key("record_id").alias("rid"), "revision", "feed_seq").where("rid is not null").distinct()
    return keyed.groupBy("rid", "revision").agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


def unscoped(rows: DataFrame) -> DataFrame:
    """Records that no scope is named for; files and symbols don't matter."""
    named = F.exists(F.coalesce("scopes", F.array()), lambda x: F.trim(x) != "")
    return rows.where(~F.coalesce(named, F.lit(False)))
