"""What changed between full snapshots, found by subtracting invertible Bloom lookup tables.

Rows are shuffled once, to the hash bucket of their path: all else happens where a bucket lies. There its readings are
reduced to one state per scan and path, the (path hash, content hash) pairs of each scan are summed up in a table of
cells (count and xors), the tables of consecutive scans are subtracted cell by cell, so that equal rows cancel, and the
pairs that differ are peeled out of what remains and named. Buckets that don't peel get larger tables, and those that
fail even then are compared row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import materialize, norm_path, sized

#: Pairs per bucket that are aimed at, and cells of each of a table's three parts, by attempt.
BUCKET_ROWS, PARTS = 128, (64, 512)
_MASK = (1 << 64) - 1


def scan_order(scans: DataFrame) -> DataFrame:
    """The scan that counts for each (repo, root, snapshot_no), numbered by snapshot within its unit.

    The latest delivery counts (of equal ones the higher scan_id); a null root is the whole repository. Scans without
    repo or snapshot number are left out.
    """
    s = scans.select("scan_id", "snapshot_no", "repo", F.coalesce("root", F.lit("")).alias("root"), "delivered_at", "unreadable_paths")
    s = s.where("repo is not null and snapshot_no is not null")
    unit = Window.partitionBy("repo", "root")
    won = s.groupBy("repo", "root", "snapshot_no").agg(F.max(F.struct("delivered_at", "scan_id", "unreadable_paths")).alias("w"))
    return won.select(
        "repo", "root", "snapshot_no", "w.scan_id", "w.unreadable_paths",
        F.xxhash64("repo", "root").alias("unit"), F.row_number().over(unit.orderBy("snapshot_no")).alias("idx"),
    )


def numbered(snap: DataFrame, order: DataFrame) -> DataFrame:
    """(scan_id, unit, idx, buckets, last_idx): a unit has a bucket for so many rows of its largest scan."""
    per_scan = snap.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = order.join(per_scan, "scan_id", "left").groupBy("unit")
    units = sizes.agg(F.ceil(F.coalesce(F.max("n"), F.lit(1)) / BUCKET_ROWS).alias("buckets"), F.max("idx").alias("last_idx"))
    return order.select("scan_id", "unit", "idx").join(units, "unit").select("scan_id", "unit", "idx", "buckets", "last_idx")


def bucketed(snap: DataFrame, order: DataFrame, places: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Readings as (unit, bucket, idx, path, t, h), each bucket in one place; ``failed`` (unit, bucket) leaves only some.

    A path that the scan could not read is a reading without hash, later than all others.
    """
    digest = F.regexp_replace(F.lower(F.trim("content_hash")), "^sha256:", "")
    at = F.unix_micros(F.expr("try_to_timestamp(indexed_at)"))
    listed = snap.select("scan_id", norm_path("path").alias("path"), at.alias("t"), F.when(digest != "", F.xxhash64(digest)).alias("h"))
    listed = listed.join(sized(places), "scan_id").select("unit", "buckets", "idx", "path", "t", "h")
    blind = order.select("scan_id", F.explode("unreadable_paths").alias("raw")).join(places, "scan_id").withColumn("path", norm_path("raw"))
    blind = blind.select("unit", "buckets", "idx", "path", F.lit((1 << 63) - 1).alias("t"), F.lit(None).cast("long").alias("h"))
    rows = listed.unionByName(blind).where("path is not null")
    rows = rows.select("unit", F.pmod(F.xxhash64("path"), F.col("buckets")).alias("bucket"), "idx", "path", "t", "h")
    if failed is not None:
        rows = rows.join(sized(failed), ["unit", "bucket"], "left_semi")
    return rows.repartition("unit", "bucket")


def scanned_states(rows: DataFrame) -> DataFrame:
    """The state after each scan: (unit, bucket, idx, path, h) with 64-bit hashes of the content. Shuffles nothing.

    Of a path's rows the latest reading counts (of equal times the one with the greater hash). Where that has no hash,
    the path keeps the state of the scan before, through any number of such scans.
    """
    seen = rows.groupBy("unit", "bucket", "idx", "path").agg(F.max(F.struct("t", "h")).alias("r"))
    key = ["unit", "bucket", "path"]
    runs = seen.select(*key, "idx", "r.h", (F.col("idx") - F.row_number().over(Window.partitionBy(*key).orderBy("idx"))).alias("run"))
    kept = F.last("h", ignorenulls=True).over(Window.partitionBy(*key, "run").orderBy("idx"))
    return runs.select(*key, "idx", kept.alias("h")).where("h is not null")


def subtracted(states: DataFrame, places: DataFrame, part: int) -> DataFrame:
    """(unit, bucket, cells): the cells that are not zero of all pairs of scans, and as pair 0 the paths. Shuffles nothing.

    A state is on the later side of its own scan's pair and on the earlier side of the next.
    """
    last = places.select("unit", "last_idx").distinct()
    c = F.xxhash64("p", "h")
    spots = [F.lit(j * part) + F.pmod(F.shiftrightunsigned("c", 21 * j).bitwiseAND(F.lit((1 << 21) - 1)), F.lit(part)) for j in range(3)]
    none = F.lit(None).cast("string")
    entries = [F.struct((F.col("idx") + later).alias("pair"), F.lit(1 - 2 * later).alias("n"), spot.cast("int").alias("cell"), none.alias("path")) for later in (0, 1) for spot in spots]
    entries.append(F.struct(F.lit(0).alias("pair"), F.lit(1).alias("n"), F.lit(0).alias("cell"), F.col("path").alias("path")))
    pairs = states.select("unit", "bucket", "idx", "path", F.xxhash64("path").alias("p"), "h").withColumn("c", c)
    apart = pairs.select("unit", "bucket", "p", "h", "c", F.explode(F.array(*entries)).alias("e")).select("unit", "bucket", "p", "h", "c", "e.*")
    cells = apart.groupBy("unit", "bucket", "pair", "cell", "path").agg(F.sum("n").cast("int").alias("n"), *(F.bit_xor(x).alias(x) for x in "phc"))
    kept = cells.where("path is not null or pair > 1 and (n != 0 or p != 0 or h != 0 or c != 0)").join(sized(last), "unit").where("pair <= last_idx")
    return kept.groupBy("unit", "bucket").agg(F.collect_list(F.struct("pair", "cell", "n", *"phc", "path")).alias("cells"))


def peel(cells: list[dict], part: int) -> tuple[list[tuple[int, int, int]], bool]:
    """The pairs in a subtracted table as (p, h, sign), and whether the whole table was taken apart.

    A cell with count 1 or -1 whose check sum fits its pair holds just that pair; taking it out of its three cells
    frees others. At the end every cell must be zero: that is the digest test of the bucket.
    """
    at = {x["cell"]: [x["n"], x["p"] & _MASK, x["h"] & _MASK, x["c"] & _MASK] for x in cells}
    todo, out = list(at), []
    while todo:
        cell = at.get(todo.pop())
        if cell is None or cell[0] not in (1, -1):
            continue
        s, p, h, c = cell
        if xxhash.xxh64_intdigest(h.to_bytes(8, "little"), xxhash.xxh64_intdigest(p.to_bytes(8, "little"), 42)) != c:
            continue
        out.append((p, h, s))
        for j in range(3):
            k = j * part + (c >> (21 * j) & ((1 << 21) - 1)) % part
            x = at.setdefault(k, [0, 0, 0, 0])
            x[0] -= s
            x[1] ^= p
            x[2] ^= h
            x[3] ^= c
            todo.append(k)
    return out, not any(any(x) for x in at.values())


def _peeled(tables: DataFrame, part: int) -> DataFrame:
    """(unit, bucket, pair, path, change, ok): the changes of every pair of scans; one row that is not ok for a table that doesn't peel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                names: dict[int, str] = {}
                by_pair: dict[int, list[dict]] = {}
                for x in r["cells"]:
                    if x["path"] is None:
                        by_pair.setdefault(x["pair"], []).append(x)
                    else:
                        names[xxhash.xxh64_intdigest(x["path"].encode(), 42)] = x["path"]
                for pair, cells in by_pair.items():
                    got, ok = peel(cells, part)
                    if not ok:
                        out.append((r["unit"], r["bucket"], pair, None, None, False))
                        continue
                    signs: dict[int, set[int]] = {}
                    for p, _, sign in got:
                        signs.setdefault(p, set()).add(sign)
                    out += [(r["unit"], r["bucket"], pair, names[p], "modified" if len(s) > 1 else "added" if 1 in s else "removed", True) for p, s in signs.items()]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["unit", "bucket", "pair", "path", "change", "ok"])

    return tables.mapInArrow(run, "unit long, bucket long, pair int, path string, change string, ok boolean")


def _row_by_row(states: DataFrame, failed: DataFrame) -> DataFrame:
    """The changes of the failed pairs of scans, from their rows."""
    late = states.join(sized(failed), ["unit", "bucket"]).where("idx = pair or idx = pair - 1")
    new, old = F.max(F.when(F.col("idx") == F.col("pair"), F.col("h"))), F.max(F.when(F.col("idx") < F.col("pair"), F.col("h")))
    sides = late.groupBy("unit", "bucket", "pair", "path").agg(new.alias("new"), old.alias("old")).where("not new <=> old")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return sides.select("unit", "pair", "path", kind.alias("change"))


def changed_between(snap: DataFrame, scans: DataFrame, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(snapshot_no, repo, path, change): added, modified and removed paths between consecutive scans of a unit.

    Missing scans are passed over and the first scan of a unit gives nothing. Empty tables give no rows; a scan without
    rows is an empty listing. Times and sizes don't matter, null paths are no paths.
    """
    order = materialize(scan_order(scans), "order")
    places = materialize(numbered(snap, order), "places")
    found = failed = None
    for k, part in enumerate(parts):
        states = scanned_states(bucketed(snap, order, places, None if failed is None else failed.select("unit", "bucket").distinct()))
        got = _peeled(subtracted(states, places, part), part)
        if failed is not None:
            got = got.join(sized(failed), ["unit", "bucket", "pair"], "left_semi")
        got = materialize(got, f"peeled{k}")
        good = got.where("ok").select("unit", "pair", "path", "change")
        found = good if found is None else found.unionByName(good)
        failed = materialize(got.where("not ok").select("unit", "bucket", "pair"), f"failed{k}")
        if failed.isEmpty():
            break
    else:
        rest = scanned_states(bucketed(snap, order, places, failed.select("unit", "bucket").distinct()))
        found = found.unionByName(_row_by_row(rest, failed))
    labels = order.select("unit", F.col("idx").alias("pair"), "snapshot_no", "repo")
    # roots of one repository may overlap
    return found.join(sized(labels), ["unit", "pair"]).select("snapshot_no", "repo", "path", "change").distinct()


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changes per snapshot, repository and kind."""
    return changes.groupBy("snapshot_no", "repo", "change").agg(F.count(F.lit(1)).alias("n"))
