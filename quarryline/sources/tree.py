"""Working trees as tables, and tables as versioned folders."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.text import LANGUAGES, content_hash, language_of, matches_globs

# Folders that are never read, at any depth.
PRUNED = (".git", "node_modules", "__pycache__", ".venv", "venv")
#: Version of the layout of cached tables.
LAYOUT = 1


class UnusableCache(RuntimeError):
    """A cache that is missing, damaged or of another version."""


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, language, content_hash, size, mtime, content, readable) of the source files below a folder.

    Only known extensions, no pruned folders; a file must be under an included glob and no excluded one. A file that
    can't be read is a row without hash and content. The folder must be mounted on all executors; its subfolders are
    walked by the tasks (Spark's own listing leaves out names that begin with an underscore, as ``__init__.py`` does).
    """
    entries = sorted(e.name for e in os.scandir(root) if e.name not in PRUNED)
    starts = spark.createDataFrame([(e,) for e in entries], "start string").repartition(max(1, len(entries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column("start").to_pylist():
                yield from _walked(root, start)

    rows = starts.mapInArrow(run, "path string, size long, mtime double, bytes binary")
    rows = rows.where(matches_globs("path", include or ["**"], exclude or []))
    return rows.select(
        "path", language_of("path").alias("language"), content_hash("bytes").alias("content_hash"), "size", "mtime",
        F.decode("bytes", "UTF-8").alias("content"), F.col("bytes").isNotNull().alias("readable"),
    )


def _walked(root: str, start: str, batch_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The source files below one entry of the root, in batches of bounded size."""
    found: list[tuple] = []
    held = 0

    def full() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["path", "size", "mtime", "bytes"])

    top = os.path.join(root, start)
    walk = os.walk(top) if os.path.isdir(top) else [(root, [], [start])]
    for folder, below, names in walk:
        below[:] = sorted(d for d in below if d not in PRUNED)
        for name in sorted(names):
            if os.path.splitext(name)[1].lower() not in LANGUAGES:
                continue
            path = os.path.join(folder, name)
            relative = os.path.relpath(path, root).replace(os.sep, "/")
            try:
                stat = os.stat(path)
                with open(path, "rb") as f:
                    data = f.read()
                found.append((relative, stat.st_size, stat.st_mtime, data))
                held += len(data)
            except OSError:
                found.append((relative, None, None, None))
            if held > batch_bytes:
                yield full()
                found.clear()
                held = 0
    if found:
        yield full()


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a JSON-lines file with a fixed schema; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append records as JSON lines; a job's rows appear together or not at all."""
    df.write.mode("append").json(path)


def write_cache(tables: dict[str, DataFrame], base: str) -> str:
    """Write tables as one new version below ``base`` and point to it; readers keep the version that they opened.

    The pointer is written last, so a failed job leaves the old version in place.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{base}/v-{version}/{name}")
    meta = json.dumps({"layout": LAYOUT, "version": version, "tables": sorted(tables)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/CURRENT")
    return version


def read_cache(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the version that ``base`` points to; raises ``UnusableCache`` if there is none that fits."""
    try:
        meta = json.loads(spark.read.text(f"{base}/CURRENT").first()[0])
    except Exception as e:
        raise UnusableCache(f"no cache below {base}") from e
    if meta.get("layout") != LAYOUT:
        raise UnusableCache(f"cache below {base} has layout {meta.get('layout')}, not {LAYOUT}")
    return {t: spark.read.parquet(f"{base}/v-{meta['version']}/{t}") for t in meta["tables"]}
