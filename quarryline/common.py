"""Session, table and materialisation helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def session(app: str = "quarryline", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on (UTC, AQE)."""
    b = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``base``; columns are pruned by the reader of the result."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-quarryline-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage and survives lost executors. The files go when the driver's Python ends.
    """
    path = f"{new_folder(df.sparkSession)}/{name}"
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one, to be dropped when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quarryline-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` as parquet."""
    df.write.option("compression", "zstd").parquet(path)


@atexit.register
def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, unless their path has it anyway.

    The archive lies beside the driver only until Spark's file server has it; executors fetch it from there.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-quarryline-"), "quarryline.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "quarryline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def cut(c: Column | str) -> Column:
    """Trim white space of any kind on both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c, F.lit(" \t\r\n\f "))


def norm_key(c: Column | str) -> Column:
    """Key as compared: trimmed and in lower case; blank becomes null."""
    k = F.lower(cut(c))
    return F.when(k != "", k)


def norm_path(c: Column | str) -> Column:
    """Path with single forward slashes and no leading ``./``; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.regexp_replace(F.regexp_replace(F.translate(cut(c), "\\", "/"), "/{2,}", "/"), r"^(\./)+", "")
    return F.when((p != "") & (p != "."), p)


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, to be broadcast if it is counted to have no more than ``rows`` rows; beyond that Spark takes its ordinary join.

    Meant for narrow tables that were written before, where the count reads no data.
    """
    return F.broadcast(df) if df.count() <= rows else df


def hot_keys(df: DataFrame, keys: list[str], share: int = 200) -> DataFrame:
    """Keys that hold more than one ``share``-th of the rows of ``df``: never more than ``share`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_t")).scalar()
    return counts.where((F.col("_n") > 1000) & (F.col("_n") * share > total)).select(*keys)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", share: int = 200, hot: DataFrame | None = None) -> DataFrame:
    """Join to a table with one row per key, safe against hot keys on the left.

    The right rows of the hot keys (at most ``share``, see ``hot_keys``) are broadcast; their left rows are never
    shuffled. All others take the ordinary join. Null keys match nothing. ``hot`` gives the hot keys where they are
    known already.
    """
    hot = F.broadcast(hot_keys(left, keys, share) if hot is None else hot).withColumn("_hot", F.lit(True))
    marked = left.join(hot, keys, "left")
    hot_left, cold_left = marked.where("_hot").drop("_hot"), marked.where("_hot is null").drop("_hot")
    hot_right = right.join(hot.drop("_hot"), keys, "left_semi")
    a = hot_left.join(F.broadcast(hot_right), keys, how)
    b = cold_left.join(right, keys, how)
    return a.unionByName(b)
