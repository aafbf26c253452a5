"""Every registered query against its SQL on the smallest tables, and streams against batches."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarryline.streaming import feeds

from .conftest import rows

BASE = Path("/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.oracle_sql().items() if not k[1:2].isdigit() or k[:2] in ("p2", "p5", "p6")}
needs_data = pytest.mark.skipif(not BASE.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in BASE.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(BASE))
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert rows_of(got.select(*cols).collect()) == rows_of(want)


def rows_of(rs):
    return sorted((tuple(map(plain, r)) for r in rs), key=str)


@needs_data
def test_entry_and_partitions(spark):
    got = entry.entry(spark)
    assert got.columns == ["rid", "severity", "status", "scopes", "priority"] and got.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_streams(spark, tmp_path):
    events = spark.read.parquet(str(BASE / "events.parquet")).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = str(tmp_path / "events")
    events.repartition(4).write.parquet(path)

    def run(make, name):
        q = make(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(path)).writeStream
        q = q.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    once = run(lambda s: feeds.first_activations(s, "user_id", "event_type", "ts"), "once")
    assert rows(once.groupBy("user_id", "event_type").count().where("count > 1")) == []
    assert once.count() == events.select("user_id", "event_type").distinct().count()
    final = run(lambda s: feeds.activity_windows(s, "ts", "1 day"), "windows")
    whole = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert final.count() > 0 and final.exceptAll(whole).count() == 0
