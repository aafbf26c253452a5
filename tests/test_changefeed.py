"""Change feeds against a plain loop."""

import random

import pytest

from quarryline.operators import changefeed
from quarryline.streaming import feeds

from .conftest import rows

SCHEMA = "feed_seq long, op string, record_id string, revision int, status string, junk string"


def plain(feed, base=()):
    best = {}
    for k, r, s in base:
        best[k] = max(best.get(k, (-1, -2)), (r, -1, "insert", s), key=lambda x: x[:2])
    for seq, op, key, rev, status, _ in feed:
        if key is None or not key.strip() or rev is None:
            continue
        k = key.strip().lower()
        new = (rev, -1 if seq is None else seq, op, status)
        if k not in best or new[:2] >= best[k][:2]:
            best[k] = new
    return sorted(((k, v[0], v[3]) for k, v in best.items() if (v[2] or "").lower() != "delete"), key=str)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_any_order_hot_key_and_repeats(spark, chunk):
    rng = random.Random(chunk)
    feed = []
    for seq in range(1, 300):
        key = "Hot " if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        op = rng.choice(["insert", "update", "update", "DELETE", None])
        feed.append((seq, op, key, rng.randrange(1, 30), None if op == "DELETE" else rng.choice(["a", "b", None]), "x"))
    feed += feed[:50] + [(500, "insert", None, 1, "a", ""), (501, "insert", " ", 1, "a", ""), (502, "insert", "z", None, "a", "")]
    rng.shuffle(feed)
    got = changefeed.apply_feed(spark.createDataFrame(feed, SCHEMA).repartition(5), chunk_rows=chunk)
    assert rows(got) == plain(feed)


def test_base_and_empty(spark):
    base = spark.createDataFrame([("a", 3, "old"), ("b", 1, "old")], "record_id string, revision int, status string")
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(changefeed.apply_feed(empty)) == []
    assert rows(changefeed.apply_feed(empty, base=base)) == [("a", 3, "old"), ("b", 1, "old")]
    feed = spark.createDataFrame([(1, "update", "A", 3, "new", ""), (2, "delete", "b", 2, None, ""), (3, "update", "c", 1, "new", "")], SCHEMA)
    assert rows(changefeed.apply_feed(feed, base=base)) == [("a", 3, "new"), ("c", 1, "new")]


def fold(feed):
    """Deliveries one after another, in order."""
    state = {}
    for seq, op, key, rev, a, b in sorted(set(feed), key=lambda x: (x[3], x[0])):
        if op == "delete":
            state.pop(key, None)
        elif op == "insert":
            state[key] = (rev, a, b)
        else:
            _, x, y = state.get(key, (0, None, None))
            state[key] = (rev, x if a is None else a, y if b is None else b)
    return sorted(((k, *v) for k, v in state.items()), key=str)


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_partial_updates_compose(spark, chunk):
    rng = random.Random(chunk)
    feed = [
        (s, rng.choice(["insert", "update", "update", "update", "delete"]), rng.choice(["hot", "hot", "k1", "k2", "k3"]), rng.randrange(1, 12), rng.choice([None, "a", "b"]), rng.choice([None, "x", "y"]))
        for s in range(1, 120)
    ]
    rng.shuffle(feed)
    df = spark.createDataFrame(feed + feed[:30], "feed_seq long, op string, record_id string, revision int, status string, kind string").repartition(4)
    assert rows(changefeed.apply_feed(df, fields=("status", "kind"), chunk_rows=chunk, partial=True)) == fold(feed)


def test_composition_is_associative(spark):
    feed = [(s, "update" if s % 3 else "insert", "k", s % 5, None if s % 2 else f"v{s}", "") for s in range(12)]
    p = changefeed.patches(spark.createDataFrame(feed, SCHEMA), "record_id", "revision", "feed_seq", "op", ["status"], partial=True)
    whole = rows(changefeed.composed(p, "_key"))
    for cut in (1, 4, 9):
        left, right = changefeed.composed(p.where(f"_seq < {cut}"), "_key"), changefeed.composed(p.where(f"_seq >= {cut}"), "_key")
        assert rows(changefeed.composed(right.unionByName(left), "_key")) == whole


def test_stream_gives_the_batch_state(spark, tmp_path):
    feed = [(k, "update" if k % 5 else "delete", f"r{k % 7}", k % 11, f"s{k}", "") for k in range(60)]
    path = str(tmp_path / "feed.parquet")
    spark.createDataFrame(feed, SCHEMA).repartition(6).write.parquet(path)
    got = feeds.streamed_state(spark, path, "record_id", "revision", "feed_seq", "op", ["status"])
    assert rows(got) == plain(feed)
