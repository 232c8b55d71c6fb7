import datetime as dt
import os
import random

import pytest

from spanloom.sources.keyed import KeyedTable

SCHEMA = "k string, at long, v string, made long"


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def folders(path):
    return {f"{d}/{b}" for d in os.listdir(f"{path}/data") for b in os.listdir(f"{path}/data/{d}") if b.startswith("__bucket=")}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=8, first=("made",))
    held = {}
    for number in range(5):
        batch = [(rng.choice([None, *"abcdefghij"]), rng.randrange(20), rng.choice((None, "x", "y")), 100 * number + i) for i in range(rng.choice((0, 1, 12)))]
        batch = list({(r[0], r[1]): r for r in batch}.values())
        version = table.upsert(spark.createDataFrame(batch, SCHEMA), number)
        for k in {r[0] for r in batch}:
            own = sorted((r for r in batch if r[0] == k), key=lambda r: r[1])
            old = held.get(k)
            last = own[-1] if old is None or own[-1][1] >= old[1] else old
            held[k] = (*last[:3], own[0][3] if old is None else old[3])
        if held:
            assert rows_of(table) == sorted(held.values(), key=repr)
            assert table.upsert(spark.createDataFrame(batch, SCHEMA), number) == version  # a batch that runs again
            assert rows_of(table) == sorted(held.values(), key=repr)


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = KeyedTable(spark, f"file://{path}", "k", "at", buckets=8)
    table.upsert(spark.createDataFrame([(str(i), 1, "old", i) for i in range(60)], SCHEMA), 0)
    assert len(folders(path)) == 8
    before = table.read()
    table.upsert(spark.createDataFrame([("7", 2, "new", 0)], SCHEMA), 1)
    assert len(folders(path)) == 9  # one bucket anew, its last version for those who still read it
    assert {r["v"] for r in before.collect()} == {"old"}  # a reader keeps the version it began with
    assert [tuple(r) for r in table.read().filter("v = 'new'").collect()] == [("7", 2, "new", 0)] and table.read().count() == 60
    for n in range(2, 6):
        table.upsert(spark.createDataFrame([("7", n + 1, "newer", 0)], SCHEMA), n)
    assert len(folders(path)) == 9 and len(os.listdir(f"{path}/manifests")) <= 2 + 2  # and check sums of a local file system
    assert KeyedTable(spark, f"file://{path}", "k", "at", buckets=99).buckets == 8


def test_a_slower_writer_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, "k", "at", buckets=2)
    table.upsert(spark.createDataFrame([("a", 1, "x", 0)], SCHEMA))
    seen = table.manifest()
    KeyedTable(spark, path, "k", "at").upsert(spark.createDataFrame([("b", 1, "y", 0)], SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(table, "manifest", lambda back=0: seen)
        with pytest.raises(Exception, match="FileAlreadyExists"):
            table.upsert(spark.createDataFrame([("c", 1, "z", 0)], SCHEMA))
    assert {r["k"] for r in table.read().collect()} == {"a", "b"}


def test_partial_changes_and_empty_tables(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=4, partial=True)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.upsert(spark.createDataFrame([], SCHEMA), 0) == -1
    table.upsert(spark.createDataFrame([("a", 1, "x", 5), ("b", 1, None, None)], SCHEMA), 1)
    table.upsert(spark.createDataFrame([("a", 2, None, 6), ("b", 2, "y", None)], SCHEMA), 2)
    assert rows_of(table) == [("a", 2, "x", 6), ("b", 2, "y", None)]


def test_a_stream_of_changes(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=4)
    schema, path = "k string, at timestamp, n long", str(tmp_path / "in")
    at = dt.datetime(2024, 1, 1)
    for batch in ([("a", at, 1), ("a", at + dt.timedelta(1), 2), ("b", at, 3)], [("a", at, 9), ("c", at, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        q = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert {(r["k"], r["n"]) for r in table.read().collect()} == {("a", 2), ("b", 3), ("c", 1)}
