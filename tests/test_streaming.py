import datetime as dt
import os

from pyspark.sql import functions as F

from spanloom.streaming import events

AT = dt.datetime(2024, 1, 1)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    schema = "k string, at timestamp, level double"
    rows = [("a", AT + dt.timedelta(seconds=s / 2), (s % 7) / 7 - 0.4) for s in range(40)] + [("b", AT + dt.timedelta(seconds=s), 0.5) for s in (0, 5, 400)] + [("z", AT + dt.timedelta(hours=5), 0.1)]
    write(spark, rows, schema, str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    for name, f in (("energy", lambda x: events.energy_windows(x, "k", "at", "level")), ("visits", lambda x: events.sessions(x, "k", "at"))):
        expected = [tuple(r) for r in f(batch).collect() if r["k"] != "z"]
        assert sorted(x for x in drained(f(stream), name) if x[0] != "z") == sorted(expected), name
    assert len([x for x in events.sessions(batch, "k", "at").collect() if x["k"] == "b"]) == 2


def test_jobs(spark, tmp_path):
    schema = "job_id string, at double, state string, stage string"
    rows = [("a", 0.0, "running", "cut"), ("a", 4.0, "running", "rank"), ("a", 9.0, "completed", ""), ("a", 20.0, "running", "late"), ("b", 1.0, "running", "cut"), ("b", 2.0, "cancel_requested", ""), ("b", 5.0, "completed", "")]
    write(spark, rows, schema, str(tmp_path / "in"))
    out = drained(events.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "jobs")
    assert sorted(out) == [("a", "completed", "rank", 5.0, False), ("a", "running", "cut", 4.0, False), ("b", "cancelled", "cut", 4.0, True)]


def test_once_and_latest(spark, tmp_path):
    schema = "k string, at timestamp, n long"
    path = str(tmp_path / "in")
    write(spark, [("a", AT, 1), ("a", AT, 2), ("b", AT, 3)], schema, path)
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    assert len(drained(events.once(stream(), "k", "at"), "once")) == 2
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    for extra in ([], [("a", AT, 9), ("c", AT, 1)]):
        if extra:
            write(spark, extra, schema, path)
        q = stream().writeStream.foreachBatch(events.latest_into(table, "k", "n")).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination(120)
    newest = max(os.listdir(table), key=lambda x: int(x.partition("=")[2]))
    assert {(r["k"], r["n"]) for r in spark.read.parquet(f"{table}/{newest}").collect()} == {("a", 9), ("b", 3), ("c", 1)}
    batch = spark.read.parquet(path)
    events.latest_into(str(tmp_path / "again"), "k", "n")(batch, 0)
    assert spark.read.parquet(str(tmp_path / "again/version=0")).agg(F.sum("n")).first()[0] == 13
