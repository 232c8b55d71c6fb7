import datetime as dt

import pytest

from spanloom.operators import folds
from spanloom.streaming import events, stateful

AT = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(df, tmp_path, name):
    """Whatever is there now; the log keeps states for the next run."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-log").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}")


def test_captions_in_two_batches_equal_the_fold(rocks, tmp_path):
    spark, schema = rocks, "source_id string, pos long, start double, end double, text string, at timestamp"
    texts = {
        "a": ["Good evening, ladies and gentlemen. Be", "Good evening, ladies and gentlemen. Be welcome", "gentlemen. Be welcome to the show", "", "to the show", None, "to the show tonight.", "Yes."],
        "b": ["One two three four", "two three four five", "five", "five six", "x", "x", "y"],
        "c": ["alone"],
    }
    rows = [(s, i, float(i), None if i % 4 == 3 else i + 1.5, t, AT + dt.timedelta(seconds=i)) for s, own in texts.items() for i, t in enumerate(own)]
    want = []
    for s in texts:
        want += [(s, c["start"], c["end"], c["text"]) for c in folds.rolling_captions({"start": r[2], "end": r[3], "text": r[4]} for r in rows if r[0] == s)]
    path = f"{tmp_path}/in"
    stream = stateful.captions(spark.readStream.schema(schema).parquet(path) if spark.createDataFrame([], schema).write.parquet(path) is None else None)
    for batch in ([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3], [("z", 0, 0.0, 1.0, "later", AT + dt.timedelta(hours=1))], [("z", 1, 1.0, 2.0, "later", AT + dt.timedelta(hours=2))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        out = run(stream, tmp_path, "captions")
    assert sorted((tuple(r) for r in out.filter("source_id <> 'z'").collect()), key=repr) == sorted(want, key=repr)


def test_onsets_equal_batch(rocks, tmp_path):
    spark, schema = rocks, "k string, at timestamp, level double"
    rows = [("a", AT + dt.timedelta(seconds=s / 2), (s * 37 % 11) / 11 - 0.4) for s in range(40)] + [("b", AT + dt.timedelta(seconds=s), v) for s, v in ((0, 0.0), (5, 0.5), (20, 0.2), (21, 0.9))]
    path = f"{tmp_path}/in"
    spark.createDataFrame([], schema).write.parquet(path)
    stream = stateful.onsets(events.energy_windows(spark.readStream.schema(schema).parquet(path), "k", "at", "level"), "k")
    batches = [[r for r in rows if r[1] < AT + dt.timedelta(seconds=12)], [r for r in rows if r[1] >= AT + dt.timedelta(seconds=12)], [("z", AT + dt.timedelta(hours=h), 0.1) for h in (1, 5)], [("z", AT + dt.timedelta(hours=9), 0.1)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        out = run(stream, tmp_path, "onsets")
    want = stateful.onsets_of(events.energy_windows(spark.createDataFrame(rows, schema), "k", "at", "level"), "k").collect()
    close = lambda rs: sorted((r["k"], r["at"], round(r["rms"], 9), round(r["onset"], 9)) for r in rs)
    assert close(out.filter("k <> 'z'").collect()) == close(want) and any(r["onset"] > 0.1 for r in want)
