import json
import os

import pytest

from spanloom.sources import snapshots

KIND, VERSION = "decisions", 2
GOOD = {"editorial_key": "k", "action": "approved", "created_at": "2026-08-15 00:00:00"}


def test_payloads(spark):
    make = lambda records, **other: json.dumps({"format": KIND, "format_version": VERSION, "record_count": len(records), "records": records} | other)
    cases = [
        (None, "missing", 0, 0), ("not json", "invalid", 0, 0), ("[]", "invalid", 0, 0), (make([]), "empty", 0, 0), (make([GOOD]), "ready", 1, 0), (make([GOOD], record_count=None), "ready", 1, 0),
        (make([GOOD], record_count="1"), "ready", 1, 0), (make([GOOD], record_count="x"), "invalid", 1, 0), (make([GOOD], record_count=2), "invalid", 1, 0), (make([GOOD], format="other"), "invalid", 1, 0),
        (make([GOOD], format_version=1), "invalid", 1, 0), (make([GOOD], format_version=None), "invalid", 1, 0), (make([GOOD, 7, None, "x", [GOOD]]), "invalid", 5, 4),
        (make([GOOD | {"editorial_key": " "}, GOOD | {"action": "maybe"}, GOOD | {"created_at": "soon"}, GOOD | {"created_at": "2026-13-01"}, GOOD | {"created_at": "2026-08-15T10:00:00Z"}]), "invalid", 5, 4),
        (json.dumps({"format": KIND, "format_version": VERSION, "records": {"a": 1}}), "invalid", 0, 0),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")
    out = {r["i"]: r for r in snapshots.judged(rows, "payload", KIND, VERSION).collect()}
    for i, (payload, state, found, invalid) in enumerate(cases):
        assert (out[i]["state"], out[i]["found"], out[i]["invalid"]) == (state, found, invalid), payload
        assert out[i]["valid"] == (state in ("empty", "ready"))


def test_written_and_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    schema = "editorial_key string, action string, created_at string"
    status = lambda: snapshots.snapshot_status(spark, folder, KIND, VERSION).first()
    assert status()["state"] == "missing"
    with pytest.raises(ValueError, match="missing"):
        snapshots.read_snapshot(spark, folder, schema, KIND, VERSION)
    for n in (0, 3, 5):
        rows = [(f"k{i}", "rejected", "2026-01-02") for i in range(n)]
        snapshots.write_snapshot(spark.createDataFrame(rows, schema), folder, KIND, VERSION, "2026-01-03")
        s = status()
        assert (s["state"], s["found"], s["declared"], s["consistent"], s["generated_at"]) == ("ready" if n else "empty", n, n, True, "2026-01-03")
        assert sorted(tuple(r) for r in snapshots.read_snapshot(spark, folder, schema, KIND, VERSION).collect()) == rows
    assert len([d for d in os.listdir(f"{tmp_path}/s") if d.startswith("records-")]) == 2
    assert snapshots.snapshot_status(spark, folder, KIND, 3).first()["state"] == "invalid"
    # a changed line has another hash, though the count fits
    data = json.loads(open(f"{tmp_path}/s/manifests/000000000002.json").read())["data"]
    part = next(f"{tmp_path}/s/{data}/{f}" for f in os.listdir(f"{tmp_path}/s/{data}") if f.startswith("part") and os.path.getsize(f"{tmp_path}/s/{data}/{f}"))
    text = open(part).read().replace("rejected", "approved", 1)
    for f in (part, part.replace("/part", "/.part") + ".crc"):
        os.remove(f)
    open(part, "w").write(text)
    assert (status()["state"], status()["consistent"], status()["found"], status()["invalid"]) == ("invalid", False, 5, 0)
    with pytest.raises(ValueError, match="invalid"):
        snapshots.read_snapshot(spark, folder, schema, KIND, VERSION)


def test_decision_records(spark):
    feedback = [(1, 1, "approved", "r", ["a"], "2026-01-01"), (2, 1, "rejected", None, None, "2026-01-02"), (3, 1, "note", "x", [], "2026-01-03"), (4, 2, "approved", "r", [], "2026-01-01"), (5, 9, "approved", "r", [], "2026-01-01")]
    clips = [(1, "k" * 100, 1.23456, 9.0, None, 7, "v1", "s"), (2, "", 0.0, 1.0, 1.0, 1, "v", "s"), (3, "z", 0.0, 1.0, 1.0, 1, "v", "s")]
    out = snapshots.decision_records(
        spark.createDataFrame(feedback, "id long, clip_id long, action string, reason_code string, tags array<string>, created_at string"),
        spark.createDataFrame(clips, "clip_id long, editorial_key string, start double, end double, duration double, score long, score_version string, source_signature string"),
    )
    assert [tuple(r) for r in out.collect()] == [("k" * 80, 1.235, 9.0, 0.0, 7, "v1", "rejected", "", [], "2026-01-02", "s")]
