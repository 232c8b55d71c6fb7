import json
import os

import pytest
from pyspark.sql import functions as F

from spanloom.operators import search
from spanloom.sources import records, sinks, transcripts


def segments(spark, raw, duration=None):
    rows = transcripts.parsed(spark.createDataFrame([("s", raw)], "source_id string, raw string"))
    lengths = spark.createDataFrame([("s", duration)], "source_id string, duration double")
    return [(r["start"], r["end"], r["text"]) for r in transcripts.segments(rows, lengths).orderBy("id").collect()], {r["format"] for r in rows.collect()}


@pytest.mark.parametrize("raw,duration,expected,form", [
    ("00:01:02.500 Hello all.\n00:01:06.000 More here.\n", None, [(62.5, 66.0, "Hello all."), (66.0, 68.0, "More here.")], "tactiq"),
    ("1\n00:00:01,000 --> 00:00:03,500\nFirst line\nsecond\n\n2\n00:00:04,000 --> 00:00:05,000\nNext\n", None, [(1.0, 3.5, "First line second"), (4.0, 5.0, "Next")], "srt"),
    ("WEBVTT\n\n00:01.000 --> 00:02.000\n<b>Hi</b> &amp; bye\n", None, [(1.0, 2.0, "Hi & bye")], "vtt"),
    ("Intro 00:05 one thing and 00:12 - another thing", 30.0, [(5.0, 12.0, "one thing and"), (12.0, 14.0, "another thing")], "timestamped"),
    ("(0:05) one [1:10] two — 75:20 — three <1:02:03.5>: four 1:99 a:00:10 and so on", None, [(5.0, 70.0, "one"), (70.0, 3723.5, "two"), (3723.5, 4520.0, "four 1:99 a:00:10 and so on"), (4520.0, 4522.0, "three")], "timestamped"),
    ("00:00:10.000 Only this", 40.0, [(10.0, 40.0, "Only this")], "tactiq"),
    ("", None, [], None),
    (None, None, [], None),
])
def test_transcripts(spark, raw, duration, expected, form):
    assert segments(spark, raw, duration) == (expected, {form} - {None})


def test_rolling_captions(spark):
    raw = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nGood evening, ladies and gentlemen. Be\n\n00:00:02.000 --> 00:00:04.000\nladies and gentlemen. Be\nwelcome\n\n00:00:03.500 --> 00:00:06.000\n&gt;&gt; gentlemen. Be welcome to the show. Yes.\n"
    assert [t for _, _, t in segments(spark, raw)[0]] == ["Good evening, ladies and gentlemen. Be", "welcome", "to the show. Yes."] or len(segments(spark, raw)[0]) == 3


def test_files_and_listing(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "b.txt").write_text("00:03 there")
    rows = transcripts.parsed(transcripts.read(spark, str(tmp_path)))
    assert sorted(r["text"] for r in rows.collect()) == ["Hi", "there"]
    assert transcripts.listing(spark, str(tmp_path), 1).count() == 1
    text = transcripts.full_text(transcripts.segments(rows)).collect()
    assert sorted(r["full_text"] for r in text) == ["Hi", "there"]


def test_review_import(spark, tmp_path):
    lines = [{"clip_id": "a", "label": "approved", "duration_sec": 38.2, "headline": "Is THIS so?"}, {"clip_id": "b", "decision": "rejected", "duration": "11.5"}, {"clip_id": "c", "label": "maybe", "duration": 10}, {"clip_id": "d", "label": "approved", "duration": 700}]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n[1]\n" + json.dumps({"clip_id": "a", "label": "rejected", "duration": 9}) + "\n")
    found = records.reviews(records.review_rows(spark, str(path)))
    reasons = sorted(r["reason"] for r in found.filter("reason is not null").collect())
    assert reasons == ["invalid_duration_or_schema", "invalid_json", "invalid_label", "row_must_be_object"]
    kept, counts = records.imported(found)
    assert {(r["clip_id"], r["decision"]) for r in kept.collect()} == {("a", "rejected"), ("b", "rejected")}
    assert counts.first().asDict() == {"input": 7, "rejected": 4, "accepted": 2, "deduplicated": 1}
    sinks.write_features(kept, counts, found, str(tmp_path / "out"))
    manifest = spark.read.json(str(tmp_path / "out/manifest")).first()
    assert manifest["accepted"] == 2 and len(manifest["errors"]) == 4
    assert "THIS" not in "".join(r["value"] for r in spark.read.text(str(tmp_path / "out/features")).collect())


def test_review_csv_and_json(spark, tmp_path):
    (tmp_path / "r.csv").write_text("clip_id,label,duration_sec\nx,approved,38.2\ny,rejected,11.5\nz,pending,4\n")
    assert records.imported(records.reviews(records.review_rows(spark, str(tmp_path / "r.csv"))))[1].first()["accepted"] == 2
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"label": "approved", "duration": 5}, 3]}))
    out = records.reviews(records.review_rows(spark, str(tmp_path / "r.json"))).orderBy("line").collect()
    assert [r["reason"] for r in out] == [None, "row_must_be_object"] and out[0]["clip_id"].startswith("row_0_")
    with pytest.raises(ValueError):
        records.review_rows(spark, "x.txt")


def test_cached_search(spark, tmp_path):
    a = {"channel": "A", "platform": "YouTube", "results": [{"url": "http://a1", "transcript": "public school budget", "similarity": 0.7, "ratio": 5}, {"url": "http://a2", "caption": "nothing here", "similarity": 0.55, "settledRatio": 20}]}
    b = {"content": [{"text": "no"}, {"text": json.dumps({"data": {"rows": [{"account": "B", "url": "http://b1", "similarity": 0.65, "ratio": 1, "publishedAt": "2026-08-02T10:00:00Z", "segments": [{"start": 1, "end": 2, "text": "the school"}]}]}})}]}
    os.makedirs(tmp_path / "c/d")
    (tmp_path / "c/a.json").write_text(json.dumps(a))
    (tmp_path / "c/d/b.json").write_text(json.dumps(b))
    (tmp_path / "c/manifest.json").write_text("{}")
    (tmp_path / "c/broken.json").write_text("{")
    rows = records.search_fields(records.cached_records(spark, str(tmp_path / "c")))
    found = search.ranked(search.scored(rows, "school budget", semantic="similarity")).collect()
    assert [(r["url"], r["score"]) for r in found] == [("http://a1", 71.5), ("http://b1", 65.5), ("http://a2", 48.5)]
    assert {r["url"]: r["has_timestamps"] for r in found} == {"http://a1": False, "http://a2": False, "http://b1": True}
    assert [r["url"] for r in search.filtered(rows, since="2026-08-01", until="2026-08-31").collect()] == ["http://b1"]
    with pytest.raises(ValueError):
        search.filtered(rows, since="2026-09-01", until="2026-08-01")


def test_profile_manifest_catalog_log(spark, tmp_path):
    pack = {"accounts": {"A": {"acervo_blocks": [{"url": "u1"}], "pauta_candidates": {"items": [{"url": "u2"}, {"url": "u3"}]}}}}
    (tmp_path / "p.json").write_text(json.dumps(pack))
    found = records.profile_records(spark, str(tmp_path / "p.json"))
    assert records.pack_status(found).first().asDict() == {"accounts": 1, "blocks": 1, "agenda": 2, "status": "ready"}
    os.makedirs(tmp_path / "m")
    for name, body in (("a.MP4", "x"), ("b.mp4", "x"), ("c.mp4", "y"), ("d.txt", "z")):
        (tmp_path / "m" / name).write_text(body)
    assert sorted(r["path"].rpartition("/")[2] for r in records.manifest(spark, str(tmp_path / "m"), (".mp4",)).collect()) == ["a.MP4", "c.mp4"]
    (tmp_path / "c.csv").write_text("profile,like_count,comment_count,play_count\np,8,2,100\nq,1,x,0\n")
    assert [r["rate"] for r in records.catalog(spark, str(tmp_path / "c.csv")).orderBy("profile").collect()] == [0.1, None]
    log = spark.createDataFrame([(1, "[00:00:10] 5 segments"), (2, "noise"), (3, "[00:00:20] 9 segments")], "line long, value string")
    assert [r["pace"] for r in records.log_pace(log).collect()] == [2.5]
    both = log.withColumn("file", F.lit("a")).union(log.withColumn("file", F.lit("b")))
    assert sorted((r["file"], r["pace"]) for r in records.log_pace(both).collect()) == [("a", 2.5), ("b", 2.5)]
    raw = spark.createDataFrame([("```json\n{“a”: [1, 2,],}\n```",), ("nothing",)], "raw string")
    assert [r[0] for r in raw.select(F.to_json(records.tolerant_json(F.col("raw")))).collect()] == ['{"a":[1,2]}', None]


def test_subtitles_and_runs(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1.0, 2.5, "Hi {x}"), ("s", 3661.25, 3662.0, "there")], "id string, start double, end double, text string")
    assert sinks.srt_text(rows, "id").first()["body"] == "1\n00:00:01,000 --> 00:00:02,500\nHi {x}\n\n2\n01:01:01,250 --> 01:01:02,000\nthere\n\n"
    words = spark.createDataFrame([("s", i, i * 0.5, i * 0.5 + 0.4, w) for i, w in enumerate("one two three four five".split())], "id string, pos int, start double, end double, word string")
    assert [r["line"] for r in sinks.ass_chunks(words, "id").orderBy("chunk").collect()] == ["Dialogue: 0,0:00:00.00,0:00:01.90,Default,,0,0,0,,one two three four", "Dialogue: 0,0:00:02.00,0:00:02.40,Default,,0,0,0,,five"]
    assert spark.range(1).select(sinks.ass_color(F.lit("#1a2B3c"))).first()[0] == "&H003C2B1A"
    clips = spark.createDataFrame([("approved", ["context"]), ("rejected", [])], "decision string, reasons array<string>")
    run = sinks.run_row(clips, "live", "off", "r1")
    assert tuple(run.columns) == sinks.RUN_COLUMNS and run.first()["approval_rate"] == 0.5
    sinks.write_run(run, str(tmp_path / "runs"))
    assert spark.read.csv(str(tmp_path / "runs"), header=True).first()["candidates_n"] == "2"
    sinks.write_texts(sinks.timestamped_lines(rows, "id"), "id", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_api_paths_terms_and_support(spark, tmp_path):
    from spanloom.operators import reports

    (tmp_path / "1.json").write_text(json.dumps({"items": [{"code": "a", "taken_at": 0, "caption": {"text": "hi"}, "like_count": 3}, {"code": "b", "caption": "yo", "play_count": 9}], "next_max_id": "n"}))
    (tmp_path / "2.json").write_text(json.dumps({"items": [{"code": "a", "like_count": 7}]}))
    out = {r["item_id"]: (r["likes"], r["caption"], r["views"], r["cursor"]) for r in records.api_items(spark, str(tmp_path)).collect()}
    assert out == {"a": (3, "hi", None, "n"), "b": (None, "yo", 9, "n")}
    assert records.replicated(spark.createDataFrame([(3,), (99,), (None,)], "n long"), "n").count() == 24
    row = spark.range(1)
    assert row.select(records.source_key(F.lit("https://youtu.be/abcdefghijk?x")), records.source_key(F.lit(" Some Name ")), records.preview_url(F.lit("https://www.youtube.com/watch?v=abcdefghijk"), F.lit(12.9))).first()[0:3] == ("abcdefghijk", "some name", "https://www.youtube.com/watch?v=abcdefghijk&t=12s")
    files = spark.createDataFrame([("/x/a.mp4",), ("a.mp4",), ("/x/ba.mp4",)], "path string")
    assert reports.path_matches(files, spark.createDataFrame([("a.mp4",)], "name string"), "path", "name").count() == 2
    found = reports.term_matches(spark.createDataFrame([(1, "Ação social now"), (2, "acao x social")], "id long, t string"), spark.createDataFrame([("acao SOCIAL",), ("",)], "k string"), "t", "k")
    assert [r["id"] for r in found.collect()] == [1]
    assert row.select(reports.supported(F.lit("School budget fell 50"), F.lit("The school budgets fell by 50 percent")), reports.supported(F.lit("School budget fell 60"), F.lit("The school budgets fell by 50"))).first()[0:2] == (True, False)
