import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import coerce, scoring, text, timecode
from spanloom.operators import clips, feedback, folds, performance, selection, similarity
from spanloom.plans import queries
from spanloom.plans import reports  # noqa: F401


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_coercions(spark):
    values = ["1", "sim", "NO", "não", "2", "0.0", "nan", "x", "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = rows.select("i", coerce.flag(F.col("v")), coerce.flag_nonzero(F.col("v")), coerce.tri_state(F.col("v")), coerce.finite_or(F.col("v"), 7)).orderBy("i").collect()
    assert [r[1] for r in out] == [True, True, False, False, True, False, False, False, False, False]
    assert [r[2] for r in out] == [True, True, False, False, True, False, True, False, False, False]
    assert [r[3] for r in out] == [True, True, False, False] + [None] * 6
    assert [r[4] for r in out] == [1.0, 7.0, 7.0, 7.0, 2.0, 0.0, 7.0, 7.0, 7.0, 7.0]
    got = one(spark, coerce.floored_or_null(F.lit("-1"), 0, 5), coerce.floored_or_null(F.lit("9"), 0, 5), coerce.labels(F.lit(" a, b;a|c ")), coerce.scrubbed(F.lit("see http://x")), coerce.whole(F.lit("-3.9")), coerce.repaired_end(F.lit(2.0), F.lit(1.0)), coerce.non_negative(F.lit("-2")))
    assert got == (None, 5.0, ["a", "b", "c"], "", -3, 2.1, None)


@pytest.mark.parametrize("raw,lenient,strict", [("00:01:02.500", 62.5, 62.5), ("01:02,5", 62.5, 62.5), ("00:75", 75.0, None), ("12.5", None, 12.5), ("-3", None, None), ("x:y", None, None), ("1:00:61", 3661.0, None)])
def test_timecodes(spark, raw, lenient, strict):
    assert one(spark, timecode.seconds_lenient(F.lit(raw)), timecode.seconds_strict(F.lit(raw))) == (lenient, strict)


def test_stamps(spark):
    assert one(spark, timecode.stamp(F.lit(3661.2504)), timecode.stamp(F.lit(1.5), ","), timecode.ass_stamp(F.lit(61.239)), timecode.minute_stamp(F.lit(125.9))) == ("01:01:01.250", "00:00:01,500", "0:01:01.23", "02:05")
    assert one(spark, timecode.day_of(F.lit("2026-08-02T10:00:00Z")), timecode.day_of(F.lit("2026-08-02 junk")), timecode.day_of(F.lit("no")))[1:] == (dt.date(2026, 8, 2), None)


def test_text_features(spark):
    t = F.lit("Olá, Ação! Why is THIS so? Because John Smith said: 50 percent.")
    got = one(spark, text.folded(F.lit("Ação É")), text.is_question(t), F.size(text.sentences(t)), text.named_entities(t), text.co_occurs(t, "Why", "Smith"), text.compacted(F.lit("one two three and of"), 14), text.slug(F.lit("Ação é: já!")))
    assert got == ("acao e", True, 3, ["Because John Smith"], True, "one two three", "acao-e-ja")
    same = one(spark, text.topic_similarity(F.lit("a:x-y"), F.lit("a:x-y")), text.topic_similarity(F.lit("a:x-y"), F.lit("b:x-z")), text.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")))
    assert same == (1.0, 1 / 3, 0.0)
    terms = one(spark, text.topic_terms(F.lit("beta alpha beta gamma alpha beta"), 2))
    assert terms == (["beta", "alpha"],)
    cases = {"we go on to be continued": "cliffhanger", "in conclusion yes": "conclusion", "we went with": "open", "It ends.": "closed_statement", "it ends": "open"}
    for raw, kind in cases.items():
        assert one(spark, text.closure_type(F.lit(raw))) == (kind,), raw
    assert one(spark, text.family(F.lit("red dog blue"), {"x": ("red",), "y": ("blue",)}, "none"), text.family(F.lit("q"), {"x": ("red",)}, "none")) == ("x", "none")


def test_scores(spark):
    for seconds, fit in ((5, 55.0), (30, 100.0), (60, 91.0), (120, 76.0), (180, 58.0), (1000, 25.0)):
        assert one(spark, scoring.duration_fit(F.lit(seconds)))[0] == pytest.approx(fit)
    assert one(spark, scoring.from_grades(*map(F.lit, "ABCA")), scoring.grade(F.lit(75)), scoring.search_score(F.lit(0.7), F.lit(1.0), F.lit(0.25))) == (61, "A", 71.5)
    gate = one(spark, scoring.technical_gate({"overlap_suspected": F.lit(True), "speaker_turn_invalid": F.lit(True), "payoff_missing": F.lit(True), "timing_ambiguous": F.lit(None).cast("boolean")}, {"overlap_suspected": 22, "timing_ambiguous": 10, "payoff_missing": 12, "speaker_turn_invalid": 18}))[0]
    assert (gate["status"], gate["penalty"], gate["reasons"]) == ("weak", 42, ["overlap_suspected", "payoff_missing", "speaker_turn_invalid"])
    factors = F.create_map(F.lit("hook"), F.lit(100.0), F.lit("flow"), F.lit(90.0))
    lifted = one(spark, scoring.final_score(factors, {"hook": 0.6, "flow": 0.5}, F.lit(0), [(F.lit(True), 78.0)], F.lit(50.0)), scoring.top_factors(factors), scoring.mean_of(factors, ("hook", "none")))
    assert lifted == (78.0, ["hook", "flow"], 100.0)
    for bad in ("", None, "x" * 50000, "?!" * 100):
        row = one(spark, *(f(F.lit(bad).cast("string")) for f in (scoring.hook, scoring.flow, scoring.value, scoring.clarity, scoring.energy_cues)))
        assert all(0 <= v <= 100 for v in row), bad


def test_performance(spark):
    at = dt.datetime(2026, 8, 1)
    rows = spark.createDataFrame([("c", 10000, 800, 100, 50, 50, at, at + dt.timedelta(hours=24)), ("d", 0, 0, 0, 0, 0, at, at - dt.timedelta(hours=1))], "content_key string, views long, likes long, comments long, shares long, saves long, published_at timestamp, collected_at timestamp")
    out = performance.normalized(rows).orderBy("content_key").collect()
    assert (out[0]["engagement_actions"], out[0]["engagement_rate"], out[0]["age_hours"], out[0]["velocity"]) == (1000, 0.1, 24.0, 416.667)
    assert (out[1]["engagement_rate"], out[1]["age_hours"]) == (None, 0.0)
    assert performance.summary(rows.limit(0).withColumns({"engagement_rate": F.lit(0.0), "velocity": F.lit(0.0)})).first().asDict() == {"n_snapshots": 0, "n_contents": 0, "views": 0, "mean_rate": None, "mean_velocity": None}
    two = spark.createDataFrame([("c", 1, 1000, at), ("c", 2, 1500, at + dt.timedelta(hours=2))], "k string, id long, views long, at timestamp")
    assert [tuple(r) for r in performance.changes(two, "k", "at", "id").orderBy("id").select("views_delta", "growth", "hours").collect()] == [(None, None, None), (500, 0.5, 2.0)]
    cohort = performance.cohort_score(spark.createDataFrame([("p", 1, None), ("p", 2, 0.5), ("p", 2, 0.1)], "g string, views long, rate double"), ["g"], {"views": 0.5, "rate": 0.3}).orderBy("score").collect()
    assert cohort[-1]["score"] == 100.0 and cohort[0]["score"] == 33.33


def test_calibration_fixture(spark):
    rows = [("approved", 35.0, {"hook": 88.0, "flow": 76.0, "value": 81.0})] * 6 + [("rejected", 35.0, {"hook": 24.0, "flow": 42.0, "value": 38.0, "own": 1.0})] * 6
    table = spark.createDataFrame(rows, "decision string, duration double, factors map<string,double>")
    assert {r["factor"]: r["delta"] for r in feedback.factor_deltas(table, "factors", "decision").collect()} == {"hook": 64.0, "flow": 34.0, "value": 43.0}
    assert feedback.eligibility(table, "decision").first()["eligible"] and not feedback.eligibility(table.limit(4), "decision").first()["eligible"]
    assert not feedback.duration_signal(table, "decision", "duration").first()["usable"]
    assert feedback.last_wins(spark.createDataFrame([("same", "a", 0), ("same", "r", 1), ("other", "a", 2)], "k string, d string, i long"), "k", "i").orderBy("place").collect()[0]["d"] == "r"
    q = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4)], "decision string, v double")
    assert feedback.feature_prior(q, "decision", "v").first()["p25"] == 1.75
    assert feedback.upper_median(q, "decision", "v").first()["upper_median"] == 3.0
    assert feedback.origin_lift(table.limit(0), "decision", "decision").count() == 0


def test_jaccard_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [f"t{rng.randrange(12)}" for _ in range(rng.choice((0, 3, 9, 14)))]) for i in range(120)]
    for threshold in (0.5, 0.72, 0.86):
        table = spark.createDataFrame(rows, "id long, t array<string>")
        classes = {r["id"]: r["class_id"] for r in similarity.jaccard_classes(table, "id", "t").collect()}
        sets = {i: set(t) for i, t in rows if t}
        assert classes == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
        reps = sorted(set(classes.values()))
        expected = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
        found = [(r["left"], r["right"]) for r in similarity.jaccard_pairs(table, "id", "t", threshold).collect()]
        assert set(found) == expected and len(found) == len(expected)


def test_near_sets_meet_by_equal_parts(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(150):  # all have most of their words in common with all others, none a rare one of its own
        base = set(rng.sample(common, rng.choice((2, 7, 60, 110))))
        rows.append((10 * i, sorted(base)))
        for k in range(rng.randrange(4)):
            rows.append((10 * i + k + 1, sorted((base | {rng.choice(common)}) - set(rng.sample(sorted(base), min(len(base) - 1, k))))))
    sets = {i: set(t) for i, t in rows}
    table = spark.createDataFrame(rows, "id long, t array<string>")
    for threshold in (0.8, 0.86, 0.9):
        reps = [r["id"] for r in similarity.jaccard_classes(table, "id", "t").filter("id = class_id").collect()]
        expected = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
        found = [(r["left"], r["right"]) for r in similarity.jaccard_pairs(table, "id", "t", threshold).collect()]
        assert set(found) == expected and len(found) == len(expected) > 50
        met = similarity._meeting_by_parts(table, "id", "t", threshold).count()
        assert met < len(reps) ** 2 / 20  # by a prefix of rare words nearly all of them met


def test_folds(spark):
    rows = [("s", 0.0, 4.0, "What is the plan for the city?", "a"), ("s", 4.2, 9.0, "We will build", "b"), ("s", 9.1, 14.0, "many schools in every quarter.", "b"), ("s", 16.0, 30.0, "And then", "b"), ("s", -1.0, 3.0, "bad", "b"), ("s", 30.0, 30.0, "bad", "b")]
    table = spark.createDataFrame(rows, "id string, start double, end double, text string, speaker string")
    said = folds.fold(table, "id", ["start"], folds.sentences(), folds.SENTENCE).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n_segments"]) for r in said] == [(0.0, 4.0, 1), (4.2, 14.0, 2), (16.0, 30.0, 1)]
    made = folds.fold(table.filter("start >= 0 and end > start"), "id", ["start"], folds.blocks(), folds.BLOCK).orderBy("index").collect()
    assert [(r["start"], r["end"], r["n_sentences"]) for r in made] == [(0.0, 30.0, 4)]
    asked = table.filter("start >= 0 and end > start").withColumn("is_question", F.col("text").contains("?"))
    qa = folds.fold(asked, "id", ["start"], folds.question_answers(), folds.QA).collect()
    assert [(r["start"], r["end"], r["basis"], r["confidence"]) for r in qa] == [(0.0, 30.0, "change_of_speaker", 0.68)]
    long = spark.createDataFrame([("s", i * 10.0, i * 10.0 + 9.5 - (i == 20), "Text." if i % 3 == 2 else "text", "a") for i in range(40)] + [("s", 420.0, 425.0, "After.", "a")], table.schema)
    ends = [(r["segment_start"], r["segment_end"]) for r in folds.fold(long, "id", ["start"], folds.chapters(), folds.CHAPTER).orderBy("index").collect()]
    assert ends == [(0, 8), (9, 17), (18, 26), (27, 35), (36, 39), (40, 40)]
    bridged = long.withColumn("bridges", F.array(F.struct(F.lit(80.0).alias("start"), F.lit(120.0).alias("end"))))
    assert folds.fold(bridged, "id", ["start"], folds.chapters(), folds.CHAPTER).orderBy("index").first()["segment_end"] > 8
    assert folds.fold(table.limit(0), "id", ["start"], folds.sentences(), folds.SENTENCE).count() == 0


def test_chapters_with_bridges_by_joins(spark):
    rng = random.Random(9)
    rows, bridges = [], []
    for s in "abcd":
        at = 0.0
        for i in range(60):
            at += rng.choice((0.0, 0.5, 2.0, 9.0)) if i else 0.0
            rows.append((s, i, at, at + rng.choice((3.0, 12.0, 40.0)), rng.choice(("Text.", "text")), rng.choice(("x", "y", None))))
            at = rows[-1][3]
        bridges += [(s, a, a + rng.choice((5.0, 90.0))) for a in rng.sample([r[2] for r in rows if r[0] == s], 0 if s == "d" else 8)]
    table = spark.createDataFrame(rows, "s string, i long, start double, end double, text string, speaker string")
    held = spark.createDataFrame(bridges, "s string, start double, end double")
    each = held.groupBy("s").agg(F.collect_list(F.struct("start", "end")).alias("bridges"))
    want = folds.fold(table.join(each, "s", "left"), "s", ["start", "i"], folds.chapters(), folds.CHAPTER)
    out = clips.bridged_chapters(table, held, "s", "i").select(want.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.filter("has_qa_bridge").count() > 3
    assert clips.bridged_chapters(table, held.limit(0), "s", "i").filter("has_qa_bridge").count() == 0


def test_portfolio_equals_the_walk(spark):
    sf = "/root/testdata/sf0.01"
    rows = selection.gates(queries.views.clips(spark, sf)).filter("size(reasons) = 0").select("doc_id", "source_id", "family", "text", "potential", "context", "duration").collect()
    rows.sort(key=lambda r: (-r["potential"], -r["context"], r["duration"], r["doc_id"]))
    kept, seen = [], []
    for r in rows:
        s = set(r["text"].lower().split())
        if any(len(s & t) / len(s | t) >= 0.86 for t in seen):
            continue
        seen.append(s)
        kept.append(r)
    assert {r["doc_id"] for r in queries.greedy_dedupe(spark, sf).collect()} == {r["doc_id"] for r in kept}
    chosen, deferred, source, family = [], [], {}, {}
    for r in kept:
        if len(chosen) >= 50 or source.get(r["source_id"], 0) >= 8:
            continue
        if family.get(r["family"], 0) >= 14:
            deferred.append(r)
            continue
        chosen.append(r["doc_id"])
        source[r["source_id"]], family[r["family"]] = source.get(r["source_id"], 0) + 1, family.get(r["family"], 0) + 1
    for r in deferred if len(chosen) < 39 else []:
        if len(chosen) < 50 and source.get(r["source_id"], 0) < 8:
            chosen.append(r["doc_id"])
            source[r["source_id"]] = source.get(r["source_id"], 0) + 1
    assert sorted(r["doc_id"] for r in queries.portfolio(spark, sf).collect()) == sorted(chosen)


def test_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    near = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    for name, run in queries.QUERIES.items():
        out = run(spark, sf)
        rows = [tuple(r) for r in out.select(*sorted(out.columns)).collect()]
        if name in queries.SQL:
            cur = con.execute(queries.SQL[name])
            columns = [d[0] for d in cur.description]
            assert sorted(columns) == sorted(out.columns), name
            expected = [tuple(v for _, v in sorted(zip(columns, r), key=lambda x: x[0])) for r in cur.fetchall()]
            assert near(rows) == near(expected), name


def test_signals_work_out_the_words_once(spark):
    from spanloom.functions import signals

    found = spark.range(1).select(signals.text_signals(F.concat(F.col("id").cast("string"), F.lit(" the river is 12 percent wrong.")), F.lit("the river with")).alias("s"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # before, the text was joined from its words for each of some hundred cues
    assert plan.count("array_join(") <= 2
    assert found.first()["s"].asDict() == {
        "topic_relevance": 37.0, "claim_strength": 43.0, "conflict_or_stakes": 40.0, "proposal_strength": 24.0, "evidence_density": 58.0, "mobilization": 20.0,
        "specificity": 61.0, "conclusion": 65.0, "context_completeness": 80.0, "context_match": 60.0, "fit": found.first()["s"]["fit"],
    }
