import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.plans.reports import VISUAL_RULES
from spanloom.operators import clips, folds, greedy, similarity

IV = "k string, id long, start double, end double"


def test_edges(spark):
    row = spark.range(1)
    words, edges = F.array(F.lit(1.0), F.lit(4.9), F.lit(5.1)), F.array(F.lit(4.0))
    v = lambda *c: tuple(row.select(*c).first())
    assert v(clips.snapped(F.lit(5.0), words, edges, 0.5), clips.snapped(F.lit(3.7), words, edges, 0.5), clips.snapped(F.lit(9.0), words, edges, 0.5)) == (4.9, 4.0, 9.0)
    none = F.lit(None).cast("double")
    assert [tuple(x) for x in v(clips.expanded(F.lit(1.0), F.lit(3.0), 8.0, none), clips.expanded(F.lit(18.0), F.lit(19.0), 8.0, F.lit(20.0)), clips.expanded(F.lit(1.0), F.lit(30.0), 8.0, none))] == [(0.0, 8.0), (12.0, 20.0), (1.0, 30.0)]
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    trims = v(*(clips.trimmed_to_words(F.lit(0.0), F.lit(30.0), F.array(*w), 20) for w in ((span(0.5, 1.0), span(28.0, 29.9)), (span(5.0, 6.0),), (span(0.1, 29.95),))), clips.trimmed_to_words(F.lit(0.0), F.lit(30.0), F.lit(None).cast("array<struct<start:double,end:double>>"), 20))
    assert [tuple(x) for x in trims] == [(0.38, 30.0, True), (0.8, 29.2, True), (0.0, 30.0, False), (0.0, 30.0, False)]


def test_scenes(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, 40.0), ("a", 2, 50.0, 229.5), ("b", 3, 10.0, 40.0), ("a", 4, 300.0, 305.0)], IV)
    scenes = spark.createDataFrame([("a", s) for s in (8.0, 8.5, 41.0, 49.5, 230.0)] + [("b", 9.0)], "k string, scene double")
    out = sorted((r["id"], r["start"], r["end"]) for r in clips.to_scenes(rows, scenes, ["k"], "id", 180.0, 20.0).collect())
    assert out == [(1, 8.5, 41.0), (2, 50.0, 229.5), (3, 10.0, 40.0)]


def test_chapters(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 50.0), ("a", 2, 90.0, 110.0), ("a", 3, 500.0, 520.0), ("a", 4, 50.0, 250.0)], IV)
    chapters = spark.createDataFrame([("a", 0, 0.0, 100.0), ("a", 1, 100.0, 180.0), ("a", 2, 190.0, 240.0)], "k string, index long, start double, end double")
    qa = spark.createDataFrame([("a", 6.0, 48.0)], "k string, start double, end double")
    out = {r["id"]: (r["chapter_ids"], r["coherence"], r["qa_bridge"]) for r in clips.with_chapters(rows, chapters, qa, ["k"], "id").collect()}
    assert out == {1: ([0], 100.0, True), 2: ([0, 1], 84.0, False), 3: (None, 35.0, False), 4: ([0, 1, 2], 52.0, False)}


def test_nearest_hook(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, float(a := rng.randrange(300)), float(a + rng.choice((5, 20)))) for i in range(60)]
    hooks = [(rng.choice("ab"), float(a := rng.randrange(300)), float(a + 3), float(i)) for i in range(15)] + [("c", 1.0, 2.0, 9.0)]
    out = {r["id"]: (r["hook_distance"], r["hook"] and r["hook"]["score"]) for r in clips.with_nearest_hook(spark.createDataFrame(rows + [("z", 99, 0.0, 9.0)], IV), spark.createDataFrame(hooks, "k string, start double, end double, score double"), ["k"], "id").collect()}
    for k, i, a, b in rows:
        ranked = sorted((0 if a < d and c < b else 1, 0.0 if a < d and c < b else min(abs(a - d), abs(c - b)), -s) for g, c, d, s in hooks if g == k)
        assert out[i] == (ranked[0][1], -ranked[0][2]), i
    assert out[99] == (None, None)


def test_hook_candidates(spark):
    said = [("a", 0.0, 4.0, "Why is the school budget cut?", False), ("a", 5.0, 9.0, "Therefore we see 50 percent gone", False), ("a", 10.0, 14.0, "why is the school budget cut", False), ("a", 400.0, 405.0, "plain words only here", True), ("b", 0.0, 1.0, "", False)]
    out = clips.hook_candidates(spark.createDataFrame(said, "k string, start double, end double, text string, overlap_suspected boolean"), "k", (("question", "^why"),), "therefore").orderBy(F.desc("score")).collect()
    assert [(r["segment_index"], r["family"], r["payoff"], r["score"]) for r in out] == [(0, "question", True, 73.0), (3, "other", False, 6.0)]


def test_diversity(spark):
    rows = spark.createDataFrame([("s", 1, 0.0, 10.0, "one two three", "a:x-y", 90.0, "p"), ("s", 2, 2.0, 9.0, "four five", "", 80.0, "p"), ("s", 3, 9.0, 19.0, "six seven", "a:x-y", 70.0, "q"), ("t", 4, 0.0, 10.0, "one two three", "", 60.0, None)], "k string, id long, start double, end double, text string, topic string, score double, kind string")
    pairs = clips.diversity_pairs(rows, "k", "id", ("kind",))
    assert {(r["left"], r["right"]): round(r["penalty"], 2) for r in pairs.collect()} == {(1, 2): 100.0, (1, 3): 48.0}
    out = clips.diversified(rows.withColumn("rank", -F.col("score")), pairs, "id", "rank", "score").orderBy("id").collect()
    assert [(r["id"], r["score"]) for r in out] == [(1, 90.0), (3, 64.0), (4, 60.0)]


def test_diversity_anywhere(spark):
    rng = random.Random(6)
    said = [" ".join(rng.choices("abcdefghijklmnop", k=rng.choice((3, 8, 12)))) for _ in range(25)] + ["", None]
    rows = []
    for i in range(140):
        start, t = float(rng.randrange(400)), rng.choice(said)
        if t and rng.random() < 0.4:
            t += " " + rng.choice("qrstu")
        topic = rng.choice(["", "a", f"{rng.choice('ab')}:{'-'.join(rng.sample('uvwxyz', rng.choice((2, 3))))}"])
        rows.append((rng.choice("stuv"), i, start, start + rng.choice((8.0, 30.0)), t, topic, float(rng.randrange(20, 100)), rng.choice(("p", "q", None)), rng.choice(("m", "n"))))
    table = spark.createDataFrame(rows, "k string, id long, start double, end double, text string, topic string, score double, kind string, mode string")

    def terms(topic):
        return {x for x in topic.partition(":")[2].split("-") if x}

    def penalty(x, y):
        same = x[0] == y[0]
        lap = max(0.0, min(x[3], y[3]) - max(x[2], y[2])) / min(x[3] - x[2], y[3] - y[2]) if same else 0.0
        a, b = set((x[4] or "").split()), set((y[4] or "").split())
        like = len(a & b) / len(a | b) * 80 if a and b else 0.0
        if same and lap <= 0.30 and sum(bool(x[c] and y[c] and x[c] != y[c]) for c in (7, 8)) >= 2:
            like = min(like, 64.0)
        a, b = terms(x[5]), terms(y[5])
        topic = len(a & b) / len(a | b) if same and a and b else 0.0
        topic += 0.15 if topic >= 0.34 and x[5][0] == y[5][0] else 0.0
        return max(lap * 100, like, min(1.0, topic) * 48)

    kept, expected = [], {}
    for x in sorted(rows, key=lambda r: (-r[6], r[1])):
        worst = max((penalty(x, y) for y in kept), default=0.0)
        if worst < 70:
            kept.append(x)
            expected[x[1]] = (round(worst, 6), float(max(0, int(x[6] - worst * 0.12)))) if worst >= 35 else (0.0, x[6])
    ranked = table.withColumn("rank", F.struct((-F.col("score")).alias("s"), "id"))
    out = clips.diversified_anywhere(ranked, "k", "id", "rank", "score", ("kind", "mode")).collect()
    assert {r["id"]: (round(r["penalty"], 6), r["score"]) for r in out} == expected and len(out) == len(expected)
    assert len({p for p, _ in expected.values()}) > 5 and clips.diversified_anywhere(ranked.limit(0), "k", "id", "rank", "score", ("kind",)).count() == 0


def test_sequence_ratio_and_previous(spark):
    pairs = [("abcd efg", "abcd xfg"), ("", "x"), (None, None), ("same", "same")]
    out = spark.createDataFrame(pairs, "a string, b string").select(clips.sequence_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in out] == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]
    schema = "k string, id long, start double, end double, text string, kind string, state string"
    new = [("a", 1, 0.0, 30.0, "x y z", "p", "u"), ("a", 2, 100.0, 130.0, "new words", "p", "u"), ("a", 3, 203.0, 235.0, "other", "p", "u"), ("a", 4, 320.0, 340.0, "the very same long text here", "p", "u"), ("b", 5, 0.0, 30.0, "x y z", "p", "u"), ("a", 6, 0.0, 30.0, "x y z", "q", "v")]
    old = [("a", 1, 10.0, 40.0, "q", "p", "u"), ("a", 2, 200.0, 230.0, "q", "p", "u"), ("a", 3, 345.0, 360.0, "the very same long text her", "p", "u")]
    left = clips.without_previous(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), ["k"], "id", ("kind", "state"))
    assert sorted(r["id"] for r in left.collect()) == [2, 5, 6]


def test_fingerprints(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 5.0), (3, 1.0, 2.0)], "id long, start double, end double")
    moves = spark.createDataFrame([(1, 1, 1.0, 9.0), (1, 2, 2.0, 8.0), (1, 3, 9.0, 1.0), (3, 1, 1.0, 2.0)], "id long, at long, start double, end double")
    assert sorted(map(tuple, clips.fingerprints(rows, moves, "id").collect())) == [(1, 0.0, 10.0, "canonical"), (1, 2.0, 8.0, "adjusted"), (3, 1.0, 2.0, "canonical")]


def test_assembly_and_ranges(spark):
    blocks = [("s", 0.0, 15.0, "And so", 10.0, False, False, ""), ("s", 15.5, 40.0, "it went on", 90.0, True, False, ""), ("s", 40.0, 60.0, "to an end.", 20.0, False, False, ""), ("s", 60.0, 70.0, "Short.", 80.0, False, False, ""), ("s", 70.0, 75.0, "unsafe", 5.0, False, True, "")]
    table = spark.createDataFrame(blocks, "k string, start double, end double, text string, score double, weak boolean, unsafe boolean, speaker string")
    out = folds.fold(table, "k", ["start"], clips.assembled(), clips.ASSEMBLED).collect()
    assert [(r["first_block"], r["last_block"], r["end"]) for r in out] == [(0, 2, 60.0)]
    segments = spark.createDataFrame([("s", i, i * 10.0, i * 10.0 + 10.0, f"t{i}") for i in range(5)], "k string, id long, start double, end double, text string")
    out = sorted((r["first_id"], r["last_id"], r["text"]) for r in clips.segment_ranges(segments, "k", 20, 30).collect())
    assert out == [(a, b, " ".join(f"t{i}" for i in range(a, b + 1))) for a in range(5) for b in range(a, 5) if 20 <= (b - a + 1) * 10 <= 30]


def test_formats_and_tracking(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None), (2, "stage", True, 1, 0.9, True), (3, None, True, 2, None, False), (4, None, None, 2, None, False), (5, "", False, 1, 0.9, True), (6, None, False, 1, 0.5, False)], "id long, declared string, podcast boolean, faces int, sure double, close boolean")
    f = clips.visual_format({"podcast": F.col("podcast"), "close_up": F.col("close")}, F.col("declared"), F.col("faces"), F.col("sure"), VISUAL_RULES)
    out = rows.select("id", f["format"].alias("f")).withColumn("l", clips.layout(F.col("f"), F.lit(True), F.lit(1))).orderBy("id").collect()
    assert [(r["f"], r["l"]) for r in out] == [("unknown", "keep_and_review"), ("stage", "keep_composition"), ("podcast", "keep_all_speakers"), ("interview", "keep_all_speakers"), ("close_selfie", "follow_speaker"), ("unknown", "keep_and_review")]
    points = spark.createDataFrame([(1, 0.0, 10.0, float(t), 0.5 + t * 0.01, 0.5, 0.9, 1) for t in range(10)] + [(2, 0.0, 10.0, float(t), 0.5 + 0.4 * (t % 2), 0.5, 0.9, 1) for t in range(10)] + [(3, 0.0, 10.0, 1.0, 0.5, 0.5, 0.2, 1)], "id long, start double, end double, time double, center_x double, center_y double, confidence double, face_count int")
    out = {r["id"]: (r["sure"], r["largest_jump"], r["motion"]) for r in clips.tracking(points, ["id"]).collect()}
    assert out == {1: (True, 0.01, 38.0), 2: (False, 0.4, 100.0)}


def test_evaluation(spark):
    p = spark.createDataFrame([("a", 0, 10.0, 40.0), ("a", 1, 80.0, 100.0), ("c", 1, 0.0, 5.0)], IV)
    r = spark.createDataFrame([("a", 0, 12.0, 39.0), ("a", 1, 80.0, 100.0), ("b", 2, 1.0, 2.0)], IV)
    out = {x["k"]: x for x in clips.evaluation(p, r, ["k"]).collect()}
    assert set(out) == {"a", "b"}
    a = out["a"]
    assert (a["precision"], a["recall"], a["matched"], a["hit_rate"], a["mean_start_error"], a["mean_end_error"]) == (1.0, 1.0, 2, 1.0, 1.0, 0.5)
    assert (out["b"]["precision"], out["b"]["recall"]) == (0.0, 0.0)
    assert {(x["k_"], x["recall"]) for x in clips.hits_at(p.withColumnRenamed("k", "g"), r.withColumnRenamed("k", "g"), ["g"], "id").withColumnRenamed("k", "k_").filter("g = 'a'").collect()} == {(1, 0.5), (3, 1.0), (5, 1.0), (10, 1.0)}


@pytest.mark.parametrize("empty", [True])
def test_empty_tables(spark, empty):
    rows = spark.createDataFrame([], IV)
    assert clips.evaluation(rows, rows, ["k"]).count() == 0
    assert clips.with_chapters(rows, rows.withColumnRenamed("id", "index"), rows, ["k"], "id").count() == 0


def test_diversity_in_time_equals_the_walk_over_all_pairs(spark):
    rng = random.Random(3)
    said = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice((0, 4, 12)))) for _ in range(12)]
    rows = []
    for i in range(220):  # half of the rows share one crowded minute
        start = rng.choice((rng.randrange(50), rng.randrange(600))) * 1.0
        rows.append((i, rng.choice(("a", "b", None)), start, start + rng.choice((8, 20, 45)), rng.choice(said) + rng.choice(("", " more")), rng.choice(("x", "y", "")), rng.choice(("m", "n")), float(rng.randrange(40, 101))))
    table = spark.createDataFrame(rows, "id long, k string, start double, end double, text string, kind string, mode string, score double")
    table = table.withColumn("rank", F.struct((-F.col("score")).alias("s"), "id"))
    pairs = clips.diversity_pairs(table.withColumn("topic", F.lit("")), "k", "id", ("kind", "mode"))
    shown = lambda df: sorted((r["id"], r["score"], round(r["penalty"], 9)) for r in df.collect())
    want = shown(clips.diversified(table, pairs, "id", "rank", "score"))
    assert shown(clips.diversified_in_time(table, "k", "id", "rank", "score", ("kind", "mode"))) == want
    assert 60 < len(want) < 200 and len({p for _, _, p in want}) > 5


def test_diversity_in_time_reads_few_texts_in_few_rounds(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):  # near texts in a crowded time, of which rows of no length or no time are part
        start = float(rng.randrange(1500)) if i % 50 else None
        end = None if start is None else start + (rng.choice((9, 30, 95, 700)) if i % 9 else 0)
        rows.append((i, "a", start, end, " ".join(w for w in words if w != f"w{rng.randrange(60)}"), float(rng.randrange(40, 101))))
    table = spark.createDataFrame(rows, "id long, k string, start double, end double, text string, score double").withColumn("rank", F.struct((-F.col("score")).alias("s"), "id"))
    met, cuts = [], []
    near, cut = similarity._near, greedy.cut
    monkeypatch.setattr(similarity, "_near", lambda pairs, *rest: (met.append(pairs.count()), near(pairs, *rest))[1])
    monkeypatch.setattr(greedy, "cut", lambda df: (cuts.append(1), cut(df))[1])
    out = {r["id"]: r["penalty"] for r in clips.diversified_in_time(table, "k", "id", "rank", "score", ()).collect()}
    want: dict[int, float] = {}
    for i, _, start, end, said, score in sorted(rows, key=lambda r: (-r[5], r[0])):
        worst = 0.0
        for j in want if start is not None else ():
            _, _, a, b, other, _ = rows[j]
            if a is not None and a < end and start < b:
                x, y = set(said.split()), set(other.split())
                short = min(end - start, b - a)
                worst = max(worst, len(x & y) / len(x | y) * 80, (min(end, b) - max(start, a)) / short * 100 if short else 0)
        if worst < 70:
            want[i] = worst
    assert {i: round(p, 9) for i, p in out.items()} == {i: round(p, 9) for i, p in want.items()}
    assert sum(met) == 0 and len(cuts) < 100 and 20 < len(want) < 100


def test_topics_count_words_within_their_row(spark, capsys):
    rows = spark.createDataFrame([(1, "Bela bela casa 1234 1234 1234 casa azul dia"), (2, None), (3, "12345 abc")], "id long, text string")
    out = clips.topics(rows, "id", F.lit("k"))
    assert {r["id"]: r["topic"] for r in out.collect()} == {1: "k:azul-bela-casa", 2: "k", 3: "k"}
    out.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_near_texts_of_rows_that_time_rules_out_are_not_paired(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, f"s{i % 2}", float(i % 7), 100.0 + i % 7, " ".join(w for w in words if w != f"w{rng.randrange(60)}"), "", 50.0) for i in range(160)]
    rows += [(200, "s3", 0.0, 9.0, " ".join(words), "", 90.0), (201, "s3", 500.0, 509.0, "else", "", 80.0)]
    table = spark.createDataFrame(rows, "id long, k string, start double, end double, text string, topic string, score double")
    met = []
    real = similarity._near
    monkeypatch.setattr(similarity, "_near", lambda pairs, *rest: (met.append(pairs.count()), real(pairs, *rest))[1])
    out = clips.diversified_anywhere(table.withColumn("rank", F.struct((-F.col("score")).alias("s"), "id")), "k", "id", "rank", "score", ()).collect()
    assert {r["id"] for r in out} == {200, 201} and sum(met) < 200  # of 1,770 pairs of near texts, 59 with the best
