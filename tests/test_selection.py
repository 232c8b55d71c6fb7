import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.functions import signals
from spanloom.operators import clips, greedy, review, selection

CLIP = "id long, source_id string, start double, end double, text string, potential long, confidence double"


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def overlap(a, b):
    return max(0.0, min(a[3], b[3]) - max(a[2], b[2])) / min(a[3] - a[2], b[3] - b[2])


def alike(a, b):
    x, y = (" ".join("".join(c if c.isalnum() or c == " " else " " for c in t.lower()).strip().split(" ")) for t in (a[4] or "", b[4] or ""))
    if not x.strip() or not y.strip():
        return 0.0
    s, t = set(x.split()), set(y.split())
    return max(len(s & t) / len(s | t), SequenceMatcher(None, x, y).ratio())


def made(rng, n):
    word = lambda: rng.choice("river city market night house train paper green stone light".split())
    rows = []
    for i in range(n):
        start = float(rng.randrange(0, 900))
        text = " ".join(word() for _ in range(rng.choice((0, 6, 9))))
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[4]
        rows.append((i, rng.choice("ab"), start, start + rng.choice((10.0, 25.0, 60.0)), text, rng.randrange(100), rng.randrange(10) / 10))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_equals_the_stages(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 70)
    first, rest = [r for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4]
    rest += [(900, *first[0][1:]), (901, "b", -5.0, 3.0, "x", 1, 0.1), (902, "b", 9.0, 9.0, "y", 1, 0.1)]
    expected, most = {"a": 100, "b": 3}, 9
    wanted = []
    for source, least in expected.items():
        own = [(*r, 0) for r in first if r[1] == source]
        if len(own) < least:
            places = {(r[2], r[3]) for r in own}
            own += [(*r, 1) for r in rest if r[1] == source and (r[2], r[3]) not in places]
        own = sorted((r for r in own if r[2] >= 0 and r[3] > r[2]), key=lambda r: (r[7], -r[5], -r[6], r[3] - r[2], r[0]))
        kept = []
        for r in own:
            if all(overlap(r, k) <= 0.30 and alike(r, k) < 0.90 for k in kept):
                kept.append(r)
        wanted += [(source, place + 1, r[0], ("primary", "fallback")[r[7]]) for place, r in enumerate(kept[:most])]
    table = spark.createDataFrame(list(expected.items()), "source_id string, expected int")
    out = selection.select_and_rank(spark.createDataFrame(first, CLIP), spark.createDataFrame(rest, CLIP), table, most=most)
    assert sorted(map(tuple, out.select("source_id", "place", "id", "origin").collect())) == sorted(wanted)
    counts = {r["source_id"]: (r["n_final"], r["reason"]) for r in selection.selection_counts(spark.createDataFrame(first, CLIP), out, table).collect()}
    assert counts["a"] == (sum(w[0] == "a" for w in wanted), "thin_pool")


def test_a_dropped_row_stands_for_no_equal_text(spark):
    rows = [(1, "s", 0.0, 10.0, "first", 90), (2, "s", 1.0, 11.0, "same words Y", 80), (3, "s", 100.0, 110.0, "same words Y", 70), (4, "s", 200.0, float("nan"), "z", 1), (5, None, 0.0, 10.0, "first", 1)]
    table = spark.createDataFrame(rows, "id long, source_id string, start double, end double, text string, potential int").withColumn("r", F.struct(-F.col("potential"), "id"))
    assert sorted(r["id"] for r in selection.without_overlaps(table, "source_id", "r").collect()) == [1, 3]
    assert selection.without_overlaps(table.limit(0), "source_id", "r").count() == 0
    # no word in common, but 0.92 of the sequence
    near = [(1, "s", 0.0, 10.0, "abcdefghijkl mnopqrstuvwx", 9), (2, "s", 50.0, 60.0, "abcdefghijklz mnopqrstuvwxz", 8), (3, "t", 50.0, 60.0, "abcdefghijklz mnopqrstuvwxz", 8)]
    table = spark.createDataFrame(near, "id long, source_id string, start double, end double, text string, potential int").withColumn("r", F.struct(-F.col("potential"), "id"))
    assert sorted(r["id"] for r in selection.without_overlaps(table, "source_id", "r").collect()) == [1, 3]


def changed(rng, value, share):
    return "".join("" if rng.random() < share / 2 else (c + rng.choice("abcxyz") if rng.random() < share / 2 else c) for c in value)


def test_texts_of_any_length_equal_a_walk_over_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh ", k=n)) for n in (5, 12, 20, 40, 90, 190, 230, 400, 900)]
    base += [" ".join("".join(rng.choices("aeioutnrs", k=rng.randint(2, 7))) for _ in range(n)) for n in (4, 30, 60, 150)]
    rows = []
    for i in range(200):
        value = changed(rng, rng.choice(base), rng.choice((0, 0, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15)))
        if rng.random() < 0.1:
            value = " ".join(rng.sample(value.split(" "), value.count(" ") + 1))
        start = rng.randrange(40) * 25.0
        rows.append((i, rng.choice("st"), start, start + rng.choice((10.0, 20.0, 40.0)), value if rng.random() < 0.9 else rng.choice(("", None)), rng.random()))
    kept = []
    for r in sorted(rows, key=lambda r: r[5]):
        if all(k[1] != r[1] or overlap(r, k) <= 0.30 and alike(r, k) < 0.90 for k in kept):
            kept.append(r)
    table = spark.createDataFrame(rows, CLIP.replace("potential long", "rank double").replace(", confidence double", ""))
    assert sorted(r["id"] for r in selection.without_overlaps(table, "source_id", "rank").collect()) == sorted(k[0] for k in kept)
    texts = sorted({(r[1], " ".join(r[4].split(" ")).strip()) for r in rows if r[4]} - {("s", ""), ("t", "")})
    numbered = [(i, s, t) for i, (s, t) in enumerate(texts)]
    wanted = {(i, j) for i, s, a in numbered for j, t, b in numbered if s == t and i != j and SequenceMatcher(None, a, b).ratio() >= 0.90}
    found = clips.sequence_pairs(spark.createDataFrame(numbered, "i long, s string, p string"), "s", "i", "p")
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_seeds_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    blocks = [(i, rng.choice(("a", "b", None)), float(s := rng.randrange(300)), s + rng.choice((0.0, 20.0, 40.0)), rng.choice(("text", " ")), rng.choice((None, 5, 50)), rng.choice((None, 3, 30))) for i in range(60)]
    rows = [(rng.choice(("a", "b", None)), float(s := rng.randrange(300)), s + 25.0) for _ in range(6)]
    wanted = []
    for source in "ab":
        taken = [(0, 0, s, e) for k, s, e in rows if k in (source, None)]
        order = sorted((b for b in blocks if b[1] == source and b[3] > b[2] and b[4].strip()), key=lambda b: (-(-1 if b[5] is None else b[5]), -(-1 if b[6] is None else b[6]), b[0]))
        seeds = []
        for b in order:
            if len(seeds) < 5 and all(overlap(b, t) < 0.72 for t in taken):
                seeds.append(b[0])
                taken.append(b)
        wanted += [(source, i + 1, b) for i, b in enumerate(seeds)]
    out = selection.block_seeds(
        spark.createDataFrame(rows, "source_id string, start double, end double"),
        spark.createDataFrame(blocks, "id long, source_id string, start double, end double, text string, self_contained int, density int"), "source_id", "id", most=5,
    )
    assert sorted((r["source_id"], r["place"], r["id"]) for r in out.collect()) == sorted(wanted)


def test_decisions_equal_a_sequential_replay(spark):
    rng = random.Random(3)
    clips = [(i, rng.choice(("k1", "k2", "k3", "")), rng.choice(("s", "t", "")), float(i % 4 * 10), float(i % 4 * 10 + 5)) for i in range(12)]
    feedback = [(i, rng.randrange(12), rng.choice(("approved", "rejected", "note")), rng.choice(("", "x")), rng.choice(([], ["t"])), rng.randrange(100)) for i in range(15)]
    records = [
        (i, rng.choice(("k1", "k2", "k9", "", None)), rng.choice(("approved", "rejected", "other")), rng.choice(("", "x")), rng.choice(([], ["t"])), rng.choice((None, *range(0, 150, 7))), rng.choice(("s", "t", "")), rng.choice((0.25, 10.5, 20.0, None)), rng.choice((5.0, 14.6, 25.5)))
        for i in range(80)
    ]
    last = {c: max((f for f in feedback if f[1] == c and f[2] != "note"), default=None) for c in range(12)}
    last = {c: f and (f[2:5], f[5]) for c, f in last.items()}
    wanted, now = [], 10**6
    for pos, key, action, reason, tags, at, sig, start, end in records:
        if not key or action == "other" or at is None:
            wanted.append((pos, None, "invalid"))
            continue
        clip = max((c for c in clips if c[1] == key), default=None)
        if clip and sig and clip[2] and sig != clip[2]:
            clip = None
        if not clip and sig and start is not None:
            clip = max((c for c in clips if c[2] == sig and abs(c[3] - start) <= 0.5 and abs(c[4] - end) <= 0.5), default=None)
        if not clip:
            wanted.append((pos, None, "unmatched"))
        elif last[clip[0]] and last[clip[0]][0] == (action, reason, tags):
            wanted.append((pos, clip[0], "already_current"))
        elif last[clip[0]] and at <= last[clip[0]][1]:
            wanted.append((pos, clip[0], "skipped_older"))
        else:
            last[clip[0]] = ((action, reason, tags), now)
            wanted.append((pos, clip[0], "imported"))
    out = review.restored(
        spark.createDataFrame(records, "pos long, editorial_key string, action string, reason string, tags array<string>, at long, signature string, start double, end double"),
        spark.createDataFrame(clips, "id long, editorial_key string, signature string, start double, end double"),
        spark.createDataFrame(feedback, "id long, clip_id long, action string, reason string, tags array<string>, at long"),
    )
    assert sorted(map(tuple, out.select("pos", "clip_id", "outcome").collect())) == sorted(wanted, key=lambda w: w[0])
    assert len({w[2] for w in wanted}) == 5
    assert sum(review.outcome_counts(out).first()[1:]) == len(records)


def test_capped_pick_with_missing_names(spark):
    rows = [(i, None if i % 3 == 0 else i % 5, None if i % 4 == 0 else "f") for i in range(60)]
    out = greedy.capped_pick(spark.createDataFrame(rows, "rank long, source long, family string"), "rank", "source", "family", 10, 2, 3, 8)
    sources, families, chosen, late = {}, {}, [], []
    for r, s, f in rows:
        if len(chosen) < 10 and sources.get(s, 0) < 2:
            if families.get(f, 0) >= 3:
                late.append((r, s))
                continue
            chosen.append(r)
            sources[s], families[f] = sources.get(s, 0) + 1, families.get(f, 0) + 1
    if len(chosen) < 8:
        for r, s in late:
            if len(chosen) < 10 and sources.get(s, 0) < 2:
                chosen.append(r)
                sources[s] = sources.get(s, 0) + 1
    assert sorted(r["rank"] for r in out.collect()) == sorted(chosen)


def test_portfolio_with_favorability(spark):
    rows = [(i, f"s{i}", "f", f"text number {i} of its own words {i}", 70, 80, 80, 30, (i % 2 == 0, 90.0, i == 4)) for i in range(6)]
    table = spark.createDataFrame(rows, "id long, source_id string, family string, text string, potential long, context long, complete long, duration long, fav struct<available:boolean,signal:double,review:boolean>")
    out = {r["id"]: (r["rank"], r["potential"]) for r in selection.rank_portfolio(table, favorability="fav", per_family=9).collect()}
    assert [out[i][1] for i in range(6)] == [71.6, 70.0, 71.6, 70.0, 70.0, 70.0]
    assert [out[i][0] for i in (0, 2, 1, 3, 4, 5)] == [1, 2, 3, 4, 5, 6]


def test_portfolio_of_large_ids_and_long_clips(spark):
    rows = [(5 * 10**12, "s", "f", "one text of words", 70, 80, 80, 10), (3, "t", "f", "another one of them", 70, 80, 80, 11), (4, "u", "f", "the third says more", 70, 81, 80, 5000), (2, "v", "g", "fourth has its own", 70, 80, 80, 5000)]
    table = spark.createDataFrame(rows, "id long, source_id string, family string, text string, potential long, context long, complete long, duration long")
    out = selection.rank_portfolio(table).orderBy("rank").collect()
    assert [r["id"] for r in out] == [4, 5 * 10**12, 3, 2]


def test_signals_of_odd_values(spark):
    none = F.lit(None)
    assert one(spark, signals.speaker_boundary(none.cast("boolean"), none.cast("double"), none.cast("boolean")), signals.hook_proximity(none.cast("double"), F.lit(1.0)), signals.hook_proximity(F.lit(90.0), F.lit(6.0))) == (50.0, 50.0, 61.0)
    assert one(spark, signals.reason_alignment(F.lit(3), F.lit(4)), signals.reason_alignment(F.lit(1), F.lit(2)), signals.counter_response(F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(9))) == (62.5, 50.0, 50.0)
    entities = {"x": r"\bann\b", "y": r"\bbob\b", "z": r"\bcarl\b"}
    roles = one(spark, signals.entity_roles(F.lit("Ann came. Bob proves it. Unlike Ann, Bob stayed."), {"x": entities["x"], "z": entities["z"]}, "unlike", "proves"), signals.entity_roles(F.lit("Bob proves it. Bob left."), {"y": entities["y"]}, "unlike", "proves"))
    assert roles == ({"x": "comparative"}, {"y": "central"})
    texts = one(spark, signals.speaker_marker(F.lit(" >> Ann Lee: hello")), signals.speaker_marker(F.lit("ann: hello")), signals.context_names(F.lit("Ann, met Bobby and ann Ed ANN")), signals.context_words(F.lit("a we, go!"), ("we",)))
    assert texts == ("Ann Lee", None, ["Ann", "Bobby"], ["go"])
    assert one(spark, signals.is_impact_word(F.lit("(Never!)")), signals.is_impact_word(F.lit("abc1")), signals.is_impact_word(F.lit("x")), signals.ends_open(none.cast("string")), signals.ends_open(F.lit("and then because"))) == (True, True, False, True, True)
    for bad in (None, "", "x" * 50_000, "?!" * 100):
        s = one(spark, signals.text_signals(F.lit(bad).cast("string"), none.cast("string")), signals.block_score(F.lit(bad).cast("string"), F.lit(20), F.lit(0), F.lit(0.0)))
        assert 0 <= s[1] <= 100 and all(0 <= v <= 108 for v in s[0])
    type_of = lambda a, b, flag: signals.editorial_type({"a": F.lit(a), "b": F.lit(b)}, "none", (F.lit(flag), "b"))
    assert one(spark, type_of(60.0, 60.0, False), type_of(60.0, 50.0, True), type_of(40.0, 44.0, None)) == ("a", "b", "none")


def test_review_fields_of_odd_values(spark):
    raw = F.lit('{"applied": true, "original_start": 1.23456, "original_end": 2, "adjusted_start": -1, "adjusted_end": 3}')
    s = one(spark, review.scene_change(raw), review.scene_change(F.lit('{"applied": 0, "direction": "outward_only", "original_start": "x"}')), review.allowed(F.lit("not json"), review.SCORECARD))
    assert s[0] is None and s[1]["applied"] is False and s[1]["direction"] == "outward_only" and s[1]["original_start"] is None and not any(s[2])
    b = one(spark, review.bounds(F.lit("5"), F.lit(None), F.lit(1.0), F.lit(float("nan")), F.lit("rendered")))[0]
    assert tuple(b["original"]) == (5.0, 5.0, 0.0) and b["status"] == "rendered" and tuple(b["active"]) == (1.0, 5.0, 4.0)
    clips = spark.createDataFrame([(0.0, 5.0, "odd", " ", "t", None, "", ["a", " "], None), (3.0, 3.0, None, None, None, None, None, None, None)], "start double, end double, state string, thesis string, title string, reason string, family string, tags array<string>, moments array<struct<kind:string,start:double,end:double,reason:string>>")
    out = review.block_dossier(clips).collect()
    assert len(out) == 1 and out[0]["block"]["state"] == "candidate" and out[0]["block"]["thesis"] == "t" and out[0]["block"]["tags"] == ["a"] and out[0]["block"]["moments"][0]["kind"] == "primary"


def test_sql_functions_equal_the_columns(spark):
    from spanloom.functions import scoring, sql, text

    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    rows = spark.createDataFrame([("Été  à la Mer!", 75.0), (None, 49.0), (" a b ", 50.0)], "t string, s double")
    rows.createOrReplaceTempView("odd_texts")
    found = spark.sql("SELECT sl_folded(t), sl_collapsed(t), sl_words(t), sl_slug(t, 8), sl_grade(s), sl_jaccard(sl_words(t), array('a', 'b', 'c')), sl_iou(0, 4, 2, 6), sl_overlap(0, 4, 2, 6), sl_bounded(s * 2), sl_search_score(0.7, 1, 0.25) FROM odd_texts").collect()
    t = F.col("t")
    columns = (text.folded(t), text.collapsed(t), text.words(t), text.slug(t, 8), scoring.grade(F.col("s")), text.jaccard(text.words(t), F.array(*map(F.lit, "abc"))))
    expected = rows.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()
    assert [tuple(r)[:6] for r in found] == [tuple(r) for r in expected]
    assert tuple(found[0])[6:] == (2 / 6, 0.5, 100.0, 71.5)


def test_selected_blocks(spark):
    from spanloom.operators import answers

    blocks = spark.createDataFrame([("a", i, i * 15.0, i * 15.0 + 15.0, f"t{i}") for i in range(20)] + [("b", 0, 0.0, 5.0, "x")], "k string, index long, start double, end double, text string")
    good = '```json\n[{"blocks": [2, 1], "hook": "A", "title": “one”,}, {"blocks": [1, 3]}, {"blocks": [3, 3]}, {"blocks": []}, {"blocks": ["x"]}, {"blocks": [19, 20]}, {"blocks": [20, 21]}, {"blocks": [0]}, 7]\n```'
    loose = 'I chose {"blocks": [4, 5], "flow": "A"} and { broken } and {"blocks": [0,1,2,3,4,5,6,7,8,9,10,11,12,13]}'
    rows = [("a", good), ("a", loose), ("b", '[{"blocks": [0]}]'), ("c", '[{"blocks": [0]}]'), ("a", None), ("a", "no")]
    out = answers.selected_blocks(spark.createDataFrame(rows, "k string, answer string"), blocks, "k").collect()
    assert sorted((r["first"], r["last"], r["start"], r["end"], r["title"], r["score"]) for r in out) == [
        (0, 13, 0.0, 180.0, "", 55), (1, 2, 15.0, 45.0, "one", 62), (4, 5, 60.0, 90.0, "", 67), (18, 19, 270.0, 300.0, "", 55),
    ]
    assert next(r["text"] for r in out if r["first"] == 1) == "t1 t2"


def test_near_texts_are_looked_for_among_kept_rows_only(spark, monkeypatch):
    # near copies that crowd one time; before, all their pairs were matched
    texts = [" ".join([f"word{i}", *(f"same{j}" for j in range(30))]) for i in range(120)]
    rows = [(i, "s", 10.0 + i / 100, 40.0 + i / 100, x, i) for i, x in enumerate(texts)] + [(500, "s", 900.0, 930.0, texts[7], 900), (501, "s", 990.0, 999.0, "something else", 901)]
    seen, links = [], clips.text_links
    monkeypatch.setattr(clips, "text_links", lambda kept, *a: seen.append(kept.count()) or links(kept, *a))
    table = spark.createDataFrame(rows, "id long, source_id string, start double, end double, text string, rank long")
    assert sorted(r["id"] for r in selection.without_overlaps(table, "source_id", "rank").collect()) == [0, 501]
    assert seen == [3, 2]


def test_a_walk_drops_only_what_is_worse(spark):
    rows = spark.createDataFrame([("b", 0, ["x"]), ("r", 1, ["x", "p"]), ("f", 2, ["o"]), ("g", 3, ["p"])], "id string, rank long, places array<string>")
    linked = spark.createDataFrame([("p", "o")], "place string, other string")
    kept = greedy.walked(rows, "id", "rank", "places", linked, lambda kept, rest: rest.limit(0))
    assert sorted(r["id"] for r in kept.collect()) == ["b", "f", "r"]


@pytest.mark.parametrize("near", [0.86, 0.9])
def test_grams_in_common_lose_no_near_text(near):
    rng = random.Random(3)
    judged, found = clips.Nearness(near), 0
    for _ in range(1500):
        base = "".join(rng.choices(rng.choice(("ab", "abcdefgh ", "aaaaaaaaaab", "xyz")), k=rng.choice((1, 3, 8, 30, 199, 200, 320))))
        a, b = changed(rng, base, rng.choice((0, 0.03, 0.08, 0.12))), changed(rng, base, rng.choice((0, 0.03, 0.08)))
        wanted = bool(a and b) and SequenceMatcher(None, a, b).ratio() >= near
        assert bool(a and b and judged(a, b)) == wanted
        found += wanted
    assert 200 < found < 1400


def test_variants_of_a_text_are_not_paired_with_each_other(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(3):  # nearly all variants of a text are near to each other, some are not
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts += [" ".join(w for k, w in enumerate(base) if k not in rng.sample(range(80), rng.randrange(14))) for _ in range(100)]
    texts += [texts[0], texts[5].upper(), "", None, "one", "two"]
    table = spark.createDataFrame([(i, t, rng.choice((70.0, 80.0, None)), float(rng.randrange(3)), 1.0) for i, t in enumerate(texts)], "id long, text string, potential double, context double, duration double")
    sets = {i: frozenset((t or "").lower().split()) for i, t in enumerate(texts)}
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.86
    kept = []
    for r in sorted(table.collect(), key=lambda r: (r["potential"] is None, -(r["potential"] or 0), -r["context"], r["id"])):
        if not any(near(sets[r["id"]], sets[k]) for k in kept):
            kept.append(r["id"])
    given = []
    real = greedy.greedy_keep
    monkeypatch.setattr(greedy, "greedy_keep", lambda rows, conflicts, *names: (given.append(conflicts.count()), real(rows, conflicts, *names))[1])
    found = {r["id"]: r["class_id"] for r in selection.without_repetitions(table).collect()}
    assert found == {i: min((j for j in sets if sets[i] and sets[j] == sets[i]), default=i) for i in kept}
    pairs = sum(near(sets[a], sets[b]) for a in sets for b in range(a))
    assert max(given) < pairs / 4 and pairs > 5000
