import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import greedy, intervals

SCHEMA = "k long, id long, start double, end double"


def random_rows(seed, n=120, keys=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(0, 400)
        rows.append((rng.randrange(keys), i, float(a), float(a + rng.choice((0, 1, 3, 10, 90)))))
    return rows


def sides(spark, left, right):
    x = spark.createDataFrame(left, "k long, a_id long, a double, b double")
    y = spark.createDataFrame(right, "k long, b_id long, c double, d double")
    return x, y


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
@pytest.mark.parametrize("touch", [False, True])
def test_overlap_join_lists_each_pair_once(spark, width, touch):
    left, right = random_rows(1), random_rows(2)
    x, y = sides(spark, left, right)
    met = (lambda a, b, c, d: a <= d and c <= b) if touch else (lambda a, b, c, d: a < d and c < b)
    usable = (lambda r: True) if touch else (lambda r: r[3] > r[2])
    expected = sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and usable(p) and usable(q) and met(p[2], p[3], q[2], q[3]))
    x, y = (x, y) if touch else (x.filter("b > a"), y.filter("d > c"))
    assert sorted((r["a_id"], r["b_id"]) for r in intervals.overlap_join(x, y, ["k"], ("a", "b", "c", "d"), width, touch).collect()) == expected


def test_measures(spark):
    row = spark.createDataFrame([(10.0, 30.0, 20.0, 40.0)], "a double, b double, c double, d double")
    a, b, c, d = map(F.col, "abcd")
    out = row.select(intervals.iou(a, b, c, d), intervals.overlap_of_shorter(a, b, c, d), intervals.coverage_of_second(a, b, c, d), intervals.overlap_of_shorter(a, a, c, d)).first()
    assert round(out[0], 6) == 0.333333 and out[1] == 0.5 and out[2] == 0.5 and out[3] is None


def test_union_and_islands(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 8.0), (1, 2, 10.0, 12.0), (2, 3, 0.0, 9.0), (2, 4, 1.0, 2.0), (2, 5, 9.5, 9.9)], SCHEMA)
    out = {r["k"]: (r["covered"], r["n_islands"]) for r in intervals.union_length(rows, ["k"]).collect()}
    assert out == {1: (10.0, 2), 2: (9.4, 2)}
    assert intervals.merged(rows, ["k"], gap=60).count() == 2
    assert intervals.union_length(rows.limit(0), ["k"]).count() == 0


def test_coverage(spark):
    p = spark.createDataFrame([(1, 0, 10.0, 40.0), (1, 1, 80.0, 100.0)], SCHEMA)
    r = spark.createDataFrame([(1, 0, 12.0, 39.0), (1, 1, 80.0, 100.0), (2, 2, 0.0, 4.0)], SCHEMA)
    out = {x["k"]: (x["reference_length"], x["covered_length"], x["coverage_ratio"]) for x in intervals.reference_coverage(p, r, ["k"], 20.0).collect()}
    assert out == {1: (47.0, 47.0, 1.0), 2: (4.0, 0.0, 0.0)}


def test_timelines(spark):
    line = intervals.derived_timeline(spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 10.0, 20.0), (2, 2, 2.0, 6.0), (2, 3, 9.0, 13.0), (1, 9, 30.0, 30.0)], SCHEMA), ["k"])
    asked = spark.createDataFrame([(1, 1, 5.0, 8.0), (1, 2, 4.0, 6.0), (1, 3, 90.0, 95.0)], SCHEMA)
    out = sorted((r["id"], r["mapped_start"], r["mapped_end"]) for r in intervals.mapped(asked, line, ["k"], 4.0).collect())
    assert out == [(1, 10.0, 13.0), (2, 4.0, 5.0), (2, 10.0, 11.0)]
    back = intervals.mapped(spark.createDataFrame([(2, 1, 9.5, 11.0)], SCHEMA), line, ["k"], 4.0, to="derived").collect()
    assert [(r["mapped_start"], r["mapped_end"]) for r in back] == [(4.5, 6.0)]


def test_nearest_and_points(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 2.0), (2, 5.0)], "k long, at double")
    right = spark.createDataFrame([(1, 3.0), (1, 10.0), (1, 12.0)], "k long, scene double")
    out = {(r["k"], r["at"]): (r["before"] and r["before"]["scene"], r["after"] and r["after"]["scene"]) for r in intervals.nearest(left, right, ["k"], "at", "scene").collect()}
    assert out == {(1, 10.0): (10.0, 12.0), (1, 2.0): (None, 3.0), (2, 5.0): (None, None)}
    rows = spark.createDataFrame([(1, 0, 10.0, 20.0)], SCHEMA)
    points = spark.createDataFrame([(1, t) for t in (8.4, 8.5, 10.0, 20.0, 20.1)], "k long, t double")
    assert sorted(r["t"] for r in intervals.points_within(rows, points, ["k"], "t", 3.0, before=1.5).collect()) == [8.5, 10.0, 20.0]


def test_runs_and_sessions(spark):
    points = spark.createDataFrame([(1, float(t), v) for t, v in enumerate((0.1, 0.7, 0.8, 0.9, 0.9, 0.2, 0.9, 0.1, 0.7, 0.7, 0.7))], "k long, t double, v double")
    out = [(r["start"], r["end"], round(r["mean_level"], 4)) for r in intervals.runs_above(points, ["k"], "t", "v", 0.6, 3.0, 1.0).orderBy("start").collect()]
    assert out == [(1.0, 5.0, 0.7), (8.0, 11.0, 0.7)]
    rows = spark.createDataFrame([(1, float(s), float(s + 10), e) for s, e in ((100, 1), (150, 0), (200, 2), (700, 1), (2000, 0))], "k long, s double, e double, ev long")
    out = [(r["start"], r["end"], r["evidence"]) for r in intervals.sessions(rows, ["k"], "s", "e", "ev", 180, 30, 30, 60).orderBy("start").collect()]
    assert out == [(70.0, 210.0, 3), (670.0, 710.0, 1)]


def test_greedy_matches_equal_the_walk(spark):
    rng = random.Random(3)
    pairs = [(a, b, round(rng.random(), 1)) for a in range(25) for b in range(25) if rng.random() < 0.3]
    used_a, used_b, expected = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), expected.append((a, b))
    out = greedy.greedy_matches(spark.createDataFrame(pairs, "p long, r long, iou double"), "p", "r", [F.desc("iou"), "p", "r"])
    assert sorted((r["p"], r["r"]) for r in out.collect()) == sorted(expected)
    assert greedy.greedy_matches(spark.createDataFrame([], "p long, r long, iou double"), "p", "r", ["p"]).count() == 0


def test_greedy_keep_equals_the_walk(spark):
    rng = random.Random(4)
    rows = [(i, rng.sample(range(1000), 1)[0] * 100 + i) for i in range(60)]
    edges = [(a, b) for a in range(60) for b in range(a) if rng.random() < 0.06]
    kept = set()
    for i, _ in sorted(rows, key=lambda x: x[1]):
        if not any((i in e) and (set(e) - {i}) & kept for e in edges):
            kept.add(i)
    out = greedy.greedy_keep(spark.createDataFrame(rows, "id long, r long"), spark.createDataFrame(edges, "left long, right long"), "id", "r")
    assert {r["id"] for r in out.collect() if r["kept"]} == kept and out.count() == 60


@pytest.mark.parametrize("seed", range(4))
def test_capped_pick_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), rng.choice("aab")) for i in range(200)]
    most, per_source, per_family, target = rng.choice((10, 50)), rng.choice((3, 8)), rng.choice((4, 14)), 39
    chosen, deferred, s, f = [], [], {}, {}
    for row in rows:
        if len(chosen) >= most or s.get(row[1], 0) >= per_source:
            continue
        if f.get(row[2], 0) >= per_family:
            deferred.append(row)
            continue
        chosen.append(row[0])
        s[row[1]], f[row[2]] = s.get(row[1], 0) + 1, f.get(row[2], 0) + 1
    if len(chosen) < min(target, most):
        for row in deferred:
            if len(chosen) < most and s.get(row[1], 0) < per_source:
                chosen.append(row[0])
                s[row[1]] = s.get(row[1], 0) + 1
    out = greedy.capped_pick(spark.createDataFrame(rows, "rank long, source long, family string"), "rank", "source", "family", most, per_source, per_family, target)
    assert sorted(r["rank"] for r in out.collect()) == sorted(chosen)
