import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import near_dedup
from spanloom.llm.common import Scratch, hot_keys, joined_by
from spanloom.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(d, grams(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return sorted(((d, len(s), None if d is None else top(d), d is None or top(d) == d) for d, s in sets), key=repr)


def found(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)


def mixed_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    rows, n = [], 0
    for size in (1, 1, 2, 3, 25, 60):
        base = [word() for _ in range(rng.choice((5, 40, 120)))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                text[rng.randrange(len(text))] = word()
            rows.append((n, " ".join(text)))
            n += 1
    passage = " ".join(word() for _ in range(30))
    for _ in range(40):  # one passage in many short documents of their own
        rows.append((n, passage + " " + " ".join(word() for _ in range(rng.choice((4, 12, 30))))))
        n += 1
    rng.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark):
    rows = mixed_rows(3)
    assert found(spark, rows) == brute(rows)


def test_chains_without_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):  # each differs a little from the one before, much from the first
        base[rng.randrange(80)] = f"x{i}"
        rows.append((100 - i, " ".join(base)))
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A B C D E F"), (9, "É b c d e f"), (10, "é b c d e f"), (None, "a b c d e f"), (11, "x " * 30000)]
    assert found(spark, rows) == brute(rows)


def test_one_id_with_two_texts_joins_their_groups(spark):
    rows = [(1, "a b c d e f"), (2, "p q r s t u"), (5, "a b c d e f"), (5, "p q r s t u")]
    assert [r[2] for r in found(spark, rows)] == [1, 1, 1, 1]


def keys_of(*texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": list(texts)})
    return [k for x in near_dedup._features(iter([batch])) for k in x.column("bands").to_pylist()]


def test_each_text_of_an_id_links_it_in_mixed_buckets(spark, monkeypatch):
    """Ids 900 and 901 are linked by a text, and all buckets of both have a pivot that is near to other texts of 900."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    rng, n = random.Random(4), itertools.count()
    fresh = lambda k: [f"n{next(n)}" for _ in range(k)]
    one = fresh(300)
    other = one[:267] + fresh(33)
    hashes, (mul, add) = near_dedup.WordHashes(), near_dedup._BANDED
    x = np.array([int(near_dedup.shingles(" ".join(one[i : i + 5]), hashes)[0]) >> 32 for i in range(296)], dtype=np.uint32)
    least = (x[:, None] * mul[None] + add[None]).argmin(axis=0).reshape(near_dedup.BANDS, near_dedup.ROWS)
    left, right = keys_of(" ".join(one), " ".join(other))
    rows = [(900, " ".join(one)), (901, " ".join(other))]
    for band in [i for i in range(near_dedup.BANDS) if left[i] == right[i]]:
        for _ in range(500):
            take = {w for q in least[band] for w in range(max(0, q - rng.randrange(24)), min(267, q + 5 + rng.randrange(24)))}
            pivot = [one[w] for w in sorted(take)]
            if len(take) <= 165 and keys_of(" ".join(pivot))[0][band] == left[band]:
                break
        else:
            raise AssertionError("no pivot")
        rows += [(band, " ".join(pivot)), (900, " ".join(pivot + fresh(round(len(pivot) * 0.35))))]
    expected = brute(rows)
    assert {r[2] for r in expected if r[0] >= 900} == {900}
    assert found(spark, rows) == expected


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 3, "q"), (2, "a b c d e f", 4, "q")], "doc_id long, text string, n long, component_id string")
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("edges,expected", [
    ([(1, 2), (2, 3), (3, 4), (5, 6), (9, 9), (None, 3), (4, 3)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}),
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(7, i) for i in range(50)], {i: 0 for i in range(50)}),
    ([], {}),
])
def test_components(spark, edges, expected):
    scratch = Scratch(spark, "test")
    out = connected_components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()
    assert {r["id"]: r["component"] for r in out} == expected and len(out) == len(expected)
    scratch.close()


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    hot, asked = near_dedup.hot_keys, []

    def at_once(counts, key):
        asked.append(hot(counts, key, least=5, share=50))
        return asked[-1]

    monkeypatch.setattr(near_dedup, "hot_keys", at_once)
    rows = mixed_rows(3)
    assert found(spark, rows) == brute(rows)
    assert sum(map(bool, asked)) > 2 and all(len(keys) <= 50 for keys in asked)


def test_hot_keys_are_bounded_and_joined_in_full(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    keys = hot_keys(rows.groupBy("k").agg(F.count("*").alias("c")), "k")
    table = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert keys == [0]
    for how in ("inner", "left"):
        out = joined_by(rows, table, "k", ["id"], keys, how)
        assert out.count() == 5000 and out.filter("v <> 2 * k").count() == 0
    assert hot_keys(rows.limit(0).groupBy("k").agg(F.count("*").alias("c")), "k") == []


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rows = mixed_rows(5)[:90]
    assert found(spark, rows) == brute(rows)
