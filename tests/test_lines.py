import random

from spanloom.functions import text


def lines(value, most, ideal):
    words = (value or "").split()
    if len(words) <= 3:
        return [" ".join(words)] if words else []
    target = max(11, min(ideal, max(11, round(len(" ".join(words)) / most)) + 4))
    out, held = [], []
    for i, word in enumerate(words):
        if held and len(" ".join([*held, word])) > target and len(out) < most - 1 and len(words) - i >= most - len(out):
            out.append(" ".join(held))
            held = []
        held.append(word)
    return [*out, " ".join(held)]


def test_balanced_lines_equal_a_loop(spark):
    rng = random.Random(4)
    values = [None, "", "  ", "one", "one two three", " one  two\tthree four ", "x" * 80, "a " * 200]
    values += [" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(4, 30))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    for most, ideal in ((3, 22), (1, 22), (2, 30), (5, 12)):
        found = rows.select("i", text.balanced_lines(rows["t"], most, ideal).alias("lines")).collect()
        assert [r["lines"] for r in sorted(found)] == [lines(v, most, ideal) for v in values]
