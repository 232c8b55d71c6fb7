import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from spanloom.llm import collocations, repair

TEXTS = "lang string, text string"


def brute_phrases(rows, least, longest, covered, top):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in candidates.items():
        inside = lambda q: any(list(q[i : i + len(words)]) == words for i in range(1, len(q)))
        if any(q[0] == lang and len(q) > len(words) + 1 and 100 * b >= covered * a and inside(q) for q, b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])]))
    ranked = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        for rank, (_, score, a, phrase, left, right) in enumerate(itertools.islice(group, top), 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def sentences(rng, n):
    words = ["the", "of", "A", "é", "long", "word x", "x\x00y", "aa", "bb", "cc", "ß"]
    make = lambda: "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "! ?")) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(("en", "en", "en", "de", None, "und")), rng.choice((make(), make(), make() + "the long word of a aa bb cc the long word of", "", None))) for _ in range(n)]


@pytest.mark.parametrize("shard,batch,few", [(collocations.SHARD, collocations.BATCH, 200_000), (150, 5, 0)])
def test_collocations_equal_brute_force(spark, monkeypatch, shard, batch, few):
    for name, value in (("SHARD", shard), ("BATCH", batch), ("BROADCAST_ROWS", few), ("SLICE", 64)):
        monkeypatch.setattr(collocations, name, value)
    rows = sentences(random.Random(3), 120) + [("en", "a b " * 500), ("en", "same " * 300), ("fr", "x")]
    docs = spark.createDataFrame(rows, TEXTS).repartition(3).withColumns({"phrase": F.lit("clash"), "shard": F.lit(1), "f": F.lit(0)})
    for least, longest, covered, top in ((12, 5, 100, 2000), (5, 3, 60, 7)):
        want = brute_phrases(rows, least, longest, covered, top)
        out = collocations.collocations(docs, least, longest, covered, top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 5


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "")], [("en", ". , ;")], [("en", "word")]):
        assert collocations.collocations(spark.createDataFrame(rows, TEXTS), 1).count() == 0
    one = collocations.collocations(spark.createDataFrame([("en", "a b")], TEXTS), 1).collect()
    assert [tuple(r) for r in one] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_scores_of_huge_counts_are_exact(spark):
    n, a = 10**15, 10**12 + 1
    score = spark.sql(f"select 1000 * cast({a} as decimal(38, 0)) * cast({n} as decimal(20, 0)) div (cast({a} as decimal(19, 0)) * cast({a + 7} as decimal(19, 0))) as s").first()["s"]
    assert score == 1000 * a * n // (a * (a + 7))


SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least cost, then ASCII-least audit, by trying every audit: rows are (role, text, fault)."""
    best = []

    def walk(i, state, cost, audit, out):
        if best and cost > best[0][0]:
            return
        if i == len(rows) and state in ("", "a"):
            found = (cost, audit, out)
            if not best or found[:2] < best[0][:2]:
                best[:] = [found]
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in "ua":
            if role in follow and audit[-2:] != "II":
                walk(i, role, cost + 5, audit + "I", [*out, ({"u": "user", "a": "assistant"}[role], "")])
        if i < len(rows):
            role, text, fault = rows[i]
            walk(i + 1, state, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in follow and role[:1]:
                    walk(i + 1, role[0], cost + more, audit + "K", [*out, (role, text)])
                for new, name in (("u", "user"), ("a", "assistant")):
                    if new in follow:
                        walk(i + 1, new, cost + 1 + more, audit + "R", [*out, (name, text)])

    best[:] = [(2 * len(rows), "D" * len(rows), [])]
    walk(0, "", 0, "", [])
    return best[0]


def brute_report(rows):
    hurt, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        hurt += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv in ids:
        own = [r for r in hurt if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        cost, audit, repaired = cheapest(faulty)
        kinds = Counter(f for _, _, f in faulty)
        initials = [r[0][:1] for r in faulty]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest))
    return out


def test_repairs_equal_every_other_way(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No?", "cut", "cut ", " \t\n", "", "Yes.", "done!\x0b ", "é", None, "a:b\nc."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]
    rows = []
    for conv in range(90):
        at = 0
        for i in range(rng.randint(1, 6)):
            at += rng.choice((1, 1, 1, 0, 3))
            role = rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[i % 2]
            rows.append((conv, rng.choice((at, at, at, at, None)), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {i}."))
    rows += [(None, None, None, None), (None, 3, "user", "x."), (-5, 10**12, "user", "Yes."), (-5, 0, "assistant", "Yes.")]
    rows += [(c, 0, "user", "Hm.") for c in range(1000, 1040)]  # some of these have no row left
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"copies": F.lit(9), "code": F.lit("clash"), "digest": F.lit(None).cast("string")}).repartition(3)
    out = repair.repair_report(repair.damaged(table))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute_report(rows), key=repr)
    assert any(r["audit"] == "" and r["cost"] == 0 for r in out.collect())


def test_repaired_rows_and_long_conversations(spark):
    table = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"text {t}." * 50) for t in range(3000)], SCHEMA)
    rows = repair.damaged(table)
    summary = repair.repaired(repair.coded(rows))
    found = repair.repaired_rows(rows, summary).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(len(found))) and len(found) > 2000
    roles = "".join(r["role"][0] for r in found)
    assert re.fullmatch("s?(ua)+", roles)
    whole = hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in found).encode()).hexdigest()
    assert repair.repair_report(rows).first()["repaired_sha256"] == whole
    assert repair.repair_report(repair.damaged(table.limit(0))).count() == 0 and repair.repaired_rows(rows.limit(0), summary.limit(0)).count() == 0
    codes = bytes(random.Random(1).choices(range(16), k=20_000))
    cost, audit, roles = repair.repair(codes)
    assert len(roles) == len(audit) and sum(c in "KRD" for c in audit) == len(codes) and re.fullmatch("(s?(ua)+)?", roles.replace(" ", ""))


def test_parts_of_phrases_come_by_a_shuffle_too(spark, monkeypatch):
    docs = spark.createDataFrame([("en" if i % 3 else None, "a b c d. b c d e a b! c d e") for i in range(12)], "lang string, text string")
    want = sorted(map(tuple, collocations.collocations(docs, least=4).collect()))
    assert collocations.BROADCAST_ROWS <= 10_000 and want  # what is broadcast is collected on the driver first
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, collocations.collocations(docs, least=4).collect())) == want


def test_packing_a_shard_needs_little_more_than_its_bitmaps():
    codes = np.random.default_rng(1).integers(0, 20_000, 1 << 20).astype(np.int32)
    tracemalloc.start()
    counts, entries, block, bits = collocations.packed(codes, 20_000)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 34 << 20  # before, 46 bytes a position
    at = np.flatnonzero(codes >= collocations.FIRST)
    assert counts.sum() == len(at) == np.bitwise_count(bits).sum() and entries.sum() == len(block)
    word = np.repeat(np.arange(20_000), entries)
    assert set(zip(word.tolist(), block.tolist())) == set(zip((codes[at] - collocations.FIRST).tolist(), (at >> 3).tolist()))


def test_a_shard_gives_a_row_for_each_part_and_not_for_each_pair_or_phrase(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = " ".join(rng.choices(words, k=40_000))
    shard = collocations.shards(spark.createDataFrame([("en", text)], TEXTS).coalesce(1)).toArrow()
    codes = np.arange(len(shard["words"][0]))
    listed = pa.table({"code": codes, "h": pa.array(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, len(codes)))})
    pairs = collocations.pairs_of(8)(shard, listed)
    size = sum(len(collocations.unplaned(x)) for x in pairs["hashes"].to_pylist())
    assert size > 30_000 and pairs.num_rows == 8 and pairs.nbytes < 9 * size  # before, a row and 32 bytes for each pair
    often = pa.concat_tables(collocations.often_of(2)(pairs.filter(pc.equal(pairs["part"], p))) for p in range(8))
    known = pa.concat_tables([listed, often.select(["part", "hashes"])], promote_options="default")
    found = collocations.phrases_of(3, 8)(shard, known)
    assert found.num_rows == 8  # before, one for each phrase
    got = {x["phrase"]: x["f"] for p in range(8) for x in collocations.sums_of(2)(found.filter(pc.equal(found["part"], p))).to_pylist()}
    w = text.split()
    brute = Counter(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    assert got == {p: c for p, c in brute.items() if c >= 2}
