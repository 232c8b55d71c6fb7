import json
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spanloom.operators import archive

ROWS = "id long, account string, source_id string, start double, end double, text string"
BLOCKS = "account string, place int, block_id string, source_id string, start double, end double, title string, summary string, highlights string, density double, self_contained double, content_class string, speaking boolean, needs_context boolean, warnings array<string>, trust_tier string"


def words(value):
    return {w for w in re.findall("[a-z0-9à-ÿ]+", (value or "").lower()) if len(w) > 2}


def similarity(a, b):
    a, b = words(a), words(b)
    if not a or not b:
        return 0.0
    return round(max(len(a & b) / len(a | b), SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio() * 0.75), 4)


def alignment(row, blocks):
    _, account, source, start, end, said = row
    own = [b for b in blocks if b[0] == account]
    if not own:
        return ("no_snapshot_blocks", 50.0, 0.0, False, None)
    if not source or start is None or end is None or end <= start:
        return ("source_not_verified", 50.0, 0.0, True, None)
    best = None
    for b in sorted(own, key=lambda b: b[1]):
        lap = max(0.0, min(end, b[5]) - max(start, b[4])) / max(0.001, min(end - start, b[5] - b[4]))
        if b[3] != source.lower() or lap <= 0:
            continue
        strength = min(1.0, lap * 0.62 + similarity(said, " ".join(b[6:9])) * 0.18 + (b[9] or 0.0) / 100 * 0.12 + (b[10] or 0.0) / 100 * 0.08)
        if best is None or strength > best[0] + 1e-12:
            best = (strength, b)
    if best is None:
        return ("source_has_no_overlapping_block", 50.0, 0.0, True, None)
    strength, b = best
    speech = b[12] is not False and b[11] in ("", "fala")
    doubt = bool(b[14] or b[13] or b[11] != "fala" or b[12] is False or b[15] not in ("owner", "qa", "verified"))
    signal = 50 + min(8, strength * 8) if speech else min(50, 50 + strength * 2)
    return ("aligned_same_source", round(signal, 1), round(min(0.98, 0.45 + strength * 0.5), 2), doubt, b[2])


def test_alignment_equals_a_loop(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choices("river city market night house train paper green stone light vidro água of".split(), k=n))
    blocks = []
    for i in range(60):
        start = float(rng.randrange(300))
        blocks.append((rng.choice("pq"), i, f"b{i}", rng.choice(("s", "t", "")), start, start + rng.choice((10.0, 40.0)), say(3), rng.choice(("", say(4))), "", rng.choice((None, 20.0, 90.0)), rng.choice((None, 50.0)), rng.choice(("fala", "fala", "", "other")), rng.choice((None, True, False)), rng.choice((False, False, True)), rng.choice(([], [], ["x"])), rng.choice(("owner", "", "qa"))))
    rows = []
    for i in range(120):
        start = float(rng.randrange(300))
        rows.append((i, rng.choice("ppqr"), rng.choice(("s", "T", "u", "", None)), rng.choice((start, start, start, None)), start + rng.choice((8.0, 30.0, 0.0)), rng.choice((say(6), "", None))))
    out = archive.aligned(spark.createDataFrame(rows, ROWS), spark.createDataFrame(blocks, BLOCKS)).collect()
    got = {r["id"]: tuple(r["alignment"][c] for c in ("state", "signal", "confidence", "review_required", "block_id")) for r in out}
    want = {r[0]: alignment(r, blocks) for r in rows}
    assert len(out) == len(rows) and {w[0] for w in want.values()} == set(archive.STATES)
    for i, (state, signal, confidence, review, block) in want.items():
        g = got[i]
        assert (g[0], g[3], g[4]) == (state, review, block) and abs(g[1] - signal) < 0.11 and abs(g[2] - confidence) < 0.011, i
    assert archive.aligned(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], BLOCKS)).filter("alignment.available").count() == 0
    assert archive.aligned(spark.createDataFrame([], ROWS), spark.createDataFrame(blocks, BLOCKS)).count() == 0


def test_blocks_and_seeds(spark):
    items = [
        {"id": "b1", "startS": 5, "endS": "0:25", "video": {"youtubeUrl": "https://youtu.be/AbCdEfGhIjK"}, "title": " A  title ", "densityRank": 120, "selfContainedRank": -3, "trustTier": "OWNER", "contentClass": "Fala", "highlights": [{"text": "said", "reason": "why"}, {"text": "more"}], "tags": ["x"], "speaking": True, "needsContext": "yes"},
        {"block_id": "b2", "start": 30.0, "end": 60.0, "videoId": "s", "summary": "text", "density_rank": 7},
        {"id": "b3", "start": 9, "end": 9, "videoId": "s"}, {"id": "b4", "start": 1, "videoId": "s"}, 7, None, "x",
        {"id": "b5", "start": 100, "end": 110, "videoId": "s", "title": "far"}, {"id": "b6", "start": 100, "end": 110, "videoId": "other", "title": "far"},
    ]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "place int, raw string").withColumn("v", F.try_parse_json("raw"))
    found = {r["block_id"]: r for r in archive.blocks(raw, "v").collect()}
    assert set(found) == {"b1", "b2", "b5", "b6"}
    b = found["b1"]
    assert (b["source_id"], b["start"], b["end"], b["title"], b["density"], b["self_contained"], b["trust_tier"], b["content_class"], b["highlights"], b["topics"], b["speaking"], b["needs_context"], b["place"]) == (
        "abcdefghijk", 5.0, 25.0, "A title", 100.0, None, "owner", "fala", "said why more", ["x"], True, True, 0)
    rows = spark.createDataFrame([(1, "a", "S", 28.0, 58.0, "own")], ROWS)
    out = archive.with_seeds(rows, archive.blocks(raw, "v")).select("id", "block_id", "source_id", "text", "seed").collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, None, "S", "own", False), (None, "b5", "s", "far", True)], key=repr)
