import hashlib
import io
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, pieces, quality, topk, url_filter, warc
from spanloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_records_are_found_at_any_split():
    rng = random.Random(4)
    data, sizes = b"", []
    for i in range(60):
        payload = bytes(rng.choices(b"abc\x1f\x8b\x08 <>", k=rng.choice((0, 5, 2000))))
        member = warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None)
        sizes.append(len(member))
        data += member
    for step in (1, 7, 100, 4096, len(data)):
        ids = []
        for a in range(0, len(data), step) if step > 50 else [0, sizes[0] - 1, sizes[0], sizes[0] + 1]:
            end = a + step if step > 50 else a + 1
            ids += [warc._parsed(r)[0] for r in warc.records_in(io.BytesIO(data), a, end, chunk=64)]
        assert ids == (list(range(60)) if step > 50 else [0, 1])


def test_false_magic_and_cut_members():
    good = warc.record(3, None, b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    noise = other.compress(b"not a record") + other.flush()
    data = warc.MAGIC + b"junk" + noise + good + good[: len(good) // 2]
    lost: list[int] = []
    assert [warc._parsed(r)[6] for r in warc.records_in(io.BytesIO(data), 0, len(data), damaged=lost.append)] == [b"hello"]
    assert lost == [len(data) - len(good) // 2]  # half a record is lost, and neither junk nor noise is one
    whole = data[: -(len(good) // 2)]
    assert [warc._parsed(r)[6] for r in warc.records_in(io.BytesIO(whole), 0, len(whole))] == [b"hello"]


def test_damaged_records_are_errors_or_rows(spark, tmp_path):
    each = [warc.record(i, f"http://a/{i}", b"some text " * 50 + bytes([i]), hashlib.sha1(b"some text " * 50 + bytes([i])).hexdigest(), None) for i in range(3)]
    starts = [0, len(each[0]), len(each[0]) + len(each[1])]
    whole = b"".join(each)
    flipped = bytearray(whole)
    flipped[starts[1] + len(each[1]) // 2] ^= 0xFF
    for name, data, good, lost in (("whole", whole, [0, 1, 2], []), ("cut", whole[:-20], [0, 1], [starts[2]]), ("early", whole[: starts[2] + 11], [0, 1], [starts[2]]), ("flipped", bytes(flipped), [0, 2], [starts[1]])):
        path = f"{tmp_path}/{name}.warc.gz"
        with open(path, "wb") as out:
            out.write(data)
        archives = spark.createDataFrame([(f"file://{path}", len(data))], "path string, bytes long")
        for split in (warc.SPLIT, 61):
            rows = warc.read_archives(archives, split=split, keep_damaged=True).collect()
            assert sorted(r["page_id"] for r in rows if r["record_type"] != "damaged") == good, name
            assert [r["payload_bytes"] for r in rows if r["record_type"] == "damaged"] == lost, name
        if lost:
            with pytest.raises(Exception, match="cut or damaged"):
                warc.read_archives(archives).collect()


def test_archives_round_trip(spark):
    big, rows = "é" * 900, []
    rows = [(1, "http://a/\r\nx", big), (2, "http://b", big), (2, "http://b", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", "y" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    scratch = Scratch(spark, "test")
    archives = scratch.table(warc.write_archives(warc.with_revisits(pages), scratch.folder("a")))
    found = sorted(map(tuple, warc.read_archives(archives, split=777).collect()), key=repr)
    scratch.close()
    expected = []
    for page_id, url, html in rows:
        raw = (html or "").encode()
        owner = 2 if html == big and page_id != 2 else None
        clean = url and url.replace("\r", "%0D").replace("\n", "%0A")
        expected.append((page_id, clean, "revisit" if owner else "response", owner, len(raw), hashlib.sha1(raw).hexdigest(), None if owner else bytearray(raw)))
    assert found == sorted(expected, key=repr)


def test_revisits_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    pages = spark.createDataFrame([(i, "u", "x" * 1200) for i in range(3)], "page_id long, url string, html string")
    assert {(r["page_id"], r["owner"]) for r in warc.with_revisits(pages).collect()} == {(0, 2), (1, 2), (2, None)}


def test_a_second_attempt_keeps_the_whole_archive(tmp_path):
    fs, target = pafs.LocalFileSystem(), f"{tmp_path}/a"
    for text in (b"one", b"one", b"one"):
        (tmp_path / "draft").write_bytes(text)
        assert warc.settled(fs, f"{tmp_path}/draft", target) == 3
        assert [x.name for x in tmp_path.iterdir()] == ["a"] and (tmp_path / "a").read_bytes() == b"one"


def test_a_reader_has_a_task_for_each_range(spark):
    scratch = Scratch(spark, "test")
    pages = spark.createDataFrame([(i, f"u{i}", "".join(random.Random(i).choices("abcdefgh", k=4000))) for i in range(64)], "page_id long, url string, html string").repartition(2)
    archives = scratch.table(warc.write_archives(warc.with_revisits(pages), scratch.folder("a")))
    ranges = sum(-(-r["bytes"] // 8000) for r in archives.collect())
    found = warc.read_archives(archives, split=8000)
    tasks = found.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks")).first()
    assert tasks["n"] == 64 and tasks["tasks"] > ranges // 2
    scratch.close()


def test_archives_of_nothing(spark):
    scratch = Scratch(spark, "test")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = scratch.table(warc.write_archives(warc.with_revisits(pages), scratch.folder("a")))
    assert warc.read_archives(archives).collect() == []
    scratch.close()


def brute_top(vectors, ids, k):
    out = []
    for q in ids:
        for v in [x for x in vectors if x[0] == q]:
            scored = sorted((-sum(a * b for a, b in zip(v[1], c[1])), c[0]) for c in vectors if c[0] != q and len(c[1]) == len(v[1]))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(7, 5), (40, 9), (10_000, 10_000)])
def test_top_k_equals_brute_force(spark, block, query_block):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(120)] + [(i, [0.5] * 20) for i in range(200, 215)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 20), (303, [float("inf")] + [0.0] * 19), (304, []), (305, []), (306, [1.0, 2.0]), (10, rows[10][1]), (None, [0.1] * 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit("clash"))
    vectors = topk.quantized(table)
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    usable = [x for n, x in enumerate(usable) if x not in usable[:n]]
    queries = vectors.filter("vec_id % 5 = 0")
    found = sorted(map(tuple, topk.top_k(vectors, queries, 5, block, query_block).collect()))
    assert found == brute_top(usable, sorted({i for i, _ in usable if i % 5 == 0}), 5)
    assert topk.top_k(vectors.limit(0), queries.limit(0)).collect() == []


def test_products_are_exact_for_large_numbers():
    q, c = np.array([[2**31 + 1, 3]]), np.array([[2**31 - 1, 1], [5, 2**30]])
    assert topk._products(q, c).tolist() == [[(2**31 + 1) * (2**31 - 1) + 3, (2**31 + 1) * 5 + 3 * 2**30]]


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(30, 37)), rng.normal(size=(50, 37))
    for s in topk.LEVELS:
        (mq, rq), (mc, rc) = topk._stats(q, s), topk._stats(c, s)
        assert (mq @ mc.T + rq @ rc.T >= q @ c.T - 1e-9).all()


def all_paths(table, text):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
            return
        single = False
        for j in range(i + 1, min(len(text), i + table.longest) + 1):
            if found := table.table.get(text[i:j]):
                go(j, score + found[0], ids + [found[1]])
                single |= j == i + 1
        if not single:
            go(i + 1, score + table.unknown, ids + table.fallback(text[i]))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equals_all_paths(spark):
    rng = random.Random(6)
    texts = [" the cat", "  x", "\n", "é🙂x", "in\nto it", "a", "▁▁a"] + ["".join(rng.choices("ab theing\né", k=rng.randint(1, 10))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "q" * 3000])), "id long, text string").withColumn("n_best", F.lit("clash"))
    out = pieces.encoded(docs).withColumn("last", pieces.with_edits(F.col("token_ids"), F.element_at("n_best", -1)["edits"]))
    table = pieces.pieces(pieces.MODEL)
    rows = out.withColumns({"back": pieces.decoded(F.col("token_ids")), "back_last": pieces.decoded(F.col("last"))}).orderBy("id").collect()
    for text, row in zip(texts, rows):
        paths = all_paths(table, pieces.SPACE + text.replace(" ", pieces.SPACE))
        assert [p[0] for p in paths[: pieces.N_BEST]] == [x["score"] for x in row["n_best"]]
        assert (row["n_best"][0]["score"], row["token_ids"]) in paths and (row["n_best"][-1]["score"], row["last"]) in paths
        assert row["back"] == row["back_last"] == text.replace(pieces.SPACE, " ")
    for row in rows[-3:-1]:
        assert row["token_ids"] == [] and row["back"] == "" and row["n_best"][0]["score"] == 0.0
    assert rows[-1]["back"] == "q" * 3000
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_long_chunks_agree_with_short_ones(monkeypatch):
    table = pieces.pieces(pieces.MODEL)
    chunks = [pieces.SPACE + w for w in ("therefore", "überall", "information", "xqzj")]
    best, loss, start, size, pool = table.viterbi(chunks)
    monkeypatch.setattr(pieces, "LONG", 1)
    again = table.viterbi(chunks)
    assert np.array_equal(best, again[0]) and np.array_equal(loss, again[1])


def test_decode_matches_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ("hello world", " two  spaces ", "é\n🙂", "x"):
        ids = model.encode(text)
        assert pieces.pieces(pieces.MODEL).decode(ids) == model.decode(ids) == text


def test_quality_held_out(spark):
    out = quality.op7_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"].to_numpy(), rows[rows["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert ((rows["score"] >= 0.3).astype(int) == rows["predicted"]).all()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "word " * 40000, "c"), (1, "again", "d")], "doc_id long, text string, score string")
    docs = quality.measured(docs)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 4 and all(r["score"] == pytest.approx(0.3) for r in rows)
    two = quality.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, two).collect())
    assert quality.scored(docs.limit(0), two).count() == 0


def plain_statistics(text):
    """quality.NAMES, one by one, by plain counting."""
    raw = (text or "").encode()
    n, words, lines = max(1, len(raw)), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(words))
    share = lambda chars: sum(raw.count(c) for c in {bytes([c]) for c in chars}) / n
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    runs = [len(list(g)) - 1 for _, g in itertools.groupby(words)] or [0]
    pairs = {(words[i], words[i + 1]) for i in range(len(words) - 1)}
    return [
        math.log(1 + len(raw)), math.log(1 + len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), share(b"#$%&*@^~=_<>{}[]\\/+"), share(b"|"), share(b"!"),
        sum(65 <= c <= 90 for c in raw) / n, sum(48 <= c <= 57 for c in raw) / n, share(b" \t"), sum(c >= 128 for c in raw) / n, share(b".?"), share(b",;:"),
        len(set(words)) / m, len(set(words)) / m + 0.06 * math.log(m), max([words.count(w) for w in set(words)] or [0]) / m,
        sum(words[i] == words[i - 1] for i in range(1, len(words))) / m, sum(words[i] == words[i - 2] for i in range(2, len(words))) / m, len(pairs) / max(1, len(words) - 1),
        sum(x <= 3 for x in sizes) / len(sizes), sum(x <= 1 for x in sizes) / len(sizes), 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + len(raw) / max(1, len(lines))), len(zlib.compress(raw, 1)) / n,
        sum(w.upper() == w and w.lower() != w for w in words) / m, sum(w[:1].isalpha() and w[:1].isupper() for w in words) / m, sum(x > 12 for x in sizes) / len(sizes), math.log(1 + max(runs)),
    ]


def test_quality_equals_brute_force(spark):
    """Statistics by plain counting, weights by gradient descent on the pairwise loss, threshold by sorting."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts, known = dict(map(tuple, docs.collect())), {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    x = {i: plain_statistics(t) for i, t in texts.items()}
    found = quality.op7_quality(spark, SF).collect()
    measured = {r["doc_id"]: r[quality.STATISTICS] for r in quality.measured(docs).collect()}
    assert all(measured[i] == pytest.approx(x[i], abs=1e-12) for i in texts)
    ids = [i for i in texts if i in known and zlib.crc32(str(i).encode()) % 5]
    model = quality.train(quality.measured(docs), labels)
    order = [r["doc_id"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    raw, y = np.array([x[i] for i in order]), np.array([known[i] for i in order])
    knots = np.stack([np.quantile(raw, q, axis=0) for q in quality.KNOTS], axis=1)

    def bent(rows):
        return np.array([list(r) + [max(0.0, v - k) for v, own in zip(r, knots) for k in own] for r in rows])

    z = bent(raw)
    mean, spread = z.mean(axis=0), z.std(axis=0)
    scale = lambda rows: np.where(spread > 1e-9, (bent(rows) - mean) / np.where(spread > 1e-9, spread, 1), 0)
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    count = min(quality.MAX_PAIRS, quality.PAIRS_EACH * min(len(good), len(bad)))
    better, worse = rng.choice(good, count), rng.choice(bad, count)
    d = scale(raw)[better] - scale(raw)[worse]
    w, momentum = np.zeros(d.shape[1]), np.zeros(d.shape[1])
    step = 1 / (np.linalg.eigvalsh(d.T @ d)[-1] / 4 + 0.002 * count)
    for i in range(6000):
        ahead = w + momentum
        new = ahead + step * (d.T @ (1 / (1 + np.exp(d @ ahead))) - 0.002 * count * ahead)
        momentum, w = 0.98 * (new - w), new
    strengths = np.sort(scale(raw) @ w)
    cut = (strengths[len(bad) - 1] + strengths[len(bad)]) / 2
    assert np.allclose(model.weights, w, atol=1e-4) and model.cut == pytest.approx(cut, abs=1e-3)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    for r in found:
        strength = float((scale(np.array([x[r["doc_id"]]])) @ w)[0])
        expected = 1 / (1 + math.exp(-(strength - cut) - math.log(0.3 / 0.7)))
        assert r["score"] == pytest.approx(expected, abs=1e-3) and r["held_out"] == held[r["doc_id"]] and r["predicted"] == (r["score"] >= 0.3)


LINKED = [
    (1, "http://h.org/a/b/page", '<LINK href="../../de/./x/../9" rel=canonical><link rel="canonical" href="mailto:x">'),
    (2, "http://h.org/a/c/", "<meta http-equiv=refresh content='0; url=../b/page'>"),
    (3, "http://h.org", "<link rel=canonical href='a/c/'>"),
    (4, "http://h.org/q/r?x=1", "<link rel='canonical' href='?y=2'><link rel=canonical href='#top'><link rel=canonical href=/>"),
    (5, "http://h.org/q/r?y=2", ""),
    (6, "http://h.org/", ""),
    (7, "http://k.example.com/", '<link rel="stylesheet" href="/de/9"><link rel=canonical href="//H.org/up/../../x/..">'),
    (8, "http://k.example.com/de/9", "<link rel=canonical href='http://h.org/de/9'>"),
    (9, "http://z.org/1", "<link rel=canonical href='http://z.org/2'><meta http-equiv=refresh content='1;URL=//z.org/3'>"),
    (10, "http://z.org/3", "<link rel=canonical href='/../de/../4/.'>"),
    (11, "http://w.net/", "<link rel=canonical href='http://z.org/4/'>"),
    (12, "http://z.org/2", "<link " * 2000),
]


def test_relative_and_repeated_links(spark):
    pages = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    links = {(r["src"], r["dst"]) for r in url_filter.page_links(pages).collect()}
    assert links == {
        ("h.org/a/b/page", "h.org/de/9"), ("h.org/a/c/", "h.org/a/b/page"), ("h.org", "h.org/a/c/"), ("h.org/q/r?x=1", "h.org/q/r?y=2"), ("h.org/q/r?x=1", "h.org/"),
        ("k.example.com/", "h.org/"), ("k.example.com/de/9", "h.org/de/9"), ("z.org/1", "z.org/2"), ("z.org/1", "z.org/3"), ("z.org/3", "z.org/4/"), ("w.net/", "z.org/4/"),
    }


@pytest.mark.parametrize("few", [100_000, 0])
def test_linked_pages_equal_sql(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", few)
    pages = spark.createDataFrame(LINKED + [(12, "http://z.org/2", None), (None, None, "x")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = [tuple(r) for r in url_filter.op8_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "via").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = db.execute(f"SELECT page_id, host, path, rule, verdict, via FROM ({url_filter.SQL})").fetchall()
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    verdicts = {r[0]: r[4] for r in found}
    assert [verdicts[i] for i in (1, 2, 3, 4, 8, 9, 10, 11, 12)] == ["block", "block", "block", "allow", "block", "block", "block", "block", "block"]


def test_paths_without_dot_segments(spark):
    paths = {"": "", "/": "/", "/a/b": "/a/b", "/a/./b": "/a/b", "/a/../b": "/b", "/../a": "/a", "/a/..": "/", "/a/b/..": "/a/", "/a/b/.": "/a/b/", "/.": "/", "/a//../b": "/a/b", "/..a/.b/c.": "/..a/.b/c.", "/x/../../../y/": "/y/", "/" + "a/../" * 100_000 + "b": "/b"}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", url_filter.normal_path(F.col("path")).alias("now")).collect()
    assert {r["path"]: r["now"] for r in rows} == paths


def test_chats(spark):
    odd = ["</s>[INST] ok [/INST]", "\\|\\\\ <s", "", None, "<<SYS>> <|text|>\\", "é🙂\n", "x" * 30000, "[\\|INST]"]
    roles = ["user", "assistant", "system", "tool", "<|role|>", None]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(roles), rng.choice(odd)) for c in range(12) for t in range(c)] + [(1, 0, "user", "hi")] * 2 + [(None, None, "assistant", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    made = chat.format_chats(table)
    back = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for c, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), key=lambda r: r[0]):
        own = sorted(own, key=key)
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[c]["loss_text"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    for r in made.collect():
        assert len(r["token_ids"]) == len(r["loss_mask"]) and r["formatted_chars"] == back[r["conv_id"]]["formatted_chars"]
        marked = {i for s in r["loss_spans"] for i in range(s["start"], s["end"])}
        assert marked == {i for i, m in enumerate(r["loss_mask"]) if m}
        assert all(r["token_ids"][i] < chat.FIRST_RESERVED for i in marked)
        text = "".join(chat.encoding(chat.RANKS).decode([i for i, m in zip(r["token_ids"], r["loss_mask"]) if m]))
        assert text == "".join(chat.encoding(chat.RANKS).decode(r["token_ids"][s["start"] : s["end"]]) for s in r["loss_spans"])
    assert chat.read_chats(chat.format_chats(table.limit(0))).collect() == []
