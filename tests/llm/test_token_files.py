import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import token_files
from spanloom.llm.token_files import EliasFano

SCHEMA = "doc_id long, text string"


def expected(rows):
    """Boundaries and checksums by encoding whole texts one after the other."""
    tokens = Tokenizer.from_file(token_files.VOCABULARY)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def written(spark, rows, tmp_path, name, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"start": F.lit("clash"), "h": F.lit(1)}).repartition(5)
    shards = token_files.write_shards(docs, f"file://{tmp_path}/{name}", **options)
    shards.write.parquet(f"{tmp_path}/{name}-list")
    return spark.read.parquet(f"{tmp_path}/{name}-list")


@pytest.mark.parametrize("numbers", [[], [0], [7], [0, 0, 0], [1, 2, 3, 4], [5, 5, 900, 900, 10**6], [0, 2**64 - 1], list(range(0, 9000, 3)), [2**40 * i for i in range(700)]])
def test_elias_fano(numbers):
    ef = EliasFano.unpacked(EliasFano.of(np.array(numbers, np.uint64)).packed())
    assert [int(x) for x in ef.at(np.arange(len(numbers)))] == numbers
    if numbers:
        asked = sorted({0, 1, 4, 899, 900, numbers[len(numbers) // 2], numbers[-1], max(numbers[-1] - 1, 0), min(numbers[-1] + 1, 2**64 - 1)})
        assert ef.above(np.array(asked, np.uint64)).tolist() == [sum(x <= a for x in numbers) for a in asked]


def test_elias_fano_random_and_small():
    rng = random.Random(4)
    for n, top in ((1, 5), (513, 600), (5000, 10**7), (70_000, 10**6)):
        numbers = np.sort(np.array([rng.randrange(top) for _ in range(n)], np.uint64))
        ef = EliasFano.of(numbers)
        assert (ef.at(np.arange(n)) == numbers).all()
        asked = np.array([rng.randrange(top) for _ in range(500)], np.uint64)
        assert (ef.above(asked) == np.searchsorted(numbers, asked, "right")).all()
    assert len(ef.packed()) < 70_000 * (2.4 + np.log2(10**6 / 70_000)) / 8


def test_encoder_equals_whole_texts(monkeypatch):
    tokens = Tokenizer.from_file(token_files.VOCABULARY)
    rng = random.Random(2)
    alphabet = [" ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "a", "the", "Étion", "don't", "9", "!", "<|endoftext|>", "🙂", "\x00", "ſ", ".", "?!", "Über,", "word.", "\nNext", "\n\n"]
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "foo\n bar", "x foo\n", "x foo\n bar", "\n", " \n ", "a\n"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    encoder = token_files.Encoder(token_files.VOCABULARY, 2)
    monkeypatch.setattr(token_files, "KNOWN", 50)
    for text in texts + texts[:50]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokens.encode(text, add_special_tokens=False).ids, repr(text)


def test_shards_equal_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i * 7 - 900, " ".join(rng.choices(["the", "of", "thing.\nand", "x", "", "être"], k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(-(2**63), "least"), (2**63 - 1, "most"), (40_000, None), (40_001, ""), (40_002, "w " * 60_000)]
    want = expected(sorted(rows))
    for name, limits in (("one", {}), ("many", {"SHARD_DOCS": 7, "RANGE": 3, "HELD": 400})):
        for k, v in limits.items():
            monkeypatch.setattr(token_files, k, v)
        shards = written(spark, rows, tmp_path, name, width=4 if limits else 2)
        found = token_files.read_documents(shards)
        got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["token_ids"]) for r in found.collect()), key=lambda r: r[1])
        assert got == want
        ids = [t for w in want for t in w[4]]
        asked = [0, 1, len(ids) - 1, *(rng.randrange(len(ids)) for _ in range(60)), *(w[1] for w in want[:20])]
        positions = spark.createDataFrame([(p,) for p in [*asked, -1, len(ids), None]], "position long")
        at = {r["position"]: (r["doc_id"], r["start"]) for r in token_files.documents_at(shards, positions).collect()}
        assert at == {p: next((w[0], w[1]) for w in want if w[1] <= p < w[1] + w[2]) for p in asked}


def test_odd_rows(spark, tmp_path):
    assert token_files.read_documents(written(spark, [], tmp_path, "empty")).count() == 0
    rows = [(None, "no id"), (None, None), (5, "same"), (5, "same"), (5, "other"), (None, "no id")]
    found = token_files.read_documents(written(spark, rows, tmp_path, "odd")).collect()
    one = {(d, t): expected([(d, t)])[0][2:4] for d, t in rows}
    assert sorted((r["doc_id"] is not None, r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((d is not None, *one[d, t]) for d, t in rows)
    ends = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and [e[2] for e in ends] == [None] * 3 + [5] * 3


def test_a_damaged_shard_is_an_error(spark, tmp_path):
    shards = written(spark, [(1, "some words"), (2, "more words")], tmp_path, "hurt")
    path = shards.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        token_files.read_documents(shards).collect()
    open(path, "wb").write(data[:-1])
    with pytest.raises(Exception, match="no whole shard"):
        token_files.read_documents(shards).collect()


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in token_files.op11_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == [w[:4] for w in expected(rows)]
