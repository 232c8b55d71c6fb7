"""Texts of a megabyte, of the kinds that make patterns and folds slow or deep."""

import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from spanloom.llm import pieces, pii, secrets

SIZE = 1 << 20
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def random_text(size=SIZE):
    return "".join(random.Random(1).choices(B64, k=size))


@pytest.mark.parametrize("unit", ["1-", "a", "1.", "a@", "1_", "+1-22-22-22 ", None])
def test_pseudonyms_of_long_runs(spark, unit):
    text = random_text() if unit is None else unit * (SIZE // len(unit))
    begun = time.time()
    out = pii.pseudonymized(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert len(out["text"]) == len(text) and time.time() - begun < 90


def test_mail_with_a_long_name_and_domain(spark):
    texts = ["a" * 50_000 + "@x.y", "a@" + "b." * 50_000 + "c", "x@" + "y" * 50_000]
    out = pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    assert [r["pii_counts"]["mail"] for r in out] == [1, 1, 0] and [len(r["text"]) for r in out] == list(map(len, texts))
    assert out[0]["text"].endswith("@x.y") and out[1]["text"].endswith(texts[1][1:]) and out[2]["text"] == texts[2]


@pytest.mark.parametrize("unit,kind", [("0123456789abcdef_", "hex"), ("AKIA ", "none"), ("a1", "none"), (None, "entropy")])
def test_secrets_of_long_runs(spark, unit, kind):
    text = random_text() if unit is None else unit * (SIZE // len(unit))
    begun = time.time()
    spans = secrets.secret_spans(spark.createDataFrame([(1, text)], "id long, text string")).first()["secret_spans"]
    found = [s for s in spans if secrets.KINDS[s["order"]] == kind]
    if kind == "hex":
        assert [(s["start"], s["end"]) for s in found] == [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    assert bool(found) == (kind != "none") and all(s["match"] == text[s["start"] : s["end"]] for s in found[:50] + found[-50:])
    assert time.time() - begun < 120


def test_segmentation_of_a_long_unbroken_chunk():
    table, text = pieces.pieces(pieces.MODEL), random_text()
    tracemalloc.start()
    begun = time.time()
    best = table.n_best(text, 2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 300 << 20 and time.time() - begun < 120
    assert best[0][0] >= best[1][0] and all(table.decode(ids) == text for _, ids in best)


def test_a_long_chunk_is_encoded_whole(spark):
    text = random_text(200_000)
    out = pieces.encoded(spark.createDataFrame([(1, text)], "id long, text string"), verify=True).first()
    assert out["round_trip"] and len(out["n_best"]) == pieces.N_BEST


def test_the_last_segmentation_is_decoded_beside_the_best(spark):
    texts = ["", "unbelievable  reconstruction\n\tof it", "▁a b", None, "日本 naïve 😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = pieces.encoded(rows, verify=True, verify_last=True)
    assert all(r["round_trip"] for r in out.collect())
    last = out.withColumn("back", pieces.decoded(pieces.with_edits(out["token_ids"], out["n_best"][F.size("n_best") - 1]["edits"])))
    assert {r["id"]: r["back"] for r in last.collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    plan = pieces.op3_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan  # one Python process for a task
