import glob

from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import pii
from tests.llm.test_near_dedup import brute as groups_of
from tests.llm.test_text_operators import contaminated

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas(), spark.read.parquet(f"{tmp_path}/{name}")
        docs = seen[name][1]
        if name != "pieces":
            assert docs.columns == columns
    before, after = seen["near_dedup"]
    kept = {r[0] for r in groups_of(list(zip(before["doc_id"].tolist(), before["text"]))) if r[3]}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, t in zip(before["doc_id"], before["text"]) if not contaminated(t, items)[4]}
    assert {r["doc_id"] for r in after.collect()} == clean and len(clean) < len(before)
    before, after = seen["pii"]
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymized(spark.createDataFrame(before)).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == again
    _, tokens = seen["pieces"]
    assert tokens.filter(~F.col("round_trip")).count() == 0 and tokens.count() == len(clean)


def test_quality_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, sf).select("doc_id").withColumn("kept", F.lit(1))
    r = docs.join(labels, "doc_id").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {x["quality"]: x["share"] for x in r}
    assert share[1] > 0.97 and share[0] < 0.15


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b c d e f 192.168.1.1", "en", "s", 3), (2, "", "en", "s", 0), (3, "w " * 30000, "en", "s", 1), (4, "x y z one two three", "en", None, 2), (4, "x y z one two three", "en", None, 2), (4, "other words altogether in this one", "en", None, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"token_ids": F.lit(5), "score": F.lit("q"), "kept": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
    once = corpus_pipeline.near_dedup_stage(spark, docs, SF).filter("doc_id = 4").collect()
    assert len(once) == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_decontaminate_stage_judges_each_row_by_its_text(spark, monkeypatch):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 13").first()["text"]
    rows = [(None, item), (None, "clean words without an id"), (None, None), (5, item), (5, "clean words of a repeated id"), (5, "clean words of a repeated id"), (6, item), (6, item), (7, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = sorted((r for r in rows if r[1] != item), key=repr)
    assert sorted(map(tuple, corpus_pipeline.decontaminate_stage(spark, docs, SF).collect()), key=repr) == clean
    monkeypatch.setattr(corpus_pipeline.near_dedup, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, corpus_pipeline.decontaminate_stage(spark, docs, SF).collect()), key=repr) == clean


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and set(out.columns) >= {"doc_id", "token_ids", "n_tokens"}


def test_nothing_else_imports_the_subpackage():
    for path in glob.glob("spanloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path
