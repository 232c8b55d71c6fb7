"""The corpus pipeline: stages over documents, each one operator of spanloom.llm.

Every stage works on all that its predecessor kept.  The first four return the columns
of documents; the last one returns token ids.  Quality scores and MinHash have no SQL
form, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, near_dedup, pieces, pii, quality
from spanloom.llm.common import Scratch, pin, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Fitted on the labelled ones among these documents."""
    columns = docs.columns
    scratch = Scratch(spark, "quality")
    # only the statistics are kept: texts are measured again when they are scored, and not written twice
    model = quality.train(scratch.table(quality.measured(docs.select("doc_id", "text")).drop("text")), read(spark, sf_dir, "labels"))
    scratch.close()
    return quality.scored(quality.measured(docs), model).filter("predicted = 1").select(*(f"`{c}`" for c in columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once if its row repeats; rows without id stay."""
    groups = near_dedup.near_duplicates(docs)
    gone = groups.filter("not kept").select("doc_id").distinct()
    few = gone.count() <= near_dedup.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    repeated = pin(groups.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return kept.select(*(f"`{c}`" for c in docs.columns))
    # texts of one id that are alike but for its other rows: one row for each id
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(f"`{c}`" for c in docs.columns)), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns)).union(once)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go; other rows of their id, or without id as they are, stay if their own text is clean."""
    found = decontaminate.judged(docs, read(spark, sf_dir, "benchmark")).filter("contaminated")
    gone = pin(found.select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct())
    few = gone.count() <= near_dedup.BROADCAST_IDS
    same = F.col("`doc_id`").eqNullSafe(F.col("__gone_id")) & (F.xxhash64("`text`") == F.col("__gone_key"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and mail names are pseudonyms from here on; n_chars follows the text."""
    out = pii.pseudonymized(docs).drop("pii_counts")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the scores of its best segmentations, and whether the ids decode to its text."""
    out = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), verify=True)
    scores = F.transform("n_best", lambda x: x["score"])
    return out.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), scores.alias("scores"), "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again.

    A stage's input goes once its result is written.  Only the last stage's input
    stays, as the returned rows are made from it.
    """
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, f"pipeline-{name}")
        docs = scratch.table(stage(spark, docs, sf_dir))
        if before:
            before.close()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
