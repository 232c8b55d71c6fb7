"""Selections of blocks that a model's answer names, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.records import tolerant_json


def selections(answers: DataFrame, key: str, raw: str = "answer") -> DataFrame:
    """``key, pos, indices`` and the texts of each object with ``blocks`` in an answer.

    An answer is JSON, perhaps fenced or with typographic quotes or trailing commas; if
    it doesn't parse as a whole, its flat objects are tried one by one.
    """
    whole = F.try_variant_get(tolerant_json(F.col(raw)), "$", "array<variant>")
    apart = F.filter(F.transform(F.regexp_extract_all(F.col(raw), F.lit(r"(\{[^{}]+\})"), 1), tolerant_json), lambda v: v.isNotNull())
    found = answers.select(key, F.posexplode(F.when(F.size(whole) > 0, whole).otherwise(apart)).alias("pos", "v"))
    text = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")).alias(name)
    grades = (F.coalesce(F.try_variant_get("v", f"$.{n}", "string"), F.lit("B")).alias(n) for n in ("hook", "flow", "value", "energy"))
    return found.select(key, "pos", F.try_variant_get("v", "$.blocks", "array<int>").alias("indices"), *map(text, ("title", "reason", "speaker")), *grades)


def contiguous(indices: Column, n: Column) -> Column:
    """``first, last`` of a run of distinct block numbers from 0, or from 1 where they can't be from 0; null for anything else."""
    low, high, size = F.array_min(indices), F.array_max(indices), F.size(indices)
    run = (size > 0) & ~F.exists(indices, lambda i: i.isNull()) & (F.size(F.array_distinct(indices)) == size) & (high - low + 1 == size)
    shift = F.when((low >= 0) & (high < n), 0).when((low >= 1) & (high <= n), 1)
    return F.when(run & shift.isNotNull(), F.struct((low - shift).alias("first"), (high - shift).alias("last")))


def selected_blocks(answers: DataFrame, blocks: DataFrame, key: str, shortest: float = 20.0, longest: float = 180.0) -> DataFrame:
    """Clips made of the blocks that each answer selects: ``key, pos, first, last, start, end, text, score`` and its texts.

    ``blocks`` has ``key, index, start, end, text``.  Selections that skip a block, name
    one that isn't there or one twice, or stay too short give nothing; longer ones end
    at ``longest``.  The score is that of the grades.
    """
    counts = blocks.groupBy(key).agg(F.count("*").alias("n"))
    found = selections(answers, key).join(counts, key).withColumn("run", contiguous(F.col("indices"), F.col("n"))).filter("run is not null")
    found = found.withColumn("index", F.explode(F.sequence("run.first", "run.last")))
    parts = found.join(blocks.select(key, F.col("index").cast("int").alias("index"), "start", "end", "text"), [key, "index"])
    kept = ("run", "title", "reason", "speaker", "hook", "flow", "value", "energy")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ")
    out = parts.groupBy(key, "pos", *kept).agg(F.min("start").alias("start"), F.max_by("end", "index").alias("end"), said.alias("text"))
    out = out.filter(F.col("end") - F.col("start") >= shortest).withColumn("end", F.least(F.col("end"), F.col("start") + longest))
    score = scoring.from_grades(*(F.col(n) for n in ("hook", "flow", "value", "energy")))
    return out.select(key, "pos", "run.first", "run.last", "start", "end", "text", "title", "reason", "speaker", score.alias("score"))
