"""Exports of a run's candidates: sixteen bounded columns without texts, written by run and read back with what was rejected."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, text

SCHEMA = "candidate-run.v1"
# The columns of a candidate, the states that ask for review, and the modes of a run.
CANDIDATE = """clip_id string, start double, end double, duration double, score double, favorability_score double, editorial_family string, coice_signal boolean, coice_score double,
from_acervo_seed boolean, review_required boolean, context_quality double, context_gate boolean, payoff_gate boolean, timing_gate boolean, visual_evidence_required boolean"""
REVIEW = {"quality_scorecard.status": ("review_required", "review"), "technical_gate.status": ("review", "weak", "blocked")}
YES = ("1", "true", "yes", "sim", "on")
HEAD = ("schema", "run_id", "source_id", "mode", "backend", "seeds_enabled", "generated_at")
COLUMNS = tuple(x.split()[0] for x in CANDIDATE.replace("\n", " ").split(", "))


def _bounded(value: Column, default: float | None = 0.0) -> Column:
    return F.round(coerce.clamp(coerce.finite_or(value, default), 0.0, 100.0), 3)


def candidate(value: Column, place: Column) -> Column:
    """The CANDIDATE columns, as a struct, of a candidate in a variant; null fields are as absent ones.

    Bounds that are the wrong way round are exchanged.  A candidate without an id is named
    by its ``place`` and interval.  What isn't an object has the defaults of an empty one.
    """
    get = lambda path: F.try_variant_get(value, f"$.{path}", "string")
    first = lambda *paths: F.coalesce(*map(get, paths))
    yes = lambda c: F.coalesce(F.when(c.try_cast("double").isNotNull(), c.try_cast("double") != 0).otherwise(F.lower(text.collapsed(c)).isin(*YES)), F.lit(False))
    flag = lambda *paths: yes(first(*paths))
    short = lambda c, n: F.substring(text.collapsed(c), 1, n)
    named = lambda *paths: coerce.first_text(*map(get, paths))
    a, b = (coerce.finite_or(first(*names), 0.0) for names in (("start", "start_time"), ("end", "end_time")))
    start, end = F.least(a, b), F.greatest(a, b)
    length = coerce.finite_or_null(get("duration"))
    duration = F.when(F.coalesce(length, end - start) <= 0, end - start).otherwise(F.coalesce(length, end - start))
    interval = F.format_string("interval_%d_%.3f_%.3f", place.cast("long"), start, end)
    own = first("signal", "coice.signal", "counterpunch.signal")
    answered = flag("counterpunch.available") & flag("counterpunch.answer_complete")
    quality = F.coalesce(get("context_quality"), get("factors.context_completeness"), get("factors.completeness"), get("quality_scorecard.context_quality"), F.lit("0"))
    gate = lambda name, other: F.coalesce(yes_or_null(first(f"technical_gate.{name}", f"factors.{name}")), other)
    yes_or_null = lambda c: F.when(c.isNotNull(), yes(c))
    in_states = [short(get(path), 32).isin(*states) for path, states in REVIEW.items()]
    review = flag("review_required") | flag("speaker_review_required") | F.coalesce(in_states[0], F.lit(False)) | F.coalesce(in_states[1], F.lit(False))
    favor = first("favorability_score", "signal", "favorability.signal")
    fields = {
        "clip_id": F.coalesce(F.nullif(short(named("clip_id", "editorial_key"), 128), F.lit("")), interval),
        "start": F.round(F.greatest(F.lit(0.0), start), 3),
        "end": F.round(F.greatest(F.lit(0.0), end), 3),
        "duration": F.round(F.greatest(F.lit(0.0), duration), 3),
        "score": _bounded(first("score", "editorial_potential_score", "total_score")),
        "favorability_score": F.when(favor.isNotNull(), _bounded(favor)),
        "editorial_family": F.coalesce(F.nullif(F.lower(short(named("editorial_family", "family", "factors.editorial_family"), 48)), F.lit("")), F.lit("unknown")),
        "coice_signal": flag("coice_signal") | flag("coice") | answered,
        "coice_score": F.when(own.isNotNull(), _bounded(own)),
        "from_acervo_seed": flag("context_seed_only") | flag("from_acervo_seed") | flag("acervo_context.seed_only"),
        "review_required": review,
        "context_quality": _bounded(quality),
        "context_gate": gate("context_gate", coerce.finite_or(quality, 0.0) >= 60),
        "payoff_gate": gate("payoff_gate", F.lit(False)),
        "timing_gate": gate("timing_gate", F.lit(False)),
        "visual_evidence_required": flag("technical_gate.visual_evidence_required", "visual_evidence_required"),
    }
    return F.struct(*(fields[c].alias(c) for c in COLUMNS))


def run_id(value: Column) -> Column:
    """A name that is safe as a folder's."""
    safe = F.regexp_replace(F.substring(text.collapsed(value), 1, 120), "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(safe, "^[._-]+|[._-]+$", ""), 1, 100), F.lit("")), F.lit("run_unknown"))


def write_runs(candidates: DataFrame, folder: str, schema: str = SCHEMA) -> None:
    """JSON lines of ``run_id, source_id, mode, backend, seeds_enabled, generated_at, candidate``, a folder for each run; a run written again is replaced."""
    rows = candidates.withColumns({"schema": F.lit(schema), "run_id": run_id(F.col("run_id"))}).select(*HEAD, "candidate").withColumn("run", F.col("run_id"))
    rows.write.option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).mode("overwrite").partitionBy("run").json(folder)


def write_table(candidates: DataFrame, folder: str) -> None:
    """The same candidates as CSV."""
    rows = candidates.select(run_id(F.col("run_id")).alias("run"), "candidate.*")
    rows.write.mode("overwrite").option("header", True).partitionBy("run").csv(folder)


def read_runs(spark: SparkSession, folder: str, run: str | None = None, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Candidates of all runs or one, and ``run, line, reason`` of the lines that aren't ones of this schema: corrupt, schema or candidate."""
    head = ", ".join(f"{c} {'boolean' if c == 'seeds_enabled' else 'string'}" for c in HEAD)
    shape = f"{head}, candidate struct<{re.sub(r'(\w+) (\w+)', r'\1: \2', CANDIDATE)}>"
    lines = spark.read.text(folder).select(F.col("value").alias("line"), F.regexp_extract("_metadata.file_path", "/run=([^/]+)/", 1).alias("run"))
    if run is not None:
        lines = lines.filter(F.col("run") == run)
    rows = lines.withColumn("r", F.from_json("line", f"{shape}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"}))
    bad = F.when(F.col("r.__corrupt").isNotNull() | F.col("r").isNull(), "corrupt").when(~F.coalesce(F.col("r.schema") == schema, F.lit(False)), "schema").when(F.col("r.candidate.clip_id").isNull(), "candidate")
    judged = rows.withColumn("reason", bad)
    return judged.filter("reason is null").select(*(f"r.{c}" for c in HEAD), "r.candidate"), judged.filter("reason is not null").select("run", "line", "reason")


def run_counts(candidates: DataFrame) -> DataFrame:
    """Candidates, those for review and those of seeds in each run."""
    return candidates.groupBy("run_id").agg(F.count("*").alias("candidates_n"), F.count_if("candidate.review_required").alias("review_n"), F.count_if("candidate.from_acervo_seed").alias("seeds_n"))
