"""Writers: feature lines with a manifest, run exports, feedback snapshots, transcripts and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import timecode

# The columns of a run export.
RUN_COLUMNS = ("live_id", "mode", "run_id", "candidates_n", "approved_n", "approval_rate", "edit_heavy_n", "rejected_favorability_n", "rejected_context_n", "seed_kept_n", "seeds_shown_n", "coice_confirmed_n", "coice_false_n", "time_to_review_min", "headline_accept_n", "notes")


def write_features(accepted: DataFrame, counts: DataFrame, errors: DataFrame, folder: str, most_errors: int = 500) -> None:
    """JSON lines of the accepted rows, and one manifest row with counts and the first errors."""
    accepted.write.mode("overwrite").json(f"{folder}/features")
    first = errors.filter("reason is not null").orderBy("line").limit(most_errors).agg(F.collect_list(F.struct("line", "clip_id", "reason")))
    counts.withColumn("errors", first.scalar()).write.mode("overwrite").json(f"{folder}/manifest")


def run_row(rows: DataFrame, live_id: str, mode: str, run_id: str) -> DataFrame:
    """One row of the 16 run metrics; what isn't known stays empty."""
    out = rows.agg(F.count("*").alias("candidates_n"), F.count_if(F.col("decision") == "approved").alias("approved_n"), F.count_if(F.array_contains("reasons", "context")).alias("rejected_context_n"))
    out = out.withColumns({"live_id": F.lit(live_id), "mode": F.lit(mode), "run_id": F.lit(run_id), "approval_rate": F.round(F.try_divide("approved_n", "candidates_n"), 4)})
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in RUN_COLUMNS))


def write_run(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).csv(folder)


def feedback_snapshot(events: DataFrame, key: str) -> DataFrame:
    """The last event of each clip with its place in the log."""
    w = Window.partitionBy(key).orderBy(F.desc("event_id"))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def srt_text(segments: DataFrame, key: str) -> DataFrame:
    """``key, body``: the SRT file of each source."""
    w = Window.partitionBy(key).orderBy("start", "end", "text")
    cue = F.concat(F.row_number().over(w).cast("string"), F.lit("\n"), timecode.stamp(F.col("start"), ","), F.lit(" --> "), timecode.stamp(F.col("end"), ","), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    rows = segments.withColumns({"__n": F.row_number().over(w), "__cue": cue})
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__cue"))), lambda x: x["__cue"]), "").alias("body"))


def ass_escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ass_chunks(words: DataFrame, key: str, size: int = 4) -> DataFrame:
    """Dialogue lines of a few words each: ``key, chunk, line`` from ``key, pos, start, end, word``."""
    rows = words.withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))
    out = rows.groupBy(key, "chunk").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("t"))
    line = F.concat(F.lit("Dialogue: 0,"), timecode.ass_stamp(F.col("a")), F.lit(","), timecode.ass_stamp(F.col("b")), F.lit(",Default,,0,0,0,,"), ass_escaped(F.col("t")))
    return out.select(key, "chunk", line.alias("line"))


def ass_color(code: Column) -> Column:
    """#RRGGBB to &H00BBGGRR."""
    c = F.upper(F.regexp_replace(code, "^#", ""))
    return F.concat(F.lit("&H00"), F.substring(c, 5, 2), F.substring(c, 3, 2), F.substring(c, 1, 2))


def timestamped_lines(segments: DataFrame, key: str) -> DataFrame:
    """``key, body``: a stamped line for each segment."""
    rows = segments.withColumn("__line", F.concat(timecode.stamp(F.col("start")), F.lit(" "), F.col("text")))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "__line"))), lambda x: x["__line"]), "\n").alias("body"))


def write_texts(bodies: DataFrame, key: str, folder: str) -> None:
    """One folder of text for each source."""
    bodies.select(key, "body").write.mode("overwrite").partitionBy(key).text(folder)
