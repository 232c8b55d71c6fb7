"""Evidence from an archive of known blocks: the best one that a clip overlaps, and blocks that no clip covers as seeds.

A block counts only for the same source and an overlapping time; a like text alone is no
evidence.  Signals are bounded, and stay for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, text, timecode
from ..sources import records
from . import clips as clip_ops
from . import intervals, selection

# Names under which a block's fields are found, in this order; the shares of a block's strength; states and tiers.
NAMES = {
    "block_id": ("id", "blockId", "block_id"),
    "start": ("startS", "start_seconds", "start", "timestamp"),
    "end": ("endS", "end_seconds", "end"),
    "video": ("video.youtubeId", "video.videoId", "video.id", "video.url", "videoId", "video_id", "sourceVideoId"),
    "url": ("video.youtubeUrl", "video.url", "youtubeUrl", "url", "source_url"),
    "source_title": ("video.title", "video.name", "sourceTitle", "source_title"),
    "title": ("title", "blockTitle", "label", "name"),
    "summary": ("summary", "description", "abstract"),
    "content_class": ("contentClass", "content_class", "class"),
    "category": ("category", "categoryLabel"),
    "density": ("densityRank", "density_rank"),
    "self_contained": ("selfContainedRank", "self_contained_rank"),
    "trust_tier": ("trustTier", "trust_tier"),
    "needs_context": ("needsContext", "needs_context"),
    "reason": ("reason", "primaryReason", "rationale"),
    "published_at": ("video.publishedAt", "video.published_at"),
}
LENGTHS = {"block_id": 120, "url": 260, "source_title": 220, "title": 260, "summary": 700, "content_class": 40, "category": 100, "trust_tier": 30, "reason": 320, "published_at": 80}
STRENGTH = {"overlap": 0.62, "words": 0.18, "density": 0.12, "self_contained": 0.08}
STATES = ("no_snapshot_blocks", "source_not_verified", "source_has_no_overlapping_block", "aligned_same_source")
SPEECH, TRUSTED = "fala", ("owner", "qa", "verified")


def source(value: Column) -> Column:
    """A source's identity without regard to case."""
    return F.lower(records.source_key(F.regexp_replace(value, "youtube[.]com/embed/", "youtu.be/")))


def blocks(rows: DataFrame, column: str, speaking: tuple[str, ...] = ("speaking",)) -> DataFrame:
    """Typed fields of archive blocks from a variant; those without a valid time go.

    Adds the fields of NAMES, ``source_id``, ``topics``, ``warnings``, ``highlights`` as
    text and ``speaking`` (null: not known) to the other columns of ``rows``.  Ranks are
    0..100: null below, 100 above.
    """
    get = lambda *names: coerce.first_text(*(F.try_variant_get(column, f"$.{n}", "string") for n in names))
    cut = lambda name: F.substring(text.collapsed(F.coalesce(get(*NAMES[name]), F.lit(""))), 1, LENGTHS[name])
    listed = lambda *names: F.coalesce(*(F.try_variant_get(column, f"$.{n}", "array<string>") for n in names), F.array().cast("array<string>"))
    moments = F.coalesce(*(F.try_variant_get(column, f"$.{n}", "array<struct<text:string,reason:string>>") for n in ("highlights", "moments", "blockHighlights")))
    said = F.array_join(F.transform(moments, lambda m: F.concat_ws(" ", m["text"], m["reason"])), " ")
    rank = lambda name: coerce.floored_or_null(get(*NAMES[name]), 0.0, 100.0)
    time = lambda name: timecode.seconds_strict(get(*NAMES[name]))
    out = rows.withColumns({
        **{name: cut(name) for name in LENGTHS}, "start": time("start"), "end": time("end"), "source_id": source(F.coalesce(get(*NAMES["video"]), get(*NAMES["url"]))),
        "density": rank("density"), "self_contained": rank("self_contained"), "topics": listed("topics", "tags", "contentTags"), "warnings": listed("gateWarnings", "gate_warnings", "riskFlags"),
        "needs_context": coerce.flag(get(*NAMES["needs_context"])), "speaking": F.coalesce(*(F.try_variant_get(column, f"$.{n}", "boolean") for n in speaking)), "highlights": F.coalesce(said, F.lit("")),
    })
    lower = {c: F.lower(c) for c in ("content_class", "trust_tier")}
    return out.withColumns(lower).filter((F.col("end") > F.col("start")) & (F.col("start") >= 0)).drop(column)


def token_similarity(left: Column, right: Column) -> Column:
    """The words' Jaccard, or three quarters of the sequence ratio of both sets in order, whichever is more; four digits."""
    words = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(text.folded(c), F.lit("([a-z0-9à-ÿ]+)"), 1)), lambda w: F.length(w) > 2)
    a, b = words(left), words(right)
    ordered = clip_ops.sequence_ratio(F.array_join(F.array_sort(a), " "), F.array_join(F.array_sort(b), " "))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.greatest(text.jaccard(a, b), ordered * 0.75), 4)).otherwise(0.0)


def aligned(rows: DataFrame, archive: DataFrame, id_col: str = "id", account: str = "account", width: float = 60.0) -> DataFrame:
    """``rows`` with ``alignment``: the block of their source that overlaps them most strongly, and what it says.

    ``rows`` has ``account, source_id, start, end, text``; ``archive`` has the columns of
    ``blocks`` with ``account`` and ``place``, their order, of which the first of equally
    strong ones stands.  Strength weighs overlap with the shorter, words and two ranks.
    Speech that isn't known to be another's lifts the signal from 50 by 8 at most; other
    blocks leave it.  Texts are compared for overlapping pairs only.
    """
    known = (F.coalesce("source_id", F.lit("")) != "") & (F.col("end") > F.col("start")) & (F.col("start") >= 0)
    own = rows.withColumn("__source", source(F.col("source_id")))
    slim = own.filter(known).select(account, "__source", id_col, "start", "end", "text")
    kept = ("block_id", "place", "start", "end", "title", "summary", "highlights", "density", "self_contained", "content_class", "speaking", "needs_context", "warnings", "trust_tier")
    other = archive.filter("source_id <> ''").select(account, F.col("source_id").alias("__source"), *(F.col(c).alias(f"o_{c}") for c in kept))
    pairs = intervals.overlap_join(slim, other, [account, "__source"], ("start", "end", "o_start", "o_end"), width)
    pairs = pairs.withColumn("overlap", intervals.overlap_of_shorter(*map(F.col, ("start", "end", "o_start", "o_end")), least=0.001))
    pairs = pairs.withColumn("words", token_similarity(F.col("text"), F.concat_ws(" ", "o_title", "o_summary", "o_highlights")))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 100.0
    parts = {"overlap": F.col("overlap"), "words": F.col("words"), "density": share("o_density"), "self_contained": share("o_self_contained")}
    pairs = pairs.withColumn("strength", coerce.clamp(sum((parts[n] * w for n, w in STRENGTH.items()), F.lit(0.0)), 0.0, 1.0))
    rest = [F.col(c).alias(c.removeprefix("o_")) for c in ("strength", "overlap", "words", *(f"o_{c}" for c in kept if c not in ("start", "end", "title", "summary", "highlights")))]
    best = pairs.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct("strength", -F.col("o_place"))).alias("__best"))
    some = archive.select(account).distinct().withColumn("__some", F.lit(True))
    out = own.join(best, id_col, "left").join(some, account, "left")
    b = F.col("__best")
    speech = F.coalesce(b["speaking"], F.lit(True)) & b["content_class"].isin("", SPEECH)
    state = F.when(F.col("__some").isNull(), STATES[0]).when(~F.coalesce(known, F.lit(False)), STATES[1]).when(b.isNull(), STATES[2]).otherwise(STATES[3])
    found = b.isNotNull()
    doubt = (F.size(b["warnings"]) > 0) | b["needs_context"] | (b["content_class"] != SPEECH) | ~F.coalesce(b["speaking"], F.lit(True)) | ~b["trust_tier"].isin(*TRUSTED)
    signal = F.when(speech, 50.0 + F.least(F.lit(8.0), b["strength"] * 8.0)).otherwise(F.least(F.lit(50.0), 50.0 + b["strength"] * 2.0))
    alignment = F.struct(
        state.alias("state"), found.alias("available"), F.when(found, F.round(signal, 1)).otherwise(50.0).alias("signal"), F.when(found, F.round(F.least(F.lit(0.98), 0.45 + b["strength"] * 0.5), 2)).otherwise(0.0).alias("confidence"),
        F.when(found, doubt).otherwise(state != STATES[0]).alias("review_required"), F.when(found, speech).alias("persona_match"), b["block_id"].alias("block_id"), F.round(b["overlap"], 3).alias("overlap"), b["words"].alias("similarity"),
    )
    return out.withColumn("alignment", alignment).drop("__source", "__best", "__some")


def with_seeds(rows: DataFrame, archive: DataFrame, key: str = "source_id", most: int = 8) -> DataFrame:
    """``rows`` and the archive's seeds of their sources, flagged as such: blocks that no row covers, with a summary for their text.

    Seeds have the block's id, times and ``seed`` true; other columns of ``rows`` are null.
    """
    sources = rows.select(source(F.col(key)).alias(key)).filter(f"{key} <> ''").distinct()
    summary = F.substring(text.collapsed(F.concat_ws(" ", "highlights", "title", "summary")), 1, 420)
    known = archive.join(sources, key, "left_semi").withColumn("text", summary)
    taken = rows.withColumn(key, F.nullif(source(F.col(key)), F.lit("")))
    seeds = selection.block_seeds(taken, known.select(key, "block_id", "start", "end", "text", "self_contained", "density"), key, "block_id", most)
    seeds = seeds.select(key, "block_id", "start", "end", "text", F.lit(True).alias("seed"))
    return rows.withColumn("seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
