"""Review data of clips: allow-listed JSON, active bounds, provenance, the queue, replayed decisions, priors and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coerce import clamp, finite_or, finite_or_null
from . import intervals

#: The decisions that are final, and those that a transcript's and a context's origin can have.
FINAL_ACTIONS = ("approved", "rejected", "needs_review")
TRANSCRIPT_SOURCES = (("subtitle", "public_subtitle"), ("gemini", "gemini_video"), ("whisper", "whisper"))
COVERAGE = ("covered", "partial", "mismatch_suspected", "empty", "unknown")


# Validated fields of JSON texts


def _text(raw: Column, path: str, most: int) -> Column:
    found = F.left(F.trim(F.get_json_object(raw, f"$.{path}")), F.lit(most))
    return F.when(found != "", found)


def _number(raw: Column, path: str) -> Column:
    return finite_or_null(F.get_json_object(raw, f"$.{path}"))


def allowed(raw: Column, fields: dict[str, tuple]) -> Column:
    """A struct of the fields of a JSON object that are valid; all others are null, and so are those of a malformed text.

    A field is ``("flag",)``, ``("text", longest)``, ``("one", names)``, ``("number",
    low, high, digits)`` clamped to its bounds (None: unbounded), ``("least", low,
    digits)`` null below it, or ``("whole", low, high)`` null outside.
    """

    def value(name: str, kind: str, *args) -> Column:
        x = _number(raw, name)
        if kind == "flag":
            stated = F.lower(F.trim(F.get_json_object(raw, f"$.{name}")))
            return F.when(stated.isin("true", "1", "yes"), True).when(stated.isin("false", "0", "no"), False)
        if kind == "text":
            return _text(raw, name, args[0])
        if kind == "one":
            found = _text(raw, name, max(map(len, args[0])) + 1)
            return F.when(found.isin(*args[0]), found)
        if kind == "number":
            low, high, digits = args
            x = x if low is None else F.greatest(F.lit(float(low)), x) + F.lit(0.0) * x
            x = x if high is None else F.least(F.lit(float(high)), x) + F.lit(0.0) * x
            return F.round(x, digits)
        if kind == "least":
            return F.when(x >= args[0], F.round(x, args[1]))
        return F.when(x.between(args[0], args[1]), x.cast("long"))

    return F.struct(*(value(name, *rule).alias(name) for name, rule in fields.items()))


# Names of stored fields, with what they may hold.
DEDUP_CONTEXT = {
    "question_answer_complete": ("flag",), "payoff_complete": ("flag",), "qa_bridge": ("flag",), "closure_type": ("text", 64), "editorial_type": ("text", 64), "chapter_primary_id": ("whole", 0, 1_000_000),
}
SCORECARD = {
    "context": ("number", 0, 100, 1), "editorial_strength": ("number", 0, 100, 1), "technical": ("number", 0, 100, 1), "confidence": ("number", 0, 100, 1),
    "status": ("one", ("candidate", "review_required")), "gate_status": ("one", ("pass", "review_required", "blocked")),
}
SCENE_CHANGE = {"applied": ("flag",)} | {n: ("least", 0, 3) for n in ("original_start", "original_end", "adjusted_start", "adjusted_end")} | {"direction": ("one", ("outward_only",))}


def scene_change(raw: Column) -> Column:
    """The allowed fields of a scene adjustment; null if it says it was applied but lacks one of its four times."""
    found = allowed(raw, SCENE_CHANGE)
    times = [found[n].isNotNull() for n in SCENE_CHANGE if n.endswith(("start", "end"))]
    return F.when(~F.coalesce(found["applied"], F.lit(False)) | (times[0] & times[1] & times[2] & times[3]), found)


def provenance(source: Column, coverage: Column, end_ratio: Column, context: Column) -> Column:
    """Where a transcript and its context come from, in known terms; anything else is unknown or none."""
    s = F.lower(F.trim(F.coalesce(source, F.lit("unknown"))))
    named = F.when(s.isin("manual", "manual_confirmed"), "manual").when(s == "automatic", "automatic").otherwise("unknown")
    for part, name in reversed(TRANSCRIPT_SOURCES):
        named = F.when(s.contains(part), name).otherwise(named)
    covered = F.trim(F.coalesce(coverage, F.lit("unknown")))
    return F.struct(
        named.alias("transcript_source"),
        F.when(covered.isin(*COVERAGE), covered).otherwise("unknown").alias("coverage_status"),
        F.when(end_ratio.isNotNull(), F.round(clamp(end_ratio, 0.0, 1.0), 3)).alias("end_ratio"),
        F.when(context.isin("local_dossier", "multimodal_auxiliary"), context).otherwise("none").alias("context_source"),
    )


def favorability_details(value: Column, available: Column, score: Column, review: Column) -> Column:
    """``available, signal, review`` of a struct of available, eligible, signal, review if there is one, else of the flat columns; 50 is the default."""
    nested = F.struct(
        (F.coalesce(value["available"], F.lit(False)) & F.coalesce(value["eligible"], F.lit(True))).alias("available"),
        clamp(finite_or(value["signal"], 50.0), 0.0, 100.0).alias("signal"),
        F.coalesce(value["review"], F.lit(False)).alias("review"),
    )
    flat = F.struct(
        (score.isNotNull() & F.coalesce(available, F.lit(True))).alias("available"),
        clamp(finite_or(score, 50.0), 0.0, 100.0).alias("signal"),
        (score.isNotNull() & F.coalesce(review, F.lit(False))).alias("review"),
    )
    return F.when(value.isNotNull(), nested).otherwise(flat)


def bounds(start: Column, end: Column, new_start: Column, new_end: Column, status: Column) -> Column:
    """A clip's own bounds and those of the file in review: the last adjustment's once it is rendered and valid."""
    a = F.greatest(F.lit(0.0), finite_or(start, 0.0))
    b = F.greatest(a, F.coalesce(finite_or_null(end), a))
    c = F.greatest(F.lit(0.0), F.coalesce(finite_or_null(new_start), a))
    d = F.coalesce(finite_or_null(new_end), b)
    rendered = F.coalesce((F.lower(F.trim(status)) == "rendered") & (d > c), F.lit(False))
    own = F.struct(F.round(a, 3).alias("start"), F.round(b, 3).alias("end"), F.round(b - a, 3).alias("duration"))
    new = F.struct(F.round(c, 3).alias("start"), F.round(d, 3).alias("end"), F.round(d - c, 3).alias("duration"))
    return F.struct(own.alias("original"), F.when(rendered, new).otherwise(own).alias("active"), F.when(rendered, "rendered").otherwise("canonical").alias("status"))


def queue(clips: DataFrame, status: str = "all", by: str = "score") -> DataFrame:
    """Clips of a review status in the queue's order: score or duration from the highest on, or the timeline; ties by id."""
    rows = clips if status == "all" else clips.filter(F.coalesce("review_status", F.lit("pending")) == status)
    order = {"score": F.desc(F.coalesce("score", F.lit(0))), "duration": F.desc(F.coalesce("duration", F.lit(0))), "timeline": F.asc(F.coalesce("start", F.lit(0)))}[by]
    return rows.orderBy(order, "id")


def score_averages(clips: DataFrame, score: str, high: float = 70.0) -> DataFrame:
    """Rows, the mean of the finite scores (0 without any), and how many reach ``high``."""
    s = finite_or_null(F.col(score))
    return clips.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(s), 6), F.lit(0.0)).alias("mean"), F.count_if(s >= high).alias("n_high"))


# Replayed decisions


def matched_records(records: DataFrame, clips: DataFrame, tolerance: float = 0.5, width: float = 60.0) -> DataFrame:
    """Adds ``clip_id``: the newest clip of a record's key, else the newest of its source whose edges lie within the tolerance.

    ``records`` has ``pos`` (unique), ``editorial_key, signature, start, end``; ``clips``
    has ``id, editorial_key, signature, start, end``.  A key's clip of another known source
    doesn't count.  Edges are sought by range bins, so no source is compared in full.
    """
    known = lambda c: F.when(F.trim(c) != "", F.trim(c))
    newest = clips.filter(known(F.col("editorial_key")).isNotNull()).groupBy("editorial_key").agg(F.max_by(F.struct("id", "signature"), "id").alias("c"))
    rows = records.join(newest, "editorial_key", "left")
    other = known(F.col("signature")) != known(F.col("c.signature"))
    rows = rows.withColumn("exact", F.when(~F.coalesce(other, F.lit(False)), F.col("c.id"))).drop("c")
    left = rows.filter("exact is null and start is not null and end is not null").select("pos", known(F.col("signature")).alias("s"), "start", "end", (F.col("start") - tolerance).alias("low"), (F.col("start") + tolerance).alias("high"))
    right = clips.select(known(F.col("signature")).alias("s"), F.col("id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("start").alias("o_at"))
    near = intervals.overlap_join(left.filter("s is not null"), right.filter("s is not null"), ["s"], ("low", "high", "o_start", "o_at"), width, touch=True)
    near = near.filter(F.abs(F.col("o_end") - F.col("end")) <= tolerance).groupBy("pos").agg(F.max("o_id").alias("near_id"))
    return rows.join(near, "pos", "left").withColumn("clip_id", F.coalesce("exact", "near_id")).drop("exact", "near_id")


def restored(records: DataFrame, clips: DataFrame, feedback: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``records`` with ``clip_id`` and ``outcome``: invalid, unmatched, already_current, skipped_older or imported.

    ``feedback`` has ``id, clip_id, action, reason, tags, at``.  Records are taken by
    ``pos``.  The first of a clip that differs from its last decision and is newer is
    imported and is the last decision from then on, made at the time of the replay; so a
    record after it is current if it says the same, else older.
    """
    said = lambda prefix="": F.struct(*(F.col(f"{prefix}{c}") for c in ("action", "reason", "tags")))
    valid = (F.trim(F.coalesce("editorial_key", F.lit(""))) != "") & F.col("action").isin(*FINAL_ACTIONS) & F.col("at").isNotNull()
    rows = records.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    found = matched_records(rows.filter("__valid"), clips, tolerance)
    last = feedback.filter(F.col("action").isin(*FINAL_ACTIONS)).groupBy("clip_id").agg(F.max_by(F.struct(said().alias("said"), "at"), "id").alias("last"))
    found = found.join(last, "clip_id", "left").withColumn("said", said())
    same = F.coalesce(F.col("last.said").eqNullSafe(F.col("said")) & F.col("last").isNotNull(), F.lit(False))
    older = F.coalesce(F.col("at") <= F.col("last.at"), F.lit(False))
    found = found.withColumns({"same": same, "fresh": ~same & ~older & F.col("clip_id").isNotNull()})
    first = found.filter("fresh").groupBy("clip_id").agg(F.min_by(F.struct("pos", "said"), "pos").alias("first"))
    found = found.join(first, "clip_id", "left")
    after = F.coalesce(F.col("pos") > F.col("first.pos"), F.lit(False))
    outcome = (
        F.when(F.col("clip_id").isNull(), "unmatched")
        .when(F.col("pos") == F.col("first.pos"), "imported")
        .when(F.when(after, F.col("first.said").eqNullSafe(F.col("said"))).otherwise(F.col("same")), "already_current")
        .otherwise("skipped_older")
    )
    found = found.select(*records.columns, "clip_id", outcome.alias("outcome"))
    bad = rows.filter(~F.col("__valid")).select(*records.columns, F.lit(None).cast("long").alias("clip_id"), F.lit("invalid").alias("outcome"))
    return found.unionByName(bad)


def outcome_counts(rows: DataFrame) -> DataFrame:
    """One row: records seen, and how many had each outcome."""
    names = ("imported", "already_current", "skipped_older", "unmatched", "invalid")
    return rows.agg(F.count("*").alias("records_seen"), *(F.count_if(F.col("outcome") == n).alias(n) for n in names))


# Priors


def outcome_shares(reviews: DataFrame, decision: str, columns: list[str]) -> DataFrame:
    """``feature, value, approved, rejected, approved_share``: how often each value of each column stands with either decision."""
    known = reviews.filter(F.col(decision).isin("approved", "rejected"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns))).alias("p")
    out = known.select(decision, pairs).groupBy("p.feature", "p.value").agg(F.count_if(F.col(decision) == "approved").alias("approved"), F.count_if(F.col(decision) == "rejected").alias("rejected"))
    total = known.agg(F.count_if(F.col(decision) == "approved"))
    return out.withColumn("approved_share", F.round(F.coalesce(F.try_divide("approved", total.scalar()), F.lit(0.0)), 3))


def flag_rates(reviews: DataFrame, decision: str, flags: list[str], wanted: str = "approved") -> DataFrame:
    """One row of the share of each flag among the reviews of one decision; 0 without any."""
    rows = reviews.filter(F.col(decision) == wanted)
    return rows.agg(*(F.round(F.coalesce(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")), F.lit(0.0)), 3).alias(f) for f in flags))


def nested_counts(rows: DataFrame, outer: str, inner: str, most: int | None = None) -> DataFrame:
    """``outer, total, counts``: a map of the inner values' numbers; the ``most`` largest totals, ties by name."""
    each = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(inner).alias("key"), F.col("n").alias("value"))))
    out = each.filter(F.col(inner).isNotNull()).groupBy(outer).agg(F.sum("n").alias("total"), F.map_from_entries(entries).alias("counts"))
    return out if most is None else out.orderBy(F.desc("total"), outer).limit(most)


def hook_priors(rows: DataFrame, account: str, hook: str, ratio: str) -> DataFrame:
    """Observations, mean and greatest ratio of each account's hooks; negative and missing ratios don't count."""
    return rows.filter(F.col(ratio) >= 0).groupBy(account, F.coalesce(hook, F.lit("other")).alias(hook)).agg(
        F.count("*").alias("observations"), F.round(F.avg(ratio), 3).alias("mean_ratio"), F.round(F.max(ratio), 3).alias("max_ratio")
    )


def feed_summary(rows: DataFrame, profile: str, video: Column, at: str, likes: str) -> DataFrame:
    """Entries of each profile, how many are videos and dated, and the range of likes."""
    return rows.groupBy(profile).agg(
        F.count("*").alias("entries"), F.count_if(video).alias("videos"), F.count(at).alias("dated"), F.min(likes).alias("likes_min"), F.max(likes).alias("likes_max")
    )


def relative_levels(points: DataFrame, keys: list[str], level: str, digits: int = 4) -> DataFrame:
    """Adds ``relative``: a level over the greatest of its source; 0 where that isn't positive."""
    top = points.groupBy(*keys).agg(F.max(level).alias("__top"))
    return points.join(top, keys).withColumn("relative", F.when(F.col("__top") > 0, F.round(F.col(level) / F.col("__top"), digits)).otherwise(0.0)).drop("__top")


# Audits


def audio_signals(clips: DataFrame, points: DataFrame, keys: list[str], id_col: str, width: float, before: float = 1.5) -> DataFrame:
    """Adds ``audio``: a struct of available, signal (0..100), the means and peaks it is made of, and whether to review it.

    ``points`` has the keys and ``at, energy, onset, reaction`` of 0..1; those from
    ``before`` ahead of a clip to its end count.  Without any the signal is 50.
    """
    p = points.select(*keys, "at", *(clamp(F.coalesce(c, F.lit(0.0)), 0.0, 1.0).alias(c) for c in ("energy", "onset", "reaction")))
    met = intervals.points_within(clips.select(*keys, id_col, (F.col("start") - before).alias("start"), "end"), p, keys, "at", width)
    means = met.groupBy(*keys, id_col).agg(F.avg("energy").alias("energy"), F.max("energy").alias("peak"), F.avg("onset").alias("onset"), F.max("reaction").alias("reaction"))
    signal = clamp(35.0 + F.col("energy") * 25.0 + F.col("peak") * 20.0 + F.col("onset") * 10.0 + F.col("reaction") * 10.0, 0.0, 100.0)
    audio = F.struct(
        F.lit(True).alias("available"), F.round(signal, 1).alias("signal"), F.round("energy", 4).alias("mean_energy"), F.round("peak", 4).alias("peak_energy"),
        F.round("onset", 4).alias("mean_onset"), F.round("reaction", 4).alias("reaction_peak"), (F.col("reaction") >= 0.58).alias("review"),
    )
    none = F.struct(F.lit(False).alias("available"), F.lit(50.0).alias("signal"), *(F.lit(None).cast("double").alias(c) for c in ("mean_energy", "peak_energy", "mean_onset", "reaction_peak")), F.lit(True).alias("review"))
    return clips.join(means.select(*keys, id_col, audio.alias("audio")), [*keys, id_col], "left").withColumn("audio", F.coalesce("audio", none))


def clip_context(clips: DataFrame, segments: DataFrame, keys: list[str], id_col: str, width: float, question: Column, slack: float = 0.5) -> DataFrame:
    """What of a transcript each clip covers: segments, questions, its ends, and whether it starts inside one or ends near a start."""
    slim = clips.select(*keys, id_col, "start", "end")
    s = segments.select(*keys, F.col("start").alias("o_start"), F.col("end").alias("o_end"), question.alias("asks"))
    met = intervals.overlap_join(slim, s, keys, ("start", "end", "o_start", "o_end"), width, touch=True)
    covered = (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))
    inside = (F.col("o_start") < F.col("start")) & (F.col("start") <= F.col("o_end"))
    found = met.groupBy(*keys, id_col).agg(
        F.count_if(covered).alias("segments"), F.count_if(covered & F.col("asks")).alias("questions"), F.max(inside).alias("inside"),
        F.min(F.when(covered, F.col("o_start"))).alias("first_start"), F.max_by(F.when(covered, F.col("o_end")), F.when(covered, F.col("o_start"))).alias("last_end"),
    )
    ends = slim.select(*keys, id_col, (F.col("end") - slack).alias("start"), (F.col("end") + slack).alias("end"))
    near = intervals.points_within(ends, segments.select(*keys, F.col("start").alias("at")), keys, "at", width).select(*keys, id_col).distinct().withColumn("near", F.lit(True))
    out = slim.join(found, [*keys, id_col], "left").join(near, [*keys, id_col], "left").fillna(0, ["segments", "questions"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*keys, id_col, (F.col("end") - F.col("start")).alias("duration"), "segments", "questions", "first_start", "last_end", yes("inside").alias("starts_inside"), yes("near").alias("ends_near"))


def clip_context_summary(rows: DataFrame) -> DataFrame:
    """Clips, those with a question, those that start inside a segment, and their mean length."""
    return rows.agg(F.count("*").alias("clips"), F.count_if(F.col("questions") > 0).alias("with_question"), F.count_if("starts_inside").alias("starting_inside"), F.coalesce(F.round(F.avg("duration"), 3), F.lit(0.0)).alias("mean_duration"))


def newest(rows: DataFrame, at: str, most: int = 50) -> DataFrame:
    """The newest rows, ties by id; ``most`` is the report's length."""
    return rows.orderBy(F.desc(at), "id").limit(most)


def block_dossier(clips: DataFrame, states: tuple[str, ...] = ("candidate", "approved", "rejected", "needs_review")) -> DataFrame:
    """``block`` of each candidate with a length: state, thesis, reason, family, at most eight tags, and its moments.

    ``clips`` has ``start, end, state, thesis, title, reason, family, tags`` and
    ``moments`` (an array of kind, start, end, reason).  Without moments the clip itself
    is the primary one.  Of moments the first eight with a length stay, as the dossier's form has it.
    """
    text = lambda *cs: F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in cs), F.lit(""))
    timed = lambda m: F.struct(F.coalesce(m["kind"], F.lit("primary")).alias("kind"), F.round(m["start"], 3).alias("start"), F.round(m["end"], 3).alias("end"), F.coalesce(m["reason"], F.lit("")).alias("reason"))
    given = F.transform(F.slice(F.filter("moments", lambda m: (m["start"] >= 0) & (m["end"] > m["start"])), 1, 8), timed)
    own = F.array(F.struct(F.lit("primary").alias("kind"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), text("reason").alias("reason")))
    block = F.struct(
        F.when(F.col("state").isin(*states), F.col("state")).otherwise("candidate").alias("state"), text("thesis", "title").alias("thesis"), text("reason").alias("reason"),
        F.when(text("family") == "", "unknown").otherwise(text("family")).alias("family"), F.slice(F.filter("tags", lambda t: F.trim(t) != ""), 1, 8).alias("tags"),
        F.round(F.col("end") - F.col("start"), 3).alias("duration"), F.when(F.size(given) > 0, given).otherwise(own).alias("moments"),
    )
    return clips.filter((F.col("start") >= 0) & (F.col("end") > F.col("start"))).withColumn("block", block)
