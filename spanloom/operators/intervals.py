"""Interval joins, unions, islands and timelines.  Columns start, end are numbers of one unit.

Range joins are done by bins: an interval is listed under each bin of a fixed width
that it touches, rows meet by (keys, bin), and a pair counts only in the first bin that
both have.  So no pair appears twice and nothing needs a distinct.  Choose a width near
the usual length of an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _binned(df: DataFrame, start: str, end: str, width: float, name: str, touch: bool) -> DataFrame:
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width) if touch else F.ceil(F.col(end) / width) - 1
    return df.withColumn(f"{name}_low", low).withColumn("__bin", F.explode(F.sequence(low, F.greatest(low, high))))


def bins(start: Column, end: Column, width: float) -> Column:
    """Numbers of the bins that an interval touches, its end not included."""
    low = F.floor(start / width)
    return F.sequence(low, F.greatest(low, F.ceil(end / width) - 1))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ends: tuple[str, str, str, str], width: float, touch: bool = False) -> DataFrame:
    """Pairs of equal keys whose intervals overlap; with ``touch`` they may share an end only.

    ``ends`` names start and end of the left and of the right side; apart from the keys
    the sides have no column in common.  Rows without start or end join nothing.
    """
    a, b, c, d = ends
    x = _binned(left.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, width, "__l", touch)
    y = _binned(right.filter(F.col(c).isNotNull() & F.col(d).isNotNull()), c, d, width, "__r", touch)
    met = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) if touch else (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    pairs = x.join(y, [*keys, "__bin"]).filter(met & (F.col("__bin") == F.greatest("__l_low", "__r_low")))
    return pairs.drop("__bin", "__l_low", "__r_low")


def intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Over the hull of both; equal to the union's length where they overlap."""
    return F.try_divide(intersection(a, b, c, d), F.greatest(b, d) - F.least(a, c))


def overlap_of_shorter(a: Column, b: Column, c: Column, d: Column, least: float = 0.0) -> Column:
    """Intersection over the shorter length, or over ``least`` if that is more."""
    return F.try_divide(intersection(a, b, c, d), F.greatest(F.least(b - a, d - c), F.lit(least)))


def coverage_of_second(a: Column, b: Column, c: Column, d: Column) -> Column:
    return intersection(a, b, c, d) / F.greatest(F.lit(0.001), d - c)


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: float = 0) -> DataFrame:
    """Adds ``island``: its number within the keys; an interval starts one if it is more than ``gap`` past all before it."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col(start) > reach + gap)).cast("int")
    return df.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def merged(df: DataFrame, keys: list[str], gap: float = 0, evidence: str | None = None) -> DataFrame:
    """The islands themselves: start, end, rows, and the sum of an evidence column."""
    sums = [F.sum(evidence).alias("evidence")] if evidence else []
    return islands(df, keys, gap=gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_rows"), *sums)


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """Length that the intervals of a key cover together; touching ones merge."""
    return merged(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("n_islands"))


def reference_coverage(predictions: DataFrame, references: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Length of the references, how much of it predictions cover, and the ratio; 0 without cover."""
    p = predictions.select(*keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    r = references.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    parts = overlap_join(p, r, keys, ("p_start", "p_end", "r_start", "r_end"), width).select(*keys, F.greatest("p_start", "r_start").alias("start"), F.least("p_end", "r_end").alias("end"))
    total = union_length(references, keys).select(*keys, F.col("covered").alias("reference_length"))
    hit = union_length(parts, keys).select(*keys, F.col("covered").alias("covered_length"))
    out = total.join(hit, keys, "left").withColumn("covered_length", F.coalesce("covered_length", F.lit(0)))
    return out.withColumn("coverage_ratio", F.round(F.col("covered_length") / F.col("reference_length"), 6))


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], ends: tuple[str, str, str, str], width: float, by: list[str], strength: Column, choice: str) -> DataFrame:
    """For each left row (``by`` names its id columns) the right row of most strength, of equal ones the smallest ``choice``."""
    pairs = overlap_join(left, right, keys, ends, width).withColumn("strength", strength)
    rest = [c for c in pairs.columns if c not in by]
    best = pairs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("strength", -F.col(choice))).alias("best"))
    return best.select(*by, "best.*")


def points_within(intervals: DataFrame, points: DataFrame, keys: list[str], at: str, width: float, before: float = 0) -> DataFrame:
    """Pairs of an interval and the points from ``start - before`` to ``end``, both included."""
    x = intervals.withColumn("__from", F.col("start") - before)
    low = F.floor(F.col("__from") / width)
    x = x.withColumn("__bin", F.explode(F.sequence(low, F.floor(F.col("end") / width))))
    y = points.withColumn("__bin", F.floor(F.col(at) / width))
    return x.join(y, [*keys, "__bin"]).filter((F.col(at) >= F.col("__from")) & (F.col(at) <= F.col("end"))).drop("__bin", "__from")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str) -> DataFrame:
    """For each left row the last right row at or before it and the first after it, by one sort of both.

    Adds ``before`` and ``after``: structs of the right side's columns, null where there
    is none.  A right row of the same place counts as before.
    """
    rows = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("__right"))
    more = right.select(*keys, F.col(other).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*right.columns).alias("__right"))
    both = rows.unionByName(more)
    order = Window.partitionBy(*keys).orderBy("__at", "__side")
    before = F.last("__right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__right", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumns({"before": before, "after": after}).filter("__side = 1").select("__left.*", "before", "after")


def derived_timeline(df: DataFrame, keys: list[str], padding: float = 0.0) -> DataFrame:
    """Places the kept intervals one after the other: original_start/end and derived_start/end.

    An interval is cut to what lies past all before it and ahead of the next one's
    start; padding never reaches into the next one or back into the last one.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = df.filter("end > start").withColumns({"__reach": reach, "__next": F.lead("start").over(order)})
    rows = rows.withColumn("__from", F.greatest("start", "__reach")).filter("end > __from")
    begin = F.greatest(F.col("__reach"), F.col("__from") - padding)
    stop = F.least(F.col("end") + padding, F.coalesce("__next", F.col("end") + padding))
    rows = rows.withColumns({"original_start": begin, "original_end": stop}).filter("original_end > original_start")
    placed = Window.partitionBy(*keys).orderBy("original_start", "original_end").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("original_end") - F.col("original_start")
    rows = rows.withColumn("derived_end", F.sum(length).over(placed)).withColumn("derived_start", F.col("derived_end") - length)
    return rows.select(*keys, "original_start", "original_end", "derived_start", "derived_end")


def mapped(queries: DataFrame, timeline: DataFrame, keys: list[str], width: float, to: str = "original") -> DataFrame:
    """Parts of the query intervals (start, end) in the other timeline; a query outside it has none."""
    source = "derived" if to == "original" else "original"
    pairs = overlap_join(queries, timeline, keys, ("start", "end", f"{source}_start", f"{source}_end"), width)
    shift = F.col(f"{to}_start") - F.col(f"{source}_start")
    return pairs.withColumns({"mapped_start": F.greatest("start", f"{source}_start") + shift, "mapped_end": F.least("end", f"{source}_end") + shift}).drop("original_start", "original_end", "derived_start", "derived_end")


def runs_above(df: DataFrame, keys: list[str], at: str, level: str, threshold: float, least: float, step: float) -> DataFrame:
    """Runs of points at or above a level: start, end (the first point below, or a step past the last), mean of what lies between."""
    order = Window.partitionBy(*keys).orderBy(at)
    high = F.col(level) >= threshold
    rows = df.withColumns({"__high": high, "__next": F.lead(at).over(order), "__next_level": F.lead(level).over(order), "__fresh": (high & ~F.coalesce(F.lag(high).over(order), F.lit(False))).cast("int")})
    rows = rows.withColumn("run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("__high")
    low = F.col("__next").isNotNull() & (F.col("__next_level") < threshold)
    found = rows.groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(F.coalesce("__next", F.col(at) + step)).alias("end"), (F.sum(level) + F.coalesce(F.sum(F.when(low, F.col("__next_level"))), F.lit(0.0))).alias("__sum"), (F.count("*") + F.count_if(low)).alias("__n"))
    return found.filter(F.col("end") - F.col("start") >= least).select(*keys, "start", "end", (F.col("__sum") / F.col("__n")).alias("mean_level"))


def sessions(df: DataFrame, keys: list[str], start: str, end: str, evidence: str, gap: float, lead: float, least: float, merge: float) -> DataFrame:
    """Windows of active rows (evidence above 0): gaps up to ``gap`` after the last active end, a lead-in, a minimal length, then merged within ``merge``."""
    active = df.filter(F.col(evidence) > 0).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), evidence)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    rows = active.withColumn("__last", F.lag("end").over(order))
    rows = rows.withColumn("__no", F.sum((F.col("__last").isNull() | (F.col("start") - F.col("__last") > gap)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "__no").agg(F.greatest(F.lit(0), F.min("start") - lead).alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.sum(evidence).alias(evidence))
    return merged(found.filter(F.col("end") - F.col("start") >= least).drop("__no"), keys, gap=merge, evidence=evidence)


def with_next_start(df: DataFrame, keys: list[str], default: float, least: float) -> DataFrame:
    """Missing ends become the next start, else start + default; each interval lasts ``least`` at least."""
    order = Window.partitionBy(*keys).orderBy("start", *[c for c in ("turn", "id") if c in df.columns])
    following = F.lead("start").over(order)
    end = F.coalesce("end", F.when(following > F.col("start"), following), F.col("start") + default)
    return df.withColumns({"id": F.row_number().over(order).cast("long") - 1, "end": F.greatest(F.col("start") + least, end)})


def coverage_status(segments: DataFrame, keys: list[str], length: str) -> DataFrame:
    """First, last and span as shares of the source's length, and empty, mismatch_suspected, partial or covered."""
    valid = (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    out = segments.groupBy(*keys, length).agg(F.min(F.when(valid, F.col("start"))).alias("first"), F.max(F.when(valid, F.col("end"))).alias("last"), F.count_if(valid).alias("n_segments"))
    share = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / F.col(length))), 3)
    out = out.withColumns({"first_ratio": share(F.col("first")), "end_ratio": share(F.col("last")), "span_ratio": share(F.col("last") - F.col("first"))})
    narrow = (F.col("first_ratio") > 0.20) | (F.col("span_ratio") < 0.55)
    status = F.when(F.col("n_segments") == 0, "empty").when(F.col("last") > F.col(length) * 1.05, "mismatch_suspected").when((F.col("end_ratio") < 0.35) | narrow, "partial").otherwise("covered")
    return out.withColumn("status", status)


def structure_audit(segments: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Counts of overlaps with all before, backward steps, gaps over 3, adjacent equal texts and empty texts."""
    order = Window.partitionBy(*keys).orderBy("turn")
    rows = segments.withColumns({
        "__reach": F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "__start": F.lag("start").over(order),
        "__text": F.lag(text).over(order),
    })
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_segments"),
        F.count_if(F.col("start") < F.col("__reach")).alias("n_overlaps"),
        F.count_if(F.col("start") < F.col("__start")).alias("n_backwards"),
        F.count_if(F.col("start") - F.col("__reach") > 3).alias("n_gaps"),
        F.count_if(F.col(text) == F.col("__text")).alias("n_repeated"),
        F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("n_empty"),
    )
