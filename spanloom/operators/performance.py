"""Performance snapshots: normalized rows, sums, changes and standing in a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import timecode


def normalized(df: DataFrame) -> DataFrame:
    """Adds engagement_actions, engagement_rate, age_hours and velocity to rows with counts and two timestamps."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    actions = n("likes") + n("comments") + n("shares") + n("saves")
    age = timecode.age_hours(F.col("published_at"), F.col("collected_at"))
    out = df.withColumns({"views": n("views"), "engagement_actions": actions, "age_hours": age})
    rate = F.round(F.try_divide("engagement_actions", F.nullif(F.col("views"), F.lit(0))), 6)
    return out.withColumns({"engagement_rate": rate, "velocity": F.round(F.col("views") / F.greatest("age_hours", F.lit(1.0)), 3)})


def selected(df: DataFrame, **equal: str | int | None) -> DataFrame:
    """Rows equal to each value given; None leaves a column open."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Rows, contents, views and means; sums of nothing are 0, means of nothing null."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_snapshots"),
        F.count_distinct("content_key").alias("n_contents"),
        F.coalesce(F.sum("views"), F.lit(0)).cast("long").alias("views"),
        F.round(F.avg("engagement_rate"), 6).alias("mean_rate"),
        F.round(F.avg("velocity"), 3).alias("mean_velocity"),
    )


def changes(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each snapshot against the last one of the same content: views_delta, growth, hours."""
    order = Window.partitionBy(key).orderBy(at, tie)
    last, when = F.lag("views").over(order), F.lag(at).over(order)
    delta = F.col("views") - last
    return df.withColumns({"views_delta": delta, "growth": F.round(F.try_divide(delta, F.nullif(last, F.lit(0))), 6), "hours": timecode.age_hours(when, F.col(at))})


def cohort_score(df: DataFrame, cohort: list[str], weights: dict[str, float], digits: int = 2) -> DataFrame:
    """Share of the cohort at or below each metric, times 100, and their mean by weight over those that exist.

    The standing of a value is counted once for each distinct value of a cohort, so a
    hot cohort is summed up before its window.
    """
    out = df
    for name in weights:
        counts = df.filter(F.col(name).isNotNull()).groupBy(*cohort, name).agg(F.count("*").alias("__n"))
        up_to = F.sum("__n").over(Window.partitionBy(*cohort).orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
        share = F.round(100.0 * up_to / F.sum("__n").over(Window.partitionBy(*cohort)), 2)
        out = out.join(counts.select(*cohort, name, share.alias(f"{name}_pct")), [*cohort, name], "left")
    known = lambda n: F.col(f"{n}_pct").isNotNull()
    total = sum((F.when(known(n), F.col(f"{n}_pct") * w).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(known(n), w).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    return out.withColumn("score", F.round(F.try_divide(total, weight), digits))


def metric_labels(velocity: Column, rate: Column, position: Column, state: Column) -> Column:
    """Names of what has been observed."""
    found = F.array(F.when(velocity.isNotNull(), "velocity"), F.when(rate.isNotNull(), "engagement"), F.when(position.isNotNull(), "position"), F.when(state != "", F.concat(F.lit("state: "), state)))
    return F.filter(found, lambda x: x.isNotNull())


def daily_progress(df: DataFrame, at: str, day: str, status: str, target: int) -> DataFrame:
    """Counts by status for one day, and the share of a target."""
    today = df.filter(F.to_date(at) == F.lit(day).cast("date"))
    out = today.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in ("approved", "rejected", "review", "pending")))
    return out.withColumn("percent", F.round(F.least(F.lit(100.0), F.col("approved") * 100.0 / target), 1))
