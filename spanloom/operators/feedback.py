"""Review decisions: latest ones, calibration, priors, imports and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The reason codes that review data carry, by what they are about.
REASON_CATEGORIES = {
    "hook": ("good_hook", "weak_hook", "no_hook"),
    "context_payoff": ("excellent_context", "missing_context", "no_payoff"),
    "speaker_audio": ("wrong_speaker", "audio_overlap"),
    "duration": ("too_long",),
    "framing": ("bad_framing",),
}


def latest(events: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """The fields of the last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("last")).select(key, "last.*")


def with_latest(rows: DataFrame, events: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """Rows with the fields of their last event, null without one."""
    return rows.join(latest(events, key, order, *fields), key, "left")


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The whole last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, in the place of its first."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"), F.min(order).alias("place"))
    return out.select(key, *(F.col(f"row.{c}").alias(c) for c in rest if c != order), "place")


def review_counts(parents: DataFrame, children: DataFrame, key: str, status: str) -> DataFrame:
    """Parents with the number of children, approved and in review; 0 without any."""
    counts = children.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(status) == "approved").alias("approved"), F.count_if(F.col(status) == "review").alias("review"))
    return parents.join(counts, key, "left").fillna(0, ["total", "approved", "review"])


def factor_deltas(reviews: DataFrame, factors: str, decision: str) -> DataFrame:
    """Mean of each factor among approved less among rejected, for factors that all reviews have."""
    long = reviews.filter(F.col(decision).isin("approved", "rejected")).select(decision, F.explode(factors).alias("factor", "value"))
    total = reviews.filter(F.col(decision).isin("approved", "rejected")).agg(F.count("*"))
    a, r = F.avg(F.when(F.col(decision) == "approved", F.col("value"))), F.avg(F.when(F.col(decision) == "rejected", F.col("value")))
    out = long.groupBy("factor").agg(F.round(a - r, 2).alias("delta"), F.count("*").alias("n"))
    return out.filter(F.col("n") == total.scalar()).select("factor", "delta", "n")


def eligibility(reviews: DataFrame, decision: str, least: int = 12, each: int = 3) -> DataFrame:
    out = reviews.agg(F.count_if(F.col(decision) == "approved").alias("approved"), F.count_if(F.col(decision) == "rejected").alias("rejected"))
    return out.withColumn("eligible", (F.col("approved") + F.col("rejected") >= least) & (F.col("approved") >= each) & (F.col("rejected") >= each))


def duration_signal(reviews: DataFrame, decision: str, seconds: str) -> DataFrame:
    """Gap of the mean durations; usable from 3 s on, as a delta of twice that within 25."""
    mean = lambda d: F.avg(F.when(F.col(decision) == d, F.col(seconds)))
    out = reviews.agg(F.round(mean("rejected") - mean("approved"), 2).alias("gap"))
    return out.withColumns({"usable": F.abs("gap") >= 3, "delta": F.when(F.abs("gap") >= 3, F.round(F.greatest(F.lit(-25.0), F.least(F.lit(25.0), F.col("gap") * 2)), 2))})


def origin_lift(reviews: DataFrame, origin: str, decision: str) -> DataFrame:
    """Smoothed approval rate of each origin against all, in points within 20; only from four reviews and two of each outcome."""
    rows = reviews.filter(F.col(decision).isin("approved", "rejected"))
    rate = lambda a, n: F.round((a + 1) / (n + 2), 4)
    overall = rows.agg(rate(F.count_if(F.col(decision) == "approved"), F.count("*")))
    out = rows.groupBy(origin).agg(F.count_if(F.col(decision) == "approved").alias("approved"), F.count_if(F.col(decision) == "rejected").alias("rejected"))
    out = out.withColumns({"overall": overall.scalar(), "rate": rate(F.col("approved"), F.col("approved") + F.col("rejected")), "enough": (F.col("approved") + F.col("rejected") >= 4) & (F.col("approved") >= 2) & (F.col("rejected") >= 2)})
    lift = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col("rate") - F.col("overall")) * 100)), 2)
    return out.withColumn("lift", F.when(F.col("enough"), lift).otherwise(0.0)).drop("overall")


def reason_categories(reviews: DataFrame, reason: str, decision: str, categories: dict[str, tuple[str, ...]] = REASON_CATEGORIES) -> DataFrame:
    """Reviews by category of their reason and outcome; usable from three on.  Unlisted reasons are left out."""
    category = F.coalesce(*(F.when(F.col(reason).isin(*codes), name) for name, codes in categories.items()))
    out = reviews.withColumn("category", category).filter("category is not null").groupBy("category")
    out = out.agg(F.count_if(F.col(decision) == "approved").alias("approved"), F.count_if(F.col(decision) == "rejected").alias("rejected"))
    return out.withColumn("usable", F.col("approved") + F.col("rejected") >= 3)


def top_reasons(reviews: DataFrame, reason: str, decision: str, most: int = 5) -> DataFrame:
    found = reviews.filter((F.col(decision) == "rejected") & (F.col(reason) != "")).groupBy(reason).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), reason).limit(most)


def feature_prior(reviews: DataFrame, decision: str, seconds: str) -> DataFrame:
    """Per decision: rows, mean, median and quartiles of the duration, by linear interpolation."""
    return reviews.groupBy(decision).agg(
        F.count("*").alias("n"),
        F.round(F.avg(seconds), 2).alias("mean"),
        F.round(F.median(seconds), 2).alias("median"),
        F.round(F.percentile(seconds, 0.25), 2).alias("p25"),
        F.round(F.percentile(seconds, 0.75), 2).alias("p75"),
    )


def shares(df: DataFrame, name: str, digits: int = 3) -> DataFrame:
    """Each value's share of all rows."""
    counts = df.groupBy(F.coalesce(name, F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))
    return counts.select(name, "n", F.round(F.col("n") / df.agg(F.count("*")).scalar(), digits).alias("share"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """The element at place n // 2 of the sorted values, found by counts of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    up_to = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"__to": up_to, "__n": F.sum("c").over(w)})
    return ranked.filter(F.col("__to") > F.floor(F.col("__n") / 2)).groupBy(key).agg(F.min(value).alias("upper_median"), F.first("__n").alias("n"))


def family_prior(df: DataFrame, family: str, value: str, confidence: Column | None = None) -> DataFrame:
    """Rows, observed values, mean and median of each family; what isn't observed is left out, never 0."""
    out = df.groupBy(F.coalesce(family, F.lit("unknown")).alias(family)).agg(
        F.count("*").alias("observations"), F.count(value).alias("n_observed"), F.round(F.avg(value), 1).alias("mean"), F.round(F.median(value), 1).alias("median")
    )
    return out


def relative_signal(priors: DataFrame, family: str, median: str) -> DataFrame:
    """50 for a family at the median of all, bent by log1p of the ratio, within 42 and 58."""
    base = priors.filter(F.col(median) > 0).agg(F.median(F.greatest(F.lit(1.0), median)))
    ratio = F.greatest(F.lit(1.0), F.col(median)) / F.coalesce(base.scalar(), F.lit(1.0))
    signal = F.greatest(F.lit(42.0), F.least(F.lit(58.0), 50.0 + (F.log1p(ratio) - 0.7) * 8.0))
    return priors.select(family, F.round(signal, 1).alias("signal"))


def recommended_format(df: DataFrame, topic: str, kind: str, least_topic: int = 2, least_all: int = 4) -> DataFrame:
    """The most approved format of each topic if it has enough, else the most approved of all."""
    best = F.max_by(F.struct(kind, "n"), F.struct("n", F.col(kind))).alias("best")
    by_topic = df.groupBy(topic, kind).agg(F.count("*").alias("n"))
    overall = df.groupBy(kind).agg(F.count("*").alias("n")).agg(best)
    best = by_topic.groupBy(topic).agg(best).withColumn("__o", overall.scalar()).withColumns({"__all": F.col(f"__o.{kind}"), "__n": F.col("__o.n")})
    chosen = F.when(F.col("best.n") >= least_topic, F.col(f"best.{kind}")).when(F.col("__n") >= least_all, F.col("__all"))
    basis = F.when(F.col("best.n") >= least_topic, "topic").when(F.col("__n") >= least_all, "overall").otherwise("none")
    return best.select(topic, chosen.alias("format"), basis.alias("basis"))


def replayed(current: DataFrame, incoming: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """What becomes of the last incoming event of each key: inserted, updated, identical or stale."""
    new = incoming.groupBy(key).agg(F.max_by(F.struct(value, at), at).alias("new"))
    old = current.groupBy(key).agg(F.max_by(F.struct(value, at), at).alias("old"))
    both = new.join(old, key, "left")
    outcome = F.when(F.col("old").isNull(), "inserted").when(F.col(f"old.{value}").eqNullSafe(F.col(f"new.{value}")), "identical").when(F.col(f"new.{at}") > F.col(f"old.{at}"), "updated").otherwise("stale")
    return both.select(key, outcome.alias("outcome"))


def absent_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those incoming ones whose keys they lack."""
    return existing.unionByName(incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
