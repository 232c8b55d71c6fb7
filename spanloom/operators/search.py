"""Lexical search over text records, with account-relative performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from .feedback import first_wins


def filtered(records: DataFrame, account: str | None = None, platform: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of an account, a platform and a range of days; rows without a day go only if a bound is given."""
    if since and until and since > until:
        raise ValueError("the range of days is inverted")
    for name, value in (("account", account), ("platform", platform)):
        records = records.filter(F.col(name) == value) if value else records
    if since:
        records = records.filter(F.col("published") >= F.lit(since).cast("date"))
    if until:
        records = records.filter(F.col("published") <= F.lit(until).cast("date"))
    return records


def scored(records: DataFrame, query: str, semantic: str | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """Records of ``account, url, text, ratio`` with lexical match and score, for a query of words.

    The ratio is set against the account's highest before anything is dropped.  Rows
    that score nothing go first; only then does the first of each (account, url) stay.
    """
    spark = records.sparkSession
    asked = spark.range(1).select(text.tokens(F.lit(query), stop=stop).alias("t")).first()["t"]
    if not asked:
        raise ValueError("the query has no word of three letters")
    wanted = F.array(*map(F.lit, asked))
    top = records.groupBy("account").agg(F.max("ratio").alias("__top"))
    rows = records.join(top, "account")
    lexical = F.size(F.array_intersect(wanted, text.tokens(F.col("text"), stop=stop))) / len(asked)
    meaning = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(semantic, F.lit(0.0)))) if semantic else F.lit(0.0)
    share = F.when(F.col("__top") > 0, F.coalesce(F.col("ratio"), F.lit(0.0)) / F.col("__top")).otherwise(0.0)
    rows = rows.withColumn("lexical", F.round(lexical, 4)).withColumn("score", scoring.search_score(meaning, lexical, share)).drop("__top")
    return first_wins(rows.filter("score > 0 and url <> ''"), ["account", "url"], "place")


def ranked(rows: DataFrame, limit: int = 25) -> DataFrame:
    return rows.orderBy(F.desc("score"), "account", "url").limit(max(1, min(50, limit)))
