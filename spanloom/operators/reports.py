"""Summaries over whole tables: audits, catalogs, dossiers and stage times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .feedback import upper_median


def frequent_openings(df: DataFrame, column: str, length: int = 45, least: int = 4, most: int = 12) -> DataFrame:
    """Openings that several texts share: the most frequent ones, ties in order of the text."""
    found = df.filter(F.trim(F.coalesce(column, F.lit(""))) != "").groupBy(F.substring(column, 1, length).alias("opening")).agg(F.count("*").alias("n"))
    return found.filter(F.col("n") >= least).orderBy(F.desc("n"), "opening").limit(most)


def catalog_summary(df: DataFrame, key: str, value: str, buckets: tuple[tuple[str, int], ...]) -> DataFrame:
    """Rows, sum, greatest and upper median of a value, and rows in each bucket (below its bound, the last without one)."""
    low, counts = None, []
    for name, bound in buckets:
        below = F.col(value) < bound
        counts.append(F.count_if(below if low is None else below & (F.col(value) >= low)).alias(name))
        low = bound
    counts.append(F.count_if(F.col(value) >= low).alias("rest"))
    out = df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.max(value).alias("greatest"), *counts)
    return out.join(upper_median(df, key, value).select(key, "upper_median"), key)


def dossier(segments: DataFrame, key: str) -> DataFrame:
    """Per source: segments, questions, speakers, share of segments with a speaker, spoken time, length of text."""
    known = F.trim(F.coalesce("speaker", F.lit(""))) != ""
    out = segments.groupBy(key).agg(
        F.count("*").alias("n_segments"), F.count_if(text.is_question(F.coalesce("text", F.lit("")))).alias("n_questions"), F.count_distinct(F.when(known, F.col("speaker"))).alias("n_speakers"), F.count_if(known).alias("__known"),
        F.sum(F.col("end") - F.col("start")).alias("spoken"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"), F.max(F.coalesce("end", "start")).alias("last"),
    )
    return out.withColumn("speaker_coverage", F.round(F.col("__known") / F.col("n_segments"), 3)).drop("__known")


def stage_times(events: DataFrame, job: str, stage: str, at: Column, tie: str) -> DataFrame:
    """Time that each job spends in each stage: up to its next event."""
    w = Window.partitionBy(job).orderBy(at, tie)
    rows = events.withColumns({"__at": at, "__next": F.lead(at).over(w)})
    return rows.filter(F.col("__next").isNotNull()).groupBy(job, stage).agg(F.sum(F.col("__next") - F.col("__at")).alias("spent"), F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


def possible_overlap(segments: DataFrame, key: str, slack: float) -> DataFrame:
    """Sources where a segment starts more than ``slack`` before the last one's end."""
    w = Window.partitionBy(key).orderBy("start", "turn")
    rows = segments.withColumn("__hit", F.coalesce(F.col("start") < F.lag("end").over(w) - slack, F.lit(False)))
    return rows.groupBy(key).agg(F.bool_or("__hit").alias("possible_overlap"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]+)/*$", 1)


def path_matches(files: DataFrame, names: DataFrame, path: str, name: str) -> DataFrame:
    """Files whose path is a given name, or ends with a slash and that name; joined by the last part."""
    x, y = files.withColumn("__b", base_name(F.col(path))), names.withColumn("__b", base_name(F.col(name)))
    full = (F.col(path) == F.col(name)) | F.endswith(F.col(path), F.concat(F.lit("/"), F.col(name)))
    return x.join(y, "__b").filter(full).drop("__b")


def term_matches(rows: DataFrame, terms: DataFrame, column: str, term: str) -> DataFrame:
    """Pairs where the folded text holds the term's words in a row: they meet by the term's first word, then the whole term decides."""
    x = rows.withColumn("__t", text.collapsed(text.folded(F.col(column)))).withColumn("__w", F.explode(F.array_distinct(text.words(F.col("__t")))))
    y = terms.withColumn("__k", text.collapsed(text.folded(F.col(term)))).filter("__k <> ''").withColumn("__w", F.get(text.words(F.col("__k")), F.lit(0)))
    whole = F.contains(F.concat(F.lit(" "), F.col("__t"), F.lit(" ")), F.concat(F.lit(" "), F.col("__k"), F.lit(" ")))
    return x.join(y, "__w").filter(whole).drop("__w", "__t", "__k")


def supported(claim: Column, source: Column, least: int = 2, stem: int = 5) -> Column:
    """Whether a generated line rests on its source: all its numbers are there, and two stems of its words."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1))
    stems = lambda c: F.array_distinct(F.transform(text.tokens(c, least=4), lambda t: F.left(t, F.lit(stem))))
    return (F.size(F.array_except(numbers(claim), numbers(source))) == 0) & (F.size(F.array_intersect(stems(claim), stems(source))) >= least)
