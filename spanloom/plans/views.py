"""Engine tables made from the driver's tables; queries and their SQL start from the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMATS = ("short", "quote", "split")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance rows from events: a user is a content, a type a platform; counts are whole numbers of the value."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    views = F.floor(F.abs("value")).cast("long")
    return e.select(
        "event_id",
        F.col("user_id").alias("content_key"),
        F.col("event_type").alias("platform"),
        (k % 3).alias("format_id"),
        F.col("ts").alias("collected_at"),
        F.date_trunc("month", "ts").alias("published_at"),
        views.alias("views"),
        (views % 7).alias("likes"),
        (k % 5).alias("comments"),
        (F.col("event_id") % 3).alias("shares"),
        F.lit(0).cast("long").alias("saves"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments from conversations, in whole milliseconds: each lasts 60 ms a character, one after the other."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = 60 * F.length(F.coalesce("text", F.lit("")))
    rows = c.withColumns({"turn": F.row_number().over(w).cast("long") - 1, "before": F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # every fifth turn begins early, and every seventh late
    start = F.greatest(F.lit(0), F.col("before") - F.when(F.col("turn") % 5 == 4, 700).otherwise(0) + F.when(F.col("turn") % 7 == 6, 4000).otherwise(0))
    return rows.select("conv_id", "turn", F.col("role").alias("speaker"), "text", start.cast("long").alias("start"), (F.col("before") + length).cast("long").alias("end"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate clips from documents and labels; times and factors are whole numbers from the text's length and id."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # counted before the join, which so moves no texts for queries that need none
    d, n = d.withColumn("n", F.length(F.coalesce("text", F.lit("")))), F.col("n")
    decision = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    reason = F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "no_payoff").otherwise("weak_hook")).when(F.col("toxic") == 1, "good_hook").otherwise("")
    start = (F.col("doc_id") * 37) % 3600
    return d.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.col("lang").alias("family"),
        "text",
        n.cast("long").alias("n"),
        start.alias("start"),
        (start + 8 + n % 90).cast("long").alias("end"),
        (8 + n % 90).cast("long").alias("duration"),
        (40 + (F.col("doc_id") * 31) % 61).alias("potential"),
        (30 + (F.col("doc_id") * 17) % 71).alias("context"),
        (30 + (F.col("doc_id") * 13) % 71).alias("complete"),
        decision.alias("decision"),
        reason.alias("reason"),
    )


def intervals(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a type as intervals of whole milliseconds: a minute for each unit of value, ten at least, per user."""
    e = table(spark, sf_dir, "events").filter((F.col("event_type") == kind) & F.col("ts").isNotNull())
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return e.select("event_id", "user_id", start.alias("start"), (start + 60_000 * F.greatest(F.lit(10), F.floor(F.abs("value")))).cast("long").alias("end"))


#: The same tables in DuckDB.
SNAPSHOTS = """snapshots AS (
  SELECT event_id, user_id AS content_key, event_type AS platform, k % 3 AS format_id, ts AS collected_at, date_trunc('month', ts) AS published_at,
    views, views % 7 AS likes, k % 5 AS comments, event_id % 3 AS shares, 0 AS saves
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(floor(abs(value)) AS BIGINT) AS views FROM events)
)"""
NORMALIZED = (
    SNAPSHOTS
    + """, normalized AS (
  SELECT *, likes + comments + shares + saves AS engagement_actions,
    CASE WHEN views <> 0 THEN round((likes + comments + shares + saves) / views, 6) END AS engagement_rate,
    round(greatest(0, epoch_us(collected_at) - epoch_us(published_at)) / 3.6e9, 3) AS age_hours,
    round(views / greatest(round(greatest(0, epoch_us(collected_at) - epoch_us(published_at)) / 3.6e9, 3), 1.0), 3) AS velocity
  FROM snapshots
)"""
)
SEGMENTS = """segments AS (
  SELECT conv_id, turn, role AS speaker, text, CAST(greatest(0, before - CASE WHEN turn % 5 = 4 THEN 700 ELSE 0 END + CASE WHEN turn % 7 = 6 THEN 4000 ELSE 0 END) AS BIGINT) AS start, CAST(before + 60 * length(coalesce(text, '')) AS BIGINT) AS "end"
  FROM (
    SELECT conv_id, role, text, row_number() OVER w - 1 AS turn, coalesce(sum(60 * length(coalesce(text, ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
  )
)"""
CLIPS = """clips AS (
  SELECT doc_id, source AS source_id, lang AS family, text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, (doc_id * 37) % 3600 AS start,
    (doc_id * 37) % 3600 + 8 + length(coalesce(text, '')) % 90 AS "end", 8 + length(coalesce(text, '')) % 90 AS duration,
    40 + (doc_id * 31) % 61 AS potential, 30 + (doc_id * 17) % 71 AS context, 30 + (doc_id * 13) % 71 AS complete,
    CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS decision,
    CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'no_payoff' ELSE 'weak_hook' END WHEN toxic = 1 THEN 'good_hook' ELSE '' END AS reason
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def intervals_sql(name: str, kind: str) -> str:
    return f"""{name} AS (
  SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS start, CAST(floor(epoch_us(ts) / 1000) + 60000 * greatest(10, floor(abs(value))) AS BIGINT) AS "end"
  FROM events WHERE event_type = '{kind}' AND ts IS NOT NULL
)"""
