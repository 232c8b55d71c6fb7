"""Registered queries: each runs library operators over whole tables, beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import coerce, scoring, text, timecode
from ..operators import clips, feedback, folds, greedy, intervals, performance, search, selection, similarity
from . import views
from .views import CLIPS, NORMALIZED, SEGMENTS, SNAPSHOTS, intervals_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SUMMARY = """count(*) AS n_snapshots, count(DISTINCT content_key) AS n_contents, CAST(coalesce(sum(views), 0) AS BIGINT) AS views,
  round(avg(engagement_rate), 6) AS mean_rate, round(avg(velocity), 3) AS mean_velocity"""


@query(f"WITH {NORMALIZED} SELECT platform, {SUMMARY} FROM normalized GROUP BY platform")
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.summary(performance.normalized(views.snapshots(spark, sf_dir)), "platform")


@query(f"WITH {NORMALIZED} SELECT {SUMMARY} FROM normalized WHERE platform = 'click' AND format_id = 1")
def perf_summary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.summary(performance.selected(performance.normalized(views.snapshots(spark, sf_dir)), platform="click", format_id=1))


@query(f"WITH {NORMALIZED} SELECT platform, format_id, {SUMMARY} FROM normalized GROUP BY ROLLUP (platform, format_id)")
def perf_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.normalized(views.snapshots(spark, sf_dir))
    return rows.rollup("platform", "format_id").agg(
        F.count("*").alias("n_snapshots"), F.count_distinct("content_key").alias("n_contents"), F.coalesce(F.sum("views"), F.lit(0)).cast("long").alias("views"), F.round(F.avg("engagement_rate"), 6).alias("mean_rate"), F.round(F.avg("velocity"), 3).alias("mean_velocity")
    )


@query(f"WITH {NORMALIZED} SELECT event_id, content_key, platform, views, engagement_actions, engagement_rate, age_hours, velocity FROM normalized")
def snapshot_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.normalized(views.snapshots(spark, sf_dir)).select("event_id", "content_key", "platform", "views", "engagement_actions", "engagement_rate", "age_hours", "velocity")


@query(f"""WITH {SNAPSHOTS}, p AS (
  SELECT *, lag(views) OVER w AS last_views, lag(collected_at) OVER w AS last_at FROM snapshots WINDOW w AS (PARTITION BY content_key ORDER BY collected_at, event_id)
) SELECT event_id, views - last_views AS views_delta, CASE WHEN last_views <> 0 THEN round((views - last_views) / last_views, 6) END AS growth,
  CASE WHEN last_at IS NOT NULL THEN round(greatest(0, epoch_us(collected_at) - epoch_us(last_at)) / 3.6e9, 3) END AS hours FROM p""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.changes(views.snapshots(spark, sf_dir), "content_key", "collected_at", "event_id").select("event_id", "views_delta", "growth", "hours")


@query(f"""WITH {NORMALIZED}, c AS (
  SELECT event_id, engagement_rate, velocity, round(100.0 * cume_dist() OVER (PARTITION BY platform, format_id ORDER BY views), 2) AS views_pct,
    CASE WHEN engagement_rate IS NOT NULL THEN round(100.0 * count(engagement_rate) OVER (PARTITION BY platform, format_id ORDER BY engagement_rate) / count(engagement_rate) OVER (PARTITION BY platform, format_id), 2) END AS rate_pct,
    round(100.0 * cume_dist() OVER (PARTITION BY platform, format_id ORDER BY velocity), 2) AS velocity_pct
  FROM normalized
) SELECT event_id, views_pct, rate_pct, velocity_pct,
  round((views_pct * 0.5 + coalesce(rate_pct * 0.3, 0) + velocity_pct * 0.2) / (0.5 + CASE WHEN rate_pct IS NULL THEN 0 ELSE 0.3 END + 0.2), 4) AS score FROM c""")
def cohort_percentile_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.normalized(views.snapshots(spark, sf_dir))
    out = performance.cohort_score(rows, ["platform", "format_id"], {"views": 0.5, "engagement_rate": 0.3, "velocity": 0.2}, digits=4)
    return out.select("event_id", "views_pct", F.col("engagement_rate_pct").alias("rate_pct"), "velocity_pct", "score")


@query("""SELECT count(*) AS total, count(*) FILTER (s = 'approved') AS approved, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'review') AS review, count(*) FILTER (s = 'pending') AS pending,
  round(least(100.0, count(*) FILTER (s = 'approved') * 100.0 / 39), 1) AS percent
FROM (SELECT CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'review' ELSE 'pending' END AS s FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05')""")
def status_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "review").otherwise("pending")
    return performance.daily_progress(e.withColumn("s", status), "ts", "2024-01-05", "s", 39)


@query("""SELECT u.user_id, l.event_type AS action, l.value FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id) l USING (user_id)""")
def latest_feedback_per_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    out = feedback.with_latest(e.select("user_id").distinct(), e.filter(F.col("event_type").isin("purchase", "error")), "user_id", ["event_id"], "event_type", "value")
    return out.select("user_id", F.col("event_type").alias("action"), "value")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.last_rows(views.table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""SELECT c_custkey, c_name, coalesce(t, 0) AS total, coalesce(a, 0) AS approved, coalesce(r, 0) AS review FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS t, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS r FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def project_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "review").otherwise("pending")
    clips = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), status.alias("status"))
    return feedback.review_counts(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), clips, "c_custkey", "status")


@query("""SELECT c_mktsegment AS project, l_returnflag AS action, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def feedback_project_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    clips, projects = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = events.join(clips, F.col("o_orderkey") == F.col("l_orderkey")).join(projects, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("project"), F.col("l_returnflag").alias("action")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def _factors() -> F.Column:
    return F.map_from_arrays(F.array(*map(F.lit, ("potential", "context", "complete"))), F.array(*(F.col(c).cast("double") for c in ("potential", "context", "complete"))))


@query(f"""WITH {CLIPS}, f AS (SELECT decision, unnest(['potential', 'context', 'complete']) AS factor, unnest([potential, context, complete]) AS value FROM clips WHERE decision <> 'pending')
SELECT factor, round(avg(value) FILTER (decision = 'approved') - avg(value) FILTER (decision = 'rejected'), 2) AS delta, count(*) AS n FROM f GROUP BY factor""")
def feedback_calibration_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.factor_deltas(views.clips(spark, sf_dir).withColumn("factors", _factors()), "factors", "decision")


@query(f"WITH {CLIPS} SELECT *, approved + rejected >= 12 AND approved >= 3 AND rejected >= 3 AS eligible FROM (SELECT count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected FROM clips)")
def calibration_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.eligibility(views.clips(spark, sf_dir), "decision")


@query(f"""WITH {CLIPS} SELECT gap, abs(gap) >= 3 AS usable, CASE WHEN abs(gap) >= 3 THEN round(greatest(-25.0, least(25.0, gap * 2)), 2) END AS delta
FROM (SELECT round(avg(n) FILTER (decision = 'rejected') - avg(n) FILTER (decision = 'approved'), 2) AS gap FROM clips)""")
def duration_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.duration_signal(views.clips(spark, sf_dir), "decision", "n")


@query(f"""WITH {CLIPS}, r AS (SELECT * FROM clips WHERE decision <> 'pending'), o AS (SELECT round((count(*) FILTER (decision = 'approved') + 1) / (count(*) + 2), 4) AS overall FROM r),
g AS (SELECT source_id, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected FROM r GROUP BY source_id)
SELECT source_id, approved, rejected, round((approved + 1) / (approved + rejected + 2), 4) AS rate, approved + rejected >= 4 AND approved >= 2 AND rejected >= 2 AS enough,
  CASE WHEN approved + rejected >= 4 AND approved >= 2 AND rejected >= 2 THEN round(greatest(-20.0, least(20.0, (round((approved + 1) / (approved + rejected + 2), 4) - overall) * 100)), 2) ELSE 0.0 END AS lift FROM g, o""")
def origin_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.origin_lift(views.clips(spark, sf_dir), "source_id", "decision")


@query(f"""WITH {CLIPS} SELECT category, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected,
  count(*) FILTER (decision IN ('approved', 'rejected')) >= 3 AS usable FROM (SELECT decision, CASE reason WHEN 'weak_hook' THEN 'hook' WHEN 'good_hook' THEN 'hook' WHEN 'no_payoff' THEN 'context_payoff' END AS category FROM clips) WHERE category IS NOT NULL GROUP BY category""")
def reason_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.reason_categories(views.clips(spark, sf_dir), "reason", "decision")


@query(f"WITH {CLIPS} SELECT reason, count(*) AS n FROM clips WHERE decision = 'rejected' AND reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 5")
def top_rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.top_reasons(views.clips(spark, sf_dir), "reason", "decision")


@query(f"""WITH {CLIPS} SELECT decision, count(*) AS n, round(avg(n), 2) AS mean, round(median(n), 2) AS median, round(quantile_cont(n, 0.25), 2) AS p25, round(quantile_cont(n, 0.75), 2) AS p75 FROM clips GROUP BY decision""")
def feature_prior_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feature_prior(views.clips(spark, sf_dir), "decision", "n")


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM documents GROUP BY 1")
def family_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.shares(views.table(spark, sf_dir, "documents").select("lang"), "lang")


@query(f"WITH {CLIPS} SELECT source_id, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM clips GROUP BY source_id")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.upper_median(views.clips(spark, sf_dir), "source_id", "n")


@query(f"""WITH {CLIPS} SELECT source_id, count(*) AS observations, count(v) AS n_observed, round(avg(v), 1) AS mean, round(median(v), 1) AS median FROM (SELECT source_id, CASE WHEN decision <> 'pending' THEN n END AS v FROM clips) GROUP BY source_id""")
def family_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.family_prior(views.clips(spark, sf_dir).withColumn("v", F.when(F.col("decision") != "pending", F.col("n"))), "source_id", "v")


@query(f"""WITH {CLIPS}, p AS (SELECT source_id, CAST(median(n) AS DOUBLE) AS m FROM clips GROUP BY source_id), b AS (SELECT median(greatest(1.0, m)) AS base FROM p WHERE m > 0)
SELECT source_id, round(greatest(42.0, least(58.0, 50.0 + (ln(1 + greatest(1.0, m) / base) - 0.7) * 8.0)), 1) AS signal FROM p, b""")
def family_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = views.clips(spark, sf_dir).groupBy("source_id").agg(F.median("n").alias("m"))
    return feedback.relative_signal(medians, "source_id", "m")


@query(f"""WITH {CLIPS}, a AS (SELECT source_id, family, count(*) AS n FROM clips WHERE decision = 'approved' GROUP BY ALL),
o AS (SELECT family AS f, count(*) AS n FROM clips WHERE decision = 'approved' GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1),
t AS (SELECT source_id, family, n FROM a QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, family DESC) = 1)
SELECT source_id, CASE WHEN t.n >= 2 THEN family WHEN o.n >= 4 THEN f END AS format, CASE WHEN t.n >= 2 THEN 'topic' WHEN o.n >= 4 THEN 'overall' ELSE 'none' END AS basis FROM t, o""")
def format_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.recommended_format(views.clips(spark, sf_dir).filter("decision = 'approved'"), "source_id", "family")


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, min(o_orderkey) AS place FROM orders GROUP BY o_custkey")
def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.last_wins(views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderstatus", "place")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 50000 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").filter("o_totalprice > 50000").select("o_custkey", "o_orderkey", "o_orderstatus")
    return feedback.first_wins(rows, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("""WITH old AS (SELECT user_id, max_by(event_type, event_id) AS t, max(event_id) AS at FROM events WHERE event_id % 3 <> 0 AND event_type <> 'view' GROUP BY user_id),
new AS (SELECT user_id, max_by(event_type, event_id) AS t, max(event_id) AS at FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT new.user_id, CASE WHEN old.at IS NULL THEN 'inserted' WHEN old.t = new.t THEN 'identical' WHEN new.at > old.at THEN 'updated' ELSE 'stale' END AS outcome FROM new LEFT JOIN old USING (user_id)""")
def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return feedback.replayed(e.filter("event_id % 3 <> 0 and event_type <> 'view'"), e.filter("event_id % 3 = 0"), "user_id", "event_id", "event_type")


@query("SELECT s_suppkey AS key, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def merge_absent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return feedback.absent_rows(s, c, ["key"])


MINUTES = 30 * 60_000


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, r = views.intervals(spark, sf_dir, "click"), views.intervals(spark, sf_dir, "purchase")
    return p.select("user_id", F.col("event_id").alias("p_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end")), r.select("user_id", F.col("event_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))


ENDS = ("p_start", "p_end", "r_start", "r_end")
PAIRS = f"""WITH {intervals_sql("p", "click")}, {intervals_sql("r", "purchase")}, pairs AS (
  SELECT p.user_id, p.event_id AS p_id, r.event_id AS r_id, p.start AS p_start, p."end" AS p_end, r.start AS r_start, r."end" AS r_end, least(p."end", r."end") - greatest(p.start, r.start) AS common
  FROM p JOIN r ON p.user_id = r.user_id AND p.start < r."end" AND r.start < p."end")"""


@query(PAIRS + " SELECT p_id, r_id, common AS strength FROM pairs QUALIFY row_number() OVER (PARTITION BY p_id ORDER BY common DESC, r_id) = 1")
def interval_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    return intervals.best_overlap(p, r, ["user_id"], ENDS, MINUTES, ["p_id"], intervals.intersection(*map(F.col, ENDS)), "r_id").select("p_id", "r_id", "strength")


@query(PAIRS + " SELECT p_id, r_id, round(common / (greatest(p_end, r_end) - least(p_start, r_start)), 6) AS iou FROM pairs WHERE common / (greatest(p_end, r_end) - least(p_start, r_start)) >= 0.3")
def interval_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    return intervals.overlap_join(p, r, ["user_id"], ENDS, MINUTES).withColumn("iou", intervals.iou(*map(F.col, ENDS))).filter("iou >= 0.3").select("p_id", "r_id", F.round("iou", 6).alias("iou"))


@query(PAIRS + """, c AS (SELECT *, least(p_end, r_end) - greatest(p_start, r_start) AS common2 FROM pairs)
SELECT p_id, r_id, CAST(abs(p_start - r_start) AS BIGINT) AS start_error, CAST(abs(p_end - r_end) AS BIGINT) AS end_error, round(common / least(p_end - p_start, r_end - r_start), 6) AS of_shorter, round(common / (r_end - r_start), 6) AS of_reference FROM c""")
def overlap_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    a, b, c, d = map(F.col, ENDS)
    return intervals.overlap_join(p, r, ["user_id"], ENDS, MINUTES).select("p_id", "r_id", F.abs(a - c).alias("start_error"), F.abs(b - d).alias("end_error"), F.round(intervals.overlap_of_shorter(a, b, c, d), 6).alias("of_shorter"), F.round(intervals.coverage_of_second(a, b, c, d), 6).alias("of_reference"))


@query(f"""WITH {intervals_sql("p", "click")}, d AS (SELECT DISTINCT x.event_id FROM p x JOIN p y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND x.start < y."end" AND y.start < x."end"
  WHERE (least(x."end", y."end") - greatest(x.start, y.start)) / (greatest(x."end", y."end") - least(x.start, y.start)) >= 0.5)
SELECT user_id, count(*) AS n, count(d.event_id) AS n_duplicates, round(count(d.event_id) / count(*), 6) AS rate FROM p LEFT JOIN d USING (event_id) GROUP BY user_id""")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.intervals(spark, sf_dir, "click")
    left = p.select("user_id", F.col("event_id").alias("p_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    right = p.select("user_id", F.col("event_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = intervals.overlap_join(left, right, ["user_id"], ENDS, MINUTES).filter(F.col("p_id") != F.col("r_id")).filter(intervals.iou(*map(F.col, ENDS)) >= 0.5).select(F.col("p_id").alias("event_id")).distinct().withColumn("hit", F.lit(1))
    out = p.join(hit, "event_id", "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count("hit").alias("n_duplicates"))
    return out.withColumn("rate", F.round(F.col("n_duplicates") / F.col("n"), 6))


def _islands(name: str, gap: int = 0) -> str:
    return f"""{name}_i AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {name}))"""


@query(f"""WITH {intervals_sql("p", "click")}, {_islands("p")}, m AS (SELECT user_id, island, min(start) AS start, max("end") AS stop FROM p_i GROUP BY ALL)
SELECT user_id, CAST(sum(stop - start) AS BIGINT) AS covered, count(*) AS n_islands FROM m GROUP BY user_id""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_length(views.intervals(spark, sf_dir, "click"), ["user_id"])


@query(PAIRS + f""", parts AS (SELECT user_id, greatest(p_start, r_start) AS start, least(p_end, r_end) AS "end" FROM pairs), {_islands("parts")}, {_islands("r")},
t AS (SELECT user_id, CAST(sum(stop - start) AS BIGINT) AS reference_length FROM (SELECT user_id, island, min(start) AS start, max("end") AS stop FROM r_i GROUP BY ALL) GROUP BY user_id),
h AS (SELECT user_id, CAST(sum(stop - start) AS BIGINT) AS covered FROM (SELECT user_id, island, min(start) AS start, max("end") AS stop FROM parts_i GROUP BY ALL) GROUP BY user_id)
SELECT user_id, reference_length, coalesce(covered, 0) AS covered_length, round(coalesce(covered, 0) / reference_length, 6) AS coverage_ratio FROM t LEFT JOIN h USING (user_id)""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.reference_coverage(views.intervals(spark, sf_dir, "click"), views.intervals(spark, sf_dir, "purchase"), ["user_id"], MINUTES)


@query(f"""WITH {intervals_sql("p", "click")}, {_islands("p", 3_600_000)} SELECT user_id, CAST(island AS BIGINT) AS island, min(start) AS start, max("end") AS "end", count(*) AS n_rows FROM p_i GROUP BY user_id, island""")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(views.intervals(spark, sf_dir, "click"), ["user_id"], gap=3_600_000)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS ev FROM events WHERE ts IS NOT NULL),
a AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 7200 THEN 0 ELSE 1 END AS fresh FROM e WHERE ev > 0 WINDOW w AS (PARTITION BY user_id ORDER BY s)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS no FROM a),
c AS (SELECT user_id, no, greatest(0, min(s) - 30) AS start, max(s) AS stop, sum(ev) AS ev FROM b GROUP BY ALL HAVING max(s) - greatest(0, min(s) - 30) >= 30),
d AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 THEN 0 ELSE 1 END AS fresh FROM c),
f AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM d)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end", count(*) AS n_rows, CAST(sum(ev) AS BIGINT) AS evidence FROM f GROUP BY user_id, island""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = views.table(spark, sf_dir, "events").filter("ts is not null").select("user_id", at.alias("s"), at.alias("t"), F.col("event_type").isin("click", "purchase").cast("long").alias("ev"))
    return intervals.sessions(rows, ["user_id"], "s", "t", "ev", gap=7200, lead=30, least=30, merge=3600)


@query("""WITH e AS (SELECT user_id, event_id AS pos, value AS v, lag(value) OVER w AS before, lead(event_id) OVER w AS nxt, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN v >= 40 AND coalesce(before < 40, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(pos) AS start, CAST(max(coalesce(nxt, pos + 1)) AS BIGINT) AS "end", round((sum(v) + coalesce(sum(nv) FILTER (nv < 40), 0)) / (count(*) + count(*) FILTER (nv < 40)), 4) AS mean_level
FROM r WHERE v >= 40 GROUP BY user_id, run HAVING max(coalesce(nxt, pos + 1)) - min(pos) >= 100""")
def high_energy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), "value")
    return intervals.runs_above(e, ["user_id"], "at", "value", 40.0, 100, 1).withColumn("mean_level", F.round("mean_level", 4))


TIMELINE = f"""{intervals_sql("p", "click")}, a AS (SELECT *, coalesce(max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach, lead(start) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
b AS (SELECT user_id, greatest(start, reach) AS o_start, least("end", coalesce(nxt, "end")) AS o_end FROM a WHERE least("end", coalesce(nxt, "end")) > greatest(start, reach)),
tl AS (SELECT *, sum(o_end - o_start) OVER (PARTITION BY user_id ORDER BY o_start, o_end ROWS UNBOUNDED PRECEDING) AS d_end FROM b)"""


@query(f"WITH {TIMELINE} SELECT user_id, CAST(o_start AS BIGINT) AS original_start, CAST(o_end AS BIGINT) AS original_end, CAST(d_end - (o_end - o_start) AS BIGINT) AS derived_start, CAST(d_end AS BIGINT) AS derived_end FROM tl")
def derived_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.derived_timeline(views.intervals(spark, sf_dir, "click"), ["user_id"])
    return out.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("original_start", "original_end", "derived_start", "derived_end")))


@query(f"""WITH {TIMELINE}, q AS (SELECT user_id, event_id, 60000 * (event_id % 97) AS start, 60000 * (event_id % 97) + 1500000 AS stop FROM events WHERE event_type = 'view')
SELECT event_id, CAST(greatest(start, d_end - (o_end - o_start)) + o_start - (d_end - (o_end - o_start)) AS BIGINT) AS mapped_start, CAST(least(stop, d_end) + o_start - (d_end - (o_end - o_start)) AS BIGINT) AS mapped_end
FROM q JOIN tl ON q.user_id = tl.user_id AND q.start < d_end AND d_end - (o_end - o_start) < q.stop""")
def timeline_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = intervals.derived_timeline(views.intervals(spark, sf_dir, "click"), ["user_id"])
    start = 60_000 * (F.col("event_id") % 97)
    asked = views.table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "event_id", start.alias("start"), (start + 1_500_000).alias("end"))
    return intervals.mapped(asked, line, ["user_id"], MINUTES).select("event_id", F.col("mapped_start").cast("long").alias("mapped_start"), F.col("mapped_end").cast("long").alias("mapped_end"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, CASE WHEN turn % 3 = 0 THEN "end" END AS e, lead(start) OVER w AS nxt, row_number() OVER w - 1 AS id FROM segments WINDOW w AS (PARTITION BY conv_id ORDER BY start, turn))
SELECT conv_id, turn, id, start, CAST(greatest(start + 50, coalesce(e, CASE WHEN nxt > start THEN nxt END, start + 2000)) AS BIGINT) AS "end" FROM s""")
def segment_fill_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir).withColumn("end", F.when(F.col("turn") % 3 == 0, F.col("end")))
    return intervals.with_next_start(rows, ["conv_id"], 2000, 50).select("conv_id", "turn", "id", "start", "end")


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(start) OVER w AS ps, lag(text) OVER w AS pt FROM segments WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_segments, count(*) FILTER (start < reach) AS n_overlaps, count(*) FILTER (start < ps) AS n_backwards, count(*) FILTER (start - reach > 3) AS n_gaps, count(*) FILTER (text = pt) AS n_repeated, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty FROM s GROUP BY conv_id""")
def transcript_structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.structure_audit(views.segments(spark, sf_dir), ["conv_id"], "text")


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, 20000 + (conv_id % 9) * 9000 AS len, start >= 0 AND "end" > start AS ok FROM segments),
g AS (SELECT conv_id, len, min(start) FILTER (ok) AS first, max("end") FILTER (ok) AS last, count(*) FILTER (ok) AS n_segments FROM s GROUP BY ALL),
r AS (SELECT *, round(least(1.0, greatest(0.0, first / len)), 3) AS first_ratio, round(least(1.0, greatest(0.0, last / len)), 3) AS end_ratio, round(least(1.0, greatest(0.0, (last - first) / len)), 3) AS span_ratio FROM g)
SELECT conv_id, n_segments, first_ratio, end_ratio, span_ratio, CASE WHEN n_segments = 0 THEN 'empty' WHEN last > len * 1.05 THEN 'mismatch_suspected' WHEN end_ratio < 0.35 OR first_ratio > 0.20 OR span_ratio < 0.55 THEN 'partial' ELSE 'covered' END AS status FROM r""")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir).withColumn("len", 20_000 + (F.col("conv_id") % 9) * 9_000)
    return intervals.coverage_status(rows, ["conv_id"], "len").select("conv_id", "n_segments", "first_ratio", "end_ratio", "span_ratio", "status")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), s AS (SELECT event_id AS sid, user_id AS u, ts AS sts FROM events WHERE event_type = 'purchase')
SELECT event_id, (SELECT max_by(sid, (sts, sid)) FROM s WHERE u = user_id AND sts <= ts) AS before_id, (SELECT min_by(sid, (sts, sid)) FROM s WHERE u = user_id AND sts > ts) AS after_id FROM p""")
def nearest_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    left = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("sid"), F.col("ts").alias("at"))
    return intervals.nearest(left, right, ["user_id"], "ts", "at").select("event_id", F.col("before.sid").alias("before_id"), F.col("after.sid").alias("after_id"))


@query(f"""WITH {intervals_sql("p", "click")}, e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS pos, value FROM events WHERE ts IS NOT NULL)
SELECT event_id, count(*) AS n_points, round(avg(value), 4) AS mean, max(value) AS peak FROM p JOIN e ON p.user_id = e.user_id AND pos BETWEEN start - 90000 AND "end" GROUP BY event_id""")
def points_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.table(spark, sf_dir, "events").filter("ts is not null").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"), "value")
    pairs = intervals.points_within(views.intervals(spark, sf_dir, "click"), points, ["user_id"], "at", MINUTES, before=90_000)
    return pairs.groupBy("event_id").agg(F.count("*").alias("n_points"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("peak"))


@query(f"""WITH {SEGMENTS}, j AS (SELECT x.conv_id, x.turn, y.turn AS later, y.text FROM segments x JOIN segments y ON x.conv_id = y.conv_id AND y.turn BETWEEN x.turn + 1 AND x.turn + 9 AND y.start < x."end" + 48000)
SELECT conv_id, turn, count(*) AS n_ahead, sha256(string_agg(coalesce(text, ''), ' ' ORDER BY later)) AS ahead_sha FROM j GROUP BY conv_id, turn""")
def lookahead_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 9)
    rows = views.segments(spark, sf_dir).withColumn("next", F.collect_list(F.struct("start", "text")).over(w))
    near = rows.withColumn("near", F.filter("next", lambda x: x["start"] < F.col("end") + 48_000)).filter("size(near) > 0")
    joined = F.array_join(F.transform("near", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return near.select("conv_id", "turn", F.size("near").cast("long").alias("n_ahead"), F.sha2(joined, 256).alias("ahead_sha"))


@query(f"""WITH {intervals_sql("p", "click")}, {intervals_sql("r", "view")} SELECT p.event_id AS p_id, min(r.event_id) AS r_id FROM p JOIN r ON p.user_id = r.user_id AND abs(p.start - r.start) <= 600000 AND abs(p."end" - r."end") <= 600000 GROUP BY p.event_id""")
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = views.intervals(spark, sf_dir, "click"), views.intervals(spark, sf_dir, "view")
    left = p.select("user_id", F.col("event_id").alias("p_id"), F.col("end").alias("p_end"), F.col("start").alias("a"), F.col("start").alias("b"))
    right = r.select("user_id", F.col("event_id").alias("r_id"), F.col("end").alias("r_end"), (F.col("start") - 600_000).alias("c"), (F.col("start") + 600_000).alias("d"))
    pairs = intervals.overlap_join(left, right, ["user_id"], ("a", "b", "c", "d"), MINUTES, touch=True).filter("abs(p_end - r_end) <= 600000")
    return pairs.groupBy("p_id").agg(F.min("r_id").alias("r_id"))


@query(f"""WITH {intervals_sql("p", "click")}, {intervals_sql("r", "purchase")} SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = p.user_id AND r.start < p."end" AND p.start < r."end" AND (least(p."end", r."end") - greatest(p.start, r.start)) / least(p."end" - p.start, r."end" - r.start) >= 0.45)""")
def fingerprint_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    met = intervals.overlap_join(p, r, ["user_id"], ENDS, MINUTES).filter(intervals.overlap_of_shorter(*map(F.col, ENDS)) >= 0.45).select("p_id").distinct()
    return p.join(met, "p_id", "left_anti").select(F.col("p_id").alias("event_id"))


@query(PAIRS + """, e AS (SELECT p_id, r_id, round(common / (greatest(p_end, r_end) - least(p_start, r_start)), 6) AS iou FROM pairs WHERE round(common / (greatest(p_end, r_end) - least(p_start, r_start)), 6) >= 0.1),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY iou DESC, p_id, r_id) AS rn FROM e),
walk AS (
  WITH RECURSIVE w(n, used, took) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
    UNION ALL SELECT rn, CASE WHEN list_contains(used, 'p' || p_id) OR list_contains(used, 'r' || r_id) THEN used ELSE list_concat(used, ['p' || p_id, 'r' || r_id]) END, NOT (list_contains(used, 'p' || p_id) OR list_contains(used, 'r' || r_id)) FROM w JOIN o ON rn = n + 1)
  SELECT n FROM w WHERE took)
SELECT p_id, r_id, iou FROM o JOIN walk ON n = rn""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    pairs = intervals.overlap_join(p, r, ["user_id"], ENDS, MINUTES).select("p_id", "r_id", F.round(intervals.iou(*map(F.col, ENDS)), 6).alias("iou")).filter("iou >= 0.1")
    return greedy.greedy_matches(pairs, "p_id", "r_id", [F.desc("iou"), "p_id", "r_id"])


ENGLISH = {"people": ("the", "of", "and"), "motion": ("ing", "tion"), "state": ("is", "are", "was")}
FOLD = f"translate(lower(coalesce(text, '')), '{text.MARKED}', '{text.PLAIN}')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@query(f"""WITH {CLIPS}, t AS (SELECT doc_id, coalesce(text, '') AS text, {FOLD} AS f FROM clips)
SELECT doc_id, CAST(len({WORDS.format("text")}) AS INTEGER) AS n_words, CAST(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) AS INTEGER) AS n_sentences,
  text LIKE '%?%' OR coalesce({WORDS.format("f")}[1] IN ('what', 'why', 'how', 'who', 'when', 'where'), false) AS question,
  sha256(array_to_string({WORDS.format("text")}[1:24], ' ')) AS opening_sha FROM t""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.clips(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = F.col("text")
    return t.select("doc_id", F.size(text.words(c)).alias("n_words"), F.size(text.sentences(c)).alias("n_sentences"), text.is_question(c).alias("question"), F.sha2(text.opening(c, 24), 256).alias("opening_sha"))


@query(f"""WITH t AS (SELECT doc_id, {FOLD} AS f FROM documents) SELECT doc_id, CAST(contains(f, 'the') AS INTEGER) + CAST(contains(f, 'tion') AS INTEGER) + CAST(contains(f, 'ent') AS INTEGER) AS cues,
  CAST(regexp_matches(f, '\\bthe\\b') AS INTEGER) + CAST(regexp_matches(f, '\\bof\\b') AS INTEGER) AS hits, CAST((length(f) - length(replace(f, 'the', ''))) // 3 AS INTEGER) AS n_the FROM t""")
def cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "documents").select("doc_id", text.folded(F.col("text")).alias("f"))
    f = F.col("f")
    return t.select("doc_id", text.cue_count(f, ("the", "tion", "ent")).alias("cues"), text.word_hits(f, ("the", "of")).alias("hits"), text.occurrences(f, "the").alias("n_the"))


CLOSURE_CUES = {"continuity": ("ion ", "ent"), "resolution": ("ble", "ado"), "open_tail": ("the", "of", "to", "de")}
CLOSURE = f"""SELECT doc_id, CASE WHEN (contains(e, 'ion ') OR contains(e, 'ent')) AND NOT (contains(e, 'ble') OR contains(e, 'ado')) THEN 'cliffhanger' WHEN contains(e, 'ble') OR contains(e, 'ado') THEN 'conclusion'
  WHEN coalesce(regexp_extract_all(e, '[a-z0-9-]+')[-1] IN ('the', 'of', 'to', 'de'), false) THEN 'open' WHEN regexp_matches(rtrim(text, ' '), '[.!?]$') THEN 'closed_statement' ELSE 'open' END AS closure
FROM (SELECT doc_id, text, right({FOLD}, 260) AS e FROM documents)"""


@query(CLOSURE)
def closure_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.closure_type(F.col("text"), **CLOSURE_CUES).alias("closure"))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {FOLD} AS f FROM documents), w AS (SELECT *, {WORDS.format("f")}[1] AS first FROM t)
SELECT doc_id, coalesce(first IN ('and', 'but', 'so', 'because', 'or', 'then', 'that'), false) AS starts_mid_sentence, text LIKE '%?%' OR coalesce(first IN ('what', 'why', 'how', 'who', 'when', 'where'), false) AS question_detected,
  contains(f, 'percent') OR contains(f, 'according to') OR contains(f, 'data') OR regexp_matches(f, '[0-9]') AS evidence_present, regexp_matches(rtrim(text, ' '), '[.!?]$') AS ends_with_stop FROM w""")
def editorial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.table(spark, sf_dir, "documents").select("doc_id", text.flags(F.coalesce("text", F.lit(""))).alias("f"))
    return out.select("doc_id", "f.starts_mid_sentence", "f.question_detected", "f.evidence_present", "f.ends_with_stop")


@query(f"""WITH t AS (SELECT doc_id, {FOLD} AS f FROM documents), n AS (SELECT doc_id, unnest([1, 2, 3]) AS o, unnest(['people', 'motion', 'state']) AS name, unnest([CAST(contains(f, 'the') AS INT) + CAST(contains(f, 'of') AS INT) + CAST(contains(f, 'and') AS INT),
  CAST(contains(f, 'ing') AS INT) + CAST(contains(f, 'tion') AS INT), CAST(contains(f, 'is') AS INT) + CAST(contains(f, 'are') AS INT) + CAST(contains(f, 'was') AS INT)]) AS n FROM t)
SELECT doc_id, CASE WHEN n > 0 THEN name ELSE 'other' END AS family FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) = 1""")
def family_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.family(F.col("text"), ENGLISH, "other").alias("family"))


@query(f"""SELECT item_id, CAST(len({WORDS.format("text")}) AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS character_count, contains(text, '?') AS question, contains(text, '!') AS exclamation, contains(text, ':') AS colon, regexp_matches(text, '[0-9]') AS number FROM benchmark""")
def headline_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.table(spark, sf_dir, "benchmark").select("item_id", text.headline_shape(F.col("text")).alias("h"))
    return out.select("item_id", *(f"h.{c}" for c in ("word_count", "character_count", "question", "exclamation", "colon", "number")))


@query(f"WITH {SEGMENTS} SELECT conv_id, turn, coalesce(contains(text, '?') OR {WORDS.format(FOLD)}[1] IN ('what', 'why', 'how', 'who', 'when', 'where'), false) AS question FROM segments")
def question_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(spark, sf_dir).select("conv_id", "turn", F.coalesce(text.is_question(F.col("text")), F.lit(False)).alias("question"))


@query(f"""WITH {CLIPS} SELECT doc_id, round(CAST(CASE WHEN n < 8 THEN 55.0 WHEN n <= 30 THEN 100.0 WHEN n <= 60 THEN 100.0 - (n - 30.0) * 0.30 WHEN n <= 120 THEN 91.0 - (n - 60.0) * 0.25 WHEN n <= 180 THEN 76.0 - (n - 120.0) * 0.30 ELSE greatest(25.0, 58.0 - (n - 180.0) * 0.15) END AS DOUBLE), 4) AS fit FROM clips""")
def duration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir).select("doc_id", F.round(scoring.duration_fit(F.col("n")), 4).alias("fit"))


@query(f"""WITH t AS (SELECT doc_id, {WORDS.format(FOLD)} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, 92.0 - len(list_filter(w, lambda x: x IN ('the', 'of', 'de'))) / len(w) * 180.0)), 4) END AS clarity FROM t""")
def clarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(scoring.clarity(F.col("text"), ("the", "of", "de")), 4).alias("clarity"))


FLOW = f"""CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE greatest(0.0, least(100.0, 45.0 + CASE WHEN s >= 2 THEN 20 ELSE 0 END + CASE WHEN s >= 4 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(rtrim(text, ' '), '[.!?]$') THEN 15 ELSE 0 END
  - CASE WHEN coalesce({WORDS.format(FOLD)}[1] IN ('and', 'but', 'so', 'because', 'or', 'then', 'that'), false) THEN 25 ELSE 0 END)) END"""
COUNTED = "(SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) AS s FROM documents)"


@query(f"SELECT doc_id, CAST({FLOW} AS DOUBLE) AS flow FROM {COUNTED}")
def flow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", scoring.flow(F.col("text")).cast("double").alias("flow"))


@query(f"""WITH t AS (SELECT doc_id, text, {WORDS.format(FOLD)} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, 35 + least(25, 5 * len(list_filter(w, lambda x: contains(x, 'ble') OR contains(x, 'ado'))))
  + least(20, 4 * len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))) + len(list_distinct(w)) / len(w) * 15 + CASE WHEN regexp_matches(text, '[?!]') THEN 5 ELSE 0 END)), 4) END AS value FROM t""")
def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(scoring.value(F.col("text"), ("ble", "ado")), 4).alias("value"))


@query(f"WITH {CLIPS} SELECT doc_id, CAST(floor(potential * 0.30::DOUBLE + context * 0.25::DOUBLE + complete * 0.25::DOUBLE + duration * 0.20::DOUBLE) AS BIGINT) AS total, CASE WHEN potential >= 75 THEN 'A' WHEN potential >= 50 THEN 'B' ELSE 'C' END AS grade FROM clips")
def four_dim_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir).select("doc_id", scoring.four_dimensions(F.col("potential"), F.col("context"), F.col("complete"), F.col("duration")).alias("total"), scoring.grade(F.col("potential")).alias("grade"))


GATES = """list_filter([CASE WHEN potential < 62 THEN 'score' END, CASE WHEN context < 55 THEN 'context' END, CASE WHEN complete < 55 THEN 'payoff' END, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 'no_transcript' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {CLIPS}, g AS (SELECT doc_id, {GATES} AS reasons FROM clips) SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM g")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gates(views.clips(spark, sf_dir)).select("doc_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"))


@query(f"WITH {CLIPS}, g AS (SELECT source_id, unnest({GATES}) AS reason FROM clips) SELECT source_id, reason, count(*) AS n FROM g GROUP BY ALL")
def gate_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gates(views.clips(spark, sf_dir)).select("source_id", F.explode("reasons").alias("reason")).groupBy("source_id", "reason").agg(F.count("*").alias("n"))


ORDER = "potential DESC, context DESC, duration, doc_id"


def ordered() -> list:
    return [F.desc("potential"), F.desc("context"), "duration", "doc_id"]


@query(f"WITH {CLIPS} SELECT source_id, doc_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY {ORDER}) AS INTEGER) AS rank FROM clips QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {ORDER}) <= 8")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(*ordered())
    return views.clips(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 8").select("source_id", "doc_id", "rank")


TOKENS = r"list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')))"


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS s FROM documents), c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM t WHERE len(s) > 0), r AS (SELECT DISTINCT class_id, s FROM c),
g AS (SELECT class_id, unnest(s) AS w FROM r), p AS (SELECT x.class_id AS "left", y.class_id AS "right", count(*) AS common FROM g x JOIN g y ON x.w = y.w AND x.class_id < y.class_id GROUP BY ALL)
SELECT "left", "right", round(common / (len(a.s) + len(b.s) - common), 6) AS similarity FROM p JOIN r a ON a.class_id = "left" JOIN r b ON b.class_id = "right" WHERE common / (len(a.s) + len(b.s) - common) >= 0.86""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select("doc_id", text.words(F.lower("text")).alias("t"))
    return similarity.jaccard_pairs(rows, "doc_id", "t", 0.86).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS s FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM t WHERE len(s) > 0")
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select("doc_id", text.words(F.lower("text")).alias("t"))
    return similarity.jaccard_classes(rows, "doc_id", "t").select("doc_id", "class_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_id", "family", "text", "potential", "context", "complete", "duration")


#: Eligible clips in rank order with the better ranked ones whose texts are near, and the walk that keeps what no kept one is near to.
KEPT = f"""WITH {CLIPS}, g AS (SELECT *, {TOKENS} AS s FROM clips WHERE len({GATES}) = 0), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rn FROM g),
t AS (SELECT rn, unnest(s) AS w FROM o), c AS (SELECT x.rn AS worse, y.rn AS better, count(*) AS common FROM t x JOIN t y ON x.w = y.w AND y.rn < x.rn GROUP BY ALL),
n AS MATERIALIZED (SELECT worse, list(better) AS near FROM c JOIN o a ON a.rn = worse JOIN o b ON b.rn = better WHERE common / (len(a.s) + len(b.s) - common) >= 0.86 GROUP BY worse),
r AS MATERIALIZED (SELECT o.rn, coalesce(near, CAST([] AS BIGINT[])) AS near FROM o LEFT JOIN n ON worse = o.rn),
walk AS (
  WITH RECURSIVE w(n, kept, took) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false
    UNION ALL SELECT rn, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, rn) ELSE kept END, len(list_intersect(kept, near)) = 0 FROM w JOIN r ON rn = n + 1)
  SELECT n FROM w WHERE took),
k AS MATERIALIZED (SELECT o.*, row_number() OVER (ORDER BY o.rn) AS kn FROM o JOIN walk ON walk.n = o.rn)"""


@query(KEPT + f", cl AS (SELECT {TOKENS} AS s, min(doc_id) AS class_id FROM g GROUP BY 1) SELECT doc_id, class_id FROM k JOIN cl USING (s)")
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.gates(candidates(spark, sf_dir)).filter("size(reasons) = 0")
    return selection.without_repetitions(rows).select(F.col("id").alias("doc_id"), "class_id")


@query(KEPT + """, pick AS (
  WITH RECURSIVE w(n, got, late) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(d BIGINT, s VARCHAR, f VARCHAR)[]), CAST([] AS STRUCT(d BIGINT, s VARCHAR, f VARCHAR)[])
    UNION ALL SELECT kn,
      CASE WHEN len(got) < 50 AND len(list_filter(got, lambda x: x.s = source_id)) < 8 AND len(list_filter(got, lambda x: x.f = family)) < 14 THEN list_append(got, {'d': doc_id, 's': source_id, 'f': family}) ELSE got END,
      CASE WHEN len(got) < 50 AND len(list_filter(got, lambda x: x.s = source_id)) < 8 AND len(list_filter(got, lambda x: x.f = family)) >= 14 THEN list_append(late, {'d': doc_id, 's': source_id, 'f': family}) ELSE late END
    FROM w JOIN k ON kn = w.n + 1)
  SELECT got, late FROM w ORDER BY n DESC LIMIT 1),
relaxed AS (
  WITH RECURSIVE w(n, got, late) AS (
    SELECT CAST(0 AS BIGINT), got, CASE WHEN len(got) < 39 THEN late ELSE late[1:0] END FROM pick
    UNION ALL SELECT n + 1, CASE WHEN len(got) < 50 AND len(list_filter(got, lambda x: x.s = late[n + 1].s)) < 8 THEN list_append(got, late[n + 1]) ELSE got END, late FROM w WHERE n < len(late))
  SELECT got FROM w ORDER BY n DESC LIMIT 1)
SELECT doc_id, source_id, family, potential FROM clips WHERE doc_id IN (SELECT unnest(got).d FROM relaxed)""")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily portfolio: gates, greedy text dedupe, caps."""
    return selection.rank_portfolio(candidates(spark, sf_dir)).select(F.col("id").alias("doc_id"), "source_id", "family", "potential")


RECORDS = f"""records AS (SELECT doc_id AS place, source AS account, 'u' || (doc_id % 700) AS url, text, n_chars % 50 AS ratio FROM documents),
asked AS (SELECT list_distinct(list_filter(regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}_-]+'), lambda t: length(t) >= 3)) AS q FROM benchmark WHERE item_id = 0),
scored AS (SELECT place, account, url, len(list_intersect(q, list_distinct(list_filter(regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}_-]+'), lambda t: length(t) >= 3)))) / len(q) AS lex, CASE WHEN max(ratio) OVER (PARTITION BY account) > 0 THEN ratio / max(ratio) OVER (PARTITION BY account) ELSE 0.0 END AS share FROM records, asked)"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    d = views.table(spark, sf_dir, "documents")
    asked = views.table(spark, sf_dir, "benchmark").filter("item_id = 0").select("text").first()
    return d.select(F.col("doc_id").alias("place"), F.col("source").alias("account"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("url"), "text", (F.col("n_chars") % 50).alias("ratio")), asked["text"]


@query(f"""WITH {RECORDS}, s AS (SELECT *, round(lex * 20.0 + share * 10.0, 2) AS score FROM scored), f AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY account, url ORDER BY place) = 1)
SELECT account, url, round(lex, 4) AS lexical, score FROM f ORDER BY score DESC, account, url LIMIT 25""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, asked = _records(spark, sf_dir)
    return search.ranked(search.scored(records, asked)).select("account", "url", "lexical", "score")


@query("SELECT source AS account, max(n_chars % 50) AS top, count(*) AS n FROM documents GROUP BY source")
def account_max_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)[0].groupBy("account").agg(F.max("ratio").alias("top"), F.count("*").alias("n"))


@query("""SELECT page_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM (SELECT page_id, list_filter(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1)), lambda x: true) AS raw, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS found FROM pages) p,
LATERAL (SELECT list(x ORDER BY k) AS ids FROM (SELECT x, min(k) AS k FROM (SELECT unnest(found) AS x, unnest(range(1, len(found) + 1)) AS k) GROUP BY x)) q WHERE len(found) > 0""")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1))
    return views.table(spark, sf_dir, "pages").select("page_id", F.posexplode(ids).alias("pos", "id")).select("page_id", "id", (F.col("pos") + 1).cast("long").alias("place"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://(?:www\.|m\.)?([^/?#]+)', 1)) AS host, rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/') AS path, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return views.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:www\.|m\.)?([^/?#]+)", 1)).alias("host"), F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "").alias("path"), F.regexp_extract(u, "[?&]page=([0-9]+)", 1).alias("page"))


@query(f"""WITH {CLIPS} SELECT doc_id, substring(sha256(lower(coalesce(source_id, '')) || '|' || printf('%.3f', start::DOUBLE) || '|' || printf('%.3f', "end"::DOUBLE) || '|' || lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))), 1, 32) AS key FROM clips""")
def editorial_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.clips(spark, sf_dir)
    return c.select("doc_id", text.editorial_key(F.coalesce("source_id", F.lit("")), F.col("start"), F.col("end"), F.col("text")).alias("key"))


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM (SELECT event_id, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS ms FROM events)""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", timecode.stamp(F.col("value")).alias("stamp"))


@query("""SELECT event_id, coalesce(CAST(k AS BIGINT), 0) AS k, greatest(0, least(100, coalesce(CAST(k AS DOUBLE), 50.0))) AS bounded FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def json_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return views.table(spark, sf_dir, "events").select("event_id", F.coalesce(coerce.whole(k), F.lit(0).cast("long")).alias("k"), coerce.bounded_score(k).alias("bounded"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.segments(spark, sf_dir).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return folds.fold(s, "conv_id", ["start", "turn"], folds.sentences(), folds.SENTENCE)


#: The same folds as walks over the n-th segment of every conversation at once.
SAID = f"""WITH {SEGMENTS}, v AS MATERIALIZED (SELECT conv_id, start / 1000 AS a, "end" / 1000 AS b, coalesce(text, '') AS t, trim(coalesce(speaker, '')) AS sp, row_number() OVER (PARTITION BY conv_id ORDER BY start, turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM segments WHERE "end" > start),
said AS (
  WITH RECURSIVE w(conv_id, n, a, b, t, k, sp, o) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), '', 0, CAST([] AS VARCHAR[]), CAST([] AS STRUCT(a DOUBLE, b DOUBLE, t VARCHAR, k INTEGER, sp VARCHAR[])[]) FROM v
    UNION ALL
    SELECT conv_id, n, CASE WHEN shut THEN NULL ELSE a END, b, CASE WHEN shut THEN '' ELSE t END, CASE WHEN shut THEN 0 ELSE k END, CASE WHEN shut THEN [] ELSE sp END,
      CASE WHEN (shut OR n = total) AND trim(t, E' \n\t') <> '' THEN list_append(o, {{'a': a, 'b': b, 't': trim(t, E' \n\t'), 'k': k, 'sp': sp}}) ELSE o END
    FROM (SELECT *, b - a >= 30 OR (regexp_matches(trim(t, E' \n\t'), '[.!?]$') AND len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) >= 5) AS shut FROM (
      SELECT v.conv_id, v.n, total, CASE WHEN w.k = 0 OR v.a - w.b > 0.8 THEN v.a ELSE w.a END AS a, v.b, CASE WHEN w.k = 0 OR v.a - w.b > 0.8 THEN v.t ELSE w.t || ' ' || v.t END AS t, CASE WHEN w.k = 0 OR v.a - w.b > 0.8 THEN 1 ELSE w.k + 1 END AS k,
        list_filter(CASE WHEN w.k = 0 OR v.a - w.b > 0.8 THEN [v.sp] WHEN list_contains(w.sp, v.sp) THEN w.sp ELSE list_append(w.sp, v.sp) END, lambda x: x <> '') AS sp,
        CASE WHEN w.k > 0 AND v.a - w.b > 0.8 AND trim(w.t, E' \n\t') <> '' THEN list_append(w.o, {{'a': w.a, 'b': w.b, 't': trim(w.t, E' \n\t'), 'k': w.k, 'sp': w.sp}}) ELSE w.o END AS o
      FROM w JOIN v ON v.conv_id = w.conv_id AND v.n = w.n + 1)))
  SELECT conv_id, unnest(o) AS x FROM w WHERE (conv_id, n) IN (SELECT conv_id, max(n) FROM v GROUP BY conv_id))"""


@query(SAID + " SELECT conv_id, x.a AS start, x.b AS \"end\", x.t AS text, x.k AS n_segments, array_to_string(x.sp, ',') AS speakers FROM said")
def build_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("conv_id", "start", "end", "text", "n_segments", F.array_join("speakers", ",").alias("speakers"))


@query(SAID + """, s AS MATERIALIZED (SELECT conv_id, x.a AS a, x.b AS b, x.t AS t, row_number() OVER (PARTITION BY conv_id ORDER BY x.a, x.b) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM said),
made AS (
  WITH RECURSIVE w(conv_id, n, a, t, k, i, done) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), '', 0, 0, CAST(NULL AS STRUCT(i INTEGER, a DOUBLE, b DOUBLE, k INTEGER, t VARCHAR)) FROM s
    UNION ALL
    SELECT conv_id, n, CASE WHEN shut THEN NULL ELSE a END, CASE WHEN shut THEN '' ELSE t END, CASE WHEN shut THEN 0 ELSE k END, CASE WHEN shut THEN i + 1 ELSE i END, CASE WHEN shut THEN {'i': i, 'a': a, 'b': b, 'k': k, 't': t} END
    FROM (SELECT *, b - a >= 30 OR (b - a >= 18 AND regexp_matches(last, '[.!?]$')) OR n = total AS shut FROM (
      SELECT s.conv_id, s.n, total, coalesce(w.a, s.a) AS a, s.b, CASE WHEN w.k = 0 THEN s.t ELSE w.t || ' ' || s.t END AS t, w.k + 1 AS k, w.i, s.t AS last FROM w JOIN s ON s.conv_id = w.conv_id AND s.n = w.n + 1)))
  SELECT conv_id, done FROM w WHERE done IS NOT NULL)
SELECT conv_id, done.i AS index, done.a AS start, done.b AS "end", done.k AS n_sentences, done.t AS text FROM made""")
def build_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(_sentences(spark, sf_dir), "conv_id", ["start", "end"], folds.blocks(), folds.BLOCK)


#: Conversations' segments in seconds, and the answers to their questions, by a walk from each question.
ANSWERS = f"""{SEGMENTS}, v AS MATERIALIZED (SELECT conv_id, start / 1000 AS a, "end" / 1000 AS b, rtrim(coalesce(text, ''), E' \\n\\t') AS t, coalesce(speaker, '') AS sp, coalesce(speaker = 'user', false) AS asks, row_number() OVER w AS n, lead(start / 1000) OVER w AS na, lead(coalesce(speaker, '')) OVER w AS nsp FROM segments WINDOW w AS (PARTITION BY conv_id ORDER BY start, turn)),
walked AS (
  WITH RECURSIVE w(conv_id, k, j, qa, asker, answerer, basis, found, last, shut) AS (
    SELECT conv_id, n, n, a, sp, '', 'no_speakers', 0, CAST(NULL AS DOUBLE), false FROM v WHERE asks
    UNION ALL
    SELECT conv_id, k, j + 1, qa, asker, CASE WHEN NOT ends AND asker <> '' AND sp <> '' AND sp <> asker THEN sp ELSE answerer END,
      CASE WHEN turns AND NOT asked THEN 'second_change' WHEN NOT ends AND asker <> '' AND sp <> '' AND sp <> asker THEN 'change_of_speaker' ELSE basis END,
      CASE WHEN ends THEN found ELSE found + 1 END, CASE WHEN ends THEN last ELSE b END, ends OR b - qa >= 32
    FROM (SELECT *, asked OR turns AS ends FROM (
      SELECT w.*, v.sp, v.b, v.asks AND found > 0 AND v.a - qa >= 6 AS asked, answerer <> '' AND v.sp <> '' AND v.sp <> answerer AS turns FROM w JOIN v ON v.conv_id = w.conv_id AND v.n = w.j + 1 WHERE NOT shut AND w.j < w.k + 12)))
  SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY j DESC) = 1),
answers AS MATERIALIZED (
  SELECT conv_id, CAST(greatest(0, qa - 2) AS DOUBLE) AS a, last AS b, CAST(k - 1 AS INTEGER) AS question_segment, found AS n_responses, answerer <> '' AS speaker_boundary, basis,
    round(greatest(0.2::DOUBLE, least(0.98::DOUBLE, 0.5::DOUBLE + least(0.16::DOUBLE, found * 0.02::DOUBLE) + CASE WHEN answerer <> '' THEN 0.12 ELSE -0.12 END)), 3) AS confidence
  FROM walked WHERE found > 0 AND last - qa >= 8)"""
CHAPTERS = f"""{ANSWERS}, x AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM answers q WHERE q.conv_id = v.conv_id AND v.b BETWEEN q.a AND q.b) OR coalesce(EXISTS (SELECT 1 FROM answers q WHERE q.conv_id = v.conv_id AND v.na BETWEEN q.a AND q.b), false) AS held FROM v),
cut AS (
  WITH RECURSIVE w(conv_id, n, first, a, i, done) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), 0, CAST(NULL AS STRUCT(i INTEGER, a DOUBLE, b DOUBLE, x BIGINT, y BIGINT)) FROM x
    UNION ALL
    SELECT conv_id, n, CASE WHEN shut THEN n ELSE first END, CASE WHEN shut THEN NULL ELSE a END, CASE WHEN shut THEN i + 1 ELSE i END, CASE WHEN shut THEN {{'i': i, 'a': a, 'b': b, 'x': first, 'y': n - 1}} END
    FROM (SELECT *, na IS NULL OR (NOT held AND (greatest(0, na - b) >= 8 OR b - a >= 180 OR (b - a >= 85 AND (regexp_matches(t, '[.!?]$') OR greatest(0, na - b) >= 1 OR (sp <> '' AND nsp <> '' AND sp <> nsp))))) AS shut FROM (
      SELECT x.conv_id, x.n, w.first, coalesce(w.a, x.a) AS a, x.b, w.i, t, sp, na, nsp, held FROM w JOIN x ON x.conv_id = w.conv_id AND x.n = w.n + 1)))
  SELECT conv_id, done FROM w WHERE done IS NOT NULL),
chapters AS MATERIALIZED (
  SELECT conv_id, done.i AS index, done.a AS a, done.b AS b, CAST(done.x AS INTEGER) AS segment_start, CAST(done.y AS INTEGER) AS segment_end,
    EXISTS (SELECT 1 FROM answers q WHERE q.conv_id = cut.conv_id AND q.a < done.b AND done.a < q.b) AS has_qa_bridge FROM cut)"""


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(spark, sf_dir).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})


@query(f'WITH {ANSWERS} SELECT conv_id, a AS start, b AS "end", question_segment, n_responses, speaker_boundary, basis, confidence FROM answers')
def qa_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seconds(spark, sf_dir).withColumn("is_question", F.coalesce(F.col("speaker") == "user", F.lit(False)))
    return folds.fold(s, "conv_id", ["start", "turn"], folds.question_answers(), folds.QA)


@query(f'WITH {CHAPTERS} SELECT conv_id, index, a AS start, b AS "end", segment_start, segment_end, has_qa_bridge FROM chapters')
def build_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that no question-answer bridge is cut by."""
    return clips.bridged_chapters(_seconds(spark, sf_dir), qa_candidates(spark, sf_dir), "conv_id", "turn")
