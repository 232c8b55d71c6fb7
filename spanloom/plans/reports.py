"""More registered queries: decision trees, reports, subtitles and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import clips, intervals, reports
from ..sources import sinks
from ..streaming import events as streams
from . import views
from .queries import CHAPTERS, FOLD, MINUTES, WORDS, build_chapters, qa_candidates, query
from .views import CLIPS, SEGMENTS, intervals_sql

#: The rules of the two decision queries below, as their SQL has them.
VISUAL_RULES = (("podcast", 0.84, ("podcast",), None), ("interview", 0.70, (), "several"), ("close_selfie", 0.72, ("close_up",), "one"), ("talking_head", 0.70, (), "one"))
DOUBTS = {"starts_mid_sentence": 14, "overlap_suspected": 22, "payoff_missing": 12, "speaker_turn_invalid": 18}
TABLES = ("customer", "orders", "lineitem", "events", "documents", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def storage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_counts({t: views.table(spark, sf_dir, t) for t in TABLES})


@query("SELECT substring(text, 1, 45) AS opening, count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, opening LIMIT 12")
def frequent_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frequent_openings(views.table(spark, sf_dir, "documents").select("text"), "text")


@query(f"""WITH {CLIPS} SELECT source_id, count(n) AS n, CAST(sum(n) AS BIGINT) AS total, max(n) AS greatest, count(*) FILTER (n < 300) AS brief, count(*) FILTER (n >= 300 AND n < 3000) AS medium, count(*) FILTER (n >= 3000) AS rest, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM clips GROUP BY source_id""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.catalog_summary(views.clips(spark, sf_dir), "source_id", "n", (("brief", 300), ("medium", 3000)))


@query(f"""WITH {SEGMENTS} SELECT conv_id, count(*) AS n_segments, count(*) FILTER (contains(coalesce(text, ''), '?') OR coalesce({WORDS.format(FOLD)}[1] IN ('what', 'why', 'how', 'who', 'when', 'where'), false)) AS n_questions,
  count(DISTINCT speaker) FILTER (trim(coalesce(speaker, '')) <> '') AS n_speakers, CAST(sum("end" - start) AS BIGINT) AS spoken, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, max(coalesce("end", start)) AS last,
  round(count(*) FILTER (trim(coalesce(speaker, '')) <> '') / count(*), 3) AS speaker_coverage FROM segments GROUP BY conv_id""")
def context_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dossier(views.segments(spark, sf_dir), "conv_id")


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS nxt FROM events WHERE ts IS NOT NULL)
SELECT user_id, event_type, CAST(sum(nxt - t) AS BIGINT) AS spent, count(*) AS n FROM e WHERE nxt IS NOT NULL GROUP BY ALL""")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").filter("ts is not null").select("user_id", "event_type", "event_id", "ts")
    return reports.stage_times(e, "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")), "event_id")


@query(f"""WITH {SEGMENTS}, s AS (SELECT conv_id, coalesce(start < lag("end") OVER (PARTITION BY conv_id ORDER BY start, turn) - 100, false) AS hit FROM segments) SELECT conv_id, bool_or(hit) AS possible_overlap FROM s GROUP BY conv_id""")
def possible_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.possible_overlap(views.segments(spark, sf_dir), "conv_id", 100)


@query("""SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS at, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(least(20.0, max(abs(value)) / greatest(sqrt(avg(value * value)), 1e-6)), 4) AS crest FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def energy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").filter("ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = streams.energy_windows(e, "user_id", "ts", "value", seconds=3600)
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "n", F.round("rms", 6).alias("rms"), F.round("crest", 4).alias("crest"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM a) SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY user_id, no""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").filter("ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.sessions(e, "user_id", "ts", gap="2 hours")
    return out.select("user_id", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


RULES = (("question", r"^\s*(?:what|why|how)\b"), ("number", r"\d"), ("shout", r"!"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(f, '^\\s*(?:what|why|how)\\b') THEN 'question' WHEN regexp_matches(f, '\\d') THEN 'number' WHEN regexp_matches(f, '!') THEN 'shout' ELSE 'other' END AS family FROM (SELECT doc_id, {FOLD} AS f FROM documents)")
def hook_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.first_rule(F.col("text"), RULES, "other").alias("family"))


@query(f"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all({FOLD}, '[a-z0-9]+'), lambda x: length(x) >= 4) AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM t),
c AS (SELECT item_id, term, count(*) AS n, min(pos) AS pos FROM u GROUP BY ALL), r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, pos) <= 6)
SELECT t.item_id, coalesce(string_agg(term, '/' ORDER BY n DESC, pos), '') AS terms FROM t LEFT JOIN r USING (item_id) GROUP BY t.item_id""")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.topic_terms(F.col("text")), "/").alias("terms"))


@query(f"""WITH t AS (SELECT doc_id, {FOLD} AS f FROM documents) SELECT doc_id, regexp_matches(f, '(?s)the.{{0,96}}tion|tion.{{0,96}}the') AS near, len(list_distinct(regexp_extract_all(f, '[0-9]{{3,}}'))) AS n_numbers FROM t""")
def local_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "documents").select("doc_id", text.folded(F.col("text")).alias("f"))
    return t.select("doc_id", text.co_occurs(F.col("f"), "the", "tion").alias("near"), F.size(F.array_distinct(F.regexp_extract_all("f", F.lit("([0-9]{3,})"), 1))).cast("long").alias("n_numbers"))


@query(f"""WITH {CLIPS}, g AS (SELECT doc_id, doc_id % 5 = 0 AS a, doc_id % 7 = 0 AS b, context < 55 AS c, decision = 'rejected' AS d FROM clips),
p AS (SELECT *, CASE WHEN a THEN 14 ELSE 0 END + CASE WHEN b THEN 22 ELSE 0 END + CASE WHEN c THEN 12 ELSE 0 END + CASE WHEN d THEN 18 ELSE 0 END AS total FROM g)
SELECT doc_id, CASE WHEN total = 0 THEN 'clean' WHEN total < 30 THEN 'review' ELSE 'weak' END AS status, CAST(least(42, total) AS INTEGER) AS penalty,
  concat_ws(',', CASE WHEN a THEN 'starts_mid_sentence' END, CASE WHEN b THEN 'overlap_suspected' END, CASE WHEN c THEN 'payoff_missing' END, CASE WHEN d THEN 'speaker_turn_invalid' END) AS reasons FROM p""")
def technical_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.clips(spark, sf_dir)
    flags = {"starts_mid_sentence": F.col("doc_id") % 5 == 0, "overlap_suspected": F.col("doc_id") % 7 == 0, "payoff_missing": F.col("context") < 55, "speaker_turn_invalid": F.col("decision") == "rejected"}
    return c.select("doc_id", scoring.technical_gate(flags, DOUBTS).alias("g")).select("doc_id", "g.status", "g.penalty", F.array_join("g.reasons", ",").alias("reasons"))


@query(f"""WITH {CLIPS}, b AS (SELECT doc_id, potential * 0.5::DOUBLE + context * 0.3::DOUBLE + complete * 0.2::DOUBLE - CASE WHEN doc_id % 5 = 0 THEN 14 ELSE 0 END AS base, doc_id % 3 = 0 AS review, doc_id % 21 - 10 AS adj FROM clips),
c AS (SELECT *, greatest(0.0, least(100.0, CASE WHEN review THEN least(base, 78.0) ELSE base END)) + greatest(-6.0, least(6.0, adj)) AS x FROM b)
SELECT doc_id, CAST(round(greatest(0.0, least(100.0, CASE WHEN review THEN least(x, 78.0) ELSE x END)), 4) AS DOUBLE) AS score FROM c""")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.clips(spark, sf_dir)
    factors = F.map_from_arrays(F.array(*map(F.lit, ("potential", "context", "complete"))), F.array(*(F.col(n).cast("double") for n in ("potential", "context", "complete"))))
    score = scoring.final_score(factors, {"potential": 0.5, "context": 0.3, "complete": 0.2}, F.when(F.col("doc_id") % 5 == 0, 14).otherwise(0), [(F.col("doc_id") % 3 == 0, 78.0)], (F.col("doc_id") % 21 - 10).cast("double"))
    return c.select("doc_id", F.round(score, 4).alias("score"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'stage' WHEN c_custkey % 3 = 0 THEN 'podcast' WHEN faces > 1 THEN 'interview' WHEN faces = 1 AND c_custkey % 2 = 0 THEN 'close_selfie' WHEN faces = 1 THEN 'talking_head' ELSE 'unknown' END AS format,
  CASE WHEN c_custkey % 11 = 0 THEN 0.96 WHEN c_custkey % 3 = 0 THEN 0.84 WHEN faces > 1 THEN 0.70 WHEN faces = 1 AND c_custkey % 2 = 0 THEN 0.72 WHEN faces = 1 THEN 0.70 ELSE 0.35 END::DOUBLE AS confidence FROM (SELECT c_custkey, c_custkey % 4 AS faces FROM customer)""")
def visual_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    f = clips.visual_format({"podcast": k % 3 == 0, "close_up": k % 2 == 0}, F.when(k % 11 == 0, "stage"), k % 4, F.lit(None).cast("double"), VISUAL_RULES, 0.96, 0.35)
    return views.table(spark, sf_dir, "customer").select("c_custkey", f.alias("f")).select("c_custkey", "f.format", "f.confidence")


@query(f"""WITH {intervals_sql("p", "click")}, s AS (SELECT DISTINCT user_id AS u, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS scene FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL), k AS (SELECT u FROM s GROUP BY u HAVING count(*) >= 2),
e AS (SELECT event_id, start, "end", (SELECT max(scene) FROM s JOIN k USING (u) WHERE u = user_id AND scene <= start AND start - scene < 900000) AS a, (SELECT min(scene) FROM s JOIN k USING (u) WHERE u = user_id AND scene >= "end" AND scene - "end" < 900000) AS b FROM p),
f AS (SELECT *, coalesce(b, "end") - coalesce(a, start) <= 7200000 AS fine FROM e), g AS (SELECT event_id, CASE WHEN fine THEN coalesce(a, start) ELSE start END AS start, CASE WHEN fine THEN coalesce(b, "end") ELSE "end" END AS stop FROM f)
SELECT event_id, start, stop AS "end" FROM g WHERE stop - start >= 600000""")
def scene_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.intervals(spark, sf_dir, "click")
    scenes = views.table(spark, sf_dir, "events").filter("event_type = 'purchase' and ts is not null").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("scene"))
    return clips.to_scenes(p, scenes, ["user_id"], "event_id", 7_200_000, 600_000, reach=900_000, width=MINUTES).select("event_id", "start", "end")


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start, "end", text) AS n FROM segments WHERE text IS NOT NULL),
c AS (SELECT conv_id, n, n || chr(10) || printf('%02d:%02d:%02d,%03d', start // 3600000, start // 60000 % 60, start // 1000 % 60, start % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', "end" // 3600000, "end" // 60000 % 60, "end" // 1000 % 60, "end" % 1000) || chr(10) || text || chr(10) || chr(10) AS cue FROM s)
SELECT conv_id, sha256(string_agg(cue, '' ORDER BY n)) AS body_sha FROM c GROUP BY conv_id""")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.segments(spark, sf_dir).filter("text is not null").withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return sinks.srt_text(s, "conv_id").select("conv_id", F.sha2("body", 256).alias("body_sha"))


@query(f"""WITH {intervals_sql("p", "click")}, {intervals_sql("r", "purchase")}, e AS (
  SELECT p.user_id, p.user_id || '/' || p.event_id AS p_id, r.user_id || '/' || r.event_id AS r_id, round((least(p."end", r."end") - greatest(p.start, r.start)) / (greatest(p."end", r."end") - least(p.start, r.start)), 6) AS iou, abs(p.start - r.start) AS a, abs(p."end" - r."end") AS b
  FROM p JOIN r ON p.user_id = r.user_id AND p.start < r."end" AND r.start < p."end"),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY iou DESC, p_id, r_id) AS rn FROM e WHERE iou >= 0.1),
walk AS (
  WITH RECURSIVE w(n, used, took) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
    UNION ALL SELECT rn, CASE WHEN list_contains(used, 'p' || p_id) OR list_contains(used, 'r' || r_id) THEN used ELSE list_concat(used, ['p' || p_id, 'r' || r_id]) END, NOT (list_contains(used, 'p' || p_id) OR list_contains(used, 'r' || r_id)) FROM w JOIN o ON rn = w.n + 1)
  SELECT n FROM w WHERE took),
m AS (SELECT user_id, count(*) AS matched, round(avg(a), 3) AS mean_start_error, round(avg(b), 3) AS mean_end_error, round(median(a), 3) AS median_start_error, round(avg(iou), 6) AS mean_iou, round(avg(CASE WHEN a <= 600000 AND b <= 600000 THEN 1 ELSE 0 END), 6) AS hit_rate FROM o JOIN walk ON walk.n = rn GROUP BY user_id)
SELECT user_id, x.n AS "references", coalesce(y.n, 0) AS predictions, coalesce(matched, 0) AS matched, mean_start_error, mean_end_error, median_start_error, mean_iou, hit_rate, coalesce(round(coalesce(matched, 0) / y.n, 6), 0.0) AS precision, round(coalesce(matched, 0) / x.n, 6) AS recall
FROM (SELECT user_id, count(*) AS n FROM r GROUP BY 1) x LEFT JOIN (SELECT user_id, count(*) AS n FROM p GROUP BY 1) y USING (user_id) LEFT JOIN m USING (user_id)""")
def evaluate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of each user's clicks against purchases."""
    p = views.intervals(spark, sf_dir, "click").withColumnRenamed("event_id", "id")
    r = views.intervals(spark, sf_dir, "purchase").withColumnRenamed("event_id", "id")
    return clips.evaluation(p, r, ["user_id"], threshold=0.1, tolerance=600_000, width=MINUTES)


@query(f"""WITH {CLIPS}, o AS MATERIALIZED (SELECT doc_id, source_id, start, "end", decision, CAST(potential AS DOUBLE) AS score, list_distinct({WORDS.format(FOLD)}) AS w, row_number() OVER (ORDER BY potential DESC, doc_id) AS rn FROM clips),
q AS MATERIALIZED (
  SELECT y.rn AS worse, x.rn AS better, (least(x."end", y."end") - greatest(x.start, y.start)) / least(x."end" - x.start, y."end" - y.start) AS lap, CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) END * 80.0 AS alike
  FROM o x JOIN o y ON x.source_id = y.source_id AND x.rn < y.rn AND x.start < y."end" AND y.start < x."end"),
z AS MATERIALIZED (SELECT worse, better, greatest(lap * 100.0, alike) AS penalty FROM q),
r AS MATERIALIZED (SELECT rn, coalesce(near, CAST([] AS BIGINT[])) AS near FROM o LEFT JOIN (SELECT worse, list(better) AS near FROM z WHERE penalty >= 70 GROUP BY worse) ON worse = rn),
walk AS MATERIALIZED (
  WITH RECURSIVE w(n, kept, took) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false
    UNION ALL SELECT rn, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, rn) ELSE kept END, len(list_intersect(kept, near)) = 0 FROM w JOIN r ON rn = w.n + 1)
  SELECT n FROM w WHERE took),
m AS (SELECT worse, max(penalty) AS penalty FROM z JOIN walk ON walk.n = better GROUP BY worse)
SELECT doc_id, source_id, CASE WHEN coalesce(penalty, 0) >= 35 THEN greatest(0, floor(score - penalty * 0.12)) ELSE score END AS score, round(coalesce(penalty, 0.0), 6) AS penalty FROM o JOIN walk ON walk.n = rn LEFT JOIN m ON worse = rn""")
def diversity_within_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a source thinned by overlap and text alone, against clips of their own time."""
    c = views.clips(spark, sf_dir)
    rows = c.select("doc_id", "source_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text", "decision", F.col("potential").cast("double").alias("score"))
    rows = rows.withColumn("rank", F.struct((-F.col("score")).alias("s"), "doc_id"))
    return clips.diversified_in_time(rows, "source_id", "doc_id", "rank", "score", ("decision",)).select("doc_id", "source_id", "score", F.round("penalty", 6).alias("penalty"))


def anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips.topics(views.clips(spark, sf_dir), "doc_id", F.lit("general"))
    start, end = (F.col(c).cast("double").alias(c) for c in ("start", "end"))
    rows = c.select("doc_id", "source_id", start, end, "text", "topic", "decision", F.col("potential").cast("double").alias("score"))
    rows = rows.withColumn("rank", F.struct((-F.col("score")).alias("s"), "doc_id"))
    out = clips.diversified_anywhere(rows, "source_id", "doc_id", "rank", "score", ("decision",))
    return out.select("doc_id", "source_id", "score", F.round("penalty", 6).alias("penalty"))


#: Every pair of clips from 35 on: text anywhere, overlap and topic within a source; then a walk in rank order.
DIVERSITY = f"""WITH {CLIPS},
o AS MATERIALIZED (
  SELECT doc_id, source_id, start, "end", CAST(potential AS DOUBLE) AS score, list_distinct({WORDS.format(FOLD)}) AS w, {WORDS.format(FOLD)} AS said,
    row_number() OVER (ORDER BY potential DESC, doc_id) AS rn
  FROM clips),
terms AS (
  SELECT rn, term, count(*) AS n FROM (SELECT rn, unnest(said) AS term FROM o)
  WHERE length(term) >= 4 AND NOT regexp_full_match(term, '\\d+') GROUP BY ALL),
topic AS (
  SELECT rn, list_distinct(list_filter(string_split(array_to_string(list_sort(list(term)), '-'), '-'), lambda t: t <> '')) AS t
  FROM (SELECT * FROM terms QUALIFY row_number() OVER (PARTITION BY rn ORDER BY n DESC, term) <= 3) GROUP BY rn),
x AS MATERIALIZED (SELECT o.rn, source_id, start, "end", len(w) AS n, coalesce(t, CAST([] AS VARCHAR[])) AS t FROM o LEFT JOIN topic USING (rn)),
words AS MATERIALIZED (SELECT rn, unnest(w) AS word FROM o),
common AS (SELECT a.rn AS better, b.rn AS worse, count(*) AS c FROM words a JOIN words b ON a.word = b.word AND a.rn < b.rn GROUP BY ALL),
by_text AS (
  SELECT better, worse, c / (a.n + b.n - c) * 80.0 AS penalty FROM common JOIN x a ON a.rn = better JOIN x b ON b.rn = worse),
by_time AS (
  SELECT a.rn AS better, b.rn AS worse, (least(a."end", b."end") - greatest(a.start, b.start)) / least(a."end" - a.start, b."end" - b.start) * 100.0 AS penalty
  FROM x a JOIN x b ON a.source_id = b.source_id AND a.rn < b.rn AND a.start < b."end" AND b.start < a."end"),
shared AS (
  SELECT a.rn AS better, b.rn AS worse, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS s
  FROM x a JOIN x b ON a.source_id = b.source_id AND a.rn < b.rn AND len(a.t) > 0 AND len(b.t) > 0),
by_topic AS (SELECT better, worse, least(1.0, s + CASE WHEN s >= 0.34 THEN 0.15 ELSE 0.0 END) * 48.0 AS penalty FROM shared),
z AS MATERIALIZED (
  SELECT better, worse, max(penalty) AS penalty FROM (FROM by_text UNION ALL FROM by_time UNION ALL FROM by_topic) WHERE penalty >= 35 GROUP BY ALL),
r AS MATERIALIZED (
  SELECT rn, coalesce(near, CAST([] AS BIGINT[])) AS near FROM o LEFT JOIN (SELECT worse, list(better) AS near FROM z WHERE penalty >= 70 GROUP BY worse) ON worse = rn),
walk AS MATERIALIZED (
  WITH RECURSIVE w(n, kept, took) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false
    UNION ALL SELECT rn, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, rn) ELSE kept END, len(list_intersect(kept, near)) = 0 FROM w JOIN r ON rn = w.n + 1)
  SELECT n FROM w WHERE took),
m AS (SELECT worse, max(penalty) AS penalty FROM z JOIN walk ON walk.n = better GROUP BY worse)
SELECT doc_id, source_id, CASE WHEN penalty >= 35 THEN greatest(0, floor(score - penalty * 0.12)) ELSE score END AS score, round(coalesce(penalty, 0.0), 6) AS penalty
FROM o JOIN walk ON walk.n = rn LEFT JOIN m ON worse = rn"""


@query(DIVERSITY)
def diversity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips thinned by the whole rule: text against all sources, overlap and topic within one."""
    return anywhere(spark, sf_dir)


@query(f"""WITH {CHAPTERS}, s AS (SELECT conv_id, turn, start / 1000 AS a, "end" / 1000 AS b FROM segments WHERE "end" > start),
m AS (SELECT s.conv_id, s.turn, s.a, s.b, c.index, least(s.b, c.b) - greatest(s.a, c.a) AS common, c.a - lag(c.b) OVER (PARTITION BY s.conv_id, s.turn ORDER BY c.index) AS gap FROM s JOIN chapters c ON c.conv_id = s.conv_id AND s.a < c.b AND c.a < s.b),
p AS (SELECT conv_id, turn, string_agg(index, ',' ORDER BY index) AS chapters, count(*) AS n, max(index) - min(index) + 1 AS reach, sum(common) AS covered, bool_or(coalesce(gap > 0.001, false)) AS gaps FROM m GROUP BY 1, 2),
q AS (SELECT DISTINCT s.conv_id, s.turn, true AS bridge FROM s JOIN answers q ON q.conv_id = s.conv_id AND s.a < q.b AND q.a < s.b WHERE s.a <= q.a + 2.5 AND s.b >= q.b - 2.5 AND (least(s.b, q.b) - greatest(s.a, q.a)) / greatest(0.001, q.b - q.a) >= 0.72)
SELECT s.conv_id, s.turn, chapters, CAST(least(100.0, CASE WHEN n IS NULL THEN 35.0 WHEN n = 1 THEN 100.0 ELSE CASE WHEN n = reach AND NOT gaps THEN 84.0 ELSE 52.0 END - CASE WHEN covered < greatest(1.0, s.b - s.a) * 0.55 THEN 12.0 ELSE 0.0 END END + CASE WHEN bridge THEN 8.0 ELSE 0.0 END) AS DOUBLE) AS coherence, coalesce(bridge, false) AS qa_bridge
FROM s LEFT JOIN p USING (conv_id, turn) LEFT JOIN q USING (conv_id, turn)""")
def chapter_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of conversations against their chapters and question-answer bridges."""
    s = views.segments(spark, sf_dir).select("conv_id", "turn", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end")).filter("end > start")
    chapters = build_chapters(spark, sf_dir).select("conv_id", "index", "start", "end")
    out = clips.with_chapters(s, chapters, qa_candidates(spark, sf_dir), ["conv_id"], "turn")
    return out.select("conv_id", "turn", F.array_join(F.transform("chapter_ids", lambda i: i.cast("string")), ",").alias("chapters"), "coherence", "qa_bridge")


@query(f"""WITH {intervals_sql("p", "click")}, {intervals_sql("r", "view")}, j AS (SELECT p.event_id, greatest(p.start, r.start) AS a, least(p."end", r."end") AS b FROM p JOIN r ON p.user_id = r.user_id AND p.start < r."end" AND r.start < p."end")
SELECT event_id, count(*) AS n_overlaps, CAST(sum(b - a) AS BIGINT) AS total FROM j GROUP BY event_id""")
def overlap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.intervals(spark, sf_dir, "click")
    r = views.intervals(spark, sf_dir, "view").select("user_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    pairs = intervals.overlap_join(p, r, ["user_id"], clips.ENDS, MINUTES)
    return pairs.groupBy("event_id").agg(F.count("*").alias("n_overlaps"), F.sum(intervals.intersection(*map(F.col, clips.ENDS))).cast("long").alias("total"))
