"""Registered queries: keyed tables that take changes, and snapshots that are judged and replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import greedy
from ..sources import runs, snapshots
from ..sources.keyed import Files, KeyedTable
from . import views
from .queries import query
from .views import CLIPS

KIND, VERSION = "decisions", 2


def folder(spark: SparkSession, name: str) -> str:
    return f"{greedy.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CHANGES = 3


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value, event_id % {CHANGES} AS batch FROM events)
SELECT user_id, max(event_id) AS at, arg_max(event_type, event_id) AS event_type, (array_agg(value ORDER BY event_id DESC))[1] AS value,
  arg_min(event_id, (batch, event_id)) AS inserted FROM e GROUP BY user_id""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches of changes: the last type and value of each user, and the event that inserted them."""
    path = folder(spark, "upserted")
    table = KeyedTable(spark, path, "user_id", "at", buckets=16, first=("inserted",))
    value = F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value")
    rows = views.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), "event_type", value, F.col("event_id").alias("inserted"))
    for number in range(CHANGES):
        table.upsert(rows.filter(F.col("at") % CHANGES == number), number)
    out = greedy.cut(table.read())
    Files(spark, path).delete(path)
    return out


@query(f"""WITH r AS (
  SELECT conv_id, trim(CASE WHEN turn % 5 = 4 THEN ' ' ELSE conv_id || ':' || turn END) <> '' AND role IN ('user', 'assistant') AND turn % 6 <> 5 AS good FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id % 7 AS k, count(*) AS n, count(*) FILTER (NOT coalesce(good, false)) AS bad FROM r GROUP BY conv_id),
s AS (SELECT conv_id, k, CASE WHEN k IN (4, 5) THEN 0 ELSE n END AS found, CASE WHEN k IN (4, 5) THEN 0 ELSE bad END AS invalid,
  CASE WHEN k NOT IN (3, 4, 5) THEN n + CASE WHEN k = 2 THEN 1 ELSE 0 END END AS declared FROM c)
SELECT conv_id, CASE WHEN k = 5 THEN 'missing' WHEN k IN (0, 1, 2, 4) OR invalid > 0 THEN 'invalid' ELSE 'ready' END AS state, declared, found, invalid, k <> 2 AS consistent
FROM s""")
def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each conversation, some with another format or version, a wrong or no count, cut off, or absent."""
    c = views.table(spark, sf_dir, "conversations").filter("conv_id is not null")
    action = F.when(F.col("role") == "user", "approved").when(F.col("role") == "assistant", "rejected").otherwise("note")
    record = F.struct(
        F.when(F.col("turn") % 5 == 4, " ").otherwise(F.concat_ws(":", "conv_id", "turn")).alias("editorial_key"), action.alias("action"),
        F.when(F.col("turn") % 6 == 5, "soon").otherwise(F.concat(F.lit("2026-01-0"), (F.col("turn") % 9 + 1).cast("string"))).alias("created_at"),
    )
    k = F.col("conv_id") % 7
    rows = c.groupBy("conv_id").agg(F.collect_list(record).alias("records"))
    count = F.when(k == 3, None).when(k == 2, F.size("records") + 1).otherwise(F.size("records"))
    payload = F.to_json(F.struct(F.when(k == 0, "other").otherwise(KIND).alias("format"), F.when(k == 1, 1).otherwise(VERSION).alias("format_version"), count.alias("record_count"), "records"))
    payload = F.when(k == 4, F.substring(payload, F.lit(1), F.length(payload) - 2)).when(k != 5, payload)
    out = snapshots.judged(rows.select("conv_id", payload.alias("payload")), "payload", KIND, VERSION)
    return out.select("conv_id", "state", "declared", "found", "invalid", "consistent")


@query(f"""WITH {CLIPS}, f AS (
  SELECT doc_id % 400 AS clip, doc_id, decision, reason FROM clips WHERE decision IN ('approved', 'rejected')),
l AS (SELECT clip, arg_max(decision, doc_id) AS action, arg_max(reason, doc_id) AS reason_code FROM f GROUP BY clip)
SELECT 'clip ' || clip AS editorial_key, CAST(start AS DOUBLE) AS start_seconds, CAST("end" AS DOUBLE) AS end_seconds, potential AS score, action, reason_code, coalesce(source_id, '') AS source_signature
FROM l JOIN clips ON doc_id = clip WHERE clip % 10 <> 0""")
def snapshot_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision of each clip as a snapshot that replaces one of half of them, read back."""
    c = views.clips(spark, sf_dir)
    feedback = c.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 400).alias("clip_id"), F.col("decision").alias("action"), F.col("reason").alias("reason_code"), F.array("family").alias("tags"), F.lit("2026-01-02T03:04:05Z").alias("created_at"))
    key = F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("clip "), F.col("doc_id").cast("string")))
    rows = c.select(F.col("doc_id").alias("clip_id"), key.alias("editorial_key"), "start", "end", "duration", F.col("potential").alias("score"), F.lit("v1").alias("score_version"), F.col("source_id").alias("source_signature"))
    records = snapshots.decision_records(feedback, rows)
    path = folder(spark, "snapshot")
    for part in (records.filter("score % 2 = 0"), records):
        snapshots.write_snapshot(part, path, KIND, VERSION, "2026-01-03")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    out = greedy.cut(snapshots.read_snapshot(spark, path, schema, KIND, VERSION))
    Files(spark, path).delete(path)
    return out.select("editorial_key", "start_seconds", "end_seconds", "score", "action", "reason_code", "source_signature")


@query(r"""WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS words FROM documents),
g AS (SELECT doc_id, words, len(words) AS n, greatest(11, least(22, greatest(11, round_even(length(array_to_string(words, ' ')) / 3, 0)) + 4)) AS goal FROM t),
w AS MATERIALIZED (SELECT doc_id, n, goal, unnest(range(n)) AS i, length(unnest(words)) AS size FROM g WHERE n > 3),
f(doc_id, i, starts, size) AS (
  SELECT doc_id, 0, [0], size FROM w WHERE i = 0
  UNION ALL
  SELECT w.doc_id, w.i, CASE WHEN wraps THEN list_append(starts, w.i) ELSE starts END, CASE WHEN wraps THEN w.size ELSE f.size + 1 + w.size END
  FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1,
    LATERAL (SELECT f.size + 1 + w.size > goal AND len(starts) < 3 AND n - w.i >= 4 - len(starts) AS wraps)),
last AS (SELECT f.doc_id, starts FROM f JOIN (SELECT doc_id, n FROM w WHERE i = 0) USING (doc_id) WHERE i = n - 1)
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 1 ELSE len(starts) END AS INTEGER) AS n_lines,
  sha256(CASE WHEN n <= 3 THEN array_to_string(words, ' ')
    ELSE array_to_string(list_transform(range(len(starts)), lambda k: array_to_string(words[starts[k + 1] + 1 : coalesce(starts[k + 2], n)], ' ')), chr(10)) END) AS lines_sha
FROM g LEFT JOIN last USING (doc_id)""")
def balanced_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents broken into three lines as titles are."""
    lines = views.table(spark, sf_dir, "documents").select("doc_id", text.balanced_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha"))


@query(f"""WITH {CLIPS}, c AS (
  SELECT *, coalesce(source_id, 'none') AS run, CASE WHEN doc_id % 5 = 0 THEN "end" ELSE start END AS a, CASE WHEN doc_id % 5 = 0 THEN start ELSE "end" END AS b FROM clips)
SELECT run AS run_id, CASE WHEN doc_id % 7 = 0 THEN 'interval_' || doc_id || '_' || printf('%.3f', CAST(start AS DOUBLE)) || '_' || printf('%.3f', CAST("end" AS DOUBLE)) ELSE 'clip ' || doc_id END AS clip_id,
  CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", CAST("end" - start AS DOUBLE) AS duration, CAST(least(100.0, round(potential * 1.5, 3)) AS DOUBLE) AS score, family AS editorial_family,
  doc_id % 4 = 0 OR doc_id % 6 = 1 AS review_required, CASE WHEN doc_id % 9 = 0 THEN false ELSE context >= 60 END AS context_gate, CAST(NULL AS VARCHAR) AS reason FROM c
UNION ALL SELECT run, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 20 = 0 THEN 'corrupt' ELSE 'schema' END FROM c WHERE doc_id % 10 = 0""")
def run_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each source as a run, written, with lines among them that are cut or of another schema, and read back."""
    k = F.col("doc_id")
    c = views.clips(spark, sf_dir).withColumn("run_id", F.coalesce("source_id", F.lit("none")))
    turned = k % 5 == 0
    raw = F.to_json(F.struct(
        F.when(k % 7 != 0, F.concat(F.lit("clip "), k.cast("string"))).alias("clip_id"), F.when(turned, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(turned, F.col("start")).otherwise(F.col("end")).alias("end"),
        (F.col("potential") * 1.5).alias("total_score"), "family", (k % 4 == 0).alias("review_required"), F.struct(F.when(k % 6 == 1, "weak").otherwise("pass").alias("status"), F.when(k % 9 == 0, False).alias("context_gate")).alias("technical_gate"), F.col("context").alias("context_quality"),
    ))
    made = c.select("run_id", "source_id", F.lit("off").alias("mode"), F.lit("local").alias("backend"), F.lit(False).alias("seeds_enabled"), F.lit("2026-01-01").alias("generated_at"), runs.candidate(F.try_parse_json(raw), k).alias("candidate"))
    path = folder(spark, "runs")
    runs.write_runs(made, path)
    cut = F.when(k % 20 == 0, F.substring(raw, 1, 20)).otherwise(raw)
    c.filter("doc_id % 10 = 0").select(cut.alias("value"), F.col("run_id").alias("run")).write.mode("append").partitionBy("run").text(path)
    kept, rejected = runs.read_runs(spark, path)
    names = ("clip_id", "start", "end", "duration", "score", "editorial_family", "review_required", "context_gate")
    good = kept.select("run_id", *(f"candidate.{n}" for n in names), F.lit(None).cast("string").alias("reason"))
    bad = rejected.select(F.col("run").alias("run_id"), *(F.lit(None).cast(good.schema[n].dataType).alias(n) for n in names), "reason")
    out = greedy.cut(good.union(bad))
    Files(spark, path).delete(path)
    return out
