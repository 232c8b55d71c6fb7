"""Registered queries: signals of candidates, review data, replayed decisions, priors and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signals
from ..operators import archive, clips, review, selection
from . import views
from .queries import FOLD, MINUTES, query
from .views import CLIPS, intervals_sql


def doc() -> Column:
    return F.col("doc_id")


def every(n: int, at: int = 0) -> Column:
    """Every n-th document; null for every 23rd, as a flag can be unknown."""
    return F.when(doc() % 23 != 0, doc() % n == at)


def every_sql(n: int, at: int = 0) -> str:
    return f"(CASE WHEN doc_id % 23 <> 0 THEN doc_id % {n} = {at} END)"


def yes_sql(n: int, at: int = 0) -> str:
    return f"coalesce({every_sql(n, at)}, false)"


@query(f"""WITH {CLIPS} SELECT doc_id,
  CASE WHEN NOT coalesce({every_sql(5, 1)} = false, true) THEN 25.0 WHEN doc_id % 3 = 0 THEN round(45.0::DOUBLE + (doc_id % 11) / 10.0::DOUBLE * 45.0::DOUBLE, 1) WHEN {yes_sql(4)} THEN 82.0 ELSE 50.0 END::DOUBLE AS speaker,
  CASE WHEN {yes_sql(7)} THEN 90.0 WHEN {yes_sql(5)} THEN 78.0 WHEN {yes_sql(2)} THEN CASE WHEN {yes_sql(3)} THEN 42.0 ELSE 58.0 END ELSE 55.0 END::DOUBLE AS qa,
  coalesce(round(50.0::DOUBLE + (CASE WHEN doc_id % 6 <> 0 THEN potential END - 50.0::DOUBLE) * 0.55::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (doc_id % 20) / 12.0::DOUBLE), 1), 50.0) AS hook,
  CASE WHEN {yes_sql(9)} OR NOT coalesce({every_sql(5, 1)} = false, true) THEN 'speaker_audio' WHEN duration > 90 THEN CASE WHEN duration > 180 THEN 'duration' WHEN {yes_sql(2)} THEN 'context_payoff' ELSE 'hook' END WHEN {yes_sql(2)} THEN 'context_payoff' ELSE 'hook' END AS category
FROM clips""")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = ~every(5, 1)
    sure = F.when(doc() % 3 == 0, (doc() % 11) / 10.0)
    hook = F.when(doc() % 6 != 0, F.col("potential")).cast("double")
    return views.clips(spark, sf_dir).select(
        "doc_id",
        signals.speaker_boundary(valid, sure, every(4)).alias("speaker"),
        signals.qa_boundary(every(7), every(5), every(2), every(3)).alias("qa"),
        signals.hook_proximity(hook, (doc() % 20).cast("double")).alias("hook"),
        signals.reason_category(every(9), valid, F.col("duration"), every(2), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).alias("category"),
    )


DELTAS = {"potential": 8.5, "context": -31.0, "complete": 1.5}


@query(f"""WITH {CLIPS} SELECT doc_id, CASE WHEN {yes_sql(8)} THEN 0.0 ELSE greatest(-6.0::DOUBLE, least(6.0::DOUBLE,
  (((potential - 50.0::DOUBLE) / 50.0::DOUBLE) * 8.5::DOUBLE - ((context - 50.0::DOUBLE) / 50.0::DOUBLE) * 25.0::DOUBLE) / 2 * 0.35::DOUBLE
  + (doc_id % 41 - 20) * 0.075::DOUBLE * (0.5::DOUBLE + CASE WHEN doc_id % 4 = 0 THEN 0.75::DOUBLE ELSE (doc_id % 10) / 10.0::DOUBLE END * 0.5::DOUBLE))) END::DOUBLE AS adjustment FROM clips""")
def feedback_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda values: F.map_from_arrays(F.array(*map(F.lit, DELTAS)), F.array(*values))
    factors, deltas = pairs([F.col(n).cast("double") for n in DELTAS]), pairs(map(F.lit, DELTAS.values()))
    sure = F.when(doc() % 4 != 0, (doc() % 10) / 10.0)
    score = signals.feedback_adjustment(factors, deltas, (doc() % 41 - 20).cast("double"), sure, ~F.coalesce(every(8), F.lit(False)))
    return views.clips(spark, sf_dir).select("doc_id", score.alias("adjustment"))


@query(f"""WITH {CLIPS}, c AS (SELECT *, CASE WHEN {yes_sql(2)} THEN greatest(0.0, least(100.0, 58.0 + CASE WHEN {yes_sql(3)} THEN 12 ELSE 0 END + CASE WHEN {yes_sql(5)} THEN 16 ELSE -18 END + CASE WHEN {yes_sql(7)} THEN 8 ELSE 0 END + least(8, doc_id % 6 * 2))) ELSE 50.0 END::DOUBLE AS counter FROM clips),
s AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (potential + context + complete) / 3.0::DOUBLE + CASE WHEN {yes_sql(7)} THEN 8 ELSE 0 END + least(8, doc_id % 6 * 2) - least(12, doc_id % 5 * 4) + (counter - 50.0::DOUBLE) * 0.12::DOUBLE)), 1) AS signal FROM c)
SELECT doc_id, counter, signal, potential + CASE WHEN {yes_sql(3, 1)} AND NOT {yes_sql(4)} THEN greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (signal - 50.0::DOUBLE) * 0.04::DOUBLE)) ELSE 0 END::DOUBLE AS selection FROM s""")
def favorability(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = signals.counter_response(every(2), every(3), every(5), every(7), doc() % 6)
    c = views.clips(spark, sf_dir).withColumn("counter", counter)
    c = c.withColumn("signal", signals.favorability([F.col(n) for n in ("potential", "context", "complete")], doc() % 5, doc() % 6, every(7), F.col("counter")))
    return c.select("doc_id", "counter", "signal", signals.selection_score(F.col("potential"), every(3, 1), F.col("signal"), every(4)).alias("selection"))


def _hits_sql(kind: str, text: str) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, ' {c} ') AS INTEGER)" for c in signals.LEXICON[kind]) + ")"


_FIT = " + ".join(f"s_{name} * {weight}::DOUBLE" for name, weight in signals.WEIGHTS.items())
_STARTS = ", ".join(
    f"least(100.0::DOUBLE, {start}::DOUBLE + ({_hits_sql(kind, 't')}{' + least(numbers, 3)' if kind == 'evidence' else ''}) * {points}::DOUBLE) AS s_{name}" for name, (kind, start, points) in signals.STARTS.items()
)
_OPENING = " OR ".join(f"starts_with(opening || ' ', '{u} ')" for u in signals.UNRESOLVED)


@query(rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS raw, list_filter(string_split(regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents),
t AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS t, len(words) AS n, array_to_string(words[1:4], ' ') AS opening, len(regexp_extract_all(array_to_string(words, ' '), '\b[0-9]+\b')) AS numbers FROM w),
h AS (SELECT doc_id, numbers, {_STARTS},
  least(100.0::DOUBLE, 32.0::DOUBLE + least(35.0::DOUBLE, numbers * 12.0::DOUBLE) + least(25.0::DOUBLE, {_hits_sql('topic', 't')} * 5.0::DOUBLE) + CASE WHEN n >= 35 THEN 10 ELSE 0 END) AS s_specificity,
  least(100.0::DOUBLE, 35.0::DOUBLE + CASE WHEN regexp_matches(raw, '[.!?] *$') THEN 30 ELSE 0 END + CASE WHEN len(list_filter(string_split_regex(raw, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) >= 3 THEN 20 ELSE 0 END + CASE WHEN n >= 24 THEN 15 ELSE 0 END) AS s_conclusion,
  least(100.0::DOUBLE, 78.0::DOUBLE - CASE WHEN {_OPENING} THEN 24 ELSE 0 END - CASE WHEN n < 14 THEN 12 ELSE 0 END + CASE WHEN {_hits_sql('topic', 't')} > 0 THEN 8 ELSE 0 END + CASE WHEN {_hits_sql('claim', 't')} + {_hits_sql('conflict', 't')} > 0 THEN 6 ELSE 0 END) AS s_context_completeness,
  least(100.0::DOUBLE, 20.0::DOUBLE + len(list_intersect(['river', 'city', 'with'], words)) / 3.0::DOUBLE * 80.0::DOUBLE) AS s_context_match FROM t)
SELECT doc_id, {", ".join(f"round(s_{n}, 1) AS {n}" for n in (*signals.STARTS, "specificity", "conclusion", "context_completeness", "context_match"))}, round({_FIT}, 1) AS fit FROM h""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.text_signals(F.col("text"), F.lit("the river with a city"))
    return views.table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.*")


@query(f"""WITH {CLIPS} SELECT doc_id, CASE WHEN duration < 15 THEN -8 WHEN duration <= 30 THEN 10 WHEN duration <= 60 THEN 7 WHEN duration <= 120 THEN 2 WHEN duration <= 180 THEN -1 ELSE -5 END AS points,
  least(CASE WHEN contains(coalesce(text, ''), 'the') THEN 80 ELSE 60 END, 20 * CAST(contains(coalesce(text, ''), 'of the') AS INTEGER) + 25 * CAST(contains(coalesce(text, ''), 'the') AS INTEGER) + 5 * (CAST(contains(coalesce(text, ''), 'and') AS INTEGER) + CAST(contains(coalesce(text, ''), 'ein') AS INTEGER))) AS relevance FROM clips""")
def duration_and_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = (F.array(*map(F.lit, names)) for names in (("of the",), ("the",), ("and", "x", "ein")))
    relevance = signals.relevance(F.coalesce("text", F.lit("")), *lists)
    return views.clips(spark, sf_dir).select("doc_id", signals.duration_points(F.col("duration")).alias("points"), relevance.alias("relevance"))


@query(rf"""WITH {CLIPS}, t AS (SELECT doc_id, duration, coalesce(text, '') AS raw, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM clips)
SELECT doc_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 40.0::DOUBLE + least(20, CAST(regexp_matches(array_to_string(w[1:15], ' '), '\bwhy\b') AS INTEGER) * 12) + least(20.0::DOUBLE, len(list_filter(w, lambda x: regexp_matches(x, 'love|fear'))) / greatest(len(w), 1)::DOUBLE * 200)
  + least(10, (length(raw) - length(replace(raw, '!', ''))) * 4 + (length(raw) - length(replace(raw, '?', ''))) * 2) + doc_id % 30
  + CASE WHEN duration < 15 THEN -8 WHEN duration <= 30 THEN 10 WHEN duration <= 60 THEN 7 WHEN duration <= 120 THEN 2 ELSE -1 END + CASE WHEN regexp_matches(raw, '[.!?] *$') THEN 10 ELSE -15 END - 1.5::DOUBLE
  - least(15.0::DOUBLE, len(list_filter(w, lambda x: x = 'so')) / greatest(len(w), 1)::DOUBLE * 150))), 4) AS score FROM t""")
def block_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = signals.block_score(F.col("text"), F.col("duration"), doc() % 30, F.lit(-1.5), (r"\bwhy\b",), ("love", "fear"), ("so",))
    return views.clips(spark, sf_dir).select("doc_id", F.round(score, 4).alias("score"))


@query(r"""SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN n_chars % 7 ELSE n_chars % 900 END::DOUBLE AS views, coalesce((doc_id % 40 + doc_id % 9) / nullif(CASE WHEN n_chars % 5 = 0 THEN n_chars % 7 ELSE n_chars % 900 END, 0)::DOUBLE, 0.0) AS engagement_rate,
  CASE WHEN n_chars % 5 = 0 THEN n_chars % 7 ELSE n_chars % 900 END / 1000.0::DOUBLE AS view_rate, coalesce(1080 / nullif(doc_id % 3 * 960, 0)::DOUBLE, 0.0) AS aspect_ratio, length(coalesce(text, '')) AS caption_chars,
  len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS caption_words FROM (SELECT * REPLACE (length(coalesce(text, '')) AS n_chars) FROM documents)""")
def catalog_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))))
    seen = F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 900)
    # every fifth row has plays only, and those that have 0 views fall back to plays of 0
    plays = F.when(F.col("n_chars") % 5 == 0, F.col("n_chars") % 7).otherwise(0)
    m = signals.catalog_metrics(seen, plays, doc() % 40, doc() % 9, F.lit(1000), F.col("text"), F.lit(1080), doc() % 3 * 960)
    return d.select("doc_id", m.alias("m")).select("doc_id", "m.*")


TOPICS = {"water": ("river", "fluss", "the river"), "people": ("city", "and", "children"), "time": ("day", "year", "night")}


def _topic_sql(terms: tuple[str, ...]) -> str:
    count = lambda x: f"(length(p) - length(replace(p, ' {'  '.join(x.split())} ', ''))) // {len('  '.join(x.split())) + 2}"
    return "(" + " + ".join(f"CASE WHEN {count(x)} > 0 THEN 1.5 + least(3, {count(x)}) ELSE 0 END" for x in terms) + ")"


@query(rf"""WITH p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all({FOLD}, '[a-z0-9]+'), '  ') || ' ' AS p FROM documents), s AS (SELECT doc_id, {", ".join(f"{_topic_sql(t)} AS {n}" for n, t in TOPICS.items())} FROM p)
SELECT doc_id, CASE WHEN greatest(water, people, time) <= 0 THEN 'general' WHEN water >= people AND water >= time THEN 'water' WHEN people >= time THEN 'people' ELSE 'time' END AS topic FROM s""")
def lexicon_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", signals.lexicon_topic(F.col("text"), TOPICS).alias("topic"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, {FOLD} AS f, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, nullif(regexp_extract(raw, '^\s*(?:>>\s*)?(\p{{Lu}}[\p{{L}}\p{{N}}_-]{{2,}}(?:\s+\p{{Lu}}[\p{{L}}\p{{N}}_-]{{2,}})?)\s*:', 1), '') AS speaker, regexp_matches(f, '\b(?:chart|graph|image|on the screen|as you can see|percent)\b') AS needs_a_look,
  CASE WHEN c = '' THEN true WHEN regexp_matches(c, '[.!?]$') THEN false ELSE regexp_matches(c, '[,;:—-]$') OR list_contains(['and', 'but', 'or', 'because', 'with', 'of', 'to', 'that'], regexp_extract_all('_ ' || lower(c), '[\p{{L}}\p{{N}}_-]+')[-1]) END AS ends_open
FROM t""")
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return views.table(spark, sf_dir, "documents").select("doc_id", signals.speaker_marker(t).alias("speaker"), signals.needs_a_look(t).alias("needs_a_look"), signals.ends_open(t).alias("ends_open"))


# Selection


@query(f"""WITH {CLIPS}, d AS (SELECT doc_id, {every_sql(3)} AS complete_context, {yes_sql(2)} AS mid, {yes_sql(5)} AS ref, CASE doc_id % 4 WHEN 0 THEN ' Review ' WHEN 1 THEN 'weak' WHEN 2 THEN 'blocked' END AS status, CASE WHEN doc_id % 8 = 2 THEN ['timing', 'technical_review', ''] END AS stated FROM clips),
r AS (SELECT doc_id, coalesce(NOT complete_context, false) AS lost, mid, ref, coalesce(lower(trim(status)) IN ('review', 'review_required', 'blocked'), false) AS rev, stated FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN lost THEN 'context_incomplete' END, CASE WHEN lost AND mid THEN 'starts_mid_sentence' END, CASE WHEN lost AND ref THEN 'starts_with_context_reference' END, CASE WHEN rev THEN 'technical_review' END, CASE WHEN rev AND stated IS NOT NULL THEN 'timing' END) AS deferral FROM r""")
def deferral(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(doc() % 4 == 0, " Review ").when(doc() % 4 == 1, "weak").when(doc() % 4 == 2, "blocked")
    stated = F.when(doc() % 8 == 2, F.array(*map(F.lit, ("timing", "technical_review", ""))))
    flags = {"context_complete": every(3), "starts_mid_sentence": every(2), "starts_with_context_reference": every(5), "gate_status": status, "gate_reasons": stated}
    rows = views.clips(spark, sf_dir).withColumns(flags)
    return selection.deferred(rows).select("doc_id", F.array_join("deferral", ",").alias("deferral"))


@query("""WITH s AS (SELECT conv_id, sum(length(coalesce(text, ''))) AS seconds, count(*) * 3 AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN seconds < 120 OR n < 8 THEN 0 ELSE least(24, greatest(3, seconds // 240 + 6, n // 18 + 6)) END AS INTEGER) AS expected, CAST(CASE WHEN seconds >= 120 THEN least(36, greatest(15, seconds // 240 + 6)) ELSE 15 END AS INTEGER) AS most FROM s""")
def expected_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "conversations").filter("conv_id is not null").groupBy("conv_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("seconds"), (F.count("*") * 3).alias("n"))
    return s.select("conv_id", selection.expected_pool(F.col("seconds"), F.col("n"), 24).alias("expected"), selection.adaptive_most(F.col("seconds")).alias("most"))



@query(f"""WITH {intervals_sql("p", "purchase")}, {intervals_sql("c", "click")}, {intervals_sql("v", "view")},
h AS (SELECT p.event_id, max(least(CASE WHEN c.event_id % 2 = 0 THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END, (c.event_id % 101) * 0.08::DOUBLE)) AS hook FROM p JOIN c ON c.user_id = p.user_id AND c.start < p."end" AND p.start < c."end" GROUP BY 1),
q AS (SELECT p.event_id, row_number() OVER (PARTITION BY p.event_id ORDER BY v.start, v."end", v.event_id % 3 <> 0, v.event_id % 2 = 0) AS n, CASE WHEN v.event_id % 3 <> 0 AND NOT p.start <= v.start + 2.5 THEN 2.5 WHEN v.event_id % 3 <> 0 AND NOT p."end" >= v."end" - 2.5 THEN 1.5 END AS gap, CASE WHEN v.event_id % 2 = 0 THEN 3.0 ELSE 1.5 END AS gain FROM p JOIN v ON v.user_id = p.user_id AND v.start < p."end" AND p.start < v."end"),
f AS (SELECT event_id, min(n) FILTER (gap IS NULL) AS first, min_by(gain, n) FILTER (gap IS NULL) AS gain FROM q GROUP BY 1),
l AS (SELECT event_id, max(gap) AS lost FROM q JOIN f USING (event_id) WHERE gap IS NOT NULL AND (first IS NULL OR n < first) GROUP BY 1)
SELECT event_id, CAST(round(greatest(-4.0::DOUBLE, least(10.0::DOUBLE, coalesce(hook, 0) + coalesce(gain, 0) - coalesce(lost, 0))), 2) AS DOUBLE) AS bonus FROM p LEFT JOIN h USING (event_id) LEFT JOIN f USING (event_id) LEFT JOIN l USING (event_id)""")
def context_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, v = (views.intervals(spark, sf_dir, kind) for kind in ("purchase", "click", "view"))
    hooks = c.select("user_id", "start", "end", (F.col("event_id") % 101).cast("double").alias("score"), (F.col("event_id") % 2 == 0).alias("payoff"))
    qa = v.select("user_id", "start", "end", (F.col("event_id") % 3 != 0).alias("needs_question"), (F.col("event_id") % 2 == 0).alias("speaker_boundary"))
    return selection.context_bonus(p, hooks, qa, "user_id", "event_id", MINUTES).select("event_id", "bonus")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Candidates of each conversation's language-like sources: every third clip is primary, the others are the fallback."""
    c = views.clips(spark, sf_dir).select(doc().alias("id"), "source_id", "start", "end", "text", "potential", (F.col("context") / 100).alias("confidence"))
    rows = c.withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    expected = rows.groupBy("source_id").agg(F.lit(40).alias("expected"))
    return rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0"), expected, rows.filter("id % 17 = 0")


@query()
def select_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, fallback, expected, previous = _sources(spark, sf_dir)
    return selection.select_and_rank(primary, fallback, expected, previous).select("source_id", "place", "id", "origin", "start", "end")


@query()
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, fallback, expected, previous = _sources(spark, sf_dir)
    return selection.selection_counts(primary, selection.select_and_rank(primary, fallback, expected, previous), expected)


#: Blocks of even documents that no approved odd one covers, and no better seed.
SEEDS = f"""WITH {CLIPS},
b AS (SELECT doc_id, source_id, start, "end", potential AS s, CASE WHEN doc_id % 6 <> 0 THEN context END AS d FROM clips WHERE doc_id % 2 = 0 AND source_id IS NOT NULL AND trim(coalesce(text, '')) <> ''),
r AS (SELECT doc_id AS id, CASE WHEN doc_id % 29 <> 0 THEN source_id END AS source_id, start, "end" FROM clips WHERE doc_id % 2 = 1 AND decision = 'approved'),
free AS MATERIALIZED (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE coalesce(r.source_id, b.source_id) = b.source_id AND r.start < b."end" AND b.start < r."end"
    AND (least(r."end", b."end") - greatest(r.start, b.start)) / least(r."end" - r.start, b."end" - b.start) >= 0.72)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(s, -1) DESC, coalesce(d, -1) DESC, doc_id) AS rn FROM free),
near AS MATERIALIZED (
  SELECT x.source_id, y.rn AS worse, list(x.rn) AS better FROM o x JOIN o y ON x.source_id = y.source_id AND x.rn < y.rn AND x.start < y."end" AND y.start < x."end"
    AND (least(x."end", y."end") - greatest(x.start, y.start)) / least(x."end" - x.start, y."end" - y.start) >= 0.72 GROUP BY ALL),
walk AS MATERIALIZED (
  WITH RECURSIVE w(source_id, n, kept, took) AS (
    SELECT DISTINCT source_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM o
    UNION ALL SELECT o.source_id, o.rn, CASE WHEN len(list_intersect(kept, coalesce(better, CAST([] AS BIGINT[])))) = 0 THEN list_append(kept, o.rn) ELSE kept END, len(list_intersect(kept, coalesce(better, CAST([] AS BIGINT[])))) = 0
    FROM w JOIN o ON o.source_id = w.source_id AND o.rn = w.n + 1 LEFT JOIN near ON near.source_id = o.source_id AND near.worse = o.rn)
  SELECT source_id, n FROM w WHERE took),
seeds AS (SELECT o.source_id, row_number() OVER (PARTITION BY o.source_id ORDER BY rn) AS place, doc_id, start, "end" FROM o JOIN walk ON walk.source_id = o.source_id AND walk.n = o.rn QUALIFY place <= 8)"""


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = views.clips(spark, sf_dir)
    density = F.when(doc() % 6 != 0, F.col("context")).alias("density")
    blocks = c.filter("doc_id % 2 = 0").select("doc_id", "source_id", "start", "end", "text", F.col("potential").alias("self_contained"), density)
    own = F.when(doc() % 29 != 0, F.col("source_id")).alias("source_id")
    return c.filter("doc_id % 2 = 1 and decision = 'approved'").select(own, "start", "end", doc().alias("id"), "text"), blocks


@query(f"{SEEDS} SELECT * FROM seeds")
def block_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, blocks = _archive(spark, sf_dir)
    return selection.block_seeds(rows, blocks, "source_id", "doc_id").select("source_id", "place", "doc_id", "start", "end")


@query(f"""{SEEDS}, t AS (SELECT DISTINCT source_id FROM r WHERE source_id IS NOT NULL)
SELECT coalesce(source_id, '') AS source_id, id, CAST(NULL AS VARCHAR) AS block_id, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", false AS seed FROM r
UNION ALL SELECT source_id, NULL, CAST(doc_id AS VARCHAR), start, "end", true FROM seeds JOIN t USING (source_id)""")
def seeded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved clips and the seeds of their sources from an archive of other ones."""
    rows, blocks = _archive(spark, sf_dir)
    times = {c: F.col(c).cast("double") for c in ("start", "end")}
    known = blocks.withColumns(times | {"block_id": doc().cast("string"), "highlights": F.lit(""), "title": F.lit(""), "summary": F.col("text")})
    out = archive.with_seeds(rows.withColumns(times), known)
    return out.select(F.coalesce("source_id", F.lit("")).alias("source_id"), "id", "block_id", "start", "end", "seed")


@query()
def archive_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents against even ones of their source as blocks of an archive."""
    c = views.clips(spark, sf_dir).withColumns({"account": F.col("family"), "start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    speaking = F.when(doc() % 3 == 0, True).when(doc() % 3 == 1, False)
    blocks = c.filter("doc_id % 2 = 0").select(
        "account", doc().cast("int").alias("place"), doc().cast("string").alias("block_id"), "source_id", "start", "end", F.lit("").alias("title"), F.col("text").alias("summary"), F.lit("").alias("highlights"),
        F.col("context").cast("double").alias("density"), F.col("potential").cast("double").alias("self_contained"), F.when(doc() % 10 != 0, archive.SPEECH).otherwise("").alias("content_class"), speaking.alias("speaking"),
        (doc() % 11 == 0).alias("needs_context"), F.array().cast("array<string>").alias("warnings"), F.lit("qa").alias("trust_tier"),
    )
    rows = c.filter("doc_id % 2 = 1").select("doc_id", "account", "source_id", "start", "end", "text")
    return archive.aligned(rows, blocks, "doc_id").select("doc_id", "alignment.*")


# Review data


@query(f"""WITH {CLIPS}, j AS (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '{{"broken' ELSE '{{"qa_bridge": ' || CASE doc_id % 3 WHEN 0 THEN '"yes"' WHEN 1 THEN 'false' ELSE '"?"' END || ', "closure_type": "  ' || family || ' ", "chapter_primary_id": ' || (doc_id - 50) || ', "context": ' || (doc_id % 150 - 20) || '.26, "gate_status": "' || CASE doc_id % 2 WHEN 0 THEN 'pass' ELSE 'other' END || '"}}' END AS raw FROM clips)
SELECT doc_id, CASE WHEN doc_id % 31 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS qa_bridge, CASE WHEN doc_id % 31 <> 0 THEN nullif(trim(json_extract_string(raw, '$.closure_type')), '') END AS closure_type, CASE WHEN doc_id % 31 <> 0 AND doc_id >= 50 THEN doc_id - 50 END AS chapter_primary_id,
  CASE WHEN doc_id % 31 <> 0 THEN round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST(json_extract_string(raw, '$.context') AS DOUBLE))), 1) END AS context, CASE WHEN doc_id % 31 <> 0 AND doc_id % 2 = 0 THEN 'pass' END AS gate_status FROM (SELECT doc_id, CASE WHEN doc_id % 31 <> 0 THEN raw END AS raw FROM j)""")
def allowed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(doc() % 3 == 0, '"yes"').when(doc() % 3 == 1, "false").otherwise('"?"')
    raw = F.concat(
        F.lit('{"qa_bridge": '), flag, F.lit(', "closure_type": "  '), F.col("family"), F.lit(' ", "chapter_primary_id": '), (doc() - 50).cast("string"),
        F.lit(', "context": '), (doc() % 150 - 20).cast("string"), F.lit('.26, "gate_status": "'), F.when(doc() % 2 == 0, "pass").otherwise("other"), F.lit('"}'),
    )
    rows = views.clips(spark, sf_dir).select("doc_id", F.when(doc() % 31 == 0, '{"broken').otherwise(raw).alias("raw"))
    out = rows.select("doc_id", review.allowed(F.col("raw"), review.DEDUP_CONTEXT).alias("d"), review.allowed(F.col("raw"), review.SCORECARD).alias("s"))
    return out.select("doc_id", "d.qa_bridge", "d.closure_type", "d.chapter_primary_id", "s.context", "s.gate_status")


@query(f"""WITH {CLIPS}, b AS (SELECT doc_id, start, "end", start + 1 AS a, start + doc_id % 9 AS z, doc_id % 4 = 0 AND start + doc_id % 9 > start + 1 AS done FROM clips)
SELECT doc_id, CAST(CASE WHEN done THEN a ELSE start END AS DOUBLE) AS start, CAST(CASE WHEN done THEN z ELSE "end" END AS DOUBLE) AS "end", CASE WHEN done THEN 'rendered' ELSE 'canonical' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'public_subtitle' WHEN doc_id % 5 = 1 THEN 'whisper' WHEN doc_id % 5 = 2 THEN 'manual' ELSE 'unknown' END AS transcript_source, CASE WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'unknown' END AS coverage_status FROM b""")
def review_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = review.bounds(F.col("start"), F.col("end"), F.col("start") + 1, F.col("start") + doc() % 9, F.when(doc() % 4 == 0, " Rendered").otherwise("failed"))
    source = F.when(doc() % 5 == 0, "YouTube Subtitles").when(doc() % 5 == 1, "whisper-large").when(doc() % 5 == 2, "manual_confirmed").when(doc() % 5 == 3, "other")
    p = review.provenance(source, F.when(doc() % 2 == 0, "partial").otherwise("odd"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    out = views.clips(spark, sf_dir).select("doc_id", b.alias("b"), p.alias("p"))
    return out.select("doc_id", "b.active.start", "b.active.end", "b.status", "p.transcript_source", "p.coverage_status")


@query(f"""WITH {CLIPS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 WHEN doc_id % 3 = 1 THEN true ELSE false END AS available, CASE WHEN doc_id % 3 = 0 THEN potential WHEN doc_id % 3 = 1 THEN context ELSE 50 END::DOUBLE AS signal, doc_id % 3 < 2 AND doc_id % 5 = 0 AS review FROM clips""")
def favorability_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = doc() % 5 == 0
    nested = F.struct((doc() % 2 == 0).alias("available"), F.lit(None).cast("boolean").alias("eligible"), F.col("potential").alias("signal"), flag.alias("review"))
    d = review.favorability_details(F.when(doc() % 3 == 0, nested), F.lit(None).cast("boolean"), F.when(doc() % 3 == 1, F.col("context")), flag)
    return views.clips(spark, sf_dir).select("doc_id", d.alias("d")).select("doc_id", "d.*")


@query(f"WITH {CLIPS} SELECT doc_id AS id, duration, potential AS score FROM clips WHERE decision = 'approved'")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.clips(spark, sf_dir).select(doc().alias("id"), "duration", F.col("potential").alias("score"), "start", F.col("decision").alias("review_status"))
    return review.queue(rows, "approved", "duration").select("id", "duration", "score")


@query(f"WITH {CLIPS} SELECT count(*) AS n, round(avg(potential), 6) AS mean, count(*) FILTER (potential >= 70) AS n_high FROM clips")
def score_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.score_averages(views.clips(spark, sf_dir), "potential")


@query("SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.newest(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts"), "ts")


# Replayed decisions


REPLAY = f"""{CLIPS}, cl AS (SELECT doc_id AS id, 'k' || doc_id % 500 AS key, source_id AS sig, start, "end" FROM clips),
fb AS (SELECT doc_id AS id, doc_id AS clip_id, CASE decision WHEN 'pending' THEN 'note' ELSE decision END AS action, reason, [reason] AS tags, doc_id * 1000 AS made FROM clips),
rc AS (SELECT doc_id AS pos, 'k' || doc_id % 700 AS key, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'rejected' ELSE 'approved' END AS action, CASE WHEN doc_id % 2 = 0 THEN 'weak_hook' ELSE '' END AS reason,
  [CASE WHEN doc_id % 2 = 0 THEN 'weak_hook' ELSE '' END] AS tags, CASE WHEN doc_id % 13 <> 0 THEN doc_id * 7919 % 1000003 END AS made, CASE WHEN doc_id % 4 <> 0 THEN source_id ELSE '' END AS sig, start + doc_id % 5 * 0.25 AS start, "end" + doc_id % 3 * 0.25 AS stop FROM clips),
ok AS (SELECT * FROM rc WHERE action <> '' AND made IS NOT NULL),
nw AS (SELECT key, max(id) AS id, max_by(sig, id) AS sig FROM cl GROUP BY key),
ex AS (SELECT ok.*, CASE WHEN ok.sig <> '' AND nw.sig <> '' AND ok.sig <> nw.sig THEN NULL ELSE nw.id END AS exact FROM ok LEFT JOIN nw USING (key)),
ma AS (SELECT *, coalesce(exact, (SELECT max(cl.id) FROM cl WHERE cl.sig = ex.sig AND ex.sig <> '' AND abs(cl.start - ex.start) <= 0.5 AND abs(cl."end" - ex.stop) <= 0.5)) AS clip_id FROM ex),
la AS (SELECT clip_id, max_by({{'a': action, 'r': reason, 't': tags}}, id) AS said, max_by(made, id) AS last_at FROM fb WHERE action IN ('approved', 'rejected', 'needs_review') GROUP BY clip_id),
st AS (SELECT ma.*, {{'a': action, 'r': reason, 't': tags}} AS says, said, last_at FROM ma LEFT JOIN la USING (clip_id)),
fi AS (SELECT clip_id, min(pos) AS first, min_by(says, pos) AS first_says FROM st WHERE clip_id IS NOT NULL AND (said IS NULL OR (says <> said AND made > last_at)) GROUP BY clip_id),
oc AS (
  SELECT pos, clip_id, CASE WHEN clip_id IS NULL THEN 'unmatched' WHEN pos = first THEN 'imported' WHEN pos > first THEN CASE WHEN says = first_says THEN 'already_current' ELSE 'skipped_older' END WHEN says = said THEN 'already_current' ELSE 'skipped_older' END AS outcome FROM st LEFT JOIN fi USING (clip_id)
  UNION ALL SELECT pos, NULL, 'invalid' FROM rc WHERE action = '' OR made IS NULL)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.clips(spark, sf_dir)
    key = lambda n: F.concat(F.lit("k"), (doc() % n).cast("string")).alias("editorial_key")
    stored = c.select(doc().alias("id"), key(500), F.col("source_id").alias("signature"), "start", "end")
    given = c.select(doc().alias("id"), doc().alias("clip_id"), F.when(F.col("decision") == "pending", "note").otherwise(F.col("decision")).alias("action"), "reason", F.array("reason").alias("tags"), (doc() * 1000).alias("at"))
    reason = F.when(doc() % 2 == 0, "weak_hook").otherwise("")
    action = F.when(doc() % 5 == 0, "").when(doc() % 5 == 1, "needs_review").when(doc() % 5 == 2, "rejected").otherwise("approved")
    records = c.select(
        doc().alias("pos"), key(700), action.alias("action"), reason.alias("reason"), F.array(reason).alias("tags"), F.when(doc() % 13 != 0, doc() * 7919 % 1000003).alias("at"),
        F.when(doc() % 4 != 0, F.col("source_id")).otherwise("").alias("signature"), (F.col("start") + doc() % 5 * 0.25).alias("start"), (F.col("end") + doc() % 3 * 0.25).alias("end"),
    )
    return review.restored(records, stored, given)


@query(f"WITH {REPLAY} SELECT pos, clip_id, outcome FROM oc")
def decisions_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select("pos", "clip_id", "outcome")


@query(f"WITH {REPLAY} SELECT count(*) AS records_seen, " + ", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("imported", "already_current", "skipped_older", "unmatched", "invalid")) + " FROM oc")
def decision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.outcome_counts(_replayed(spark, sf_dir))


# Priors


@query(f"""WITH {CLIPS}, k AS (SELECT decision, unnest([{{'f': 'family', 'v': coalesce(family, 'unknown')}}, {{'f': 'reason', 'v': coalesce(reason, 'unknown')}}]) AS p FROM clips WHERE decision IN ('approved', 'rejected')),
g AS (SELECT p.f AS feature, p.v AS value, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected FROM k GROUP BY 1, 2)
SELECT *, round(coalesce(approved / (SELECT count(*) FROM clips WHERE decision = 'approved'), 0), 3) AS approved_share FROM g""")
def outcome_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.outcome_shares(views.clips(spark, sf_dir), "decision", ["family", "reason"])


@query(f"WITH {CLIPS} SELECT round(avg(CAST(contains(text, '?') AS INTEGER)), 3) AS question, round(avg(CAST(contains(text, '!') AS INTEGER)), 3) AS exclamation, round(avg(CAST({yes_sql(3)} AS INTEGER)), 3) AS bridge FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM clips) WHERE decision = 'approved'")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.clips(spark, sf_dir).withColumns({"question": F.col("text").contains("?"), "exclamation": F.col("text").contains("!"), "bridge": every(3)})
    return review.flag_rates(rows, "decision", ["question", "exclamation", "bridge"])


@query(f"""WITH {CLIPS}, n AS (SELECT source_id, family, count(*) AS n FROM clips WHERE decision = 'approved' AND family IS NOT NULL GROUP BY ALL)
SELECT source_id, CAST(sum(n) AS BIGINT) AS total, string_agg(family || '=' || n, ',' ORDER BY family) AS counts FROM n GROUP BY source_id ORDER BY total DESC, source_id LIMIT 20""")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.nested_counts(views.clips(spark, sf_dir).filter("decision = 'approved'"), "source_id", "family", 20)
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("source_id", "total", F.array_join(entries, ",").alias("counts"))


@query("SELECT source, coalesce(lang, 'other') AS lang, count(*) AS observations, round(avg(n_chars % 50 / 10), 3) AS mean_ratio, max(n_chars % 50 / 10) AS max_ratio FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2")
def hook_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").withColumn("ratio", F.col("n_chars") % 50 / 10)
    return review.hook_priors(rows, "source", "lang", "ratio").select("source", "lang", "observations", "mean_ratio", "max_ratio")


@query("SELECT event_type, count(*) AS entries, count(*) FILTER (event_id % 3 = 0) AS videos, count(ts) AS dated, min(value) AS likes_min, max(value) AS likes_max FROM events GROUP BY event_type")
def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.feed_summary(views.table(spark, sf_dir, "events"), "event_type", F.col("event_id") % 3 == 0, "ts", "value")


@query("SELECT event_id, CASE WHEN max(value) OVER (PARTITION BY user_id) > 0 THEN round(value / max(value) OVER (PARTITION BY user_id), 4) ELSE 0.0 END AS relative FROM events WHERE user_id IS NOT NULL")
def relative_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.relative_levels(views.table(spark, sf_dir, "events").filter("user_id is not null"), ["user_id"], "value").select("event_id", "relative")


# Audits


@query(f"""WITH {intervals_sql("p", "purchase")}, pt AS (SELECT user_id, epoch_ms(ts) AS spot, event_id % 10 / 10 AS energy, event_id % 7 / 10 AS onset, event_id % 11 / 10 AS reaction FROM events WHERE event_type = 'click' AND ts IS NOT NULL),
m AS (SELECT event_id, avg(energy) AS e, max(energy) AS k, avg(onset) AS o, max(least(1.0, reaction)) AS r FROM p JOIN pt ON pt.user_id = p.user_id AND spot >= p.start - 60000 AND spot <= p."end" GROUP BY 1)
SELECT event_id, e IS NOT NULL AS available, CASE WHEN e IS NULL THEN 50.0 ELSE round(greatest(0.0, least(100.0, 35.0::DOUBLE + e * 25.0::DOUBLE + k * 20.0::DOUBLE + o * 10.0::DOUBLE + r * 10.0::DOUBLE)), 1) END AS signal, coalesce(r >= 0.58, true) AS review FROM p LEFT JOIN m USING (event_id)""")
def audio_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").filter("event_type = 'click' and ts is not null")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    points = e.select("user_id", at.alias("at"), *((F.col("event_id") % n / 10).alias(c) for c, n in (("energy", 10), ("onset", 7), ("reaction", 11))))
    out = review.audio_signals(views.intervals(spark, sf_dir, "purchase"), points, ["user_id"], "event_id", MINUTES, before=60_000)
    return out.select("event_id", "audio.available", "audio.signal", "audio.review")


CONTEXT = f"""{intervals_sql("p", "purchase")}, {intervals_sql("c", "click")},
a AS (SELECT p.event_id, p."end" - p.start AS duration, count(c.event_id) FILTER (c.start < p."end" AND c."end" > p.start) AS segments, count(c.event_id) FILTER (c.start < p."end" AND c."end" > p.start AND c.event_id % 3 = 0) AS questions,
  coalesce(bool_or(c.start < p.start AND p.start <= c."end"), false) AS starts_inside, coalesce(bool_or(c.start BETWEEN p."end" - 500 AND p."end" + 500), false) AS ends_near FROM p LEFT JOIN c USING (user_id) GROUP BY p.event_id, p.start, p."end")"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = (views.intervals(spark, sf_dir, kind) for kind in ("purchase", "click"))
    return review.clip_context(p, c, ["user_id"], "event_id", MINUTES, F.col("event_id") % 3 == 0, slack=500)


@query(f"WITH {CONTEXT} SELECT event_id, duration, segments, questions, starts_inside, ends_near FROM a")
def clip_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("event_id", "duration", "segments", "questions", "starts_inside", "ends_near")


@query(f"WITH {CONTEXT} SELECT count(*) AS clips, count(*) FILTER (questions > 0) AS with_question, count(*) FILTER (starts_inside) AS starting_inside, round(avg(duration), 3) AS mean_duration FROM a")
def clip_context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.clip_context_summary(_context(spark, sf_dir))


# Operators that had tests only


@query(f"""WITH {CLIPS}, s AS (SELECT source_id, start, "end" FROM clips WHERE doc_id % 40 = 0),
r AS (SELECT source_id, start, "end", row_number() OVER (PARTITION BY source_id ORDER BY start, "end") AS id FROM s)
SELECT x.source_id, x.id AS first_id, y.id AS last_id, x.start, y."end" FROM r x JOIN r y ON y.source_id = x.source_id AND y.id >= x.id AND y.start <= x.start + 600 AND y."end" BETWEEN x.start + 60 AND x.start + 600""")
def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.clips(spark, sf_dir).filter("doc_id % 40 = 0").select("source_id", "start", "end", F.lit("").alias("text"))
    s = s.withColumn("id", F.row_number().over(Window.partitionBy("source_id").orderBy("start", "end")).cast("long"))
    return clips.segment_ranges(s, "source_id", 60, 600).select("source_id", "first_id", "last_id", "start", "end")


@query(f"""WITH {CLIPS}, a AS (SELECT doc_id, max_by({{'s': s, 'e': e}}, {{'n': k, 's': s, 'e': e}}) AS a FROM (SELECT doc_id, unnest([0, 1]) AS k, start + unnest([0, 1]) * (doc_id % 3) AS s, "end" - unnest([0, 1]) * (doc_id % 5) AS e FROM clips WHERE doc_id % 2 = 0) WHERE e > s GROUP BY 1)
SELECT doc_id, start, "end", 'canonical' AS kind FROM clips UNION ALL SELECT doc_id, a.s, a.e, 'adjusted' FROM clips JOIN a USING (doc_id) WHERE a.s <> start OR a.e <> "end\"""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.clips(spark, sf_dir)
    changes = c.filter("doc_id % 2 = 0").withColumn("at", F.explode(F.array(F.lit(0), F.lit(1))))
    changes = changes.select("doc_id", "at", (F.col("start") + F.col("at") * (doc() % 3)).alias("start"), (F.col("end") - F.col("at") * (doc() % 5)).alias("end"))
    return clips.fingerprints(c.select("doc_id", "start", "end"), changes, "doc_id").select("doc_id", "start", "end", "kind")


@query("""WITH x AS (SELECT user_id, event_id % 100 / 10 AS time, 0.2 + event_id % 50 / 100 AS cx, 0.3 + event_id % 30 / 100 AS cy, 0.5 + event_id % 5 / 10 AS sure, CASE WHEN event_id % 97 = 0 THEN 2 ELSE 1 END AS faces, event_id FROM events WHERE user_id IS NOT NULL),
u AS (SELECT user_id, time, min_by(cx, event_id) AS cx, min_by(cy, event_id) AS cy, min_by(sure, event_id) AS sure, min_by(faces, event_id) AS faces FROM x WHERE time <= 8 GROUP BY 1, 2),
f AS (SELECT *, abs(cx - lag(cx) OVER w) AS dx, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) AS step FROM u WHERE sure >= 0.60 WINDOW w AS (PARTITION BY user_id ORDER BY time)),
g AS (SELECT user_id, count(*) AS n, round((max(time) - min(time)) / 8.0::DOUBLE, 3) AS coverage, round(coalesce(max(dx), 0.0), 3) AS largest_jump, count(*) FILTER (faces > 1) AS multiple, avg(step) AS a, max(step) AS b FROM f GROUP BY 1)
SELECT user_id, n, coverage, largest_jump, n >= 3 AND coverage >= 0.60 AND multiple = 0 AND largest_jump <= 0.30 AS sure, CASE WHEN n >= 2 THEN round(greatest(0.0, least(100.0, 35.0::DOUBLE + a * 220.0::DOUBLE + b * 80.0::DOUBLE)), 1) ELSE 50.0 END AS motion FROM g""")
def face_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = views.table(spark, sf_dir, "events").filter("user_id is not null").select("user_id", k, (k % 100 / 10).alias("time")).filter("time <= 8")
    first = e.groupBy("user_id", "time").agg(F.min("event_id").alias("event_id"))
    points = first.select(
        "user_id", "time", F.lit(0.0).alias("start"), F.lit(8.0).alias("end"), (0.2 + k % 50 / 100).alias("center_x"), (0.3 + k % 30 / 100).alias("center_y"), (0.5 + k % 5 / 10).alias("confidence"), F.when(k % 97 == 0, 2).otherwise(1).alias("face_count"),
    )
    return clips.tracking(points, ["user_id"]).select("user_id", "n", "coverage", "largest_jump", "sure", "motion")
