"""Candidate clips: edges, chapters, hooks, diversity, assembly, tracking and evaluation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType
from pyspark.sql.window import Window

from ..functions import text
from . import folds, greedy, intervals, similarity

ENDS = ("start", "end", "o_start", "o_end")


def _aliased(df: DataFrame, keys: list[str], prefix: str = "o") -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys))


# Edges


def snapped(value: Column, words: Column, edges: Column, tolerance: float) -> Column:
    """The nearest word boundary within the tolerance, else the nearest segment boundary, else the value; of equally near ones the first."""

    def near(bounds: Column) -> Column:
        best = F.array_min(F.transform(bounds, lambda b, i: F.struct(F.abs(b - value).alias("d"), i.alias("i"), b.alias("b"))))
        return F.when(best["d"] <= tolerance, best["b"])

    return F.coalesce(near(words), near(edges), value)


def expanded(start: Column, end: Column, least: float, limit: Column) -> Column:
    """An interval widened about its middle to ``least``, moved to lie within 0 and the limit (null: none)."""
    mid = (start + end) / 2.0
    a, b = mid - least / 2, mid + least / 2
    b = F.when(a < 0, b - a).otherwise(b)
    a = F.greatest(a, F.lit(0.0))
    over = F.greatest(b - limit, F.lit(0.0))
    a = F.when(limit.isNotNull() & (over > 0), F.greatest(a - over, F.lit(0.0))).otherwise(a)
    b = F.when(limit.isNotNull() & (over > 0), limit).otherwise(b)
    short = (end - start) < least
    return F.struct(F.when(short, a).otherwise(start).alias("start"), F.when(short, b).otherwise(end).alias("end"))


def to_scenes(clips: DataFrame, scenes: DataFrame, keys: list[str], id_col: str, longest: float, shortest: float, reach: float = 2.0, width: float = 60.0) -> DataFrame:
    """Edges moved outward to scene changes less than ``reach`` away, unless the clip gets too long; too short clips go.

    ``scenes`` has the keys and ``scene``; sources with fewer than two distinct scenes stay as they are.
    """
    counts = scenes.filter("scene >= 0").groupBy(*keys).agg(F.count_distinct("scene").alias("__n")).filter("__n >= 2")
    points = scenes.join(counts.select(*keys), keys, "left_semi").filter("scene >= 0").distinct()
    pairs = intervals.points_within(clips.select(*keys, id_col, (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"), F.col("start").alias("s"), F.col("end").alias("e")), points, keys, "scene", width)
    edges = pairs.groupBy(*keys, id_col).agg(
        F.max(F.when((F.col("scene") <= F.col("s")) & (F.col("s") - F.col("scene") < reach), F.col("scene"))).alias("__a"), F.min(F.when((F.col("scene") >= F.col("e")) & (F.col("scene") - F.col("e") < reach), F.col("scene"))).alias("__b")
    )
    out = clips.join(edges, [*keys, id_col], "left")
    a, b = F.coalesce("__a", "start"), F.coalesce("__b", "end")
    fine = (b > a) & (b - a <= longest)
    out = out.withColumns({"original_start": F.col("start"), "original_end": F.col("end"), "start": F.when(fine, a).otherwise(F.col("start")), "end": F.when(fine, b).otherwise(F.col("end"))})
    return out.filter(F.col("end") - F.col("start") >= shortest).drop("__a", "__b")


def trimmed_to_words(start: Column, end: Column, words: Column, shortest: float, pad: float = 0.12, most: float = 0.8) -> Column:
    """Edges drawn in to the first and last word of an array of (start, end), by at most ``most`` each; null words change nothing."""
    inside = F.filter(words, lambda w: (w["start"] >= start) & (w["start"] < w["end"]) & (w["end"] <= end))
    a = F.least(start + most, F.greatest(start, F.array_min(F.transform(inside, lambda w: w["start"])) - pad))
    b = F.greatest(end - most, F.least(end, F.array_max(F.transform(inside, lambda w: w["end"])) + pad))
    apply = (F.coalesce(F.size(inside), F.lit(0)) > 0) & (b - a >= max(shortest, 2.0)) & ((a - start >= 0.05) | (end - b >= 0.05))
    return F.struct(F.when(apply, F.round(a, 3)).otherwise(start).alias("start"), F.when(apply, F.round(b, 3)).otherwise(end).alias("end"), F.coalesce(apply, F.lit(False)).alias("applied"))


# Chapters, questions and hooks


def with_chapters(clips: DataFrame, chapters: DataFrame, qa: DataFrame, keys: list[str], id_col: str, width: float = 60.0) -> DataFrame:
    """Adds chapter_ids (by index), coherence and qa_bridge.

    One chapter is 100; several are 84 if contiguous without gaps, else 52, and 12 less
    if they cover under 0.55 of the clip; none is 35.  A bridge adds 8: a question and
    answer that the clip holds but for 2.5 s a side, and at least 0.72 of it.
    """
    met = intervals.overlap_join(clips.select(*keys, id_col, "start", "end"), _aliased(chapters, keys), keys, ENDS, width)
    common = intervals.intersection(*map(F.col, ENDS))
    order = Window.partitionBy(*keys, id_col).orderBy("o_index")
    met = met.withColumns({"common": common, "gap": F.col("o_start") - F.lag("o_end").over(order)})
    per = met.groupBy(*keys, id_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("o_index"))), lambda x: x["o_index"]).alias("chapter_ids"),
        F.count("*").alias("n"),
        (F.max("o_index") - F.min("o_index") + 1).alias("reach"),
        F.sum("common").alias("covered"),
        F.max(F.coalesce(F.col("gap") > 0.001, F.lit(False))).alias("gaps"),
    )
    q = intervals.overlap_join(clips.select(*keys, id_col, "start", "end"), _aliased(qa.select(*keys, "start", "end"), keys), keys, ENDS, width)
    held = (F.col("start") <= F.col("o_start") + 2.5) & (F.col("end") >= F.col("o_end") - 2.5) & (intervals.coverage_of_second(*map(F.col, ENDS)) >= 0.72)
    bridges = q.filter(held).select(*keys, id_col).distinct().withColumn("qa_bridge", F.lit(True))
    out = clips.join(per, [*keys, id_col], "left").join(bridges, [*keys, id_col], "left")
    several = F.when((F.col("n") == F.col("reach")) & ~F.col("gaps"), 84.0).otherwise(52.0) - F.when(F.col("covered") < F.greatest(F.lit(1.0), F.col("end") - F.col("start")) * 0.55, 12.0).otherwise(0.0)
    base = F.when(F.col("n").isNull(), 35.0).when(F.col("n") == 1, 100.0).otherwise(several)
    bridge = F.coalesce("qa_bridge", F.lit(False))
    return out.withColumns({"qa_bridge": bridge, "coherence": F.least(F.lit(100.0), base + F.when(bridge, 8.0).otherwise(0.0))}).drop("n", "reach", "covered", "gaps")


def with_nearest_hook(clips: DataFrame, hooks: DataFrame, keys: list[str], id_col: str, width: float = 60.0) -> DataFrame:
    """Adds hook (a struct) and hook_distance: an overlapping hook first, else the nearest by distance; ties by score.

    Overlaps come from the range join, neighbours from one sort of starts and ends; of
    hooks that end before the clip the latest end counts, of later ones the first start.
    """
    h = hooks.select(*keys, F.struct(*hooks.columns).alias("hook"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("score").alias("o_score"))
    slim = clips.select(*keys, id_col, "start", "end")
    over = intervals.overlap_join(slim, h, keys, ENDS, width).groupBy(*keys, id_col).agg(F.max_by("hook", "o_score").alias("hook_over"))
    ends = h.groupBy(*keys, "o_end").agg(F.max_by("hook", "o_score").alias("hook_e")).withColumnRenamed("o_end", "at_e")
    starts = h.groupBy(*keys, "o_start").agg(F.max_by("hook", "o_score").alias("hook_s")).withColumnRenamed("o_start", "at_s")
    one = intervals.nearest(slim, ends, keys, "start", "at_e").select(*keys, id_col, "start", "end", F.col("before.hook_e").alias("hb"), (F.col("start") - F.col("before.at_e")).alias("db"))
    touches = F.col("before.at_s") == F.col("end")  # a start right at the clip's end
    ha, da = F.when(touches, F.col("before.hook_s")).otherwise(F.col("after.hook_s")), F.when(touches, 0.0).otherwise(F.col("after.at_s") - F.col("end"))
    two = intervals.nearest(one, starts, keys, "end", "at_s").select(*keys, id_col, "hb", "db", ha.alias("ha"), da.alias("da"))
    out = clips.join(over, [*keys, id_col], "left").join(two, [*keys, id_col], "left")
    closer = F.when(F.col("db").isNotNull() & (F.col("da").isNull() | (F.col("db") < F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("hb.score") >= F.col("ha.score")))), F.struct(F.col("hb").alias("hook"), F.col("db").alias("d"))).otherwise(F.struct(F.col("ha").alias("hook"), F.col("da").alias("d")))
    return out.withColumns({"hook": F.coalesce("hook_over", closer["hook"]), "hook_distance": F.when(F.col("hook_over").isNotNull(), 0.0).otherwise(closer["d"])}).drop("hook_over", "hb", "db", "ha", "da")


def hook_candidates(segments: DataFrame, key: str, rules: tuple[tuple[str, str], ...], payoff: str, most: int = 12) -> DataFrame:
    """Scored openings of ``key, start, end, text, overlap_suspected``, without near repetitions, the best of each source.

    A payoff is sought in the next nine segments that start within 48 s.  A candidate
    goes if a better kept one overlaps it by over 2 s or shares 0.72 of its words.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    ahead = F.collect_list(F.struct("start", "end", "text")).over(w.rowsBetween(1, 9))
    rows = segments.filter("trim(coalesce(text, '')) <> ''").withColumns({"segment_index": F.row_number().over(w) - 1, "__ahead": ahead})
    near = F.filter("__ahead", lambda s: s["start"] - F.col("start") <= 48)
    # up to the first that reaches 32 s, and that one
    reach = F.array_position(F.transform(near, lambda s: s["end"] - F.col("start") >= 32), True)
    rows = rows.withColumn("__near", F.when(reach > 0, F.slice(near, F.lit(1), reach.cast("int"))).otherwise(near))
    t = text.folded(F.col("text"))
    found = F.lower(F.array_join(F.transform("__near", lambda s: s["text"]), " ")).rlike(payoff)
    family = text.first_rule(F.col("text"), rules, "other")
    score = (
        28.0 + F.when(family != "other", 16).otherwise(0) + F.when(text.is_question(F.col("text")), 10).otherwise(0) + F.when(t.rlike(r"\d"), 8).otherwise(0) + F.when(t.rlike(r"\b(?:but|however|while)\b"), 7).otherwise(0)
        + F.when(F.col("start") <= 35, 5).otherwise(0) - F.when(F.coalesce("overlap_suspected", F.lit(False)), 14).otherwise(0) + F.when(found, 14).otherwise(-8) - F.when(F.col("end") - F.col("start") < 1.2, 7).otherwise(0)
    )
    last = F.try_element_at(F.col("__near"), F.lit(-1))["end"]
    end = F.greatest(F.col("end"), F.least(F.col("start") + 58.0, F.coalesce(last, F.col("end"))))
    out = rows.select(key, "segment_index", F.greatest(F.lit(0.0), F.col("start") - 1.5).alias("start"), end.alias("end"), "text", family.alias("family"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).cast("double").alias("score"), found.alias("payoff"))
    out = out.withColumn("id", F.concat_ws("#", F.col(key).cast("string"), F.col("segment_index").cast("string")))
    slim = out.select(key, "id", "start", "end", text.tokens(F.col("text")).alias("t"))
    pairs = intervals.overlap_join(slim, _aliased(slim, [key]), [key], ENDS, 60.0).filter("id < o_id").filter(F.least("end", "o_end") - F.greatest("start", "o_start") > 2).select(F.col("id").alias("left"), F.col("o_id").alias("right"))
    scoped = slim.select("id", F.transform("t", lambda x: F.concat(F.col(key).cast("string"), F.lit("\x1f"), x)).alias("t"))
    classes = similarity.jaccard_classes(scoped, "id", "t")
    like = similarity.jaccard_pairs(scoped, "id", "t", 0.72)
    members = classes.select(F.col("id").alias("m"), "class_id")
    alike = members.filter("m <> class_id").select(F.col("class_id").alias("left"), F.col("m").alias("right"))
    # members of a class conflict as their class does; ties within it by its first member
    spread = like.join(members.select(F.col("class_id").alias("left"), F.col("m").alias("l")), "left").join(members.select(F.col("class_id").alias("right"), F.col("m").alias("r")), "right").select(F.col("l").alias("left"), F.col("r").alias("right"))
    rank = F.struct((-F.col("score")).alias("s"), F.when(F.col("payoff"), 0).otherwise(1).alias("p"), "segment_index", "id")
    kept = greedy.greedy_keep(out.withColumn("rank", rank), pairs.union(alike).union(spread), "id", "rank").filter("kept")
    best = Window.partitionBy(key).orderBy("rank")
    return kept.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most).drop("__n", "kept", "rank")


def bridged_chapters(segments: DataFrame, bridges: DataFrame, key: str, id_col: str, width: float = 60.0, **limits: float) -> DataFrame:
    """Chapters of ``folds.chapters`` that no bridge (``key, start, end``) is cut by, with ``has_qa_bridge`` where one overlaps.

    Which segments begin or end in a bridge, and which chapters have one, are range joins,
    so the fold reads two flags a row and holds no bridge.
    """
    slim = bridges.select(key, "start", "end")
    ends = segments.select(key, id_col, F.explode(F.array(F.struct(F.lit(True).alias("last"), F.col("end").alias("at")), F.struct(F.lit(False).alias("last"), F.col("start").alias("at")))).alias("p"))
    points = ends.select(F.col(key), id_col, "p.last", "p.at").filter("at is not null")
    held = intervals.points_within(slim, points, [key], "at", width).groupBy(key, id_col).agg(F.bool_or("last").alias("end_inside"), F.bool_or(~F.col("last")).alias("start_inside"))
    rows = segments.join(held, [key, id_col], "left")
    made = folds.fold(rows, key, ["start", id_col], folds.chapters(**limits), folds.CHAPTER).drop("has_qa_bridge")
    met = intervals.overlap_join(made.select(key, "index", "start", "end"), _aliased(slim, [key]), [key], ENDS, width)
    some = met.select(key, "index").distinct().withColumn("has_qa_bridge", F.lit(True))
    return made.join(some, [key, "index"], "left").withColumn("has_qa_bridge", F.coalesce("has_qa_bridge", F.lit(False)))


# Diversity and repetition


def distinct_context(a: Callable[[str], Column], b: Callable[[str], Column], names: tuple[str, ...]) -> Column:
    """Whether two rows differ in at least two of the named signals; null or empty ones don't count."""
    differ = (F.when(a(n).isNotNull() & b(n).isNotNull() & (a(n) != b(n)), 1).otherwise(0) for n in names)
    return sum(differ, F.lit(0)) >= 2


def diversity_pairs(rows: DataFrame, key: str, id_col: str, signals: tuple[str, ...], width: float = 60.0) -> DataFrame:
    """``left, right, penalty`` of pairs of one source that overlap in time or share a topic: overlap*100, text*80 (64 if the context differs), topic*48."""
    slim = rows.select(key, id_col, "start", "end", "topic", *signals, text.words(text.folded(F.col("text"))).alias("w"))
    other = _aliased(slim, [key])
    timed = intervals.overlap_join(slim, other, [key], ENDS, width).filter(F.col(id_col) < F.col(f"o_{id_col}"))
    topical = slim.filter("topic <> ''").join(other, (slim[key] == other[key]) & (slim["topic"] == other["o_topic"])).filter(F.col(id_col) < F.col(f"o_{id_col}")).drop(other[key])
    pairs = timed.unionByName(topical).dropDuplicates([key, id_col, f"o_{id_col}"])
    overlap = intervals.overlap_of_shorter(*map(F.col, ENDS))
    differs = distinct_context(F.col, lambda n: F.col(f"o_{n}"), signals) & (overlap <= 0.30)
    like = text.jaccard(F.array_distinct("w"), F.array_distinct("o_w")) * 80.0
    penalty = F.greatest(overlap * 100.0, F.when(differs, F.least(like, F.lit(64.0))).otherwise(like), text.topic_similarity(F.col("topic"), F.col("o_topic")) * 48.0)
    return pairs.select(F.col(id_col).alias("left"), F.col(f"o_{id_col}").alias("right"), penalty.alias("penalty"))


def diversified(rows: DataFrame, pairs: DataFrame, id_col: str, rank: str, score: str) -> DataFrame:
    """Rows kept where no better kept row has a penalty of 70 with them; from 35 on their score falls by 0.12 of it, truncated."""
    kept = greedy.greedy_keep(rows, pairs.filter("penalty >= 70").select("left", "right"), id_col, rank).filter("kept").drop("kept")
    ends = kept.select(F.col(id_col).alias("i"), F.col(rank).alias("r"))
    both = pairs.join(ends.select(F.col("i").alias("left"), F.col("r").alias("lr")), "left").join(ends.select(F.col("i").alias("right"), F.col("r").alias("rr")), "right")
    worse = both.select(F.when(F.col("lr") < F.col("rr"), F.col("right")).otherwise(F.col("left")).alias(id_col), "penalty").groupBy(id_col).agg(F.max("penalty").alias("penalty"))
    out = kept.join(worse, id_col, "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    return out.withColumn(score, F.when(F.col("penalty") >= 35, F.greatest(F.lit(0), F.floor(F.col(score) - F.col("penalty") * 0.12)).cast("double")).otherwise(F.col(score).cast("double")))


def diversified_in_time(rows: DataFrame, key: str, id_col: str, rank: str, score: str, signals: tuple[str, ...], width: float = 60.0) -> DataFrame:
    """``diversified`` over the ``diversity_pairs`` of rows without topics, whose pairs are those of a time, without making them all.

    A walk (``greedy.walked_in_time``) goes by times and needs no texts.  Kept rows overlap
    by less than 0.70, so few share a time; only their texts are read and compared, and the
    walk is repeated with the near ones found until there are none (``greedy.settled``).  A
    row that another walk finds near ones of is then held against all rows of its time, so
    variants of a text don't come back one at a time.
    """
    timed = F.col(key).isNotNull() & F.col(id_col).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    slim = greedy.cut(rows.filter(timed).select(key, id_col, F.col(rank).alias("r"), "start", "end", *signals))
    overlap = intervals.overlap_of_shorter(*map(F.col, ENDS))
    differs = distinct_context(F.col, lambda n: F.col(f"o_{n}"), signals) & F.coalesce(F.col("overlap") <= 0.30, F.lit(False))
    # of the walks so far: rows that were kept with near ones, words of kept rows, penalties
    named, texts, last = [], [], []

    def only(some: DataFrame, ids: DataFrame) -> DataFrame:
        return some.join(F.broadcast(ids) if ids.count() <= similarity.BROADCAST_IDS else ids, id_col, "left_semi")

    def paired(some: DataFrame, other: DataFrame) -> DataFrame:
        """Overlapping pairs of a row and a better one, with their overlap, and whether their contexts differ."""
        pairs = intervals.overlap_join(some, _aliased(other, [key]), [key], ENDS, width).filter("o_r < r").withColumn("overlap", overlap)
        return pairs.select(id_col, F.col(f"o_{id_col}").alias("other"), "overlap", differs.alias("differs"))

    def worded(ids: DataFrame) -> DataFrame:
        """``id, n, h``: the words of some rows, for which hashes stand, in a tenth of the room."""
        w = F.transform(F.array_distinct(text.words(text.folded(F.col("text")))), lambda x: F.xxhash64(x))
        return greedy.cut(only(rows.select(id_col, "text"), ids).select(id_col, w.alias("h")).withColumn("n", F.size("h")))

    def by_text(pairs: DataFrame, one: DataFrame, two: DataFrame, least: Column) -> DataFrame:
        """``id, other, penalty`` of those pairs whose texts could have a penalty of ``least``; words of both sides."""
        sized = pairs.join(one, id_col).join(two.select(F.col(id_col).alias("other"), F.col("n").alias("o_n")), "other")
        # a Jaccard is at most the smaller size over the greater one, so most pairs go before words are compared
        bound = F.when((F.col("n") > 0) & (F.col("o_n") > 0), F.least("n", "o_n") / F.greatest("n", "o_n") * 80.0).otherwise(0.0)
        both = sized.filter(bound >= least).join(two.select(F.col(id_col).alias("other"), F.col("h").alias("o_h")), "other")
        value = text.jaccard("h", "o_h") * 80.0
        return both.select(id_col, "other", F.when(F.col("differs"), F.least(value, F.lit(64.0))).otherwise(value).alias("penalty"))

    def walk(links: DataFrame | None) -> DataFrame:
        links = slim.select(id_col, F.col(id_col).alias("other")).limit(0) if links is None else links
        linked = slim.join(links.groupBy(id_col).agg(F.collect_set("other").alias("near")), id_col, "left")
        # of equal times the best row drops the others or goes with them, if it has no other conflict
        plain = F.col("near").isNull() & (F.col("end") > F.col("start"))
        first = linked.filter(plain).groupBy(key, "start", "end").agg(F.min(F.struct("r", F.col(id_col).alias("id"), "near")).alias("best"))
        first = first.select(key, F.col("best.id").alias(id_col), "best.r", "start", "end", "best.near")
        return greedy.walked_in_time(first.union(linked.filter(~plain).select(*first.columns)), key, id_col, "r", "near", width, 70.0)

    def near_texts(kept: DataFrame) -> DataFrame:
        here = greedy.cut(only(slim, kept))
        fresh = kept if not texts else greedy.cut(kept.join(texts[-1].select(id_col), id_col, "left_anti"))
        texts.append(worded(fresh) if not texts else greedy.cut(texts[-1].union(worded(fresh))))
        pairs = greedy.cut(paired(here, here))
        worst = pairs.groupBy(id_col).agg(F.max(F.col("overlap") * 100.0).alias("over"))
        found = greedy.cut(by_text(pairs.join(worst, id_col), texts[-1], texts[-1], F.coalesce("over", F.lit(0.0))))
        last.append(worst.toDF(id_col, "penalty").union(found.select(id_col, "penalty")).groupBy(id_col).agg(F.max("penalty").alias("penalty")))
        found = greedy.cut(found.filter("penalty >= 70").select(id_col, "other"))
        again = greedy.cut(found.select(F.col("other").alias(id_col)).distinct().join(named[-1], id_col, "left_semi")) if named else None
        if again is not None and again.limit(1).count():
            pairs = greedy.cut(paired(slim, only(slim, again)).filter(F.coalesce(F.col("overlap") * 100.0 < 70, F.lit(True))))
            words = worded(greedy.cut(pairs.select(id_col).distinct()))
            found = greedy.cut(found.union(by_text(pairs, words, only(texts[-1], again), F.lit(70.0)).filter("penalty >= 70").select(id_col, "other")).distinct())
        betters = found.select(F.col("other").alias(id_col))
        named.append(greedy.cut((named[-1].union(betters) if named else betters).distinct()))
        return found

    stays = greedy.settled(walk, near_texts)
    out = only(rows, stays).unionByName(rows.filter(~timed)).join(last[-1], id_col, "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    return out.withColumn(score, F.when(F.col("penalty") >= 35, F.greatest(F.lit(0), F.floor(F.col(score) - F.col("penalty") * 0.12)).cast("double")).otherwise(F.col(score).cast("double")))


def topics(rows: DataFrame, id_col: str, kind: Column, least: int = 4, most: int = 3) -> DataFrame:
    """``rows`` with ``topic``: ``kind:a-b-c`` of the most frequent words of ``least`` letters or more, of equally frequent ones the first of the alphabet."""
    said = rows.withColumn("__s", F.sort_array(text.words(text.folded(F.col("text")))))
    # a word's first place in the sorted words and the next one's tell how often it is said, without a row for each word
    first = F.filter(F.sequence(F.lit(0), F.size("__s")), lambda i: (i < F.size("__s")) & ((i == 0) | (F.get("__s", i) != F.get("__s", i - 1))))
    said = said.withColumn("__first", first)
    count = lambda at, k: F.coalesce(F.get("__first", k + 1), F.size("__s")) - at
    said = said.withColumn("__terms", F.transform("__first", lambda at, k: F.struct((-count(at, k)).alias("n"), F.get("__s", at).alias("term"))))
    of = F.filter("__terms", lambda t: (F.length(t["term"]) >= least) & ~t["term"].rlike(r"^\d+$"))
    said = said.withColumn("__top", F.slice(F.sort_array(of), 1, most)["term"])
    terms = F.when(F.size("__top") > 0, F.array_join(F.sort_array("__top"), "-"))
    return said.withColumn("topic", F.concat_ws(":", kind, terms)).drop("__s", "__first", "__terms", "__top")


def _text_penalty(key: str, signals: tuple[str, ...]) -> Column:
    """Of rows that overlap by 0.30 at most; a missing source counts as the same."""
    same = F.coalesce(F.col(key) == F.col(f"o_{key}"), F.lit(True))
    differs = same & distinct_context(F.col, lambda n: F.col(f"o_{n}"), signals)
    return F.when(differs, F.least(F.col("similarity") * 80.0, F.lit(64.0))).otherwise(F.col("similarity") * 80.0)


def _timed_pairs(rows: DataFrame, key: str, id_col: str, signals: tuple[str, ...], width: float, floor: float) -> DataFrame:
    """``left, right, penalty`` of one source's overlapping pairs by overlap and text, from ``floor`` on."""
    slim = rows.select(key, id_col, "start", "end", *signals, "w")
    pairs = intervals.overlap_join(slim, _aliased(slim, [key]), [key], ENDS, width).filter(F.col(id_col) < F.col(f"o_{id_col}"))
    overlap = intervals.overlap_of_shorter(*map(F.col, ENDS))
    like = text.jaccard("w", "o_w") * 80.0
    differs = distinct_context(F.col, lambda n: F.col(f"o_{n}"), signals) & (overlap <= 0.30)
    penalty = F.greatest(overlap * 100.0, F.when(differs, F.least(like, F.lit(64.0))).otherwise(like))
    return pairs.select(F.col(id_col).alias("left"), F.col(f"o_{id_col}").alias("right"), penalty.alias("penalty")).filter(F.col("penalty") >= floor)


def _topic_penalties(kept: DataFrame, key: str, id_col: str) -> DataFrame:
    """``id, penalty`` of 35 or more by the topics of better rows of the same source; a topic is asked for its best row only."""
    kind = F.substring_index("topic", ":", 1)
    terms = F.array_sort(F.array_distinct(F.filter(F.split(F.substring(F.col("topic"), F.length(kind) + 2, F.length("topic")), "-"), lambda t: t != "")))
    rows = kept.filter(F.col(key).isNotNull() & F.col("topic").contains(":")).select(key, F.col(id_col).alias("i"), "r", kind.alias("kind"), terms.alias("terms")).filter("size(terms) > 0")
    scoped = F.transform("terms", lambda t: F.concat(F.col(key).cast("string"), F.lit("\x1f"), t))
    rows = rows.select("i", "r", "kind", F.array_join(scoped, "\x1e").alias("ts"), scoped.alias("t"))
    nodes = greedy.cut(rows.groupBy("ts", "kind").agg(F.min("r").alias("m")))
    like = similarity.jaccard_pairs(rows.select("ts", "t").distinct(), "ts", "t", 35 / 48 - 0.15).select("left", "right", "similarity")
    both = like.union(like.select("right", "left", "similarity")).union(rows.select(F.col("ts").alias("left"), F.col("ts").alias("right"), F.lit(1.0).alias("similarity")).distinct())
    met = rows.join(both, F.col("ts") == F.col("left")).drop("ts").join(nodes.select(F.col("ts").alias("right"), F.col("kind").alias("o_kind"), "m"), "right").filter("m < r")
    bonus = F.when((F.col("kind") != "") & (F.col("kind") == F.col("o_kind")) & (F.col("similarity") >= 0.34), 0.15).otherwise(0.0)
    return met.select(F.col("i").alias(id_col), (F.least(F.lit(1.0), F.col("similarity") + bonus) * 48.0).alias("penalty")).filter("penalty >= 35")


def diversified_anywhere(rows: DataFrame, key: str, id_col: str, rank: str, score: str, signals: tuple[str, ...], width: float = 60.0) -> DataFrame:
    """Rows kept by a walk in rank order over the whole rule, with ``penalty`` and the score that it lowers.

    Text counts against every kept row, of whatever source and time: Jaccard*80 (64 at
    most if source is the same, context differs and overlap is 0.30 at most).  Overlap*100
    and topic*48 count within a source.  A row goes from 70 on; from 35 on its score falls
    by 0.12 of the penalty, truncated.  Penalties under 35 are given as 0.  Rows without
    source overlap none.

    Rows of equal words, source and signals have a place in common, and so have rows of a
    time: a place is asked for its best undecided row (``greedy.walked``), so neither
    copies nor a crowded time make pairs.  Near texts are looked for among rows that stay
    only, and the walk is repeated with what was found (``greedy.settled``), so near copies
    make none either.  Only rows that stay meet from 35 on.
    """
    w = F.array_distinct(text.words(text.folded(F.col("text"))))
    base = rows.select(key, id_col, F.col(rank).alias("r"), "start", "end", "topic", *signals, w.alias("w"))
    # hashes stand for words here, in a tenth of the room
    base = base.withColumn("w", F.array_sort(F.transform("w", lambda x: F.xxhash64(x))))
    base = greedy.cut(base.withColumn("fp", F.when(F.size("w") > 0, F.unhex(similarity.named("w")))))
    ids = base.filter("fp is not null").select(id_col, "fp")
    classes = ids.join(ids.groupBy("fp").agg(F.min(id_col).alias("class_id")), "fp").select(id_col, "class_id")
    scope = F.col(key).cast("string")
    times = F.when(scope.isNotNull() & (F.col("end") > F.col("start")), F.transform(intervals.bins(F.col("start"), F.col("end"), width), lambda b: F.concat(F.lit("time:"), scope, F.lit("\x1f"), b.cast("string"))))
    group = F.when(F.col("class_id").isNotNull(), F.xxhash64(F.to_json(F.struct("class_id", key, *signals))))
    places = F.concat(F.coalesce(F.transform(times, lambda t: F.xxhash64(t)), F.array().cast("array<long>")), F.array_compact(F.array("g")))
    slim = base.drop("w", "fp", "topic").join(classes, id_col, "left").withColumn("g", group).withColumn("places", places)
    slim = greedy.cut(slim.select(key, id_col, "r", "start", "end", "class_id", "g", *signals, "places"))
    groups = greedy.cut(slim.filter("g is not null").select("g", "class_id", key, *signals).distinct())
    same = groups.select(F.col("class_id").alias("left"), F.col("class_id").alias("right"), F.lit(1.0).alias("similarity")).distinct()

    def walk(links: DataFrame | None) -> DataFrame:
        both = same if links is None else greedy.cut(same.union(links))
        met = groups.join(both, F.col("class_id") == F.col("left")).drop("class_id").join(_aliased(groups, []), F.col("right") == F.col("o_class_id"))
        linked = met.filter(_text_penalty(key, signals) >= 70).select(F.col("g").alias("place"), F.col("o_g").alias("other"))

        def timed(kept: DataFrame, rest: DataFrame) -> DataFrame:
            """Rows that overlap a kept one by 0.70, or by over 0.30 with its words, which then count in full whatever the context."""
            named = lambda df: df.select(key, id_col, "r", "start", "end", "class_id")
            pairs = intervals.overlap_join(named(rest), _aliased(named(kept), [key]), [key], ENDS, width).filter("o_r < r")
            pairs = pairs.withColumn("overlap", intervals.overlap_of_shorter(*map(F.col, ENDS)))
            worded = pairs.filter("overlap > 0.30").join(both, (F.col("class_id") == F.col("left")) & (F.col("o_class_id") == F.col("right")), "left_semi")
            return pairs.filter(F.col("overlap") * 100.0 >= 70).select(id_col).union(worded.select(id_col))

        return greedy.walked(slim, id_col, "r", "places", linked, timed)

    one = slim.filter(F.col(id_col) == F.col("class_id")).select(id_col)
    sets = greedy.cut(base.join(one, id_col, "left_semi").select(F.col(id_col).alias("id"), "fp", F.size("w").alias("n"), F.col("w").alias("h")))
    all_parts = greedy.cut(similarity.parts_of(sets, 70 / 80))
    known: list[DataFrame] = []

    def near_texts(kept: DataFrame) -> DataFrame:
        """Classes of near words that no walk has known yet: those that two rows which stay have, and all that are near to the better one's.

        What a row drops would else come back one variant at a time.
        """
        own = slim.select(id_col, "class_id", "r").join(kept, id_col, "left_semi").filter("class_id is not null")
        ids = greedy.cut(own.groupBy(F.col("class_id").alias("id")).agg(F.min("r").alias("r")))
        few = sets.join(F.broadcast(ids.select("id")) if ids.count() <= similarity.BROADCAST_IDS else ids.select("id"), "id", "left_semi")
        found = greedy.cut(similarity.Near(greedy.cut(few), "id", 70 / 80, ids).among(ids, known[-1] if known else None))
        if found.limit(1).count():
            ends = found.join(ids.toDF("left", "lr"), "left").join(ids.toDF("right", "rr"), "right")
            better, worse = (F.when((F.col("lr") < F.col("rr")) == b, F.col("left")).otherwise(F.col("right")) for b in (True, False))
            ends = greedy.cut(ends.select(better.alias("better"), worse.alias("worse")))
            first = ends.select(F.col("better").alias("id")).distinct().join(ends.select(F.col("worse").alias("id")), "id", "left_anti")
            found = found.union(similarity.near_to(greedy.cut(first), all_parts, sets, 70 / 80))
        found = greedy.cut(found.union(found.select("right", "left", "similarity")).dropDuplicates(["left", "right"]))
        known.append(greedy.cut(known[-1].union(found)) if known else found)
        return found

    stays = greedy.settled(walk, near_texts)
    few = stays.count() <= similarity.BROADCAST_IDS
    only = lambda df: df.join(F.broadcast(stays) if few else stays, id_col, "left_semi")
    kept = greedy.cut(only(base).join(only(slim.select(id_col, "g", "class_id")), id_col))
    like = similarity.jaccard_pairs(kept, id_col, "w", 35 / 80).select("left", "right", "similarity")
    same = kept.filter("g is not null").select("class_id").distinct()
    same = same.join(kept.groupBy("class_id").agg(F.min(id_col).alias("left")), "class_id").select("left", F.col("left").alias("right"), F.lit(1.0).alias("similarity"))
    members = similarity.jaccard_classes(kept, id_col, "w").select(id_col, F.col("class_id").alias("c")).join(kept.select(id_col, key, "r", *signals), id_col)
    met = members.join(like.union(like.select("right", "left", "similarity")).union(same), F.col("c") == F.col("left")).drop("c").join(_aliased(members, []), F.col("right") == F.col("o_c")).filter("o_r < r")
    by_text = met.select(id_col, _text_penalty(key, signals).alias("penalty"))
    ranks = kept.select(F.col(id_col).alias("i"), "r")
    ends = _timed_pairs(kept, key, id_col, signals, width, 35.0).join(ranks.toDF("left", "lr"), "left").join(ranks.toDF("right", "rr"), "right")
    by_time = ends.select(F.when(F.col("lr") < F.col("rr"), F.col("right")).otherwise(F.col("left")).alias(id_col), "penalty")
    worst = by_text.union(by_time).union(_topic_penalties(kept, key, id_col)).groupBy(id_col).agg(F.max("penalty").alias("penalty")).filter("penalty >= 35")
    out = only(rows).join(worst, id_col, "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    return out.withColumn(score, F.when(F.col("penalty") >= 35, F.greatest(F.lit(0), F.floor(F.col(score) - F.col("penalty") * 0.12)).cast("double")).otherwise(F.col(score).cast("double")))


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, for pairs that passed cheaper bounds."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right)])


def plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9à-ÿ ]+", " "))


def text_similarity(left: Column, right: Column) -> Column:
    """The greater of the words' Jaccard and the sequence ratio; 0 where either is empty."""
    a, b = plain(left), plain(right)
    return F.when((a != "") & (b != ""), F.greatest(text.jaccard(F.array_distinct(text.words(a)), F.array_distinct(text.words(b))), sequence_ratio(a, b))).otherwise(0.0)


#: Lengths of character grams for texts whose matching blocks are few, fewer, or any number.
GRAMS = (8, 4, 2)


@F.pandas_udf(IntegerType())
def _seeds(texts: pd.Series) -> pd.Series:
    """How many blocks a match with this second text can have: one for each character that isn't too frequent, which from 200 characters on begin all blocks."""

    def seeds(value: str) -> int:
        often = len(value) // 100 + 1 if len(value) >= 200 else len(value)
        return sum(n for n in Counter(value).values() if n <= often)

    return texts.map(seeds)


@F.pandas_udf(ArrayType(StringType()))
def numbered_grams(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Character grams, each with how many of it came before."""

    def grams(value: str, q: int) -> list[str]:
        seen: Counter = Counter()
        out = []
        for i in range(len(value) - q + 1):
            gram = value[i : i + q]
            out.append(f"{gram}{seen[gram]}")
            seen[gram] += 1
        return out

    return pd.Series([grams(x, q) for x, q in zip(texts, sizes)])


def sequence_pairs(texts: DataFrame, scope: str, key: str, value: str, near: float = 0.90) -> DataFrame:
    """``first, second`` keys of one scope whose texts have a sequence ratio of ``near`` or more, the second one being matched against.

    ``value`` is a ``plain`` text; ``near`` is 0.9 at least.  The ratio of texts of T
    characters together has M = 0.45 T matched ones at least, in k blocks.  Neighbouring
    blocks have an unmatched character between them, so k is at most 0.1 T + 1; and as a
    block begins with a character that the second text hasn't too often, k is at most their
    number.  So M - (q - 1) k grams of q characters are common.  That is half of all the
    grams or more for q = 2, and for a greater q if the second text has as few such
    characters as ``_seeds`` is asked for: a join of sets at 0.5, in which grams are
    numbered, misses no pair, and only its pairs are matched.  (Grams are named by 64 bits:
    two of a text of n grams fall together with a chance of n * n / 2**65.)
    """
    if near < 0.90:
        raise ValueError("candidates are complete from a ratio of 0.9 on")
    rows = texts.select(F.col(scope).cast("string").alias("s"), F.col(key).alias("i"), F.col(value).alias("p")).filter("p <> ''")
    n = F.length("p")
    fits = lambda q: n >= 1.5715 * (q - 1) * (3 * F.col("seeds") - 2)
    rows = rows.withColumn("seeds", _seeds("p")).withColumn("q", F.when(fits(8), 8).when(fits(4), 4).otherwise(2))
    # lengths differ by a factor of 9/11 at most, so by one step of this scale
    rows = greedy.cut(rows.withColumn("step", F.floor(F.log(n.cast("double")) / math.log(11 / 9) + 1e-9)))
    wanted = rows.select("s", "q", F.explode(F.array(*(F.col("step") + d for d in (-1, 0, 1)))).alias("step")).distinct()
    found = None
    for q in GRAMS:
        asked = rows.join(wanted.filter(F.col("q") == q).select("s", "step"), ["s", "step"], "left_semi")
        grams = F.transform(numbered_grams(F.col("p"), F.lit(q)), lambda g: F.xxhash64("s", g))
        sets = greedy.cut(asked.select("i", grams.alias("g")))
        pairs = similarity.jaccard_pairs(sets, "i", "g", 0.5).select("left", "right")
        # texts of the same grams are one class of the join
        classes = similarity.jaccard_classes(sets, "i", "g").select("i", "class_id")
        pairs = pairs.union(pairs.select("right", "left")).union(classes.select("class_id", "class_id").distinct().toDF("left", "right"))
        both = pairs.join(classes.toDF("first", "left"), "left").join(classes.toDF("second", "right"), "right").filter("first <> second").select("first", "second")
        found = both.withColumn("q", F.lit(q)) if found is None else found.union(both.withColumn("q", F.lit(q)))
    found = found.join(rows.select(F.col("i").alias("first"), F.col("p").alias("a")), "first").join(rows.select(F.col("i").alias("second"), F.col("p").alias("b"), "q"), ["second", "q"])
    long_enough = 2 * F.least(F.length("a"), F.length("b")) >= near * (F.length("a") + F.length("b")) - 1e-9
    return found.filter(long_enough).filter(sequence_ratio(F.col("a"), F.col("b")) >= near).select("first", "second")


def _counted_grams(codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character grams of a text, in order, and how often each occurs."""
    many = max(len(codes) - q + 1, 0)
    out = np.zeros(many, np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + many]
    return np.unique(out, return_counts=True)


class Nearness:
    """Whether two texts have a sequence ratio of ``near``, where grams in common tell most of the others without a match.

    Texts of T characters together have M = near * T / 2 matched ones at least, in k
    blocks.  Neighbouring blocks have an unmatched character between them, so k is at most
    T - 2 M + 1; and each block but one at the very start holds a character that the
    second text hasn't too often, so k is at most one more than these.  So M - (q - 1) k
    grams of q characters are common, counted as often as they occur; equal hashes of
    different grams can only add to them.
    """

    def __init__(self, near: float):
        self.near, self.known = near, {}

    def facts(self, value: str) -> dict:
        if value not in self.known:
            codes = np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.uint64)
            often = len(value) // 100 + 1 if len(value) >= 200 else len(value)
            seeds = sum(n for n in Counter(value).values() if n <= often)
            self.known[value] = {"codes": codes, "seeds": seeds}
        return self.known[value]

    def grams(self, value: str, q: int) -> tuple[np.ndarray, np.ndarray]:
        facts = self.facts(value)
        if q not in facts:
            facts[q] = _counted_grams(facts["codes"], q)
        return facts[q]

    def common(self, a: str, b: str, q: int) -> int:
        (x, n), (y, m) = self.grams(a, q), self.grams(b, q)
        if not len(x) or not len(y):
            return 0
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return int(np.minimum(n, m[at])[y[at] == x].sum())

    def __call__(self, a: str, b: str) -> bool:
        total = len(a) + len(b)
        if 2 * min(len(a), len(b)) < self.near * total - 1e-9:
            return False
        matched = math.ceil(self.near * total / 2 - 1e-9)
        blocks = min(total - 2 * matched + 1, self.facts(b)["seeds"] + 1)
        for q in GRAMS:
            need = matched - (q - 1) * blocks
            if need > 0 and self.common(a, b, q) < need:
                return False
        return SequenceMatcher(None, a, b).ratio() >= self.near


def near_sequences(left: Column, right: Column, near: float) -> Column:
    """Whether the sequence ratio of ``left`` matched against ``right`` is ``near`` or more; not where one is null or empty."""

    @F.pandas_udf(BooleanType())
    def judged(a: pd.Series, b: pd.Series) -> pd.Series:
        is_near = Nearness(near)
        return pd.Series([bool(x and y and is_near(x, y)) for x, y in zip(a, b)], dtype=bool)

    return judged(left, right)


def text_links(kept: DataFrame, key: str, near: float = 0.90) -> DataFrame:
    """``place, other`` of the texts of two rows of one source, of which the worse one has the words or the sequence of the better one.

    ``kept`` has ``key, rank, words_at, text_at``, a ``plain`` text ``p`` and its distinct
    words ``t``.  All pairs of like size are made, so a source's rows are to be few.
    """
    rows = kept.filter("p <> ''").withColumns({"n": F.length("p"), "m": F.size("t")})

    def paired(size: str, ratio: float, *names: str) -> DataFrame:
        """Pairs of rows whose sizes are within ``ratio``, so at most one step of this scale apart."""
        step = F.floor(F.log(F.col(size).cast("double")) / -math.log(ratio) + 1e-9)
        x = rows.select(key, "rank", size, *names, F.explode(F.array(*(step + d for d in (-1, 0, 1)))).alias("step"))
        y = rows.select(key, *(F.col(c).alias(f"o_{c}") for c in ("rank", size, *names)), step.alias("step"))
        fits = F.least(size, f"o_{size}") >= ratio * F.greatest(size, f"o_{size}") - 1e-9
        return x.join(y, [key, "step"]).filter((F.col("o_rank") < F.col("rank")) & fits)

    by_words = paired("m", near, "words_at", "t").filter(text.jaccard("t", "o_t") >= near - 1e-12).select("words_at", "o_words_at")
    # the ratio is at most 2 * min / (sum of lengths)
    by_text = paired("n", near / (2 - near), "text_at", "p").filter(near_sequences(F.col("p"), F.col("o_p"), near)).select("text_at", "o_text_at")
    return by_words.union(by_words.select("o_words_at", "words_at")).union(by_text).toDF("place", "other").distinct()


def without_previous(clips: DataFrame, previous: DataFrame, keys: list[str], id_col: str, signals: tuple[str, ...], width: float = 60.0) -> DataFrame:
    """Clips that no earlier export repeats: overlap of 0.45, edges within 4 and 6 s, or text of 0.86 within 30 s; unless their context differs."""
    said = lambda df, *names: df.select(*keys, *names, "start", "end", *signals, plain(F.col("text")).alias("p")).withColumn("t", F.array_distinct(text.words(F.col("p"))))
    new = said(clips, id_col).withColumns({"__from": F.col("start") - 30.0, "__to": F.col("end") + 30.0})
    pairs = intervals.overlap_join(new, _aliased(said(previous), keys), keys, ("__from", "__to", "o_start", "o_end"), width, touch=True)
    overlap = intervals.overlap_of_shorter(*map(F.col, ENDS), least=1.0)
    edges = (F.abs(F.col("start") - F.col("o_start")) <= 4) & (F.abs(F.col("end") - F.col("o_end")) <= 6)
    same = ~distinct_context(F.col, lambda n: F.col(f"o_{n}"), signals)
    is_timed = (overlap >= 0.45) | edges
    timed = pairs.filter(same & is_timed).select(*keys, id_col)
    # what its time tells needs no text; the sequence ratio is at most 2*min/(sum of lengths), so lengths rule most pairs out
    asked = pairs.filter(same & ~F.coalesce(is_timed, F.lit(False)) & (F.abs(F.col("start") - F.col("o_start")) <= 30) & (F.col("p") != "") & (F.col("o_p") != ""))
    n, m = F.length("p"), F.length("o_p")
    worded = text.jaccard("t", "o_t") >= 0.86
    wordy = asked.filter(worded).select(*keys, id_col)
    wordy = wordy.union(asked.filter((2 * F.least(n, m) >= 0.86 * (n + m) - 1e-9) & near_sequences(F.col("p"), F.col("o_p"), 0.86)).select(*keys, id_col))
    return clips.join(timed.union(wordy).distinct(), [*keys, id_col], "left_anti")


def fingerprints(clips: DataFrame, adjustments: DataFrame, id_col: str) -> DataFrame:
    """The canonical interval of each clip and that of its last valid adjustment, distinct; adjustments have ``at, start, end``."""
    valid = adjustments.filter("start >= 0 and end > start").groupBy(id_col).agg(F.max_by(F.struct("start", "end"), F.struct("at", "start", "end")).alias("a"))
    own = F.struct("start", "end", F.lit("canonical").alias("kind"))
    other = F.when(F.col("a").isNotNull() & ((F.col("a.start") != F.col("start")) | (F.col("a.end") != F.col("end"))), F.struct(F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.lit("adjusted").alias("kind")))
    out = clips.filter("start >= 0 and end > start").join(valid, id_col, "left")
    return out.select(id_col, F.explode(F.filter(F.array(own, other), lambda x: x.isNotNull())).alias("f")).select(id_col, "f.*")


# Assembly


ASSEMBLED = "start double, end double, first_block int, last_block int, score double, text string"


def assembled(shortest: float = 20.0, target: float = 45.0, longest: float = 180.0, before: float = 2.5) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """For ``folds.fold`` over scored blocks (start, end, text, score, weak, unsafe, speaker): the best first.

    A weak opening takes the block before it if both are safe.  A clip grows to a natural
    end past the preferred length, and claims its blocks; one that stays too short
    claims none.
    """

    def step(found: Iterator[dict]) -> Iterator[dict]:
        rows = list(found)  # the best block comes first, so all of a source must be known
        used: set[int] = set()
        stopped = lambda r: r["text"].rstrip()[-1:] in tuple(".!?")
        for k in sorted(range(len(rows)), key=lambda i: -rows[i]["score"]):
            if k in used:
                continue
            first = last = k
            if rows[k]["weak"] and k and k - 1 not in used and not rows[k]["unsafe"] and not rows[k - 1]["unsafe"] and -0.25 <= rows[k]["start"] - rows[k - 1]["end"] <= before and rows[k]["end"] - rows[k - 1]["start"] <= longest:
                first = k - 1
            enough = lambda: rows[last]["end"] - rows[first]["start"] >= max(shortest, min(target, 30.0)) and stopped(rows[last])  # noqa: E731, B023
            while not enough() and last + 1 < len(rows):
                new = rows[last + 1]
                turn = (rows[last]["speaker"] or "") and (new["speaker"] or "") and rows[last]["speaker"] != new["speaker"]
                if turn or last + 1 in used or new["unsafe"] or new["end"] - rows[first]["start"] > longest:
                    break
                last += 1
                if rows[last]["end"] - rows[first]["start"] >= target:
                    break
            if rows[last]["end"] - rows[first]["start"] < shortest:
                continue
            used.update(range(first, last + 1))
            part = rows[first : last + 1]
            yield {"start": part[0]["start"], "end": min(part[-1]["end"], part[0]["start"] + longest), "first_block": first, "last_block": last, "score": sum(r["score"] for r in part) / len(part), "text": " ".join(r["text"] for r in part)}

    return step


def segment_ranges(segments: DataFrame, key: str, shortest: float, longest: float) -> DataFrame:
    """All runs of consecutive segments whose length lies within the bounds: start, end, first and last id, text.

    A run's candidates come from a frame of the following rows, cut at the longest length.
    """
    order = Window.partitionBy(key).orderBy("start").rangeBetween(0, int(longest))
    rows = segments.withColumn("run", F.collect_list(F.struct("id", "end", "text")).over(order))
    ends = rows.select(key, "id", "start", "run", F.posexplode("run").alias("n", "last"))
    fits = ends.filter((F.col("last.id") >= F.col("id")) & F.col("last.end").between(F.col("start") + shortest, F.col("start") + longest))
    said = F.array_join(F.transform(F.slice("run", F.lit(1), F.col("n") + 1), lambda x: x["text"]), " ")
    return fits.select(key, "start", F.col("last.end").alias("end"), F.col("id").alias("first_id"), F.col("last.id").alias("last_id"), said.alias("text"))


# Visual decisions


#: An example of a rule table: name, confidence, flags of which one must be set (none named: any), and which count of faces fits.
FORMAT_RULES = (("panel", 0.9, ("panel",), None), ("group", 0.6, (), "several"), ("close_up", 0.6, ("close_up",), "one"), ("single", 0.6, (), "one"))


def visual_format(
    flags: dict[str, Column], declared: Column, faces: Column, confidence: Column, rules: tuple = FORMAT_RULES,
    declared_confidence: float = 1.0, unknown_confidence: float = 0.0, least_confidence: float = 0.75,
) -> Column:
    """Format and confidence: a declared one, else the first rule that fits, else unknown.

    A rule with ``one`` face asks for one that is known with ``least_confidence`` (or
    without any statement), one with ``several`` for more than one.  A flag that is
    null or not given is not set.
    """
    named = lambda name, sure: F.struct(F.lit(name).alias("format"), F.lit(float(sure)).alias("confidence"))
    count = {"one": (faces == 1) & (confidence.isNull() | (confidence >= least_confidence)), "several": faces > 1, None: F.lit(True)}
    stated = F.struct(declared.alias("format"), F.lit(float(declared_confidence)).alias("confidence"))
    out = F.when(F.coalesce(declared, F.lit("")) != "", stated)
    for name, sure, needed, people in rules:
        is_set = F.lit(not needed)
        for flag in needed:
            is_set = is_set | F.coalesce(flags.get(flag, F.lit(False)), F.lit(False))
        out = out.when(is_set & F.coalesce(count[people], F.lit(False)), named(name, sure))
    return out.otherwise(named("unknown", unknown_confidence))


def layout(format_name: Column, tracking_sure: Column, faces: Column) -> Column:
    """How to reframe: only a single person whom tracking follows is cut out; all else keeps its composition."""
    alone = format_name.isin("talking_head", "close_selfie")
    return F.when(alone & tracking_sure & (faces == 1), "follow_speaker").when(alone, "center_review").when(format_name.isin("interview", "podcast", "split_screen"), "keep_all_speakers").when(format_name == "unknown", "keep_and_review").otherwise("keep_composition")


def tracking(points: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, confidence, jumps and motion of the face positions of each clip (``start, end, time, center_x, center_y, confidence, face_count``)."""
    rows = points.filter((F.col("time") >= F.col("start")) & (F.col("time") <= F.col("end")) & (F.col("confidence") >= 0.60))
    w = Window.partitionBy(*keys).orderBy("time")
    rows = rows.withColumns({"dx": F.abs(F.col("center_x") - F.lag("center_x").over(w)), "step": F.sqrt(F.pow(F.col("center_x") - F.lag("center_x").over(w), 2) + F.pow(F.col("center_y") - F.lag("center_y").over(w), 2))})
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round((F.max("time") - F.min("time")) / F.greatest(F.lit(0.1), F.max("end") - F.min("start")), 3).alias("coverage"), F.round(F.avg("confidence"), 3).alias("confidence"), F.round(F.coalesce(F.max("dx"), F.lit(0.0)), 3).alias("largest_jump"),
        F.count_if(F.col("face_count") > 1).alias("multiple"), F.avg("step").alias("mean_step"), F.max("step").alias("max_step"), F.round(F.avg("center_x"), 4).alias("center_x"), F.round(F.avg("center_y"), 4).alias("center_y"),
    )
    sure = (F.col("n") >= 3) & (F.col("coverage") >= 0.60) & (F.col("multiple") == 0) & (F.col("largest_jump") <= 0.30)
    motion = F.when(F.col("n") >= 2, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 35.0 + F.col("mean_step") * 220.0 + F.col("max_step") * 80.0)), 1)).otherwise(50.0)
    return out.withColumns({"sure": sure, "motion": motion})


# Evaluation


def evaluation(predictions: DataFrame, references: DataFrame, keys: list[str], threshold: float = 0.5, tolerance: float = 2.0, width: float = 60.0) -> DataFrame:
    """Greedy one-to-one matches of each source by IoU: precision, recall, boundary errors and the share within a tolerance.

    Both sides have the keys, ``id, start, end``.  Sources without references give no score.
    """
    p = predictions.filter("start >= 0 and end > start").select(*keys, F.concat_ws("/", *keys, "id").alias("p_id"), "start", "end")
    r = references.filter("start >= 0 and end > start").select(*keys, F.concat_ws("/", *keys, "id").alias("r_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    pairs = intervals.overlap_join(p, r, keys, ENDS, width).withColumn("iou", F.round(intervals.iou(*map(F.col, ENDS)), 6)).filter(F.col("iou") >= threshold)
    found = greedy.greedy_matches(pairs, "p_id", "r_id", [F.desc("iou"), "p_id", "r_id"])
    errors = found.withColumns({"a": F.round(F.abs(F.col("start") - F.col("o_start")), 3), "b": F.round(F.abs(F.col("end") - F.col("o_end")), 3)})
    hits = errors.groupBy(*keys).agg(F.count("*").alias("matched"), F.round(F.avg("a"), 3).alias("mean_start_error"), F.round(F.avg("b"), 3).alias("mean_end_error"), F.round(F.median("a"), 3).alias("median_start_error"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg(((F.col("a") <= tolerance) & (F.col("b") <= tolerance)).cast("int")), 6).alias("hit_rate"))
    out = r.groupBy(*keys).agg(F.count("*").alias("references")).join(p.groupBy(*keys).agg(F.count("*").alias("predictions")), keys, "left").join(hits, keys, "left").fillna(0, ["predictions", "matched"])
    return out.withColumns({"precision": F.coalesce(F.round(F.try_divide("matched", "predictions"), 6), F.lit(0.0)), "recall": F.round(F.col("matched") / F.col("references"), 6)})


def hits_at(predictions: DataFrame, references: DataFrame, keys: list[str], order: str, tops: tuple[int, ...] = (1, 3, 5, 10), width: float = 60.0) -> DataFrame:
    """Recall of the first k predictions of each source at IoU 0.5."""
    ranked = predictions.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    out = None
    for k in tops:
        part = evaluation(ranked.filter(F.col("__n") <= k).drop("__n"), references, keys, width=width).select(*keys, F.lit(k).alias("k"), "matched", "recall")
        out = part if out is None else out.union(part)
    return out
