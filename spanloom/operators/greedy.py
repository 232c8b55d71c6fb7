"""Greedy selections as parallel rounds that give the sequential result.

A row is kept unless a kept row of better rank conflicts with it.  In every round the
undecided rows with no undecided better neighbour are kept and their neighbours dropped.
Rounds are few because chains of conflicts are short.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, StructField, StructType
from pyspark.sql.window import Window

from . import intervals

#: A span of time that one task walks, in widths of ``walked_in_time``.
SPAN = 10
#: What a span says of a row: it goes, it depends on what isn't decided, nothing here keeps it from staying.
GOES, OPEN, STAYS = 0, 1, 2


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder for tables between jobs; a local session without one gets one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spanloom-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def greedy_keep(rows: DataFrame, conflicts: DataFrame, key: str, rank: str) -> DataFrame:
    """``rows`` with ``kept``.

    ``rank`` is unique, smaller is better; ``conflicts`` has ``left, right`` keys in any
    order.  The same as a walk in rank order that keeps what conflicts with nothing kept.
    """
    ranks = rows.select(F.col(key).alias("k"), F.col(rank).alias("r"))
    ends = conflicts.join(ranks.select(F.col("k").alias("left"), F.col("r").alias("lr")), "left").join(ranks.select(F.col("k").alias("right"), F.col("r").alias("rr")), "right")
    edges = cut(ends.select(F.when(F.col("lr") < F.col("rr"), F.col("left")).otherwise(F.col("right")).alias("better"), F.when(F.col("lr") < F.col("rr"), F.col("right")).otherwise(F.col("left")).alias("worse")).filter("better <> worse").distinct())
    dropped = None
    while edges.limit(1).count():
        blocked = edges.select(F.col("worse").alias("better")).distinct()
        free = edges.select("better").distinct().join(blocked, "better", "left_anti")
        now = cut(edges.join(free, "better", "left_semi").select("worse").distinct())
        dropped = now if dropped is None else cut(dropped.union(now))
        decided = free.select(F.col("better").alias("worse")).union(now)
        edges = cut(edges.join(decided, "worse", "left_anti").join(decided.select(F.col("worse").alias("better")), "better", "left_anti"))
    if dropped is None:
        return rows.withColumn("kept", F.lit(True))
    return rows.join(dropped.select(F.col("worse").alias(key), F.lit(False).alias("__out")), key, "left").withColumn("kept", F.col("__out").isNull()).drop("__out")


def walked(rows: DataFrame, key: str, rank: str, places: str, linked: DataFrame, met: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The ``key`` of rows that a walk in rank order keeps, where conflicts are known by places and not by pairs of rows.

    ``rank`` is unique, smaller is better; ``places`` is an array of strings.  ``linked``
    has ``place, other``: no row at ``place`` stays beside a better kept one at ``other``,
    which can be the same.  ``met(kept, rows)`` gives the ``key`` of those rows that conflict with
    a better kept one in any other way; two such rows have a place in common.

    In each round a place is asked for its best undecided row.  A row stays once nothing
    better is undecided at its places and those they are linked to, and drops its
    conflicts.  So neither copies nor a crowded time make pairs, and a round reads only
    undecided rows; their best one is always decided, and usually one for each place is.
    """
    rest, kept = cut(rows), []
    linked = cut(linked.distinct())
    while rest.limit(1).count():
        asked = rest.select(key, F.col(rank).alias("r"), F.explode(places).alias("place"))
        best = asked.groupBy("place").agg(F.min("r").alias("best"))
        low = best.union(linked.join(best.select(F.col("place").alias("other"), "best"), "other").select("place", "best"))
        low = low.groupBy("place").agg(F.min("best").alias("low"))
        waiting = asked.join(low, "place").filter("low < r").select(key).distinct()
        free = cut(rest.join(waiting, key, "left_anti"))
        kept.append(free.select(key))
        taken = free.select(F.explode(places).alias("other"), F.col(rank).alias("by")).join(linked, "other").groupBy("place").agg(F.min("by").alias("by"))
        gone = asked.join(taken, "place").filter("by < r").select(key)
        gone = gone.union(met(free, rest).select(key)).union(free.select(key)).distinct()
        rest = cut(rest.join(gone, key, "left_anti"))
    out = rows.select(key).limit(0)
    for now in kept:
        out = out.union(now)
    return out


class _Span:
    """The walk over one key's span of time, whose rows come in rank order, a batch after the other.

    Holds the times of the rows that stay or are open.  A row that only this span has
    stays or goes here and now, unless its conflict is with an open row; then it is open.
    A row that other spans have too is open until all of them have been asked.
    """

    def __init__(self, most: float):
        self.most = most
        self.times: dict[int, tuple[list, list]] = {STAYS: ([], []), OPEN: ([], [])}
        self.ids: dict[int, set] = {STAYS: set(), OPEN: set()}

    def met(self, start, end, other_start, other_end) -> np.ndarray:
        """Whether the shorter one of two intervals has a share of ``most`` percent or more in the other."""
        common = np.minimum(end, other_end) - np.maximum(start, other_start)
        shorter = np.minimum(end - start, other_end - other_start)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (shorter > 0) & (common > 0) & (common / shorter * 100.0 >= self.most)

    def known(self, state: int, start: np.ndarray, end: np.ndarray, block: int = 1 << 21) -> np.ndarray:
        """Which of the intervals meet one of a state that came in an earlier batch."""
        others = np.unique(np.array(self.times[state]), axis=1)
        out = np.zeros(len(start), bool)
        step = max(1, block // max(1, len(start)))
        for i in range(0, others.shape[1], step):
            out |= self.met(start[:, None], end[:, None], *others[:, None, i : i + step]).any(axis=1)
        return out

    def walk(self, ids: list, start: np.ndarray, end: np.ndarray, near: list, alone: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """What becomes of each row; ``fixed`` ones are known to stay."""
        said = np.full(len(ids), GOES, np.int8)
        there = ~self.known(STAYS, start, end) | fixed
        left = np.flatnonzero(there)
        unsure = np.zeros(len(ids), bool)
        unsure[left] = self.known(OPEN, start[left], end[left])
        while len(left):
            i, left = left[0], left[1:]
            if near[i] and not fixed[i]:
                if not self.ids[STAYS].isdisjoint(near[i]):
                    continue
                unsure[i] |= not self.ids[OPEN].isdisjoint(near[i])
            said[i] = STAYS if fixed[i] or not unsure[i] else OPEN
            state = said[i] if alone[i] or fixed[i] else OPEN
            for held, value in zip(self.times[state], (start[i], end[i])):
                held.append(value)
            self.ids[state].add(ids[i])
            hit = self.met(start[left], end[left], start[i], end[i])
            if state == STAYS:
                left = left[~hit | fixed[left]]
            else:
                unsure[left[hit]] = True
        return said


def walked_in_time(rows: DataFrame, key: str, id_col: str, rank: str, near: str, width: float, most: float) -> DataFrame:
    """The ``id_col`` of rows that a walk in rank order keeps, where rows of a key conflict by time, or are named as such.

    ``rank`` is unique, smaller is better.  A row goes if a better kept one has ``most``
    percent or more of the shorter interval in common with it, or is in its array ``near``,
    whose rows overlap it.  ``width`` is near the usual length of an interval.

    Time is cut into spans, and a task walks a span of a key as Spark sorts it, with
    numbers only of what stays or is open.  What the ends of spans leave open is walked
    again with other ends, so rounds are few, and rows that are decided are read once.
    """
    rest = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(rank).alias("r"), F.col("start").cast("double"), F.col("end").cast("double"), F.col(near).alias("near"), F.lit(False).alias("fixed"))
    span, kept, turn = SPAN * width, [], 0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = walk = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, spans = batch.column("key"), batch.column("span")
            differ = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(spans[1:], spans[:-1])).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(differ) + 1).tolist(), batch.num_rows]
            start, end = (batch.column(n).to_numpy() for n in ("start", "end"))
            alone, fixed = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("alone", "fixed"))
            ids, near_ids = batch.column("id").to_pylist(), batch.column("near").to_pylist()
            said = []
            for a, b in zip(ends, ends[1:]):
                if (at := (keys[a].as_py(), spans[a].as_py())) != last:
                    last, walk = at, _Span(most)
                said.append(walk.walk(ids[a:b], start[a:b], end[a:b], near_ids[a:b], alone[a:b], fixed[a:b]))
            said = np.concatenate(said)
            out = batch.append_column("said", pa.array(said, pa.int8()))
            # what goes is told only where another span could think otherwise
            yield out.filter(pa.array(~fixed & ((said != GOES) | ~alone)))

    while True:
        spans = intervals.bins(F.col("start") + turn % 2 * span / 2, F.col("end") + turn % 2 * span / 2, span)
        listed = rest.withColumn("spans", spans).select("*", (F.size("spans") == 1).alias("alone"), F.explode("spans").alias("span")).drop("spans")
        # numbers are small, but a walk takes its time: the first round is not put together into few tasks
        many = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if not turn else []
        dealt = listed.repartition(*many, "key", "span").sortWithinPartitions("key", "span", "r")
        told = dealt.mapInArrow(judge, StructType([*dealt.schema.fields, StructField("said", ByteType())]))
        told = told.groupBy("id").agg(F.min("said").alias("said"), F.first(F.struct("key", "r", "start", "end", "near", "alone")).alias("row"))
        told = cut(told.filter(F.col("said") > GOES).select("id", "said", "row.*"))
        kept.append(told.filter(F.col("said") == STAYS).select("id"))
        if not told.filter(F.col("said") == OPEN).limit(1).count():
            break
        # a row that several spans had has not yet dropped its conflicts
        rest = told.filter((F.col("said") == OPEN) | ~F.col("alone")).select("key", "id", "r", "start", "end", "near", (F.col("said") == STAYS).alias("fixed"))
        turn += 1
    out = kept[0]
    for now in kept[1:]:
        out = out.union(now)
    return out.select(F.col("id").alias(id_col))


def settled(walk: Callable[[DataFrame | None], DataFrame], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a walk keeps under all its conflicts, of which some are asked for among kept rows only.

    ``walk(links)`` keeps rows under the conflicts that it knows by itself and under
    ``links``, none at first; ``near(kept)`` gives those links that two of the kept rows
    break.  What a walk under some of the conflicts keeps is what it keeps under all of
    them, once no two kept rows are in conflict: a row that is out conflicts with a better
    kept one, and so does it under all.  Each walk knows new links, so there is an end;
    where few rows stay, as those of a time, near texts of the others are never paired.
    """
    links = None
    while True:
        kept = cut(walk(links))
        found = cut(near(kept))
        if not found.limit(1).count():
            return kept
        links = found if links is None else links.union(found)


def greedy_matches(pairs: DataFrame, left: str, right: str, order: list) -> DataFrame:
    """Pairs taken in order where neither side has been used: in each round those that are the first of both their sides."""
    w = lambda side: Window.partitionBy(side).orderBy(*order)
    rest, taken = cut(pairs), None
    while rest.limit(1).count():
        first = rest.withColumns({"__l": F.row_number().over(w(left)), "__r": F.row_number().over(w(right))})
        now = cut(first.filter("__l = 1 and __r = 1").drop("__l", "__r"))
        taken = now if taken is None else taken.union(now)
        rest = cut(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti").select(*pairs.columns))
    return pairs.limit(0) if taken is None else taken


def capped_pick(rows: DataFrame, rank: str, source: str, family: str, most: int = 50, per_source: int = 8, per_family: int = 14, target: int = 39) -> DataFrame:
    """Selected rows, in rank order under caps for sources and families; families' overflow comes back if the target is missed.

    ``rank`` is unique: a number, or a struct whose fields are compared one after the other.

    The walk needs the next ``most`` rows of what isn't full yet, as often as a source or
    a family gets full: at most ``most / per_source + most / per_family`` times, and in
    the second pass ``most / per_source`` times.  So Spark finds each such batch by a top-k
    over all rows, and the driver never sees more than ``most`` rows at once, however many
    sources and families there are.
    """
    kind = rows.schema[rank].dataType

    def literal(value) -> Column:
        """A rank as it was collected, which can be a struct."""
        return (F.struct(*(F.lit(v).alias(n) for n, v in zip(kind.names, value))) if isinstance(value, tuple) else F.lit(value)).cast(kind)

    slim = cut(rows.select(F.col(rank).alias("rank"), F.col(source).alias("source"), F.col(family).alias("family")))
    chosen: list = []
    counts: tuple[dict, dict] = {}, {}

    def full(which: int, cap: int) -> list:
        return [name for name, n in counts[which].items() if n >= cap]

    def among(column: str, names: list) -> Column:
        known = [n for n in names if n is not None]
        found = F.coalesce(F.col(column).isin(known), F.lit(False)) if known else F.lit(False)
        return found | F.col(column).isNull() if None in names else found

    def walk(pool: DataFrame, families_capped: bool) -> None:
        last = None
        while len(chosen) < most:
            rest = pool.filter(~among("source", full(0, per_source)))
            rest = rest.filter(~among("family", full(1, per_family))) if families_capped else rest
            batch = (rest if last is None else rest.filter(F.col("rank") > literal(last))).orderBy("rank").limit(most).collect()
            if not batch:
                return
            for row in batch:
                last = row["rank"]
                chosen.append(last)
                for group, name in zip(counts, (row["source"], row["family"])):
                    group[name] = group.get(name, 0) + 1
                source_full = counts[0][row["source"]] >= per_source
                family_full = families_capped and counts[1][row["family"]] >= per_family
                if source_full or family_full or len(chosen) >= most:
                    break

    walk(slim, True)
    if len(chosen) < min(target, most):
        over = full(1, per_family)
        walk(slim.filter(among("family", over) & ~F.col("rank").isin([literal(v) for v in chosen])), False)
    return rows.filter(F.col(rank).isin([literal(v) for v in chosen])) if chosen else rows.limit(0)
