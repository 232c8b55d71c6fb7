"""Exact Jaccard joins of token sets: by equal parts for near sets, by prefixes for others."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import joins
from .greedy import cut

#: From this similarity on sets meet by equal parts, of some five tokens and more.
NEAR = 0.8
#: Sets of a candidate pair are picked by a broadcast of their ids up to this number.
BROADCAST_IDS = 200_000
#: Meetings of two sets for each part of a set, from which on all of them are not made at once.
FEW_PAIRS = 4


def named(tokens: Column | str) -> Column:
    """128 bits that stand for a set of tokens, of a sorted array."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    # the count keeps apart what joining could mix up
    return F.md5(F.concat_ws("\x1f", F.size(tokens).cast("string"), tokens.cast("array<string>")))


def _sets(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key, set, fp`` of rows with tokens: the sorted set, and 128 bits that stand for it."""
    rows = df.select(F.col(key), F.sort_array(F.array_distinct(tokens)).alias("set")).filter(F.size("set") > 0)
    return rows.withColumn("fp", F.unhex(named("set")))


def _self_joined(rows: DataFrame, counts: DataFrame, share: int = 1000, least: int = 1000, parts: int = 32) -> DataFrame:
    """Pairs of rows with a token in common; the rows of a token that many have (``token, c``) are dealt over tasks.

    Such a token holds a ``share``-th of all rows or more, so there are never more than
    ``share`` of them.
    """
    hot = joins.hot_keys(counts, "token", "c", least, share)
    is_hot = F.col("token").isin(hot) if hot else F.lit(False)
    x, y = (rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "pos", "n"))) for s in "xy")
    x = x.withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("id_x"), F.lit(parts)).cast("int")).otherwise(0))
    y = y.withColumn("part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return x.join(y, ["token", "part"]).drop("part")


class Parts:
    """How sets are cut into parts, such that two of Jaccard ``threshold`` or more have some equal ones.

    Sizes fall into levels, and near sets into one level or two neighbouring ones.  Two
    sets that meet at a level g, which is the greater of theirs, differ by d(g) tokens at
    most.  A token spoils the part that its hash puts it in, so of d + k parts k are
    equal; ``need`` is that k, more than one where parts are many.
    """

    def __init__(self, threshold: float, largest: int = 1 << 31):
        ends = [1]
        while ends[-1] <= largest / threshold:
            ends.append(math.floor(ends[-1] / threshold + 1e-9) + 1)
        self.ends = np.array(ends)
        differ = np.floor((1 - threshold) / (1 + threshold) * 2 * (self.ends[1:] - 1) + 1e-9).astype(np.int64)
        self.need = 1 + np.minimum(2, differ // 10)
        self.parts = differ + self.need

    def level(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, sizes, "right") - 1

    def signed(self, sets: pa.ListArray) -> pa.ListArray:
        """Signatures of sets of hashes: those of their parts at their own level, then those at the next one."""
        sizes = np.asarray(sets.value_lengths())
        hashes = sets.flatten().to_numpy().view(np.uint64)
        row, level = np.repeat(np.arange(len(sizes)), sizes), self.level(sizes)
        many = np.stack([self.parts[level], self.parts[level + 1]])
        start = np.r_[0, many.T.ravel().cumsum()]
        out = np.zeros(start[-1], np.uint64)
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        for up in (0, 1):
            first = start[up:-1:2]
            np.add.at(out, first[row] + (hashes % many[up][row].astype(np.uint64)).astype(np.int64), mixed)
            at = np.repeat(first, many[up]) + _counted(many[up])
            out[at] += (np.repeat(level + up, many[up]).astype(np.uint64) << np.uint64(40)) + _counted(many[up]).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        return pa.ListArray.from_arrays(pa.array(start[::2], pa.int32()), pa.array(out.view(np.int64)))


def _counted(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the numbers, one after the other."""
    return np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)


def written(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key, fp, n, h`` of rows with tokens, worked out once: 128 bits for the set, its size, and 64 bits for each token."""
    rows = df.select(F.col(key), F.sort_array(F.array_distinct(tokens)).alias("set"))
    return cut(rows.select(key, F.unhex(named("set")).alias("fp"), F.size("set").alias("n"), F.transform("set", lambda t: F.xxhash64(t)).alias("h"))).filter("n > 0")


def parts_of(classes: DataFrame, threshold: float) -> DataFrame:
    """``id, n, pos, token``: the parts of sets of ``id, n, h``, at their own level and the next."""
    parts = Parts(threshold)

    @F.arrow_udf("array<bigint>")
    def signed(sets: pa.Array) -> pa.Array:
        return parts.signed(sets)

    ends = F.array(*map(F.lit, parts.ends.tolist()))
    level = F.size(F.filter(ends, lambda e: e <= F.col("n"))) - 1
    classes = classes.select("id", "n", signed("h").alias("sigs")).withColumn("level", level)
    classes = classes.withColumn("own", F.get(F.array(*map(F.lit, parts.parts.tolist())), F.col("level")))
    heads = classes.select("id", "n", "level", F.col("own"), F.posexplode("sigs").alias("pos", "token"))
    return heads.select("id", "n", (F.col("level") * 2 + F.when(F.col("pos") < F.col("own"), 0).otherwise(1)).cast("int").alias("pos"), "token")


def _shared_parts(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """``id, n, pos, token, c`` of the parts that ``c`` classes of equal sets have, two or more; ``sets`` as ``written``."""
    classes = sets.groupBy("fp").agg(F.min(key).alias("id"), F.first("n").alias("n"), F.first("h").alias("h")).filter("id is not null")
    # most signatures are of one set only, and go before anything meets
    return cut(parts_of(classes, threshold).withColumn("c", F.count("*").over(Window.partitionBy("token"))).filter("c > 1"))


def _fitting(met: DataFrame, threshold: float) -> DataFrame:
    """``id_x, id_y`` of classes that meet at as many parts as near ones must have in common."""
    needs = F.array(*map(F.lit, Parts(threshold).need.tolist()))
    at = lambda s: F.shiftright(f"pos_{s}", 1) + F.col(f"pos_{s}") % 2
    group = F.greatest(F.shiftright("pos_x", 1), F.shiftright("pos_y", 1))
    fits = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * threshold - 1e-9
    met = met.filter(fits & (at("x") == group) & (at("y") == group)).select("id_x", "id_y", F.get(needs, group).alias("need"))
    return met.groupBy("id_x", "id_y").agg(F.count("*").alias("c"), F.min("need").alias("need")).filter("c >= need").select("id_x", "id_y")


def _meeting(heads: DataFrame, threshold: float) -> DataFrame:
    """``id_x, id_y``, id_x < id_y, of all classes that can be near."""
    return _fitting(_self_joined(heads, heads.select("token", "c").distinct()).filter("id_x < id_y"), threshold)


def _meeting_by_parts(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    return _meeting(_shared_parts(written(df, key, tokens), key, threshold), threshold)


def _meeting_best(heads: DataFrame, threshold: float) -> DataFrame:
    """``id_x, id_y`` of the classes that can be near to the best one, ``id_x``, of one of their parts; ``heads`` with ``r``."""
    best = cut(heads.groupBy("token").agg(F.min(F.struct("r", "id", "n", "pos")).alias("b"), F.count("*").alias("c")).filter("c > 1"))
    rows = heads.select("token", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "pos")))
    met = joins.apart(rows, best.select("token", *(F.col(f"b.{c}").alias(f"{c}_x") for c in ("id", "n", "pos"))), "token", joins.hot_keys(best, "token", "c"))
    return _fitting(met.filter("id_x <> id_y"), threshold)


def _near(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """``left, right, similarity`` of the pairs ``id_x, id_y`` whose sets are near; sets join only these pairs."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("id_x").alias("id")).union(pairs.select("id_y")).distinct())
    few = wanted.count() <= BROADCAST_IDS
    rows = sets.withColumnRenamed(key, "id").join(F.broadcast(wanted) if few else wanted, "id", "left_semi").groupBy("id").agg(F.first("h").alias("h"))
    hot = joins.hot_keys(cut(pairs.groupBy("id_x").agg(F.count("*").alias("n"))), "id_x")
    both = joins.apart(pairs.join(rows.toDF("id_y", "y"), "id_y"), rows.toDF("id_x", "x"), "id_x", hot)
    common = F.size(F.array_intersect("x", "y"))
    out = both.withColumn("similarity", common / (F.size("x") + F.size("y") - common))
    return out.filter(F.col("similarity") >= threshold - 1e-12).select(F.col("id_x").alias("left"), F.col("id_y").alias("right"), "similarity")


def near_to(some: DataFrame, parts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``left, right, similarity`` of the sets near to one of ``some`` (``id``), which is left; ``parts`` as ``parts_of`` all sets."""
    own = cut(parts.join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, "id", "left_semi").select("token", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "pos"))))
    other = parts.select("token", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "pos")))
    met = other.join(F.broadcast(own) if own.count() <= BROADCAST_IDS else own, "token").filter("id_x <> id_y")
    return _near(_fitting(met, threshold), sets, "id", threshold)


class Near:
    """Near pairs of sets, asked for again and again among fewer of them.

    ``sets`` as ``written``.  Classes of equal sets go by their smallest key; ``ranks`` has
    the unique rank ``r`` of each class ``id``, smaller is better.
    """

    def __init__(self, sets: DataFrame, key: str, threshold: float, ranks: DataFrame):
        self.sets, self.key, self.threshold = sets, key, threshold
        self.heads = cut(_shared_parts(sets, key, threshold).drop("c").join(ranks, "id"))

    def among(self, kept: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """``left, right, similarity`` of near pairs of ``kept`` classes (``id``): all, or if these could be many, those of a part's best class; none only if none are near, or all are ``known`` (``left, right``).

        Variants of one text are near in nearly all pairs, which so are not made: once the
        best of them drops the others, few are left to be paired.
        """
        def new(pairs: DataFrame) -> DataFrame:
            pairs = pairs if known is None else pairs.join(known.toDF("id_x", "id_y", *known.columns[2:]), ["id_x", "id_y"], "left_anti")
            return _near(pairs, self.sets, self.key, self.threshold)

        some = self.heads.join(kept.select("id"), "id", "left_semi")
        some = cut(some.withColumn("c", F.count("*").over(Window.partitionBy("token"))).filter("c > 1"))
        n = some.select(F.sum(F.col("c") - 1) / 2, F.count("*")).first()
        if n[1] and n[0] > FEW_PAIRS * n[1]:
            found = cut(new(_meeting_best(some, self.threshold)))
            if found.limit(1).count():
                return found
        return new(_meeting(some, self.threshold))


def _meeting_by_prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """``id_x, id_y`` of classes that share a rare token and have room for as many common ones as near ones must have."""
    long = classes.select("id", F.explode("set").alias("token"))
    rarity = cut(long.groupBy("token").agg(F.count("*").alias("n")))
    counted = joins.apart(long, rarity, "token", joins.hot_keys(rarity, "token"))
    ranked = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("o"))
    size = F.size("o")
    prefix = (size - F.ceil(size * threshold - 1e-9) + 1).cast("int")
    heads = cut(ranked.select("id", size.alias("n"), F.posexplode(F.slice("o.token", F.lit(1), prefix)).alias("pos", "token")))
    fits = (F.col("id_x") < F.col("id_y")) & (F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * threshold - 1e-9)
    # the tokens after a first common one bound what both can have in common
    room = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    need = F.ceil(threshold / (1 + threshold) * (F.col("n_x") + F.col("n_y")) - 1e-9)
    counts = cut(heads.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > 1))
    met = _self_joined(heads.join(counts.select("token"), "token", "left_semi"), counts).filter(fits)
    met = met.groupBy("id_x", "id_y").agg(F.min(F.struct("pos_x", room.alias("room"), need.alias("need"))).alias("first"))
    return met.filter("first.room >= first.need").select("id_x", "id_y")


def jaccard_pairs(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """``left, right, similarity`` of all distinct rows of similarity ``threshold`` or more, left < right.

    From ``NEAR`` on sets are cut into more parts than near ones have different tokens,
    and only those with equal parts meet (``Parts``).  Below, tokens are ordered by how rare
    they are in the table: two sets that similar share one of the first
    n - ceil(threshold * n) + 1 of them, so only these meet, and what follows the first one
    they share must leave room enough.  Then the full sets decide.  Rows with equal sets are
    joined as one class: ``jaccard_classes`` lists them, and their pairs are not expanded
    here.  Empty sets match nothing.  Keys are unique.
    """
    if threshold >= NEAR:
        sets = written(df, key, tokens)
        return _near(_meeting(_shared_parts(sets, key, threshold), threshold), sets, key, threshold)
    classes = _sets(df, key, tokens).groupBy("fp").agg(F.min(key).alias("id"), F.first("set").alias("set")).select("id", "set")
    # sets join only the pairs that are left
    both = _meeting_by_prefixes(classes, threshold).join(classes.toDF("id_x", "x"), "id_x").join(classes.toDF("id_y", "y"), "id_y")
    common = F.size(F.array_intersect("x", "y"))
    out = both.withColumn("similarity", common / (F.size("x") + F.size("y") - common))
    return out.filter(F.col("similarity") >= threshold - 1e-12).select(F.col("id_x").alias("left"), F.col("id_y").alias("right"), "similarity")


def jaccard_classes(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Each row with the smallest key of the rows that have the same, non-empty token set."""
    rows = _sets(df, key, tokens)
    return rows.join(rows.groupBy("fp").agg(F.min(key).alias("class_id")), "fp").select(key, "class_id", "set")
