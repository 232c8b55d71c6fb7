"""Exact top-k inner-product search with multi-resolution segment bounds.

Vectors are cut into segments.  With the means and the residual norms of its
segments, the product of two vectors is at most
``sum(len * mean_q * mean_v + rest_q * rest_v)``.  Bounds of 2, 4, 8 and 16
segments are tried in this order; only candidates whose bound reaches a query's
present k-th best score go on, and survivors get their exact integer product.
For unit vectors this is the lower bound on their distance.

Queries and candidates are dealt into bounded blocks; each pair of blocks is one
group, so a task's memory depends on the block sizes alone.  A first pass searches
one block of candidates for every query: its k-th best score there is a threshold
that all other blocks start from.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pin, read

LEVELS = (2, 4, 8, 16)
#: A score below all.
NOTHING = -(2**63)
#: Partitions of the pairs of blocks at most; beyond it a task has several pairs, one after the other.
PARTITIONS = 50_000
OUT = "query_id long, query_key long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, vec``: floor(scale * x) of each component as long.

    Rows without an id, and vectors that are null or hold a null or non-finite
    component, are left out.  Rows repeated in full count once.
    """
    v = F.col(f"`{vec_col}`")
    usable = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return (
        vectors.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull())
        .filter(usable)
        .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))
        .dropDuplicates(["vec_id", "vec"])
    )


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled means and residual norms of the segments, a row per vector."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    means, rest = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = x[:, a:b]
        m = part.mean(axis=1)
        means.append(m * math.sqrt(b - a))
        rest.append(np.sqrt(((part - m[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(rest, axis=1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: in doubles where these are exact, which is far faster."""
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if wide < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of this block for each query: query index, candidate index, score.

    ``least`` is a score for each query that k candidates of all blocks are known to
    reach; candidates below it may be left out.
    """
    none = np.empty(0, dtype=np.int64)
    out_q, out_c, out_s = [none], [none], [none]
    n, dims = c.shape
    levels = [s for i, s in enumerate(LEVELS) if dims and (i == 0 or s <= dims)]
    c_stats = [np.concatenate(_stats(c.astype(np.float64), s), axis=1) for s in levels]
    q_stats = [np.concatenate(_stats(q.astype(np.float64), s), axis=1) for s in levels]
    for a in range(0, len(q) if n else 0, rows):
        b = min(a + rows, len(q))
        own = q_ids[a:b, None] == c_ids[None, :]
        floor = least[a:b].astype(np.float64)
        alive, seeded = ~own, False
        for m, w in zip(q_stats, c_stats):
            cols = np.flatnonzero(alive.any(axis=0))
            bound = m[a:b] @ w[cols].T
            bound[~alive[:, cols]] = -np.inf
            if not seeded and len(cols) >= k:
                # the candidates of the best coarse bounds make the first threshold of this block
                first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                union = np.unique(first)
                seen = _products(q[a:b], c[cols[union]]).astype(np.float64)
                seen[own[:, cols[union]]] = -np.inf
                if len(union) >= k:
                    floor = np.maximum(floor, -np.partition(-seen, k - 1, axis=1)[:, k - 1])
                seeded = True
            slack = 1e-6 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
            alive[:, cols] &= bound >= (floor - slack)[:, None]
        cols = np.flatnonzero(alive.any(axis=0))
        scores = _products(q[a:b], c[cols])
        for i in range(b - a):
            at = np.flatnonzero(alive[i, cols])
            top = at[_best(scores[i, at], c_ids[cols[at]], k)]
            out_q.append(np.full(len(top), a + i))
            out_c.append(cols[top])
            out_s.append(scores[i, top])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _searched(left: DataFrame, right: DataFrame, k: int, groups: int) -> DataFrame:
    """The k best of each query in each pair of blocks; a group of blocks is dealt to a partition, which isn't coalesced."""

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")
        stack = lambda x: np.stack(x.to_numpy()).astype(np.int64)
        ids, keys, found = qs["q_vec_id"].to_numpy(), qs["q_query_key"].to_numpy(), cs["vec_id"].to_numpy()
        i, j, s = search_block(ids, stack(qs["q_vec"]), qs["q_least"].to_numpy(), found, stack(cs["vec"]), k)
        return pd.DataFrame({"query_id": ids[i], "query_key": keys[i], "vec_id": found[j], "score": s})

    # some partitions more than groups, as two groups may have one hash
    parts = max(1, min(3 * groups, PARTITIONS))
    # own names on the left: both sides can come from one table
    left = left.toDF(*(f"q_{c}" for c in left.columns))
    qs = left.repartition(parts, "q_dims", "q_qb", "q_cb").groupBy("q_dims", "q_qb", "q_cb")
    return qs.cogroup(right.repartition(parts, "dims", "qb", "cb").groupBy("dims", "qb", "cb")).applyInPandas(search, OUT)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, query_block: int = 16_384) -> DataFrame:
    """The k highest integer products of every query: ``query_id, rank, vec_id, score``.

    Both inputs have ``vec_id, vec`` as ``quantized`` makes them.  Ties go to the
    smaller vec_id.  A candidate with the query's own id is left out, and so are
    vectors of another length than the query's.  A query with fewer than k
    candidates gets what there is; empty inputs give no rows.  One id with several
    different vectors is one query (and one candidate) for each.  Products are
    exact while they fit a long.
    """
    n, m = candidates.count(), queries.count()
    c_blocks, q_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    spread = lambda count: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(count)).cast("int")
    across = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "vec", F.xxhash64("vec_id", "vec").alias("query_key"), F.size("vec").alias("dims"), spread(q_blocks).alias("qb"))
    right = candidates.select("vec_id", "vec", F.size("vec").alias("dims"), spread(c_blocks).alias("cb"))
    nothing = F.lit(NOTHING).cast("long").alias("least")
    if c_blocks == 1:
        parts = _searched(left.select("*", F.lit(0).alias("cb"), nothing), right.withColumn("qb", across(q_blocks)), k, q_blocks)
    else:
        first = pin(_searched(left.select("*", F.lit(0).alias("cb"), nothing), right.filter("cb = 0").withColumn("qb", across(q_blocks)), k, q_blocks))
        least = first.groupBy(F.col("query_id").alias("vec_id"), "query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        known = left.join(least, ["vec_id", "query_key"], "left").fillna({"least": NOTHING})
        rest = known.withColumn("cb", F.explode(F.sequence(F.lit(1), F.lit(c_blocks - 1))))
        parts = _searched(rest, right.filter("cb > 0").withColumn("qb", across(q_blocks)), k, q_blocks * (c_blocks - 1)).union(first)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pin(quantized(read(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.vec AS query_vec, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_vec ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
