"""Joins in which a key that many rows share is no task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, key: str, n: str = "n", least: int = 1000, share: int = 1000) -> list:
    """Keys with a count of ``least`` and a ``share``-th of all: ``share`` of them at most.  ``counts`` is read twice."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    return [r[0] for r in counts.filter(F.col(n) >= max(least, total // share)).select(key).collect()] if total >= least else []


def apart(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join to a table with unique keys: rows of ``hot`` keys stay in their tasks and meet a broadcast of these keys alone."""
    if not hot:
        return rows.join(table, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    met = rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key)
    return rows.filter(~is_hot).join(table.filter(~is_hot), key).unionByName(met)
