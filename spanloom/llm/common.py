"""Shared helpers: where intermediate tables live, and how they are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Parquet tables of one operator call, in the shared folder.

    ``table`` writes a DataFrame and returns it as read back, so lineage ends
    there and a lost executor costs a re-read.  ``close`` removes the folder;
    what a returned DataFrame still needs goes through ``pin`` instead.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        self.drop(self.path)


def pin(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` or a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def emitted(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], tuple[Column, Column | None]],
    kind: str,
    between: Callable[[Column, Column], Column] | None = None,
    last: Callable[[Column], Column] | None = None,
    block: int = 256,
) -> Column:
    """What a fold over ``items`` gives out, as one array of type ``kind``; time is linear in the items.

    ``step(state, item)`` returns the next state and the array given out there, or
    None where ``between(state, next state)`` gives it (null: nothing).  ``last(state)``
    is given out at the end.  Items are folded by blocks, as an array that grows by
    one at each of n steps would be copied n times.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["s"], x)
        grown = lambda t: F.struct(t.alias("s"), let_out(t).alias("out"))
        let_out = lambda t: let(out if between is None else between(acc["s"], t), lambda o: F.when(o.isNull(), acc["out"]).otherwise(F.concat(acc["out"], o)))
        return let(after, grown)

    def whole(arr: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(arr) / block).cast("int") - 1)
        begin = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        part = lambda s, i: F.aggregate(F.slice(arr, i * block + 1, F.lit(block)), F.struct(s.alias("s"), none.alias("out")), one)
        joined = lambda acc, i: let(part(acc["s"], i), lambda p: F.struct(p["s"].alias("s"), F.concat(acc["out"], F.array(p["out"])).alias("out")))
        done = F.aggregate(blocks, begin, joined)
        final = lambda d: F.flatten(d["out"]) if last is None else F.concat(F.flatten(d["out"]), F.coalesce(last(d["s"]), none))
        return F.when(F.size(arr) == 0, none).otherwise(let(done, final))

    return let(items, whole)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], few: int, parts: int = 32) -> DataFrame:
    """``rows`` left-joined to ``table``, whose keys are unique, such that a hot key of ``rows`` is no task of its own.

    A table of at most ``few`` rows is sent to every task.  A larger one is joined by
    a shuffle on the key and a salt: rows of one key are dealt by a hash of their
    ``spread`` columns, and the table's row goes to each of the ``parts`` shares.
    ``table`` is counted, so it should be written or checkpointed already.
    """
    if table.count() <= few:
        return rows.join(F.broadcast(table), on, "left")
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread)), F.lit(parts)))
    each = table.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(each, [*on, "__share"], "left").drop("__share")


def hot_keys(counts: DataFrame, key: str, least: int = 1000, share: int = 1000) -> list:
    """Keys of ``key, c`` with a count of at least ``least`` and a ``share``-th of the sum of all: never more than ``share`` keys."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total")).first()["total"]
    if total < least:
        return []
    return [r[0] for r in counts.filter(F.col("c") >= max(least, total // share)).select(key).collect()]


def joined_by(rows: DataFrame, table: DataFrame, key: str, spread: list[str], hot: list, how: str = "inner", parts: int = 64) -> DataFrame:
    """Join on ``key`` in which the rows of ``hot`` keys are dealt over ``parts`` shares by a hash of ``spread``.

    The table's rows of a hot key go to each share; ``hot`` is bounded by ``hot_keys``.
    """
    if not hot:
        return rows.join(table, key, how)
    share = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    shares = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__share", share).join(table.withColumn("__share", F.explode(shares)), [key, "__share"], how).drop("__share")


def apart(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join to a table with one row for each key: the rows of ``hot`` keys stay where they are, and meet a broadcast of their keys' rows.

    ``hot`` is bounded by ``hot_keys``, and so is that broadcast.
    """
    if not hot:
        return rows.join(table, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(~is_hot).join(table.filter(~is_hot), key).unionByName(rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
