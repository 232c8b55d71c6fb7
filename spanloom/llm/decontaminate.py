"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions.

A window of an item is contained in a document only if all its shingles are.  A set
that must be contained whole has a prefix of one token: so each window is looked up by
its rarest shingle alone.  Rarity is counted over all documents.  A document position
that holds such a shingle is a candidate; it must leave room for the window on both
sides, and then the words of the window are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pin, read

WINDOW, SHINGLE = 13, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows (about 400 bytes each) up to which candidates are checked beside their scan; beyond it they are joined by a shuffle.
BLOCK = 50_000
#: Distinct shingles (8 bytes each) that are sent to every task at once.  With more, rarity is counted by a shuffled join, and candidates are sought in blocks.
BROADCAST_TOKENS = 1_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased; split at ASCII characters that are neither letters nor digits."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def _windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows with the ids of their items."""
    items = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(WINDOW)))).alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))


def _token(w: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(w, i + n) for n in range(width)))


def _positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each word of each document (and shingle width), with the shingle that starts there."""
    rows = docs.select("*", F.posexplode("words").alias("pos", "word"))
    tokens = [F.xxhash64(F.lit(k), "word", *(F.get("words", F.col("pos") + n) for n in range(1, k))) for k in widths]
    return rows.withColumn("token", tokens[0] if len(tokens) == 1 else F.explode(F.array(*tokens))).drop("word")


def contained_windows(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, key, found``: start, end and items of each occurrence in documents that have any.

    ``key`` is xxhash64 of the text.
    """
    windows = scratch.table(_windows(benchmark))
    count = windows.count()
    widths = sorted(r[0] for r in windows.select(F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect())  # three values at most
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("words"))
    if not count:
        return docs.limit(0).select("doc_id", "key", F.array().cast("array<struct<start:int,end:int,items:array<bigint>>>").alias("found"))

    width = F.least(F.size("window"), F.lit(SHINGLE))
    token = F.when(width == 1, _token(F.col("window"), F.col("at"), 1)).when(width == 2, _token(F.col("window"), F.col("at"), 2)).otherwise(_token(F.col("window"), F.col("at"), SHINGLE))
    spread = windows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("window") - width))).withColumn("token", token)
    tokens = scratch.table(spread.select("token").distinct())
    small = tokens.count() <= BROADCAST_TOKENS
    seen = _positions(docs, widths).select("token").join(F.broadcast(tokens) if small else tokens, "token")
    rarity = scratch.table(seen.groupBy("token").agg(F.count("*").alias("n")))
    # shingles that no document has can't be in one: their windows need no lookup
    counted = spread.join(rarity, "token", "left")
    rarest = counted.groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("r")).filter("r.n > 0")
    anchors = scratch.table(rarest.groupBy(F.col("r.token").alias("token")).agg(F.collect_list(F.struct(F.col("r.at").alias("at"), "window", "items")).alias("windows")))

    # of a candidate only the words around it leave the scan, whatever the text's length
    lead = F.least("pos", F.lit(WINDOW - 1))
    near = F.slice("words", F.col("pos") - lead + 1, F.lit(2 * WINDOW - 1))
    blocks = math.ceil(anchors.count() / BROADCAST_TOKENS)
    hits = None
    for i in range(blocks):
        part = anchors.select("token").filter(F.pmod("token", F.lit(blocks)) == i)
        block = _positions(docs, widths).join(F.broadcast(part), "token").select("doc_id", "key", "token", "pos", lead.alias("lead"), near.alias("near"))
        hits = block if hits is None else hits.union(block)
    hits = scratch.table(hits if blocks else _positions(docs.limit(0), widths).select("doc_id", "key", "token", "pos", lead.alias("lead"), near.alias("near")))

    def fits(x: Column) -> Column:
        start, size = F.col("lead") - x["at"], F.size(x["window"])
        return (start >= 0) & (start + size <= F.size("near")) & (F.slice("near", F.greatest(start, F.lit(0)) + 1, size) == x["window"])

    place = lambda x: F.struct((F.col("pos") - x["at"]).alias("start"), (F.col("pos") - x["at"] + F.size(x["window"])).alias("end"), x["items"].alias("items"))
    checked = hits.join(F.broadcast(anchors) if count <= BLOCK else anchors, "token")
    found = checked.select("doc_id", "key", F.transform(F.filter("windows", fits), place).alias("found")).filter("size(found) > 0")
    return found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("found")).alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` for each row of ``doc_id, text``; see ``judged``."""
    return judged(docs, benchmark).drop("key")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with ``key``, xxhash64 of the text: with doc_id it says which of an id's rows are meant.

    ``n_hit`` counts words inside any occurrence of a 13-word window of an item (or
    of a shorter item as a whole).  Contaminated: hit, and a twentieth of the words
    at least.  Null and empty texts have no words; items without id or words have no
    windows; items that repeat count once by id.  Repeated rows get equal results,
    a null doc_id is kept, other columns are ignored, and empty tables are allowed.
    """
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    benchmark = benchmark.select(F.col("`item_id`").alias("item_id"), F.col("`text`").alias("text"))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = contained_windows(docs, benchmark, scratch)
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    merged = F.aggregate(F.array_sort("spans"), start, lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("hit"), F.greatest(a["reach"], s["end"]).alias("reach")))
    spans = F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    found = found.select("doc_id", "key", spans.alias("spans"), F.sort_array(F.transform(F.array_distinct(F.flatten("found.items")), lambda i: i.cast("string"))).alias("item_ids"))
    hits = pin(scratch.table(found.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), merged["hit"].alias("hit"), "item_ids")))
    scratch.close()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAK_ANY_CASE), "")).cast("long").alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
w AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[i:i + 12], ' ') AS win
  FROM b, unnest(range(1, greatest(len(words) - 12, 1) + 1)) u(i) WHERE len(words) > 0
), g AS (
  SELECT n, i - 1 AS start, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM w), unnest(range(1, len(words) - size + 2)) u(i)
), h AS MATERIALIZED (SELECT n, start, g.size, item_id FROM g JOIN w USING (size, win)),
c AS (SELECT n, count(DISTINCT start + j) AS n_hit FROM h, unnest(range(0, size)) u(j) GROUP BY n),
k AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN k USING (n)
"""
