"""MinHash near-duplicate groups over word shingles.

Steps, each written to the shared folder:

1. One Arrow pass over the texts: the set of shingles, its fingerprint, and 336
   universal-hash minima as 56 band keys of 6.
2. Documents with equal sets are one class, named by its smallest id.
3. Band buckets of two or more classes.  A pair of similarity 0.75 shares no bucket
   with probability (1 - 0.75^6)^56 = 1.7e-5, one of 0.8 with 4e-8.
4. Each class is compared with the bucket pivot it shares most bands with, then, for
   some rounds, with other pivots of buckets that still hold several components.
   So a large group is joined by stars, never by all its pairs.
5. Buckets that hold several components even then: all pairs across components,
   less those that sizes or the triangle inequality of the Jaccard distance to the
   pivot rule out, are verified by signatures of 2048 bits, made for these documents
   only, and survivors are compared too, each pair in the first bucket it shares.
   No bucket and no candidate is capped or dropped.  Rows of a hot bucket, and
   pairs of a hot document, are dealt over many tasks in each join.
6. Links are confirmed on full sets; components come from large-star/small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, apart, hot_keys, joined_by, pin, read
from .components import connected_components

WORDS, SIMILARITY = 5, 0.75
BANDS, ROWS = 56, 6
#: One bit of each of so many further minima; equal with probability (1 + similarity) / 2.
BITS = 2048
#: Estimated similarity below which a signature rules a pair out: 0.75 less 4.8 standard deviations, so one pair of 0.75 in 10^6.
SIGNATURE_FLOOR = 0.68
STAR_ROUNDS = 1
#: Ids up to this many are sent to every task when texts are picked (8 bytes each); beyond it the pick is a shuffled join.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240517)
_odd = lambda *shape: _rng.integers(0, 2**31, shape, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BANDED = (_odd(BANDS * ROWS), _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32))
_SIGNED = (_odd(BITS), _rng.integers(0, 2**32, BITS, dtype=np.uint32))
_MIX = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
FEATURES = "doc_id long, n long, fp binary, bands array<long>"


class WordHashes(dict):
    """64-bit hashes of words, kept for repeated ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII case and white space only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    wide = min(words, len(h))
    out = np.full(len(h) - wide + 1, np.uint64(wide), dtype=np.uint64)
    for i in range(wide):
        out = _mixed(out * _STEP + h[i : len(h) - wide + 1 + i])
    return np.unique(out)


def minima(found: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least a*x+b mod 2^32 over the shingles x, for each a, b of the family."""
    mul, add = family
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), np.uint32(2**32 - 1))
    block = 32 if len(mul) > 1000 else 128
    for a in range(0, len(x), block):
        np.minimum(out, (x[a : a + block, None] * mul[None] + add[None]).min(axis=0), out=out)
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in _parts(batches):
        n, fps, lows = [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py(), hashes)
            n.append(len(found))
            fps.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            if len(found):
                lows.append(minima(found, _BANDED))
        some = np.array(n, dtype=np.int64) > 0
        keys = np.empty(0, dtype=np.int64)
        if lows:
            rows = np.stack(lows).astype(np.uint64).reshape(len(lows), BANDS, ROWS)
            keys = _mixed((_mixed(rows) * _MIX).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64).ravel()
        offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], names=["doc_id", "n", "fp", "bands"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in _parts(batches):
        fps, out = [], np.zeros((len(batch), BITS // 64), dtype=np.int64)
        for i, text in enumerate(batch.column("text")):
            found = shingles(text.as_py(), hashes)
            fps.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            low = minima(found, _SIGNED)
            out[i] = np.packbits(((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(bool)).view(np.int64)
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * (BITS // 64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=["doc_id", "fp", "sig"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of the full sets of each pair."""
    hashes = WordHashes()
    last_id, last = None, None
    for batch in _parts(batches):
        common, total = [], []
        for b, x, y in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
            one = shingles(x.as_py(), hashes)
            key = (b, len(y.as_py() or ""))
            if key != last_id or last[0] != y.as_py():
                last_id, last = key, (y.as_py(), shingles(y.as_py(), hashes))
            same = len(np.intersect1d(one, last[1], assume_unique=True))
            common.append(same)
            total.append(len(one) + len(last[1]) - same)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])


class _Links:
    """Compared pairs and components so far, as tables in the scratch folder."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.scratch = docs, scratch
        self.components: DataFrame | None = None
        self.distances: DataFrame | None = None
        self.hot: list = []  # keys of buckets that hold many rows

    def labelled(self, rows: DataFrame, column: str = "id", spread: tuple[str, ...] = (), hot: tuple = ()) -> DataFrame:
        """With the component of each row's id, which is the id itself where nothing is linked; ``hot`` ids are in many rows."""
        if self.components is None:
            return rows.withColumn("comp", F.col(column))
        known = self.components.select(F.col("id").alias(column), "component")
        return joined_by(rows, known, column, list(spread), list(hot), "left").withColumn("comp", F.coalesce("component", column)).drop("component")

    def bucketed(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of buckets joined to a table with a row for each key."""
        return apart(rows, table, "key", self.hot)

    def texts(self, ids: DataFrame) -> DataFrame | None:
        """Documents of these distinct ids; None for no ids."""
        ids = self.scratch.table(ids)
        count = ids.count()
        ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids
        return self.docs.join(ids, "doc_id", "left_semi").select("doc_id", "text") if count else None

    def compare(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b) of classes on full sets, and join the components of those that are linked."""
        if self.distances is not None:
            pairs = pairs.join(self.distances.select("a", "b"), ["a", "b"], "left_anti")
        pairs = self.scratch.table(pairs.select("a", "b"))
        texts = self.texts(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"))
        if texts is None:
            return
        texts_of = (texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        hot_a, hot_b = (hot_keys(pairs.groupBy(s).agg(F.count("*").alias("c")), s) for s in "ab")
        both = joined_by(pairs, next(texts_of), "a", ["b"], hot_a)
        both = joined_by(both, next(texts_of), "b", ["a"], hot_b).select("a", "b", "text_a", "text_b")
        found = both.mapInArrow(_compared, "a long, b long, common long, total long").groupBy("a", "b").agg(F.max_by("common", F.col("common") / F.col("total")).alias("common"), F.max_by("total", F.col("common") / F.col("total")).alias("total"))
        found = self.scratch.table(found)
        self.distances = found if self.distances is None else self.distances.union(found)
        self.join(found.filter(F.col("common") * 100 >= F.col("total") * 75).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def join(self, links: DataFrame) -> None:
        """Components after these links, by their present components."""
        ends = self.labelled(self.labelled(links, "u").withColumnRenamed("comp", "cu"), "v").select(F.col("cu").alias("u"), F.col("comp").alias("v"))
        merged = connected_components(ends, self.scratch)
        if self.components is None:
            self.components = self.scratch.table(merged)
            return
        new = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
        old = self.components.join(new, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        fresh = merged.join(self.components, "id", "left_anti").select("id", "component")
        self.components = self.scratch.table(old.union(fresh))


def _fits(a: str, b: str) -> F.Column:
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * 75


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("id", "pivot").alias("b"), F.greatest("id", "pivot").alias("a")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``doc_id, text``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  Texts
    that are null, empty or blank have no shingles and are linked with nothing; a
    text of under five words is one shingle.  Rows that share a doc_id are one
    document: each of its texts can link it.  A row without doc_id takes no part;
    its component_id is null and it is kept.  Other columns are ignored.  An empty
    table gives no rows.
    """
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    features = scratch.table(docs.mapInArrow(_features, FEATURES))
    members = features.filter("doc_id is not null and fp is not null")
    named = scratch.table(members.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    hot_sets = [bytes(fp) for fp in hot_keys(named, "fp")]
    named = named.drop("c")
    classes = scratch.table(joined_by(members.select("doc_id", "fp"), named, "fp", ["doc_id"], hot_sets).select("doc_id", "rep").distinct())
    copies = classes.filter("doc_id <> rep").select("doc_id").join(classes.filter("doc_id = rep").select("doc_id"), "doc_id", "left_anti")
    reps = members.join(copies, "doc_id", "left_anti")

    links = _Links(docs.filter("doc_id is not null"), scratch)
    several = classes.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("rep").alias("u"), F.max("rep").alias("v")).filter("c > 1")
    if several.limit(1).count():  # one id with several texts joins their classes
        links.join(several.select("doc_id").join(classes, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))

    rows = reps.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("pivot"), F.max("id").alias("other")).filter("pivot < other")
    shared = scratch.table(shared.select("key", "pivot", "c"))
    links.hot = hot_keys(shared, "key")
    buckets = scratch.table(links.bucketed(rows, shared.drop("c")).select("key", "id", "n", "pivot"))
    sizes = buckets.filter("id = pivot").select("key", F.col("n").alias("pivot_n")).groupBy("key").agg(F.min("pivot_n").alias("pivot_n"))
    stars = links.bucketed(buckets.filter("id <> pivot"), sizes).filter(_fits("n", "pivot_n")).groupBy("id", "pivot").agg(F.count("*").alias("c"))
    best = stars.groupBy("id").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot"))
    links.compare(_ordered(best))

    mixed = buckets
    for turn in range(STAR_ROUNDS):
        mixed = _mixed_buckets(links, mixed, scratch)
        if not mixed.limit(1).count():
            break
        pivots = mixed.groupBy("key").agg(F.min_by(F.struct("id", "n", "comp"), F.xxhash64("id", F.lit(turn))).alias("p"))
        tried = links.bucketed(mixed, pivots).filter("comp <> p.comp").filter(_fits("n", "p.n"))
        # a component tries the pivot once, by one of its rows
        links.compare(_ordered(tried.groupBy("comp", F.col("p.id").alias("pivot")).agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("id"))))
    mixed = _mixed_buckets(links, mixed, scratch)
    if mixed.limit(1).count():
        links.compare(_across(links, mixed, reps.select(F.col("doc_id").alias("id"), "fp", "bands"), scratch))

    known = joined_by(features.select("doc_id", F.col("n").alias("n_shingles"), "fp"), named, "fp", ["doc_id"], hot_sets, "left")
    final = known.withColumn("id", F.coalesce("rep", "doc_id"))
    out = links.labelled(final).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    out = pin(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    scratch.close()
    return out


def _mixed_buckets(links: _Links, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the buckets that hold several components, with these."""
    rows = links.labelled(rows.select("key", "id", "n", "pivot"))
    several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    return scratch.table(links.bucketed(rows, several))


def _across(links: _Links, mixed: DataFrame, bands: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs of a bucket's different components that could be linked.

    All rows are first compared with their pivot: distances then rule pairs out.
    Near copies of the pivot drop out whole, however many they are, where the others
    are far from it.  The least distance over several texts of an id is no metric, so
    it rules nothing out.
    """
    links.compare(_ordered(mixed.filter("id <> pivot")))
    mixed = _mixed_buckets(links, mixed, scratch)
    far = links.distances.select("a", "b", (1 - F.col("common") / F.col("total")).alias("d"))
    ends = mixed.withColumn("a", F.greatest("id", "pivot")).withColumn("b", F.least("id", "pivot")).join(far, ["a", "b"], "left")
    many = bands.select("id", "fp").distinct().groupBy("id").count().filter("count > 1").select("id")
    many = scratch.table(many.join(mixed.select("id").distinct(), "id", "left_semi"))
    if many.limit(1).count():
        for end in ("id", "pivot"):
            ends = ends.join(many.select(F.col("id").alias(end), F.lit(True).alias(f"many_{end}")), end, "left")
        free = F.col("many_id").isNotNull() | F.col("many_pivot").isNotNull()
    else:
        free = F.lit(False)
    ends = links.labelled(ends.withColumn("d", F.when(free, F.lit(None)).when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.col("d"))).drop("comp"))
    hot = hot_keys(mixed.groupBy("pivot").agg(F.count("*").alias("c")), "pivot")
    ends = links.labelled(ends.withColumnRenamed("comp", "own"), "pivot", ("id", "key"), hot).withColumnRenamed("comp", "pivot_comp")
    slack = 1 - SIMILARITY + 1e-9
    nearest = ends.filter("own <> pivot_comp").groupBy("key").agg(F.min(F.coalesce("d", F.lit(0.0))).alias("nearest"))
    ends = links.bucketed(ends, nearest).filter((F.col("own") != F.col("pivot_comp")) | F.col("d").isNull() | (F.col("d") >= F.col("nearest") - slack))
    ends = scratch.table(ends.select("key", "id", "n", "own", "d"))
    texts = links.texts(ends.select(F.col("id").alias("doc_id")).distinct())
    if texts is None:
        return ends.select(F.col("id").alias("a"), F.col("id").alias("b"))
    signed = texts.mapInArrow(_signed, "doc_id long, fp binary, sig array<long>").withColumnRenamed("doc_id", "id")
    signed = scratch.table(signed.join(bands, ["id", "fp"]).select("id", "sig", F.transform("bands", lambda b: b.bitwiseAND(0x7FFFFFFF).cast("int")).alias("bands")))
    ends = ends.join(signed, "id").withColumn("band", F.array_position("bands", F.col("key").bitwiseAND(0x7FFFFFFF).cast("int")).cast("int")).filter("band > 0")  # only the texts that are in the bucket
    x, y = (ends.select("key", "band", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "own", "d", "sig", "bands"))) for s in "xy")
    apart = sum((F.bit_count(F.col("sig_x")[i].bitwiseXOR(F.col("sig_y")[i])) for i in range(BITS // 64)), F.lit(0))
    before = lambda c: F.slice(c, F.lit(1), F.col("band") - 1)
    earlier = F.exists(F.zip_with(before("bands_x"), before("bands_y"), lambda p, q: p == q), lambda e: e)
    pairs = joined_by(x, y.drop("band"), "key", ["id_x"], links.hot).filter("id_x > id_y and own_x <> own_y").filter(_fits("n_x", "n_y"))
    pairs = pairs.filter(F.coalesce(F.abs(F.col("d_x") - F.col("d_y")) <= slack, F.lit(True)))
    pairs = pairs.filter(apart <= int((1 - SIGNATURE_FLOOR) / 2 * BITS)).filter(~earlier)
    return pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w
), g AS MATERIALIZED (SELECT doc_id, unnest(grams) AS gram FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * common >= 75 * (len(x.grams) + len(y.grams) - common)
), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  WITH RECURSIVE reach(doc_id, seen) AS (SELECT a, a FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.seen)
  SELECT doc_id, min(seen) AS least FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(least, s.doc_id) AS component_id, coalesce(coalesce(least, s.doc_id) = s.doc_id, true) AS kept
FROM s LEFT JOIN r USING (doc_id)
"""
