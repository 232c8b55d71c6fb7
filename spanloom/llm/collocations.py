"""Phrases of words that stand together more often than their parts suggest.

Texts are cut into pieces and words, and shards of them are kept as one compressed
position bitmap per word: the 8-position blocks in which a word occurs, and a byte of
bits for each.  A phrase's bitmap holds the positions of its last word; shifting it by
one and ANDing it with the words' bitmaps gives the bitmaps of all longer phrases at
once, block by block, and their popcounts are the shard's counts.  A position between
two pieces belongs to no word, so no phrase crosses it.  Counts are sums over shards:

1. words: a shard's counts are added up; rare words have no bitmap from here on.
2. pairs: each shard extends its words by one; sums of hashed pairs name those that
   can be frequent (a collision only lets a pair through to step 3).
3. phrases: each shard goes depth-first from these pairs, extending a phrase only where
   its last two words are such a pair; sums are exact, by the phrase's text.

Pairs and phrases are dealt into parts by their hash, and what a shard has in a part is
one row: sorted hashes as differences, or texts on lines, and their counts.  A part is
added up in one task; parts number as the corpus's positions, so none grows with it.

What a shard needs to know of the other shards comes by a join on words or pairs, so
nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, looked_up, pin, read

LEAST, LONGEST, TOP = 100, 5, 2000
#: A longer phrase drops a candidate that it contains if it has this percentage of its count.
COVERED = 100
#: Positions after which a task closes its shards.
SHARD = 6 << 20
#: Bytes of text split at once, and entries of bitmaps extended at once.
SLICE, BATCH = 1 << 20, 1 << 16
#: Positions of the corpus for each part of its pairs and phrases, and the least number of parts.
PART, PARTS = 2 << 20, 128
#: Rows of a table that is sent to every task, through the driver; a larger one is joined by a shuffle, over so many shares of a key.
BROADCAST_ROWS, SHARES = 10_000, 4
UNKNOWN = "und"

SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
NO_WORD, END = 0, 1  # codes of the empty string between two blanks, and of a piece's end
FIRST = 2
SHARDS = "shard long, lang string, positions long, words array<string>, counts array<int>, entries array<int>, blocks binary, bits binary"


class Codes(dict):
    """Words of a shard, numbered as they come."""

    def __init__(self):
        super().__init__({b"": NO_WORD, b"\n": END})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits as four planes of bytes, which compress well where most are small."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def coded(text: str, codes: Codes) -> list[np.ndarray]:
    """The text's words and pieces' ends as codes, slice by slice."""
    data, out, start = text.encode().translate(SPLIT).replace(b"\n", b" \n "), [], 0
    while start < len(data):
        end = len(data) if len(data) - start <= SLICE else data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        words = data[start:end].split(b" ")
        found = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        out.append(found[found != NO_WORD])
        start = end + 1
    out.append(np.array([END], np.int32))
    return out


def packed(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences and bitmap entries of each word, and the entries' blocks and bits, word by word."""
    # word and position in one number, sorted in place: a shard is large, and a copy of each costs as much again
    at = np.flatnonzero(codes >= FIRST)
    high = codes[at].astype(np.int64)
    high -= FIRST
    high <<= 32
    at |= high
    del high
    at.sort()
    word = (at >> 32).astype(np.int32)
    counts = np.bincount(word, minlength=words)
    at &= 0xFFFFFFFF
    bit = np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
    at >>= 3
    block = at.astype(np.uint32)
    del at
    first = np.flatnonzero(np.r_[True, (np.diff(word) != 0) | (np.diff(block) != 0)][: len(word)])
    bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
    return counts, np.bincount(word[first], minlength=words), block[first], bits


def shards(docs: DataFrame) -> DataFrame:
    """``lang, text`` as rows of SHARDS, one for each language of a shard; nulls are UNKNOWN and empty.

    ``blocks`` has the differences of the entries' block numbers in planes.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[Codes, list[np.ndarray]]] = {}
        total, number = 0, TaskContext.get().partitionId() << 32

        def closed() -> Iterator[pd.DataFrame]:
            nonlocal total, number
            for lang in list(held):
                codes, parts = held.pop(lang)
                found = np.concatenate(parts)
                parts.clear()
                words = [w.decode() for w in codes][FIRST:]
                codes.clear()
                positions = len(found)
                counts, entries, block, bits = packed(found, len(words))
                del found
                blocks = planes(np.diff(block, prepend=np.uint32(0)))
                yield pd.DataFrame({"shard": [number], "lang": [lang], "positions": [positions], "words": [words], "counts": [counts.astype(np.int32)], "entries": [entries.astype(np.int32)], "blocks": [blocks], "bits": [bits.tobytes()]})
                del words, counts, entries, block, bits, blocks
                number += 1
            total = 0

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                codes, parts = held.setdefault(lang, (Codes(), []))
                new = coded(text, codes)
                parts += new
                total += sum(map(len, new))
                if total >= SHARD:
                    yield from closed()
        yield from closed()

    rows = docs.select(F.coalesce("`lang`", F.lit(UNKNOWN)).alias("lang"), F.coalesce("`text`", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, SHARDS)


class Bitmaps:
    """A shard's bitmaps of the words that are wanted, block by block."""

    def __init__(self, shard: pa.Table, wanted: np.ndarray):
        entries = shard["entries"][0].values.to_numpy()
        bits = np.frombuffer(shard["bits"][0].as_py(), np.uint8)
        block = unplaned(shard["blocks"][0].as_py()).cumsum(dtype=np.uint32).view(np.int32)  # positions have 32 bits, blocks 29
        word = np.repeat(np.arange(len(entries), dtype=np.int32), entries)
        keep = np.zeros(len(entries), bool)
        keep[wanted] = True
        keep = keep[word]
        self.words = len(entries)
        self.by_word = word[keep], block[keep], bits[keep]
        order = np.argsort(self.by_word[1], kind="stable")
        self.word, block, self.bits = (x[order] for x in self.by_word)
        self.start = np.r_[0, np.bincount(block, minlength=(shard["positions"][0].as_py() >> 3) + 2).cumsum()]

    def extended(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes, words, blocks and bits of all phrases one word longer: the shifted bitmaps AND those of the words."""
        carried = np.flatnonzero(bits >> 7)
        moved = np.left_shift(bits, 1)
        stay = np.flatnonzero(moved)
        node = np.r_[node[stay], node[carried]]
        block = np.r_[block[stay], block[carried] + 1]
        moved = np.r_[moved[stay], np.ones(len(carried), np.uint8)]
        first = self.start[block]
        many = self.start[block + 1] - first
        at = np.arange(many.sum()) + np.repeat(first - np.r_[0, many.cumsum()[:-1]], many)
        hit = self.bits[at] & np.repeat(moved, many)
        some = np.flatnonzero(hit)
        return np.repeat(node, many)[some], self.word[at[some]], np.repeat(block, many)[some], hit[some]

    def grouped(self, node: np.ndarray, word: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same entries phrase by phrase: first entry, node, word and popcount of each phrase, and their blocks and bits."""
        key = node.astype(np.int64) * self.words + word
        order = np.argsort(key, kind="stable")
        key, block, bits = key[order], block[order], bits[order]
        first = np.flatnonzero(np.r_[True, np.diff(key) != 0][: len(key)])
        counts = np.add.reduceat(np.bitwise_count(bits), first, dtype=np.int64) if len(first) else first
        return first, key[first] // self.words, key[first] % self.words, counts, block, bits


def batches(first: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Ranges of phrases whose entries number about BATCH, or one phrase if it has more."""
    ends, begin = np.r_[first[1:], total], 0
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(ends, first[begin] + BATCH, "right")))
        yield begin, end
        begin = end


def empty(schema: str) -> pa.Table:
    """No rows of a schema of longs, strings and binaries."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase by that of all but its last word and that of this."""
    return left * np.uint64(0x9E3779B97F4A7C15) + right


def parted(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts of hashes, by their upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def keyed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part and the lower 32 bits in one number."""
    return parted(hashes, parts) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def cuts_of(parts: np.ndarray) -> list[int]:
    """Where a part begins in sorted ones, and the end of all."""
    return [*np.flatnonzero(np.r_[True, np.diff(parts) != 0][: len(parts)]).tolist(), len(parts)]


def hashes_of(words: int, listed: pa.Table) -> np.ndarray:
    """The hashes of a shard's words, by their codes."""
    hashes = np.zeros(words, np.uint64)
    hashes[listed["code"].to_numpy()] = listed["h"].to_numpy().view(np.uint64)
    return hashes


PAIRS = "shard long, part long, hashes binary, counts binary"
OFTEN = "of long, part long, hashes binary"
SUMS = "lang string, part long, phrases string, counts binary"


def pairs_of(parts: int):
    """Counts of a shard's pairs of listed words, a row for each part: the lower 32 bits of the pairs' hashes, sorted, and the counts."""

    def pair(shard: pa.Table, listed: pa.Table) -> pa.Table:
        keys, sums, names = [], [], [x.split()[0] for x in PAIRS.split(", ")]
        if shard.num_rows and listed.num_rows:
            maps = Bitmaps(shard, listed["code"].to_numpy())
            hashes = hashes_of(maps.words, listed)
            word, block, bits = maps.by_word
            first = np.flatnonzero(np.r_[True, np.diff(word) != 0])
            for a, b in batches(first, len(word)):
                part = slice(first[a], first[b] if b < len(first) else len(word))
                _, one, two, counts, _, _ = maps.grouped(*maps.extended(word[part], block[part], bits[part]))
                keys.append(keyed(joint(hashes[one], hashes[two]), parts))
                sums.append(counts.astype(np.uint32))
            del maps, word, block, bits
        if not sum(map(len, keys)):
            return empty(PAIRS)
        keys, sums = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(keys)
        keys, sums = keys[order], sums[order]
        part, low = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
        cuts = cuts_of(part)
        spans = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        rows = [planes(np.diff(low[x], prepend=np.uint32(0))) for x in spans], [planes(sums[x]) for x in spans]
        return pa.table([pa.repeat(shard["shard"][0], len(spans)), part[cuts[:-1]], *(pa.array(x, pa.binary()) for x in rows)], names)

    return pair


def often_of(least: int):
    """Of a part's pairs those that all shards together have ``least`` times, a row for each shard that has any."""

    def add(rows: pa.Table) -> pa.Table:
        each = [unplaned(x).cumsum(dtype=np.uint32) for x in rows["hashes"].to_pylist()]
        counts = np.concatenate([unplaned(x) for x in rows["counts"].to_pylist()])
        found, at = np.unique(np.concatenate(each), return_inverse=True)
        often = (np.bincount(at, counts, len(found)) >= least)[at]  # exact: sums are far below 2 ** 53
        kept = [x[y].tobytes() for x, y in zip(each, np.split(often, np.cumsum([len(x) for x in each])[:-1]))]
        out = pa.table([rows["shard"], rows["part"], pa.array(kept, pa.binary())], [x.split()[0] for x in OFTEN.split(", ")])
        return out.filter(np.array([len(x) > 0 for x in kept]))

    return add


def phrases_of(longest: int, parts: int):
    """Counts of a shard's phrases of 2 to ``longest`` words in which each two neighbours are one of its frequent pairs, a row for each part."""

    def grow(shard: pa.Table, known: pa.Table) -> pa.Table:
        texts, sums, places = [], [], []
        listed, pairs = known.filter(known["code"].is_valid()), known.filter(known["part"].is_valid())
        if shard.num_rows and pairs.num_rows:
            words = shard["words"][0].values
            maps = Bitmaps(shard, listed["code"].to_numpy())
            hashes = hashes_of(maps.words, listed)
            often = np.sort(np.concatenate([np.frombuffer(x, np.uint32) | np.uint64(part << 32) for part, x in zip(pairs["part"].to_pylist(), pairs["hashes"].to_pylist())]))
            word, block, bits = maps.by_word
            first = np.flatnonzero(np.r_[True, np.diff(word) != 0])
            stack = [(word[first][:, None], hashes[word[first]], first, block, bits)]  # phrases' words, their hashes and first entries, the entries
            while stack:
                phrases, hashed, first, block, bits = stack.pop()
                for a, b in reversed(list(batches(first, len(block)))):
                    low, high = first[a], first[b] if b < len(first) else len(block)
                    node = np.repeat(np.arange(a, b), np.diff(np.r_[first[a:b], high]))
                    if b - a < len(first):  # one batch at a time, the others wait
                        stack.append((phrases[a:b], hashed[a:b], first[a:b] - low, block[low:high], bits[low:high]))
                        continue
                    node, word, at, hit = maps.extended(node, block, bits)
                    pair = keyed(joint(hashes[phrases[node, -1]], hashes[word]), parts)
                    found = often[np.minimum(np.searchsorted(often, pair), len(often) - 1)] == pair
                    first, node, word, counts, at, hit = maps.grouped(node[found], word[found], at[found], hit[found])
                    longer, hashed = np.c_[phrases[node], word], joint(hashed[node], hashes[word])
                    texts.append(pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in longer.T), " "))
                    sums.append(counts.astype(np.uint32))
                    places.append(parted(hashed, parts))
                    if longer.shape[1] < longest and len(first):
                        stack.append((longer, hashed, first, at, hit))
        if not sum(map(len, sums)):
            return empty(SUMS)
        sums, places = np.concatenate(sums), np.concatenate(places).astype(np.int64)
        order = np.argsort(places, kind="stable")
        sums, places = sums[order], places[order]
        cuts = cuts_of(places)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays(texts).take(pa.array(order))), "\n")
        counts = pa.array([planes(sums[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
        return pa.table([pa.repeat(shard["lang"][0], len(lines)), places[cuts[:-1]], lines, counts], [x.split()[0] for x in SUMS.split(", ")])

    return grow


def sums_of(least: int):
    """``lang, phrase, f`` of a part's phrases that all shards together have ``least`` times."""

    def add(rows: pa.Table) -> pa.Table:
        lines = pc.split_pattern(rows["phrases"], "\n")
        many = pc.list_value_length(lines).to_numpy()
        counts = np.concatenate([unplaned(x) for x in rows["counts"].to_pylist()]).astype(np.int64)
        lang = rows["lang"].take(pa.array(np.repeat(np.arange(len(many)), many)))
        each = pa.table([lang, pc.list_flatten(lines), counts], ["lang", "phrase", "c"])
        summed = each.group_by(["lang", "phrase"], use_threads=False).aggregate([("c", "sum")]).rename_columns(["lang", "phrase", "f"])
        return summed.filter(pc.greater_equal(summed["f"], least))

    return add


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all words and phrases of up to ``longest`` words that occur ``least`` times, and ``lang, n`` of all words.

    Occurrences are contiguous within a piece and may overlap.  ``docs`` has ``lang, text``.
    """
    # a row has megabytes, so a group of rows is closed by its size and not after a hundred of them
    small = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(32 << 20)}
    kept = scratch.table(shards(docs), **small)
    totals = kept.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    each = kept.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("shard", "lang", "code", F.col("x.words").alias("phrase"), F.col("x.counts").alias("c"))
    # a word has a row for each shard at most; sums beside these rows need no join of them
    often = scratch.table(each.withColumn("f", F.sum("c").over(Window.partitionBy("lang", "phrase"))).filter(F.col("f") >= least))
    words = often.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    listed = often.select(F.col("shard").alias("of"), "code", F.xxhash64("lang", "phrase").alias("h"))
    parts = max(PARTS, (kept.agg(F.sum("positions")).first()[0] or 0) // PART)
    together = lambda rows, run, schema: kept.groupBy("shard").cogroup(rows.groupBy("of")).applyInArrow(run, schema)
    pairs = together(listed, pairs_of(parts), PAIRS).groupBy("part").applyInArrow(often_of(least), OFTEN)
    known = listed.unionByName(pairs, allowMissingColumns=True)
    phrases = together(known, phrases_of(longest, parts), SUMS).groupBy("part").applyInArrow(sums_of(least), "lang string, phrase string, f long")
    return scratch.table(words.unionByName(phrases)), totals


def words_of(phrase: Column, first: Column | int, many: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, many), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    ``a`` is the phrase's count, at least ``least``; ``l`` and ``r`` those of the two parts
    at the cut with the least ``score``, floor(1000 a n / (l r)), the earliest of equal
    ones; ``n`` counts the language's words.  A phrase inside a longer candidate with
    ``covered`` percent of its count is left out: as counts fall with length, the
    candidates of one word more tell this for all.  Products are decimals of 38 digits;
    beyond them Spark raises an error.  Null languages are ``und``, null texts empty;
    repeated rows count as often as they stand; other columns are ignored; no rows give
    no phrases.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counted, totals = phrase_counts(docs, scratch, least, longest)
    length = F.size(F.split("phrase", " "))
    candidates = counted.withColumn("length", length).filter("length > 1")
    inner = candidates.filter("length > 2").select("lang", "f", F.explode(F.array(*(words_of(F.col("phrase"), i, F.col("length") - 1) for i in (1, 2)))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", words_of(F.col("phrase"), 1, F.col("k")).alias("head"), words_of(F.col("phrase"), F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"))
    parts = lambda part, count: counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cuts = looked_up(cuts, parts("head", "l"), ["lang", "head"], ["phrase"], BROADCAST_ROWS, SHARES)
    cuts = looked_up(cuts, parts("tail", "r"), ["lang", "tail"], ["phrase"], BROADCAST_ROWS, SHARES)
    cuts = looked_up(cuts, scratch.table(totals), ["lang"], ["phrase"], BROADCAST_ROWS, SHARES)
    score = F.expr("1000 * cast(a as decimal(38, 0)) * cast(n as decimal(20, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # tasks rank their own rows first, so ``top`` rows of each language and task are all that meets
    ranked = best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = pin(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    scratch.close()
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM words)
), f AS (
  SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c ANTI JOIN inside ON c.lang = inside.lang AND c.phrase = inside.phrase AND 100 * inside.longer >= 100 * c.a
), parts AS (
  SELECT lang, phrase, a, h AS cut, array_to_string(w[1 : h], ' ') AS head, array_to_string(w[h + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS h FROM kept)
), cuts AS (
  SELECT p.lang, p.phrase, a, cut, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM parts AS p JOIN n ON n.lang = p.lang
  JOIN f AS x ON x.lang = p.lang AND x.phrase = head JOIN f AS y ON y.lang = p.lang AND y.phrase = tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
