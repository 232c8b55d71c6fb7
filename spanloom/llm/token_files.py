"""Token ids as binary shards, with the documents' boundaries in Elias-Fano form.

A shard file holds, one after the other:

* the ids of its documents, without gaps, two bytes each (little-endian; four bytes if
  the writer is told so),
* the ends of the documents as positions in these ids, in Elias-Fano form,
* their document ids, less the smallest one, in Elias-Fano form,
* a trailer of fixed size with the counts, the sections' places and a checksum.

Elias-Fano form keeps n ascending numbers below u in about n (2 + log2(u / n)) bits: the
lower bits of each as they are, the upper ones as a row of bits with a 1 for each number
after as many 0s as its upper part.  Counts of ones before every 512 of these bits, four
bytes each, make ``select`` a search and a look into one block: the n-th 1 gives a
number, the n-th 0 the first number of an upper part, and so the document of a position.
There is no table of 64-bit offsets, in the file or in memory.

Documents stand by id in ascending order, over all shards: Spark deals them to tasks by
ranges, sorts them, and each task writes its range as one shard or several of a bounded
size, under a draft name until it is whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pin, read
from .warc import settled

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: A shard is closed at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 1 << 20, 1 << 28
#: Documents that a reading task takes, the bytes of ids that it holds at once, and tasks at most; beyond them a task takes several ranges.
RANGE, HELD, READERS = 1 << 13, 8 << 20, 50_000
#: Rows of the files' table that is sent to every task; a larger one is joined by a shuffle.
BROADCAST_FILES, TILE = 100_000, 1 << 22
#: Parts of texts whose ids a worker remembers.
KNOWN = 1_200_000
WORD = re.compile(r"\n[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_AND_MARKS = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)")
#: Bits of a block of the upper row, and numbers whose lower bits are packed at once.
BLOCK, PACK = 512, 1 << 16
TRAILER = struct.Struct("<8s8Q2I")
MAGIC = b"IDSHARD1"
SHARDS = "path string, partition int, part int, docs long, ids long, bytes long"


@dataclass
class EliasFano:
    """``n`` ascending numbers: ``low`` lower bits of each, the upper bits' row, and the ones before each of its blocks."""

    n: int
    low: int
    lows: np.ndarray
    row: np.ndarray
    ones: np.ndarray

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        """Of uint64 numbers in ascending order, which may repeat."""
        n = len(numbers)
        low = max(0, ((int(numbers[-1]) + 1) // n).bit_length() - 1) if n else 0
        parts = []
        for at in range(0, n if low else 0, PACK):
            part = numbers[at : at + PACK]
            bits = (part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            parts.append(np.packbits(bits.astype(np.uint8), bitorder="little"))
        upper = (numbers >> np.uint64(low)).astype(np.int64) + np.arange(n)
        blocks = (int(upper[-1]) // BLOCK + 1) if n else 0
        row = np.zeros(blocks * BLOCK // 8, np.uint8)
        np.bitwise_or.at(row, upper >> 3, np.left_shift(1, upper & 7).astype(np.uint8))
        return cls(n, low, np.concatenate(parts) if parts else np.zeros(0, np.uint8), row, cls.counted(row))

    @staticmethod
    def counted(row: np.ndarray) -> np.ndarray:
        each = np.bitwise_count(row).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        return np.r_[0, each.cumsum()[:-1]].astype(np.uint32)[: len(each)]

    def packed(self) -> bytes:
        return struct.pack("<2Q", self.n, self.low) + self.ones.tobytes() + self.row.tobytes() + self.lows.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> EliasFano:
        n, low = struct.unpack_from("<2Q", data)
        lows = (n * low + 7) // 8
        blocks = (len(data) - 16 - lows) // (4 + BLOCK // 8)
        ones = np.frombuffer(data, np.uint32, blocks, 16)
        row = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, 16 + 4 * blocks)
        return cls(n, low, np.frombuffer(data, np.uint8, lows, len(data) - lows), row, ones)

    def select(self, which: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Places in the upper row of the 1s (or 0s) of these numbers, from 0."""
        which = np.asarray(which, np.int64)
        before = np.arange(len(self.ones), dtype=np.int64) * BLOCK - self.ones if zeros else self.ones
        block = np.searchsorted(before, which, "right") - 1
        out = np.empty(len(which), np.int64)
        for at in range(0, len(which), PACK // 64):
            part = slice(at, at + PACK // 64)
            bits = np.unpackbits(self.row.reshape(-1, BLOCK // 8)[block[part]], axis=1, bitorder="little")
            seen = (bits ^ 1 if zeros else bits).cumsum(axis=1, dtype=np.int16)
            wanted = which[part] - before[block[part]] + 1
            out[part] = block[part] * BLOCK + (seen >= wanted[:, None]).argmax(axis=1)
        return out

    def at(self, which: np.ndarray) -> np.ndarray:
        """The numbers in these places, as uint64."""
        which = np.asarray(which, np.int64)
        out = (self.select(which) - which).astype(np.uint64) << np.uint64(self.low)
        for at in range(0, len(which) if self.low else 0, PACK):
            place = which[at : at + PACK, None] * self.low + np.arange(self.low)
            bits = (self.lows[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            out[at : at + PACK] |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def above(self, values: np.ndarray) -> np.ndarray:
        """How many numbers are at most each of these, so that it is the place of the next one: the document that holds a position."""
        values = np.asarray(values, np.uint64)
        upper = (values >> np.uint64(self.low)).astype(np.int64)
        many = len(self.row) * 8 - self.n
        # numbers with a smaller upper part, and with this one or a smaller one
        bound = lambda u: np.where(u <= 0, 0, np.where(u > many, self.n, self.select(np.clip(u, 1, max(many, 1)) - 1, zeros=True) - np.clip(u, 1, max(many, 1)) + 1))
        low, high = bound(upper), bound(upper + 1)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self.at(np.minimum(middle, max(self.n - 1, 0))) <= values)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts.

    The vocabulary's own splitting rule puts a boundary before a blank, and around a line
    feed, between two characters that aren't white space, and merges don't cross it.  So a
    text's ids are those of its parts, cut before such blanks and line feeds.  Parts recur:
    each is encoded once, as long as KNOWN of them are remembered.
    """

    def __init__(self, path: str, width: int):
        self.tokens, self.kind = tokenizer(path), np.dtype(f"<u{width}")
        self.lengths = np.zeros(self.tokens.get_vocab_size(), np.int64)  # bytes of each id: its string has a letter for each
        for token, i in self.tokens.get_vocab().items():
            self.lengths[i] = len(token)
        # parts without the blank before them; with it, those that hold blanks or end in white space; marks by themselves
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokens.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, parts: list[str]) -> None:
        """Encodes parts in one text, which falls into them again; marks after a word are its neighbours, not its end."""
        ended = [(x, *found.groups()) for x in parts if (found := WORD_AND_MARKS.fullmatch(x))]
        whole = {x for x in parts if not WORD_AND_MARKS.fullmatch(x)}
        new = list(whole.union(word for _, word, _ in ended).difference(self.known))
        units = [x if x[0] == "\n" else f" {x}" for x in new]
        found = self.ids("".join(units))
        ends = np.fromiter((len(x.encode()) for x in units), np.int64, len(units)).cumsum()
        cuts = np.searchsorted(self.lengths[found].cumsum(), ends) + 1
        data, last = found.tobytes(), 0
        for part, cut in zip(new, (cuts * self.kind.itemsize).tolist()):
            self.known[part] = data[last:cut]
            last = cut
        for part, word, marks in ended:
            if marks not in self.marks:
                self.marks[marks] = self.ids(marks).tobytes()
            self.known[part] = self.known[word] + self.marks[marks]

    def encode(self, text: str) -> bytes:
        if len(self.known) > KNOWN:  # what came first is the most frequent
            self.known = dict(islice(self.known.items(), KNOWN // 2))
        head, *rest = text.replace("\n", " \n").split(" ")
        missing = set(rest).difference(self.known)
        if rest and (not head or head[-1].isspace() or any(not x or x[-1].isspace() or x[:2].lstrip("\n")[:1].isspace() or x[:2] == "\n\n" for x in missing)):
            head, *rest = self.joined(text.split(" "))
            rest = [f" {x}" if " " in x or x[-1].isspace() else x for x in rest]
            missing = set(rest).difference(self.known)
            for part in [x for x in missing if x[0] == " "]:
                self.known[part] = self.ids(part).tobytes()
                missing.remove(part)
        start = f"\n{head}"  # a word at the start is one after a line feed without this one's id
        if WORD.fullmatch(start):
            if start not in self.known:
                missing.add(start)
        else:
            start = None
        if missing:
            self.learn(list(missing))
        first = self.known[start][self.kind.itemsize :] if start else self.ids(head).tobytes()
        return first + b"".join(map(self.known.__getitem__, rest))

    @staticmethod
    def joined(parts: list[str]) -> list[str]:
        """Parts that were cut at every blank, put together again where a blank isn't a boundary."""
        chunks = [[parts[0]]]
        for before, part in zip(parts, parts[1:]):
            if before and part and not before[-1].isspace() and not part[0].isspace():
                chunks.append([part])
            else:
                chunks[-1].append(part)
        return [" ".join(x) for x in chunks]


@lru_cache(maxsize=2)
def encoder_of(path: str, width: int) -> Encoder:
    """Shared by the tasks of a Python worker, so that what one has learnt serves the next one."""
    return Encoder(path, width)


class Writer:
    """One shard file: ids as they come, boundaries and document ids at its end."""

    def __init__(self, fs: pafs.FileSystem, base: str, name: str, attempt: int, width: int):
        self.fs, self.target, self.draft = fs, f"{base}/{name}", f"{base}/.{name}.{attempt}"
        self.out, self.width, self.crc, self.ids = fs.open_output_stream(self.draft), width, 0, 0
        self.ends: list[int] = []
        self.docs: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.crc = zlib.crc32(ids, self.crc)
        self.ids += len(ids) // self.width
        self.ends.append(self.ids)
        self.docs.append(doc_id)

    def close(self) -> int:
        known = [x for x in self.docs if x is not None]
        least = known[0] if known else 0
        ends, docs = (EliasFano.of(np.array(x, np.uint64)).packed() for x in (self.ends, [x - least for x in known]))
        self.out.write(ends)
        self.out.write(docs)
        crc = zlib.crc32(docs, zlib.crc32(ends, self.crc))
        self.out.write(TRAILER.pack(MAGIC, len(self.docs), len(known), self.ids, self.width, least & (2**64 - 1), self.ids * self.width, len(ends), len(docs), crc, 0))
        self.out.close()
        return settled(self.fs, self.draft, self.target)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Writes ``doc_id, text`` (null: empty) to ``folder`` and returns SHARDS, lazily.

    Rows stand by doc_id, nulls first, then by hash and text; each has its text's ids and
    ``end_id``.  ``doc_id`` is a long.  An empty table makes no files.  Whole rows that are equal
    fall to one task, which writes them as they come.  A task that runs again makes the same
    files, and keeps those that an earlier attempt has made whole.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context, encoder = TaskContext.get(), encoder_of(vocabulary, width)
        end, out, rows = np.array([end_id], encoder.kind).tobytes(), None, []

        def closed() -> None:
            name = out.target.rpartition("/")[2]
            rows.append((f"{folder}/{name}", context.partitionId(), len(rows), len(out.docs), out.ids, out.close()))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text) + end
                if out and (len(out.docs) >= SHARD_DOCS or out.ids + len(ids) // width > SHARD_IDS):
                    closed()
                    out = None
                out = out or Writer(fs, base, f"part-{context.partitionId():06d}-{len(rows):06d}.ids", context.taskAttemptId(), width)
                out.add(None if doc_id is None else int(doc_id), ids)
        if out:
            closed()
        if rows:
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SHARDS.split(", ")])

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce("`text`", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")
    return ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, SHARDS)


class Shard:
    """An open shard file."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file, size = fs.open_input_file(name), fs.get_file_info(name).size
        magic, self.docs, self.known, self.ids, self.width, least, at, ends, docs, self.crc, _ = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or size != at + ends + docs + TRAILER.size:
            raise ValueError(f"{path} is no whole shard of ids")
        self.least = least - 2**64 if least >= 2**63 else least
        self.ends = EliasFano.unpacked(self.file.read_at(ends, at))
        self.names = EliasFano.unpacked(self.file.read_at(docs, at + ends))

    def starts(self, first: int, last: int) -> np.ndarray:
        """Positions of the documents from ``first`` on, up to the end of ``last - 1``."""
        found = self.ends.at(np.arange(max(first - 1, 0), last)).astype(np.int64)
        return found if first else np.r_[0, found]

    def doc_ids(self, which: np.ndarray) -> list[int | None]:
        """Ids of these documents; those without one come first in a shard."""
        which = which - (self.docs - self.known)
        found = iter(self.names.at(which[which >= 0]))
        return [None if x < 0 else self.least + int(next(found)) for x in which]

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids in these positions."""
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def verify(self) -> None:
        crc, left, at = 0, self.file.size() - TRAILER.size, 0
        while left:
            part = self.file.read_at(min(left, HELD), at)
            crc, left, at = zlib.crc32(part, crc), left - len(part), at + len(part)
        if crc != self.crc:
            raise ValueError("a shard of ids doesn't fit its checksum")


def based(shards: DataFrame) -> DataFrame:
    """SHARDS with ``base``, the ids of all shards before, and ``first``, the documents before: a row for each file meets in one task."""
    before = Window.orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return shards.withColumns({"base": F.coalesce(F.sum("ids").over(before), zero), "first": F.coalesce(F.sum("docs").over(before), zero)})


def read_documents(shards: DataFrame, verify: bool = True, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, token_ids`` of written SHARDS; token_ids is null without ``ids``.

    ``start`` counts the ids of all documents before.  Tasks take RANGE documents of a
    shard; the one that takes its first ones also verifies the checksum.
    """
    count = shards.agg(F.coalesce(F.sum(F.ceil(F.col("docs") / RANGE)), F.lit(1)).alias("n")).first()["n"]
    starts = F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(RANGE).cast("long"))
    ranges = based(shards).select("path", "base", "docs", F.explode(starts).alias("begin"))
    ranges = ranges.repartitionByRange(max(1, min(int(count), READERS)), "path", "begin")
    schema = "doc_id string, start long, n_tokens long, ids_crc32 long, token_ids array<int>"
    columns = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base, docs, begin in zip(batch["path"], batch["base"], batch["docs"], batch["begin"]):
                shard, last = Shard(path), min(docs, begin + RANGE)
                if verify and begin == 0:
                    shard.verify()
                places, names = shard.starts(begin, last), shard.doc_ids(np.arange(begin, last))
                rows, at = [], 0
                while at < len(names):
                    # documents whose ids are held at once: HELD bytes of them, or one document
                    to = max(at + 1, int(np.searchsorted(places, places[at] + HELD // 4, "right")) - 1)
                    data = shard.read(int(places[at]), int(places[to])).astype("<u4")
                    for i in range(at, to):
                        own = data[places[i] - places[at] : places[i + 1] - places[at]]
                        rows.append((None if names[i] is None else str(names[i]), base + places[i], len(own), zlib.crc32(own), own.astype(np.int32) if ids else None))
                    at = to
                    if ids:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return ranges.mapInPandas(scan, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def documents_at(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """``position, doc_id, start`` for each ``position`` in the ids of all shards, by select in the shard that holds it.

    Positions meet the files that share a tile of TILE ids with them; null ones and those
    outside find nothing.
    """
    files = pin(based(shards).select("path", "base", "ids", F.explode(F.expr(f"sequence(base div {TILE}, (base + ids - 1) div {TILE})")).alias("tile")))
    wanted = positions.select(F.col("`position`").cast("long").alias("position")).withColumn("tile", F.expr(f"position div {TILE}"))
    placed = wanted.join(F.broadcast(files) if files.count() <= BROADCAST_FILES else files, "tile").filter("position >= base and position < base + ids")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (path, base), rows in batch.groupby(["path", "base"]):
                shard = Shard(path)
                which = shard.ends.above((rows["position"] - base).to_numpy().astype(np.uint64))
                starts = np.where(which > 0, shard.ends.at(np.maximum(which - 1, 0)).astype(np.int64), 0)
                names = [None if x is None else str(x) for x in shard.doc_ids(which)]
                yield pd.DataFrame({"position": rows["position"].to_numpy(), "doc_id": names, "start": base + starts})

    found = placed.select("path", "base", "position").mapInPandas(find, "position long, doc_id string, start long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    shards = scratch.table(write_shards(read(spark, sf_dir, "documents"), scratch.folder("shards")))
    out = pin(read_documents(shards, ids=False).drop("token_ids"))
    scratch.close()
    return out
