"""WARC archives: a parallel writer, and a reader that splits files at any byte.

The writer makes one gzip member a record, one archive a partition, under a
temporary name until it is whole.  The reader deals byte ranges of the archives to
tasks.  A task scans its range for the gzip magic, takes a candidate for a member
once its decoded head is that of a WARC record, and owns the records that start in
its range, reading the last one past the end.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, looked_up, pin, read

MAGIC = b"\x1f\x8b\x08"
LEAST_BYTES = 1000
SPLIT = 16 << 20
#: Tasks of a reader at most; beyond it a task scans several ranges.
READERS = 50_000
CHUNK = 1 << 18
#: Repeated payloads up to this many (48 bytes each) are sent to every task; beyond it they are joined by a shuffle on digest and salt.
BROADCAST_DIGESTS = 200_000
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, owner``: owner is the page that a revisit refers to, else null.

    Of the rows with equal payloads of at least ``least`` bytes, the largest
    page_id owns it; rows that share this page_id all keep their payload, and rows
    without page_id refer to it.
    """
    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("url"), F.encode(F.coalesce("`html`", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    owners = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("owner")).filter("n > 1 and owner is not null").select("digest", "owner")
    joined = looked_up(rows, pin(owners), ["digest"], ["page_id", "url"], BROADCAST_DIGESTS)
    return joined.withColumn("owner", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("owner")), F.col("owner")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP head, not the payload."""
    name = lambda n: f"<urn:x-page:{'' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if owner is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(owner)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + member.flush()


def settled(fs: pafs.FileSystem, draft: str, target: str) -> int:
    """Renames a whole draft to its target, or drops it if another attempt has made the target; the target's size.

    Not every file system replaces an existing target, and none need to.
    """
    made = lambda: fs.get_file_info(target).type == pafs.FileType.File
    if not made():
        try:
            fs.move(draft, target)
        except OSError:
            if not made():
                raise
    if fs.get_file_info(draft).type == pafs.FileType.File:
        fs.delete_file(draft)
    return fs.get_file_info(target).size


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes rows of ``with_revisits`` to ``folder`` and returns ``path, bytes, records`` of the archives, lazily.

    A task that runs again, or beside another attempt, makes the same records: it
    keeps an archive that an earlier attempt has already made whole.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{base}/.{name}.{context.taskAttemptId()}"
        fs.create_dir(base, recursive=True)
        count = 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for page_id, url, payload, digest, owner in zip(batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["owner"]):
                    whole = lambda x: None if pd.isna(x) else int(x)
                    data = record(whole(page_id), url, payload, digest, whole(owner))
                    out.write(data)
                    count += 1
        size = settled(fs, draft, f"{base}/{name}")
        yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("owner").cast("string").alias("owner"))
    return rows.mapInPandas(write, "path string, bytes long, records long")


def _parsed(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of a decoded record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x != "<urn:x-page:>" else None
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), size, stated, payload if kind == "response" else None


def _head(data: bytes) -> bytes:
    """The first bytes that a member decodes to, as far as it can be decoded."""
    try:
        return zlib.decompressobj(31).decompress(data, 7)
    except zlib.error:
        return b""


def records_in(stream, start: int, end: int, chunk: int = CHUNK, step: int = 8192, damaged: Callable[[int], None] | None = None) -> Iterator[bytes]:
    """Decoded records whose member starts in [start, end) of a seekable stream.

    A member that breaks or ends too early is a lost record if its decoded head is a WARC
    record's, and so is whatever else follows a record and isn't one: ``damaged`` gets its
    offset, and without it an error is raised.  Bytes before the first record of a range
    that look like no head are not taken for one.
    """
    stream.seek(start)
    held, base, pos = b"", start, 0  # held: bytes from offset ``base`` on; before ``pos`` they are done with
    after: int | None = None  # where a record has just ended, and so the next one starts

    def more() -> bool:
        nonlocal held, base, pos
        got = stream.read(chunk)
        held, base, pos = held[pos:] + got, base + pos, 0
        return bool(got)

    def lost(at: int) -> None:
        if damaged is None:
            raise ValueError(f"the record at byte {at} is cut or damaged")
        damaged(at)

    while base + pos < end:
        found = held.find(MAGIC, pos)
        if found < 0:
            pos = max(pos, len(held) - len(MAGIC) + 1)
            if not more():
                if after is not None and base + len(held) > after:
                    lost(after)
                return
            continue
        pos = found
        if after is not None and base + pos > after:
            lost(after)
            after = None
        if base + pos >= end:
            return
        decoder, out, used = zlib.decompressobj(31), [], 0
        whole, cut = True, False
        while not decoder.eof:
            if pos + used == len(held) and not more():
                whole, cut = False, True
                break
            piece = held[pos + used : pos + used + step]
            try:
                out.append(decoder.decompress(piece))
            except zlib.error:
                whole = False
                break
            used += len(piece)
            if used == len(piece) and not b"WARC/1.".startswith(out[0][:7]):
                whole = False
                break
        head = b"".join(out[:8])[:7] or _head(held[pos : pos + step])
        if whole and head == b"WARC/1.":
            yield b"".join(out)
            pos += used - len(decoder.unused_data)
            after = base + pos
            continue
        # a head that is too short to tell is a record's if the file ends in it
        if base + pos == after or head == b"WARC/1." or (cut and b"WARC/1.".startswith(head)):
            lost(base + pos)
        pos, after = pos + 1, None


def read_archives(archives: DataFrame, split: int = SPLIT, payload: bool = True, keep_damaged: bool = False) -> DataFrame:
    """The records of ``path, bytes``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    ``payload_bytes`` and the digest are of the full payload for revisits too;
    their payload is null, as are all without ``payload``.  A record that is cut or damaged
    is an error, or with ``keep_damaged`` a row of type ``damaged`` and nulls, whose
    payload_bytes is its offset; records after it are read.  ``archives`` is read
    twice, first to count the ranges, as a stated number of partitions isn't coalesced:
    each range is a task, up to READERS of them.
    """
    count = archives.agg(F.coalesce(F.sum(F.ceil(F.greatest("bytes", F.lit(1)) / split)), F.lit(1)).alias("n")).first()["n"]
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))
    ranges = archives.select("path", F.explode(starts).alias("start")).repartitionByRange(max(1, min(int(count), READERS)), "path", "start")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        columns = [x.split()[0] for x in RECORD.split(", ")]
        frame = lambda: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        for batch in batches:
            for name, start in zip(batch["path"], batch["start"]):
                fs, path = pafs.FileSystem.from_uri(name)
                broken: list[int] = []
                with fs.open_input_file(path) as stream:
                    for data in records_in(stream, int(start), int(start) + split, damaged=broken.append if keep_damaged else None):
                        row = _parsed(data)
                        rows.append(row if payload else (*row[:-1], None))
                        held += len(data) if payload else 256
                        if held > 8 << 20:
                            yield frame()
                            rows, held = [], 0
                rows += [(None, None, "damaged", None, offset, None, None) for offset in broken]
        if rows:
            yield frame()

    return ranges.mapInPandas(scan, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null page_id, url and html are written as no id, no target and an empty payload; an empty table gives empty archives."""
    scratch = Scratch(spark, "warc")
    archives = scratch.table(write_archives(with_revisits(read(spark, sf_dir, "pages")), scratch.folder("archives")))
    found = read_archives(archives, payload=False)
    out = pin(scratch.table(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")))
    scratch.close()
    return out


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner IS NOT NULL AND (page_id IS NULL OR owner <> page_id) THEN owner END AS refers_to
FROM o
"""
