"""SentencePiece encoding and decoding, with N-best segmentations.

Texts are normalized as the model's own library does it here: a space in front, and
U+2581 for spaces.  No piece holds U+2581 after another character, so the lattice of a
text falls into chunks (a run of U+2581 and what follows it), and its N best paths are
made of the N best paths of its chunks.

* Distinct chunks go through a batched forward Viterbi that keeps the best and the
  second-best score of every node; hashed substrings find their pieces.
* The N-1 chunks with the least loss at their second-best path hold all differences
  between the N best paths of a text.  Their N best paths come from a backward A-star
  search, in which the forward Viterbi scores are the exact remaining score.  As each
  open path stands for at least one whole path of just its estimated score, no more
  than N of them need be kept.

A character without a piece costs 10 more than the worst piece and becomes its UTF-8
bytes.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
N_BEST = 4
UNKNOWN_COST = 10.0
LONG = 96  # chunks above this length go through the search one by one
CACHE = 150_000
BLOCK = 100_000  # characters that go through the search at once: about 30 bytes for each character and piece length
_P = np.uint64(0x9E3779B97F4A7C15)
EDITS = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])))]))


def _code(chars: np.ndarray) -> np.ndarray:
    x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """Scores and ids of a model's pieces; control, unknown and byte pieces aren't part of the lattice."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.table: dict[str, tuple[float, int] | None] = {}
        self.bytes = [0] * 256
        self.surface = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.table[piece] = (model.get_score(i), i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.widths = np.array([len(x) for x in self.surface], dtype=np.int32)
        self.places = np.cumsum(self.widths, dtype=np.int64) - self.widths
        self.pool = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        self.longest = max(map(len, self.table))
        self.unknown = min(s for s, _ in self.table.values() if s > -1e8) - UNKNOWN_COST
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.table)
        self.alone = {c for c in "\n\t" if not any(c in p for p in self.table)}
        self.hashed = []
        for n in range(1, self.longest + 1):
            own = [(p, s, i) for p, (s, i) in self.table.items() if len(p) == n]
            h = self._hashes(np.array([[ord(c) for c in p] for p, _, _ in own], dtype=np.uint32).reshape(-1, n))[:, -1]
            order = np.argsort(h)
            self.hashed.append((h[order], np.array([s for _, s, _ in own])[order], np.array([i for _, _, i in own], dtype=np.int32)[order]))
        for piece in list(self.table):
            for n in range(1, len(piece)):
                self.table.setdefault(piece[:n], None)  # a prefix only
        self.power = np.array([1] + [pow(int(_P), n, 2**64) for n in range(1, self.longest + 1)], dtype=np.uint64)

    @staticmethod
    def _hashes(codes: np.ndarray) -> np.ndarray:
        """Prefix hashes of rows of characters."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        mixed = _code(codes)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _P + mixed[:, j]
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def ahead(self, text: str) -> array:
        """For each position the score of the best path to it: all that the search backward needs, 8 bytes a character."""
        table, most, unknown = self.table, self.longest, self.unknown
        best = array("d", [-math.inf]) * (len(text) + 1)
        best[0] = 0.0
        for i in range(len(text)):
            here, single = best[i], False
            for j in range(i + 1, min(len(text), i + most) + 1):
                found = table.get(text[i:j], 0)
                if found == 0:
                    break
                if found:
                    best[j] = max(best[j], here + found[0])
                    single |= j == i + 1
            if not single:
                best[i + 1] = max(best[i + 1], here + unknown)
        return best

    def ending(self, text: str, j: int) -> list[tuple[int, float, int]]:
        """Start, score and id of the pieces that end at j, the longest first; id -1 is an unknown character."""
        starts = range(max(0, j - self.longest), j)
        found = [(i, *hit) for i in starts if (hit := self.table.get(text[i:j]))]
        return found if found and found[-1][0] == j - 1 else [*found, (j - 1, self.unknown, -1)]

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, as score and ids, the best first; memory is a few numbers a character."""
        if not text:
            return [(0.0, [])]
        ahead = self.ahead(text)
        # open paths: estimated whole score, position, score so far, link to what follows
        opened: list[tuple[float, int, float, tuple | None]] = [(ahead[-1], len(text), 0.0, None)]
        done: list[tuple[float, list[int]]] = []
        while opened and len(done) < n:
            whole, at, so_far, link = opened.pop(0)
            if at == 0:
                ids: list[int] = []
                while link:
                    start, i, link = link
                    ids.extend([i] if i >= 0 else self.fallback(text[start]))
                done.append((whole, ids))
                continue
            for start, s, i in self.ending(text, at):
                estimate = ahead[start] + so_far + s
                if len(opened) >= n - len(done):
                    if estimate <= opened[-1][0]:
                        continue
                    opened.pop()
                place = len(opened)
                while place and opened[place - 1][0] < estimate:
                    place -= 1
                opened.insert(place, (estimate, start, so_far + s, (start, i, link)))
        return done

    def viterbi(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score and loss at the second-best path (inf: there is none) of each chunk; start and size of its best ids in a pool, and the pool."""
        best, loss = np.zeros(len(chunks)), np.full(len(chunks), np.inf)
        start, size = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        pool: list[np.ndarray] = []
        filled = 0
        lengths = np.array([len(c) for c in chunks])
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            rows = 1 if n > LONG else max(1, BLOCK // int(n))
            for a in range(0, len(own), rows):
                part = own[a : a + rows]
                if n > LONG:
                    paths = self.n_best(chunks[part[0]], 2)
                    best[part] = paths[0][0]
                    loss[part] = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
                    flat = np.array(paths[0][1], dtype=np.int32)
                    sizes = np.array([len(flat)])
                else:
                    best[part], loss[part], sizes, flat = self._block([chunks[k] for k in part], int(n))
                size[part], start[part] = sizes, filled + np.cumsum(sizes) - sizes
                pool.append(flat)
                filled += len(flat)
        return best, loss, start, size, np.concatenate([np.empty(0, dtype=np.int32), *pool])

    def _block(self, chunks: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For chunks of one length: best score, loss, number of ids, and all ids one after the other."""
        m = len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(m, n)
        h = self._hashes(codes)
        score, piece = [], []
        for k in range(1, min(n, self.longest) + 1):
            keys, scores, names = self.hashed[k - 1]
            sub = h[:, k:] - h[:, :-k] * self.power[k]
            found = np.searchsorted(keys, sub).clip(max=max(len(keys) - 1, 0))
            hit = keys[found] == sub if len(keys) else np.zeros(sub.shape, dtype=bool)
            none = self.unknown if k == 1 else -np.inf
            score.append(np.where(hit, scores[found] if len(keys) else none, none))
            piece.append(np.where(hit, names[found] if len(keys) else -1, -1))
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back = np.zeros((n + 1, m), dtype=np.int8)
        first[0] = 0
        for j in range(1, n + 1):
            for k in range(min(j, self.longest), 0, -1):
                step = score[k - 1][:, j - k]
                one, two = first[j - k] + step, second[j - k] + step
                second[j] = np.maximum(np.minimum(first[j], one), np.maximum(second[j], two))
                better = one > first[j]
                back[j][better] = k
                first[j] = np.maximum(first[j], one)
        with np.errstate(invalid="ignore"):
            loss = first[n] - second[n]
        rows, pos = np.arange(m), np.full(m, n)
        out = np.full((m, n), -2, dtype=np.int32)
        stacked = np.full((min(n, self.longest) + 1, m, n), -1, dtype=np.int32)
        for k, names in enumerate(piece, 1):
            stacked[k, :, : n - k + 1] = names
        turn = n - 1
        while (live := pos > 0).any():
            k = back[pos[live], rows[live]].astype(np.int64)
            begin = pos[live] - k
            out[live, turn] = stacked[k, rows[live], begin]
            pos[live] = begin
            turn -= 1
        used = out != -2
        sizes, flat = used.sum(axis=1), out[used]
        if (odd := np.flatnonzero((out == -1).any(axis=1))).size:
            split = np.split(flat, np.cumsum(sizes)[:-1])
            for x in odd:
                split[x] = np.array(self._with_bytes(chunks[x], split[x]), dtype=np.int32)
            sizes, flat = np.array([len(x) for x in split]), np.concatenate(split)
        return first[n], loss, sizes, flat

    def _with_bytes(self, chunk: str, row: np.ndarray) -> list[int]:
        found, pos = [], 0
        for i in row.tolist():
            if i >= 0:
                found.append(i)
                pos += len(self.surface[i].decode())
            else:
                found.extend(self.fallback(chunk[pos]))
                pos += 1
        return found

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return [text]
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if "\n" in self.alone else [text]):
            if k:
                out.append("\n")
            head, *words = line.split(SPACE)
            if head:
                out.append(head)
            if "" not in words:
                out.extend([SPACE + w for w in words])
                continue
            run = ""
            for w in words:
                run += SPACE
                if w:
                    out.append(run + w)
                    run = ""
            if run:
                out.append(run)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        """Texts of rows of ids, by gathering the bytes of all their pieces at once; null for null."""
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        counts = np.array(pa.compute.fill_null(pa.compute.list_value_length(rows), 0))
        sizes = self.widths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        raw = flat.tobytes()
        out = []
        for a, b, some in zip(starts.tolist(), stops.tolist(), rows.is_valid().to_pylist()):
            a += raw[a : a + 1] == b" " and b > a  # the space that encoding put in front
            out.append(raw[a:b].decode("utf-8", "replace") if some else None)
        return pa.array(out, pa.string())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class _Encoder:
    """Encodes batches of texts; best paths of distinct chunks are kept between them."""

    def __init__(self, path: str, n: int):
        self.pieces, self.n = pieces(path), n
        self.others: dict[str, list[tuple[float, list[int]]]] = {}
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.score, self.loss = np.empty(0), np.empty(0)
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.int32)

    def learn(self, new: list[str]) -> None:
        score, loss, start, size, pool = self.pieces.viterbi(new)
        self.start, self.size = np.concatenate([self.start, len(self.pool) + start]), np.concatenate([self.size, size])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.pool = np.concatenate([self.pool, pool])

    def alternatives(self, chunk: str, k: int) -> list[tuple[float, list[int]]]:
        """Loss and ids of the n-1 next best paths of a chunk."""
        found = self.others.get(chunk)
        if found is None:
            if len(self.others) > CACHE // 10:
                self.others.clear()
            own = self.pool[self.start[k] : self.start[k] + self.size[k]].tolist()
            paths = self.pieces.n_best(chunk, self.n)
            found = self.others[chunk] = [(paths[0][0] - s, ids) for s, ids in paths if ids != own][: self.n - 1]
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """Sizes, ids of all texts one after the other, and the n best of each."""
        if len(self.index) > CACHE:
            self.reset()
        split = [self.pieces.chunks(t or "") for t in texts]
        index, before = self.index, len(self.index)
        at = [np.array([index.setdefault(c, len(index)) for c in x], dtype=np.int64) for x in split]
        if len(index) > before:
            self.learn(list(itertools.islice(reversed(index), len(index) - before))[::-1])
        flat = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
        sizes = self.size[flat]
        ends = np.cumsum(sizes)
        take = np.repeat(self.start[flat] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        counts = np.array([int(self.size[x].sum()) for x in at], dtype=np.int64)
        return counts, self.pool[take], [self.ranked(x, s) for x, s in zip(at, split)]

    def ranked(self, at: np.ndarray, chunks: list[str]) -> list[dict]:
        total = float(self.score[at].sum())
        out = [{"score": total, "edits": []}]
        if self.n == 1 or not len(at):
            return out
        loss = self.loss[at]
        few = np.argsort(loss, kind="stable")[: self.n - 1] if len(at) < 64 else np.sort(np.argpartition(loss, self.n - 1)[: self.n - 1])
        few = few[np.isfinite(loss[few])]
        place = np.cumsum(self.size[at]) - self.size[at]
        mixes: list[tuple[float, list]] = [(0.0, [])]
        for k in few:
            options = [(0.0, None), *self.alternatives(chunks[k], at[k])]
            mixes = sorted(((a + b, [*edits, (k, ids)] if ids is not None else edits) for a, edits in mixes for b, ids in options), key=lambda x: x[0])[: self.n]
        for lost, edits in [x for x in mixes if x[1]][: self.n - 1]:
            spans = [{"start": int(place[k]), "end": int(place[k] + self.size[at[k]]), "ids": ids} for k, ids in edits]
            out.append({"score": total - lost, "edits": sorted(spans, key=lambda e: e["start"])})
        return out


def _edited(ids: np.ndarray, edits: list[dict]) -> np.ndarray:
    """Ids of a segmentation that ``edits`` make from the best one."""
    parts, at = [], 0
    for e in edits:
        parts += [ids[at : e["start"]], np.array(e["ids"], dtype=np.int32)]
        at = e["end"]
    return np.concatenate([*parts, ids[at:]])


def encoded(docs: DataFrame, path: str = MODEL, n: int = N_BEST, text: str = "text", verify: bool = False, verify_last: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (the best segmentation) and ``n_best``; to ``verify`` adds ``round_trip``.

    ``round_trip`` says whether the ids decode to the text, with spaces for U+2581; with
    ``verify_last`` those of the last segmentation must too.

    ``n_best`` has up to n segmentations, the best first: score, and the edits (spans
    of token_ids and what stands there instead) that make it from the best.  A null or
    empty text has no tokens and one empty segmentation of score 0.  All other columns
    pass through; existing ones of these names are replaced.
    """
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_best", EDITS), *[T.StructField("round_trip", T.BooleanType())] * verify]
    rest = docs.drop(*(f.name for f in added))
    schema = T.StructType([*rest.schema.fields, *added])

    def decoded_to(table: Pieces, rows: pa.ListArray, texts: list[str | None]) -> list[bool]:
        return [x.as_py() == (t or "").replace(SPACE, " ") for x, t in zip(table.decode_all(rows), texts)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path, n)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
        for whole in batches:
            a = 0
            while a < len(whole):  # parts of about a million characters
                b, held = a, 0
                while b < len(whole) and (b == a or held < 1_000_000):
                    held += len(whole.column(text)[b].as_py() or "")
                    b += 1
                batch = whole.slice(a, b - a)
                texts = batch.column(text).to_pylist()
                counts, ids, ranked = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                found = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(ranked, kind)]
                if verify:
                    same = decoded_to(encoder.pieces, found[0], texts)
                    if verify_last:
                        last = [_edited(ids[x:y], best[-1]["edits"]) for x, y, best in zip(offsets, offsets[1:], ranked)]
                        ends = np.r_[0, np.cumsum([len(x) for x in last])].astype(np.int32)
                        other = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(last), pa.int32()))
                        same = [x and y for x, y in zip(same, decoded_to(encoder.pieces, other, texts))]
                    found.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[f.name for f in schema])
                a = b

    return rest.mapInArrow(encode, schema)


def decoded(tokens: Column, path: str = MODEL) -> Column:
    """Text of token ids; null for null.  A U+2581 of the original text comes back as a space."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        table = pieces(path)
        parts = [table.decode_all(ids.slice(a, 512)) for a in range(0, len(ids), 512)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode(tokens)


def with_edits(tokens: Column, edits: Column) -> Column:
    """The token ids of an alternative segmentation."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda x, e: F.struct(e["end"].alias("at"), F.concat(x["out"], F.slice(tokens, x["at"] + 1, e["start"] - x["at"]), e["ids"]).alias("out"))
    done = F.aggregate(edits, start, step)
    return F.concat(done["out"], F.slice(tokens, done["at"] + 1, F.size(tokens)))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the best and the other segmentations, and whether both the best and the last decode to the text."""
    # decoded in the task that encodes: a second one beside it would load the model again
    out = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), verify=True, verify_last=True)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        F.col("n_best")[0]["score"].alias("score"),
        F.array_join(F.transform("n_best", lambda x: x["score"].cast("decimal(38,3)").cast("string")), ",").alias("n_best_scores"),
        F.xxhash64("n_best").alias("n_best_hash"),
        "round_trip",
    )
