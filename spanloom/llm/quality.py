"""Quality scores by Bradley-Terry pairwise ranking.

A text is a vector of surface statistics, each also bent at quantile knots.  A
document's strength is linear in them; the odds that one document of a pair is the
better are the logistic function of the difference.  Preference pairs come from a
bounded sample of labelled documents (one of label 1, one of label 0).  The threshold
is the strength at the quantile where the share of label 0 lies, over all labelled
documents that may be learned from.  Each text is measured once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pin, read

#: At most so many labelled documents are fetched to fit the model: those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000
#: Preference pairs drawn for each sampled document of the rarer label, and in all.
PAIRS_EACH, MAX_PAIRS = 40, 40_000
#: Relative accuracy of the threshold's quantile is one in this many.
QUANTILE_PARTS = 100_000
STATISTICS = "__statistics"
KNOTS = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)
THRESHOLD = 0.3

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "symbols", "bars", "exclamations", "upper", "digits", "spaces", "non_ascii",
    "sentence_ends", "commas", "distinct_words", "distinct_adjusted", "top_word", "same_as_last", "same_as_second_last", "distinct_pairs", "short_words", "one_char_words",
    "lines_repeated", "line_chars", "compressed", "upper_words", "capitalized_words", "long_words", "repeated_run",
)


def features(text: str | None) -> np.ndarray:
    """The statistics of one text, in the order of NAMES; all are finite, for an empty text too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    at = lambda chars: int(hist[list(chars)].sum()) / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same1 = sum(map(bytes.__eq__, words, words[1:])) / m
    same2 = sum(map(bytes.__eq__, words, words[2:])) / m
    capital = sum(65 <= w[0] <= 90 for w in words) / m
    # longest repetition of one word in a row
    longest = run = 0
    if same1 > 0:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 0
            longest = max(longest, run)
    return np.array([
        math.log1p(len(raw)), math.log1p(len(words)), lengths.mean(), lengths.std(), at(b"#$%&*@^~=_<>{}[]\\/+"), at(b"|"), at(b"!"), int(hist[65:91].sum()) / n, int(hist[48:58].sum()) / n, at(b" \t"), int(hist[128:].sum()) / n,
        at(b".?"), at(b",;:"), len(counts) / m, len(counts) / m + 0.06 * math.log(m), max(counts.values(), default=0) / m, same1, same2, pairs, float((lengths <= 3).mean()), float((lengths <= 1).mean()),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(raw) / max(1, len(lines))), len(zlib.compress(raw, 1)) / n, sum(w.isupper() for w in words) / m, capital, float((lengths > 12).mean()), math.log1p(longest),
    ])


@dataclass
class Model:
    knots: np.ndarray  # a row for each statistic
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float

    def bent(self, x: np.ndarray) -> np.ndarray:
        bends = np.maximum(0, x[:, :, None] - self.knots[None]).reshape(len(x), -1)
        return (np.concatenate([x, bends], axis=1) - self.mean) / self.scale

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.bent(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and THRESHOLD exactly at the cut."""
        z = self.slope * (self.strength(x) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(z: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float, steps: int = 25, block: int = 4096) -> np.ndarray:
    """Weights of least logistic loss over pairs of rows of z, with a ridge penalty, by Newton's steps; differences are made a block at a time."""
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        slope, curve = -penalty * w, penalty * np.eye(z.shape[1])
        for a in range(0, len(better), block):
            x = z[better[a : a + block]] - z[worse[a : a + block]]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (1 - p)
            curve += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """A model from statistics x and labels y.  Without both labels all weights are 0, and every score is THRESHOLD."""
    dims = len(NAMES)
    x = x.reshape(-1, dims)
    knots = np.quantile(x, KNOTS, axis=0).T if len(x) else np.zeros((dims, len(KNOTS)))
    wide = dims * (1 + len(KNOTS))
    model = Model(knots, np.zeros(wide), np.ones(wide), np.zeros(wide), 1.0, 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = model.bent(x)
    model.mean, spread = z.mean(axis=0), z.std(axis=0)
    model.scale = np.where(spread > 1e-9, spread, np.inf)
    z = model.bent(x)
    rng = np.random.default_rng(seed)
    count = min(MAX_PAIRS, PAIRS_EACH * min(len(good), len(bad)))
    model.weights = _logistic(z, rng.choice(good, count), rng.choice(bad, count), penalty=0.002 * count)
    model.cut = float(np.quantile(model.strength(x), len(bad) / (len(good) + len(bad))))
    return model


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its text, to be written before they are used more than once; null is as an empty text."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        x = [features(t.as_py()) for t in texts]
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0)))

    return docs.withColumn(STATISTICS, measure(F.col("`text`")))


def _strengths(model: Model, rows: DataFrame):
    """A function of a column of statistics: the strength, or with ``score`` the score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 600 numbers

    def of(statistics: Column, score: bool) -> Column:
        @F.arrow_udf("double")
        def strength(batch: pa.Array) -> pa.Array:
            out = [np.empty(0)]
            for a in range(0, len(batch), 1000):
                x = batch.slice(a, 1000).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                out.append(shared.value.score(x) if score else shared.value.strength(x))
            return pa.array(np.concatenate(out))

        return strength(statistics)

    return of


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of labelled documents whose fold (crc32 of the id's text mod 5) is not 0; ``docs`` as ``measured`` makes it.

    Weights are fitted on at most ``rows`` of them.  The threshold is from all.
    Labels that are null or not 0 or 1 are left out; an id with both labels counts
    for both.
    """
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`quality`").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).distinct()
    learned = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(STATISTICS).alias("x")).join(known, "doc_id")
    sample = learned.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(rows).toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy() if sample.num_rows else np.empty(0)
    model = fit(x, sample.column("quality").to_numpy())
    if model.weights.any():
        strength = _strengths(model, docs)(F.col("x"), False)
        strengths = pin(learned.select("quality", strength.alias("s")))
        share = strengths.agg(F.avg(1 - F.col("quality")).alias("share")).first()["share"]
        at = strengths.agg(F.percentile_approx("s", share, QUANTILE_PARTS).alias("s")).first()["s"]
        # half-way between the last strength below the cut and the first above it
        ends = strengths.agg(F.max(F.when(F.col("s") <= at, F.col("s"))).alias("low"), F.min(F.when(F.col("s") > at, F.col("s"))).alias("high")).first()
        model.cut = (ends["low"] + (ends["low"] if ends["high"] is None else ends["high"])) / 2
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, as ``measured`` makes it, with score and predicted; these come from the text alone.

    Columns of these names are replaced; all others pass through, but for the statistics.
    """
    score = _strengths(model, docs)(F.col(STATISTICS), True)
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(STATISTICS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pin(measured(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
