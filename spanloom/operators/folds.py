"""Left folds over one transcript at a time: captions, sentences, blocks, chapters, questions.

Each depends on what it has kept so far, so a source is folded by one task; parallelism
is the number of sources.  Spark sorts the rows, and a task streams them through the fold.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = "start double, end double, text string, n_segments int, speakers array<string>, overlap_suspected boolean, timing_ambiguous boolean"
BLOCK = "index int, start double, end double, n_sentences int, text string"
CHAPTER = "index int, start double, end double, segment_start int, segment_end int, has_qa_bridge boolean"


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Applies ``step`` to the rows of each key in order; ``schema`` describes what it yields beside the key.

    Spark deals the keys over partitions and sorts them, spilling where it must.  A task
    streams its partition, so it holds what the step keeps open and a batch, not a key.
    """
    kind = dict(df.dtypes)[key]
    names = [x.strip().split()[0] for x in _split(schema)]

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            plain = batch.astype(object)
            yield from plain.where(plain.notna(), None).to_dict("records")

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([f[i] for f in found], dtype=object) for i, n in enumerate([key, *names])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for name, rows in itertools.groupby(rows_of(batches), lambda r: r[key]):
            for made in step(rows):
                found.append((name, *(made[n] for n in names)))
                if len(found) >= 5000:
                    yield frame(found)
                    found = []
        yield frame(found)

    dealt = df.repartition(key).sortWithinPartitions(key, *(F.asc_nulls_last(c) for c in order))
    return dealt.mapInPandas(run, f"{key} {kind}, {schema}")


def _split(schema: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def _stopped(text: str) -> bool:
    return text.rstrip()[-1:] in tuple(".!?")


def sentences(pause: float = 0.8, longest: float = 30.0, words: int = 5) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Closes a sentence at a pause, at a length, or at a stop after enough words."""

    def close(held: list[dict]) -> dict:
        speakers = list(dict.fromkeys(s for r in held if (s := (r.get("speaker") or "").strip())))
        overlap = any(bool(r.get("overlap_suspected")) for r in held)
        unsure = any(r.get("timing_confidence") is not None and (r["timing_confidence"] or 1.0) < 0.6 for r in held)
        return {"start": held[0]["start"], "end": held[-1]["end"], "text": " ".join(str(r["text"] or "") for r in held).strip(), "n_segments": len(held), "speakers": speakers, "overlap_suspected": overlap, "timing_ambiguous": overlap or unsure}

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []
        last = 0.0
        for r in rows:
            if r["start"] is None or r["end"] is None or r["start"] < 0 or r["end"] <= r["start"]:
                continue
            if held and last > 0 and r["start"] - last > pause:
                yield from (x for x in [close(held)] if x["text"])
                held = []
            held.append(r)
            last = r["end"]
            text = " ".join(str(x["text"] or "") for x in held).strip()
            if r["end"] - held[0]["start"] >= longest or (_stopped(text) and len(text.split()) >= words):
                if text:
                    yield close(held)
                held = []
        if held:
            yield from (x for x in [close(held)] if x["text"])

    return step


def blocks(longest: float = 30.0, shortest: float = 18.0) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Closes a block at a length, or earlier at a stop."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []
        index = 0
        for r, after in _with_next(rows):
            held.append(r)
            length = r["end"] - held[0]["start"]
            if length >= longest or (length >= shortest and _stopped(r["text"])) or after is None:
                yield {"index": index, "start": held[0]["start"], "end": r["end"], "n_sentences": len(held), "text": " ".join(x["text"] for x in held)}
                held = []
                index += 1

    return step


def chapters(target: float = 85.0, longest: float = 180.0, hard_gap: float = 8.0, soft_gap: float = 1.0, most: int | None = None) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Ends a chapter at a long gap, past the target at a natural end, or at the longest length; never inside a bridge.

    Rows may say by ``end_inside`` and ``start_inside`` whether their ends lie in a bridge of
    question and answer (``clips.bridged_chapters`` finds this by joins), or the first one
    carries all ``bridges`` of the source.  All chapters are given, or the first ``most``.
    """

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        bridges: list[tuple] = []
        inside = lambda t: any(a <= t <= b for a, b in bridges)
        start, first, index = None, 0, 0
        for k, (r, after) in enumerate(_with_next(rows)):
            if k == 0 and r.get("bridges") is not None:
                bridges = [(b["start"], b["end"]) for b in r["bridges"]]
            start = r["start"] if start is None else start
            ends = after is None
            if after is not None and not (r.get("end_inside") or after.get("start_inside") or inside(r["end"]) or inside(after["start"])):
                gap, length = max(0.0, after["start"] - r["end"]), r["end"] - start
                turn = bool(r.get("speaker")) and bool(after.get("speaker")) and r["speaker"] != after["speaker"]
                ends = gap >= hard_gap or length >= longest or (length >= target and (_stopped(str(r["text"] or "")) or gap >= soft_gap or turn))
            if not ends:
                continue
            if most is None or index < most:
                b = r["end"]
                yield {"index": index, "start": start, "end": b, "segment_start": first, "segment_end": k, "has_qa_bridge": any(x < b and start < y for x, y in bridges)}
            start, first, index = None, k + 1, index + 1

    return step


def _with_next(rows: Iterator[dict]) -> Iterator[tuple[dict, dict | None]]:
    """Each row with the one after it."""
    held = None
    for r in rows:
        if held is not None:
            yield held, r
        held = r
    if held is not None:
        yield held, None


def rolled(last: dict | None, row: dict) -> tuple[dict | None, dict | None]:
    """The caption that is done once ``row`` has come, if any, and the open one: ``start, end, words``.

    A caption that repeats the end of the open one keeps only its new words, and stretches
    that one; if nothing is new, it goes.  An overlap is the whole open caption, or three
    words or more.
    """
    words = str(row["text"] or "").split()
    if not words:
        return None, last
    if last is None:
        return None, {"start": row["start"], "end": row["end"], "words": words}
    new = words
    old, low = [w.lower() for w in last["words"]], [w.lower() for w in words]
    sizes = [len(old)] if low[: len(old)] == old and (len(old) >= 2 or len(low) > 1 or low == old) else []
    sizes += [n for n in range(min(len(old), len(low)), 2, -1) if old[-n:] == low[:n]]
    if sizes:
        new = words[sizes[0] :]
        if last["end"] is not None and row["end"] is not None:
            last = last | {"end": max(last["end"], row["end"])}
    return (last, {"start": row["start"], "end": row["end"], "words": new}) if new else (None, last)


def said(caption: dict) -> dict:
    return {"start": caption["start"], "end": caption["end"], "text": " ".join(caption["words"])}


def rolling_captions(rows: Iterator[dict]) -> Iterator[dict]:
    """Captions without what they repeat of the one before: see ``rolled``."""
    last: dict | None = None
    for r in rows:
        done, last = rolled(last, r)
        if done is not None:
            yield said(done)
    if last is not None:
        yield said(last)


QA = "start double, end double, question_segment int, n_responses int, speaker_boundary boolean, basis string, confidence double"


def question_answers(ahead: int = 12, longest: float = 32.0, least: float = 8.0, most: int | None = None) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """For each question the answer that follows: up to a new question after 6 s, a second change of speaker, or a length.

    All are given, or the first ``most``.
    """

    def answer(k: int, q: dict, following: list[dict]) -> dict | None:
        asker, answerer, basis, found = q.get("speaker") or "", "", "no_speakers", []
        for r in following:
            who = r.get("speaker") or ""
            if r["is_question"] and found and r["start"] - q["start"] >= 6:
                break
            if answerer and who and who != answerer:
                basis = "second_change"
                break
            found.append(r)
            if asker and who and who != asker:
                answerer, basis = who, "change_of_speaker"
            if r["end"] - q["start"] >= longest:
                break
        if not found or found[-1]["end"] - q["start"] < least:
            return None
        sure = 0.5 + min(0.16, len(found) * 0.02) + (0.12 if answerer else -0.12)
        return {"start": max(0.0, q["start"] - 2), "end": found[-1]["end"], "question_segment": k, "n_responses": len(found), "speaker_boundary": bool(answerer), "basis": basis, "confidence": round(max(0.2, min(0.98, sure)), 3)}

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        held: deque[dict] = deque()
        made, k, rows = 0, 0, iter(rows)
        while True:
            held.extend(itertools.islice(rows, ahead + 1 - len(held)))
            if not held:
                return
            q = held.popleft()
            found = answer(k, q, list(held)) if q["is_question"] and (most is None or made < most) else None
            if found:
                made += 1
                yield found
            k += 1

    return step


def ordered_text(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The texts of a key joined in order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("full_text"))
