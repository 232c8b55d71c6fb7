"""Repair of conversations whose turns are lost, empty, repeated, cut or given to the wrong role.

A conversation keeps a subsequence of its rows, some with another role, so that roles
run ``system? (user assistant)+``.  Between two kept rows every row is deleted, which
prefix sums price; the pair of their roles says what must be inserted.  So what comes
after a kept row costs, for each role of the next kept row, the least of one running
minimum, and a conversation of n rows takes 3 n steps from its end to its start.

Of equally cheap repairs the one with the ASCII-least audit is taken, which needs no
comparison of audits: after the same kept row, repairs first differ where one deletes
longer, and D comes before I, K and R; those that next keep the same row differ by an
insert before it, and I comes before K and R; then K comes before R.

Rows meet in one stream, sorted by conversation and turn.  First come their codes, which
are all that the repair needs to hold; then the texts pass by in the same order beside
the audit, and are digested as they pass.  A conversation has one audit and one digest,
so one task streams it, however long it is.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pin, read

#: Costs of a repair.
REROLE, DELETE, CUT, INSERT = 1, 2, 5, 5
NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Inserts from one role to the next one; "" is the start.
BEFORE = {"": {"s": 0, "u": 0, "a": 1}, "s": {"u": 0, "a": 1}, "u": {"a": 0, "u": 1}, "a": {"u": 0, "a": 1}}
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
#: A row's code is its role's place here plus 4 times its fault's place.
INITIALS, KINDS = ("s", "u", "a", ""), ("", *FAULTS)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows with the fault that crc32 of ``conv_id:turn`` gives them.

    Of 20 faults, 0 drops the row (no copies), 1 empties its text, 2 removes its full
    stops, exclamation and question marks, 3 repeats it (two copies) and 4 gives it to
    the user.  Null texts, roles and parts of the key are a space.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key) % 20
    text, role = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in ("text", "role"))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select(
        F.col("`conv_id`").alias("conv_id"),
        F.col("`turn`").alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, copy, code`` of rows of ``damaged``; rows without copies stay, with a null code.

    A row's first fault counts: blank, duplicate (its role and text stand earlier in the
    conversation), truncated.  Texts are compared by their SHA-256, which also orders rows
    of one turn and role.
    """
    solid = F.rtrim(F.translate("text", "\x09\x0a\x0b\x0c\x0d", "     "))
    fault = F.when(solid == "", 1).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), fault.alias("fault"), "copies")
    kept = rows.withColumn("copy", F.explode(F.when(F.col("copies") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("copies")))))
    order = Window.partitionBy("conv_id", "role", "digest", F.col("copies") == 0).orderBy(F.asc_nulls_first("turn"), "copy")
    again = (F.row_number().over(order) > 1) & (F.col("fault") != 1)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("copies") > 0, place + 4 * F.when(again, 2).otherwise(F.col("fault")))
    return kept.withColumn("code", code.cast("int")).select("conv_id", "turn", "role", "digest", "copy", "code")


def repair(codes: bytes) -> tuple[int, str, str]:
    """Least cost of the rows' codes, its audit, and for each letter of the audit the role it leaves (blank for deletions)."""
    n = len(codes)
    # of keeping a row with a role: the next kept row and its role; of each role: least cost of keeping a row with it, and the row
    following, then = {r: array("q", bytes(8 * n)) for r in NAMES}, {r: bytearray(n) for r in NAMES}
    best: dict[str, tuple[int, int]] = {}

    def letter(at: int, role: str) -> str:
        return "K" if INITIALS[codes[at] & 3] == role else "R"

    def onward(role: str, at: int) -> tuple[int, int, int, str, str]:
        """The best way on after ``role``, where rows from ``at`` on are left; row n is the end."""
        ways = [(DELETE * (n - at) + INSERT * AFTER[role], -n, 0, "", " ")]
        for role_then, inserts in BEFORE[role].items():
            if role_then in best:
                cost, place = best[role_then]  # with the deletion of all rows before it
                ways.append((cost - DELETE * at + INSERT * inserts, -place, -inserts, letter(place, role_then), role_then))
        return min(ways)

    for at in range(n - 1, -1, -1):
        kind, made = KINDS[codes[at] >> 2], []
        if kind in ("blank", "duplicate"):
            continue
        for role in NAMES:
            kept = letter(at, role)
            if kept == "K" or role != "s":
                cost, place, _, _, after = onward(role, at + 1)
                following[role][at], then[role][at] = -place, ord(after)
                made.append((role, cost + CUT * (kind == "truncated") + REROLE * (kept == "R") + DELETE * at))
        for role, cost in made:
            if role not in best or cost < best[role][0]:  # of equal ones the later row stays
                best[role] = cost, at
    cost, place, _, _, role = onward("", 0)
    place, before, at, audit, roles = -place, "", 0, [], []
    while True:
        inserts = AFTER[before] if place == n else BEFORE[before][role]
        audit.append("D" * (place - at) + "I" * inserts)
        roles.append(" " * (place - at))
        for _ in range(inserts):
            before = "a" if before == "u" else "u"
            roles.append(before)
        if place == n:
            return cost, "".join(audit), "".join(roles)
        audit.append(letter(place, role))
        roles.append(role)
        before, at, place, role = role, place + 1, following[role][place], chr(then[role][place])


SUMMARY = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string"


def repaired(codes: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of ``coded`` rows; a task holds about 30 bytes for each row of one conversation."""

    def summed(key: str | None, held: bytearray, turns: tuple) -> dict:
        letters = [INITIALS[c & 3] for c in held]
        kinds = [KINDS[c >> 2] for c in held]
        cost, audit, roles = repair(bytes(held))
        low, high, distinct = turns
        return {
            "conv_id": key, "gaps": 0 if low is None else high - low + 1 - distinct, **{k: kinds.count(k) for k in FAULTS},
            "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:])), "cost": cost, "audit": audit, "roles": roles,
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["conv_id"], b["turn"], b["code"]))
        done, held = [], 0
        for key, group in groupby(rows, key=lambda r: r[0]):
            codes, last, low, high, distinct = bytearray(), None, None, None, 0
            for _, turn, code in group:
                if code < 0:
                    continue
                codes.append(code)
                if turn is not None and turn != last:
                    last, high, distinct = turn, int(turn), distinct + 1
                    low = high if low is None else low
            done.append(summed(key, codes, (low, high, distinct)))
            held += 2 * len(codes) + 100
            if held > 8 << 20:
                yield pd.DataFrame(done)
                done, held = [], 0
        if done:
            yield pd.DataFrame(done)

    rows = codes.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "copy")
    whole = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  integers with nulls would be floats
    return rows.select(whole("conv_id"), whole("turn"), F.coalesce("code", F.lit(-1)).alias("code")).mapInPandas(run, SUMMARY)


def edited(rows: DataFrame, summary: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over each partition's conversations: keys, and iterators of the turn, role and text of rows after repair.

    ``rows`` is of ``damaged``, ``summary`` of ``repaired``.  A conversation's audit comes
    first in the stream and its rows after it, so a task holds the audit and a batch of rows.
    """

    def turns(audit: str, roles: str, group: Iterator[tuple]) -> Iterator[tuple]:
        for edit, role in zip(audit, roles):
            turn, name, text = (None, None, "") if edit == "I" else next(group)[1:4]
            if edit != "D":
                yield turn, name if edit == "K" else NAMES[role], text

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for b in batches for r in zip(b["conv_id"], b["turn"], b["role"], b["text"]))

        def conversations() -> Iterator[tuple]:
            for key, group in groupby(stream, key=lambda r: r[0]):
                _, _, audit, roles = next(group)
                yield key, turns(audit, roles, group)

        return run(conversations())

    texts = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    texts = texts.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("string").alias("turn"), "role", "text", "copy", F.col("turn").alias("by"), F.sha2("text", 256).alias("digest"))
    none = F.lit(None).cast(rows.schema["turn"].dataType)
    first = summary.select(F.col("conv_id").cast(rows.schema["conv_id"].dataType), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("turn"), F.col("audit").alias("role"), F.col("roles").alias("text"), F.lit(0).alias("copy"), none.alias("by"), F.lit("").alias("digest"))
    both = texts.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("by"), "role", "digest", "copy")
    return both.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text").mapInPandas(task, schema)


def repaired_rows(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text`` of repaired conversations, numbered by ``place``; inserted rows have no turn."""
    schema = "conv_id string, place long, turn string, role string, text string"

    def run(conversations: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for key, turns in conversations:
            for place, (turn, role, text) in enumerate(turns):
                out.append((key, place, turn, role, text))
                held += len(text) + 64
                if held > 8 << 20:
                    yield pd.DataFrame(out, columns=["conv_id", "place", "turn", "role", "text"])
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "place", "turn", "role", "text"])

    return edited(rows, summary, run, schema)


def repaired_digests(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of each conversation's ``role:text`` lines, joined by newlines."""

    def run(conversations: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out = []
        for key, turns in conversations:
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append((key, digest.hexdigest()))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])

    return edited(rows, summary, run, "conv_id string, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """SUMMARY without roles, and ``repaired_sha256``, of each conversation of ``damaged`` rows.

    Rows stand by turn, nulls first, then by role and by SHA-256 of the text.  Rows without
    conv_id are one conversation.  A conversation whose rows are all dropped has zeros, an
    empty audit and the digest of nothing; no rows give no conversations.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    summary = scratch.table(repaired(coded(rows)))
    found = repaired_digests(rows, summary).withColumnRenamed("conv_id", "of")
    joined = summary.join(found, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of", "roles")
    out = pin(joined.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType)))
    scratch.close()
    return out


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same repair as a recursion from the last row to the first, over whole audits of all four states."""
    cut = "CASE WHEN kind = 'truncated' THEN 5 ELSE 0 END"
    keep = lambda r, name: f"""CASE WHEN kind IN ('blank', 'duplicate') {"OR initial <> 's'" if r == "s" else ""} THEN NULL
      WHEN initial = '{r}' THEN {{c: p.{r}.c + {cut}, d: 'K' || p.{r}.d, x: list_concat([role || ':' || text], p.{r}.x)}}
      ELSE {{c: p.{r}.c + 1 + {cut}, d: 'R' || p.{r}.d, x: list_concat(['{name}:' || text], p.{r}.x)}} END AS k{r}"""  # noqa: E731
    gone = lambda q: f"{{c: {q}.c + 2, d: 'D' || {q}.d, x: {q}.x}}"
    put = lambda k, name: f"CASE WHEN {k} IS NOT NULL THEN {{c: {k}.c + 5, d: 'I' || {k}.d, x: list_concat(['{name}:'], {k}.x)}} END"
    least = lambda *ways: "list_min(list_filter([" + ", ".join(ways) + "], lambda w: w IS NOT NULL))"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''),
      lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))),
    lambda r, bit: xor(r >> 1, (xor(r, bit) & 1) * 3988292384)), 4294967295) % 20 AS fault FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS initial FROM hurt
), faulty AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS kind
  FROM placed
), p AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {{c: 0::BIGINT, d: '', x: []::VARCHAR[]}} AS t,
    {{c: 10::BIGINT, d: 'II', x: ['user:', 'assistant:']}} AS s, {{c: 5::BIGINT, d: 'I', x: ['assistant:']}} AS u, {{c: 0::BIGINT, d: '', x: []::VARCHAR[]}} AS a FROM faulty
  UNION ALL
  SELECT conv_id, i, {least(gone("t"), "ks", "ku", put("ka", "user"))}, {least(gone("s"), "ku", put("ka", "user"))},
    {least(gone("u"), "ka", put("ku", "assistant"))}, {least(gone("a"), "ku", put("ka", "user"))}
  FROM (SELECT f.conv_id, f.i, p.t, p.s, p.u, p.a, {keep("s", "system")},
    {keep("u", "user")}, {keep("a", "assistant")}
    FROM p JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i - 1) AS q
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
    count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), done AS (SELECT conv_id, t FROM p WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(t.c, 0) AS cost, coalesce(t.d, '') AS audit, sha256(coalesce(array_to_string(t.x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted AS k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
