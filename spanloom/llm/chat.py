"""Chat formatting on tokens: encoded segments, reserved ids between them, loss masks.

The template is ``[INST]user[/INST]``, ``<s>assistant</s>``, ``<<SYS>>system<</SYS>>``
and ``<|role|>other<|text|>text<|end|>`` for any other role.  Each of these marks is
one reserved id past the byte-level vocabulary.  Texts are encoded by themselves, so
no text can make a reserved id; control strings in them are escaped as well, so none
can be mistaken for a mark in the formatted text:  ``\\`` becomes ``\\\\``, and a
control string gets ``\\|`` after its first character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern that this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIRST_RESERVED = 50_260
MARKS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
IDS = {mark: FIRST_RESERVED + i for i, mark in enumerate(MARKS)}
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|end|>")
CONTROL = r"(<|\[)(/?INST\]|/?s>|</?SYS>>|\|role\|>|\|text\|>|\|end\|>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\|$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:\||(\\))", "$1")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts: Column, path: str) -> Column:
    @F.pandas_udf("array<int>")
    def encode(batch: pd.Series) -> pd.Series:
        return pd.Series([encoding(path).encode_ordinary(x) for x in batch], dtype=object)

    return encode(texts)


def format_chats(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """``conv_id, token_ids, loss_spans, loss_mask, formatted_chars`` for each conversation.

    ``rows`` has ``conv_id, turn, role, text``.  Turns stand by turn, then role, then
    text, nulls first; repeated rows are repeated turns.  A null text or role is
    empty; rows without conv_id make one conversation of their own.  A conversation is
    one row of the result, so its tokens must fit a task's memory; that holds for the
    rows without conv_id too, so filter them out before where they may be many.
    ``loss_spans`` has the first and end position of each assistant text, without
    marks: they come from prefix sums of the segments' lengths.  ``loss_mask`` is 1 in
    these spans and 0 elsewhere.  No rows give no conversations.
    """
    role = F.coalesce("role", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("known", F.col("role").isin(*ROLES))
    mark = lambda which: F.create_map(*(F.lit(x) for r, m in ROLES.items() for x in (r, m[which])))
    pick = lambda which: F.coalesce(F.try_element_at(mark(which), F.col("role")), F.lit(OTHER[which]))
    reserved = F.create_map(*(F.lit(x) for m, i in IDS.items() for x in (m, i)))
    turns = turns.withColumns({"open": pick(0), "close": pick(1), "safe": escaped(F.col("text")), "safe_role": F.when(~F.col("known"), escaped(F.col("role"))).otherwise("")})
    chars = F.length("open") + F.length("safe") + F.length("close") + F.when(F.col("known"), 0).otherwise(F.length("safe_role") + len("<|text|>"))
    turns = turns.withColumn("chars", chars.cast("long"))
    turns = turns.withColumns({"ids": encoded(F.col("safe"), path), "role_ids": encoded(F.col("safe_role"), path)})
    head = F.concat(F.array(reserved[F.col("open")]), F.when(F.col("known"), F.array().cast("array<int>")).otherwise(F.concat("role_ids", F.array(F.lit(IDS["<|text|>"])))))
    turns = turns.withColumns({"head": head, "segment": F.concat(head, "ids", F.array(reserved[F.col("close")]))})
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.coalesce(F.sum(F.size("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumns({"pos": F.row_number().over(order), "start": before + F.size("head")})
    span = F.when(F.col("role") == "assistant", F.struct("start", (F.col("start") + F.size("ids")).alias("end")))
    parts = F.sort_array(F.collect_list(F.struct("pos", "segment", span.alias("span"))))
    chats = turns.groupBy("conv_id").agg(parts.alias("parts"), F.sum("chars").alias("formatted_chars"))
    spans = F.filter(F.col("parts.span"), lambda s: s.isNotNull())
    chats = chats.select("conv_id", F.flatten("parts.segment").alias("token_ids"), spans.alias("loss_spans"), "formatted_chars")
    return chats.select("conv_id", "token_ids", "loss_spans", loss_mask(F.col("loss_spans"), F.size("token_ids")).alias("loss_mask"), "formatted_chars")


def loss_mask(spans: Column, size: Column) -> Column:
    """1 inside the spans, which are in order and apart, and 0 elsewhere, up to ``size``."""
    many = lambda value, n: F.array_repeat(F.lit(value).cast("tinyint"), n.cast("int"))
    # each span brings the zeros before it
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end"])
    parts = F.transform(spans, lambda s, i: F.concat(many(0, s["start"] - before(i)), many(1, s["end"] - s["start"])))
    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0).cast("long"))
    return F.concat(F.flatten(parts), many(0, size - last))


def read_chats(chats: DataFrame, path: str = RANKS) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` back from token_ids and loss_spans.

    ``turns`` is an array of role and text; ``loss_text`` the unescaped text of the
    tokens in all spans, one span after the other.
    """
    opens = {IDS[m[0]]: role for role, m in ROLES.items()}
    names = {i: m for m, i in IDS.items()}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoding(path)
        for batch in batches:
            turns, losses, sizes = [], [], []
            for ids, spans in zip(batch["token_ids"], batch["loss_spans"]):
                found, role, held, chars = [], None, [], 0
                for i in map(int, ids):
                    if i < FIRST_RESERVED:
                        held.append(i)
                        continue
                    text = tokens.decode(held)
                    chars += len(text) + len(names[i])
                    if names[i] == "<|text|>":
                        role = text
                    elif i in opens:
                        role = opens[i]
                    elif names[i] != "<|role|>":
                        found.append({"role": role, "text": text})
                    held = []
                turns.append(found)
                losses.append("".join(tokens.decode(ids[s["start"] : s["end"]].tolist()) for s in spans))
                sizes.append(chars)
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turns": turns, "loss": losses, "formatted_chars": sizes})

    rows = chats.select(F.col("conv_id").cast("string").alias("conv_id"), "token_ids", "loss_spans")
    back = rows.mapInPandas(decode, "conv_id string, turns array<struct<role: string, text: string>>, loss string, formatted_chars long")
    plain = F.transform("turns", lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), plain.alias("turns"), unescaped(F.col("loss")).alias("loss_text"), "formatted_chars")


PROBE = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)
    back = read_chats(format_chats(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
      + 2 * len(regexp_extract_all(text, '(<|\[)(/?INST\]|/?s>|</?SYS>>|\|role\|>|\|text\|>|\|end\|>)'))
      + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE
        23 + length(role) + length(role) - length(replace(role, '\', '')) + 2 * len(regexp_extract_all(role, '(<|\[)(/?INST\]|/?s>|</?SYS>>|\|role\|>|\|text\|>|\|end\|>)')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
