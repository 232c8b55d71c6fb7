"""Secret scan in DataFrame functions: patterns, and windows of high entropy.

Three kinds are patterns.  The fourth slides a window of 20 characters over candidate
strings, which are runs of base64 characters outside the spans of the three.  The
fold over a candidate carries the count of each character, 12 counts of 5 bits to a
long.  When the window moves, only the counts of the entering and the leaving
character change, and with them the sum of c*log2(c), from which the entropy follows.
The threshold depends on the narrowest character class that holds the window.  Sums
are whole millionths, so that a comparison never hangs on rounding.  Overlapping
windows of high entropy make one span; the allow-list is held against each span.

Every step is linear in the text, whatever it holds: one long candidate, or many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emitted, let, read

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
LINK = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = KEYWORD + LINK + r"[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # as [0-9a-f]+ of 16 or more: a run is matched whole or not at all
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Strings that are no secrets: ids in the UUID form, alphabets written out, and words of sample values.
ALLOWED = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|0123456789|(?i:abcdefgh|example|sample|dummy|placeholder|changeme|xxxx)"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits; a window of digits alone is never taken.
THRESHOLDS = {"hex": 3.2, "base64": 3.9}
UNIT = 10**6
TERMS = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]
#: What a character's n-th occurrence in the window adds to the sum.
GAINS = [0] + [TERMS[c] - TERMS[c - 1] for c in range(1, WINDOW + 1)]
#: The characters of candidates: digits first, then the other hexadecimal digits.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
DIGITS, HEXES, PACKED, BITS = 10, 22, 12, 5
SPAN = "struct<start:int,end:int,match:string>"
BLANK = "\n"


def limit(bits: float) -> int:
    """A window has at least so many bits when its sum is at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def _located(text: Column, pattern: str, found: Column) -> Column:
    """start, end and match of the matches, in code points, from the lengths of what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.slice(F.arrays_zip(found.alias("m"), gaps.alias("g")), 1, F.size(found))

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        at = end + x["g"]
        to = at + F.length(x["m"])
        return to, F.array(F.struct(at.alias("start"), to.alias("end"), x["m"].alias("match")))

    return F.when(F.size(found) > 0, emitted(zipped, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _high_entropy(value: Column) -> Column:
    """``start, end, match`` (from 0) of the unions of overlapping windows that reach their class's threshold."""
    codes = [(i // PACKED, 1 << (BITS * (i % PACKED))) for i in range(len(ALPHABET))]
    fields = F.array(*(F.lit(f) for f, _ in codes))
    units = F.array(*(F.lit(u).cast("long") for _, u in codes))
    gains = F.array(*(F.lit(t).cast("long") for t in GAINS))
    nothing = F.lit(None).cast("struct<k:int,f:int,u:bigint>")
    zeros = F.array(*(F.lit(0).cast("long") for _ in range(codes[-1][0] + 1)))
    start = F.struct(
        zeros.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("hexes"),
        F.lit(0).alias("at"), F.lit(-1).alias("open"), F.lit(-1).alias("close"),
    )

    def coded(c: Column) -> Column:
        k = F.instr(F.lit(ALPHABET), c) - 1
        return let(k, lambda k: F.struct(k.alias("k"), F.get(fields, k).alias("f"), F.get(units, k).alias("u")))

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("div", F.get(counts, c["f"]), c["u"]).bitwiseAND((1 << BITS) - 1).cast("int")

    def moved(s: Column, x: Column) -> Column:
        """The window without x.o, which is null until it is full, and with x.i."""
        into, out = x["i"], x["o"]
        same = F.coalesce(into["k"] == out["k"], F.lit(False)).cast("int")
        gone = F.coalesce(F.get(gains, count(s["counts"], out)), F.lit(0).cast("long"))
        come = F.get(gains, count(s["counts"], into) - same + 1)
        change = lambda j: F.when(j == into["f"], into["u"]).otherwise(0) - F.when(j == out["f"], out["u"]).otherwise(0)
        below = lambda n: (into["k"] < n).cast("int") - F.coalesce((out["k"] < n).cast("int"), F.lit(0))
        return F.struct(
            F.transform(s["counts"], lambda v, j: v + change(j)).alias("counts"),
            (s["sum"] - gone + come).alias("sum"), (s["digits"] + below(DIGITS)).alias("digits"), (s["hexes"] + below(HEXES)).alias("hexes"),
            (s["at"] + 1).alias("at"), s["open"].alias("open"), s["close"].alias("close"),
        )

    def judged(s: Column) -> Column:
        most = F.when(s["digits"] == WINDOW, F.lit(-1)).when(s["hexes"] == WINDOW, limit(THRESHOLDS["hex"])).otherwise(limit(THRESHOLDS["base64"]))
        return F.struct(s.alias("s"), ((s["at"] >= WINDOW) & (s["sum"] <= most)).alias("hit"), ((s["close"] < 0) | (s["at"] - WINDOW > s["close"])).alias("new"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        after = let(let(moved(s, x), judged), lambda r: F.struct(
            r["s"]["counts"].alias("counts"), r["s"]["sum"].alias("sum"), r["s"]["digits"].alias("digits"), r["s"]["hexes"].alias("hexes"), r["s"]["at"].alias("at"),
            F.when(r["hit"] & r["new"], r["s"]["at"] - WINDOW).otherwise(r["s"]["open"]).alias("open"),
            F.when(r["hit"], r["s"]["at"]).otherwise(r["s"]["close"]).alias("close"),
        ))
        return after, None

    def spans(chars: Column) -> Column:
        coded_chars = F.transform(chars, coded)
        zipped = let(coded_chars, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(nothing, WINDOW), c), F.lit(1), F.size(c)), lambda i, o: F.struct(i.alias("i"), o.alias("o"))))
        # a span is given out once a later window starts another, and the last one at the end
        closed = lambda s, t: F.when((t["open"] != s["open"]) & (s["close"] >= 0), F.array(F.struct(s["open"].alias("start"), s["close"].alias("end"))))
        found = emitted(zipped, start, step, "struct<start:int,end:int>", closed, lambda s: F.when(s["close"] >= 0, F.array(F.struct(s["open"].alias("start"), s["close"].alias("end")))))
        return F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.array_join(F.slice(chars, f["start"] + 1, f["end"] - f["start"]), "").alias("match")))

    return let(F.split(value, ""), spans)


def _blanked(text: Column, pattern: str, masked: Column) -> Column:
    """The text with each match replaced by its item of ``masked``."""
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(masked, F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), s["match"].alias("match")))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secret_spans``: array of start, order (in KINDS), end, match; by start, then kind.

    Positions are code points, ends exclusive.  A null or empty text has none.  Base
    kinds: see the patterns.  ``entropy`` spans never touch a base span; each holds a
    digit and a letter, and nothing of the allow-list.  Repeated rows are scanned
    alike; an existing column of this name is replaced, and all others pass through.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    names = {k: f"__found_{k}" for k in patterns}
    out = docs.withColumns({names[k]: F.regexp_extract_all(t, F.lit(p), 0) for k, p in patterns.items()})
    value = lambda m: F.regexp_extract(m, "^" + KEYWORD + LINK + "(.*)$", 1)
    taken = {"assign": lambda m: F.length(value(m)) >= 12, "access": lambda m: F.length(m) >= 18, "hex": lambda m: F.lit(True)}
    at = {k: _located(t, p, F.col(names[k])) for k, p in patterns.items()}
    accepted = lambda k: F.filter(at[k], lambda s: taken[k](s["match"]))
    base = F.concat(*(_kind(accepted(k), k) for k in patterns))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    # a candidate is rare: most texts leave at the first test
    some = F.exists(F.regexp_extract_all(t, F.lit(CANDIDATE), 0), mixed)
    out = out.withColumns({"__base": F.array_sort(base), "__some": some})
    mask = lambda k: F.transform(names[k], lambda m: F.when(taken[k](m), F.repeat(F.lit(BLANK), F.length(m))).otherwise(m))
    chars = {k: F.split(_blanked(t, p, mask(k)), "") for k, p in patterns.items()}
    either = lambda x, y: F.zip_with(x, y, lambda a, b: F.when(a == b, a).otherwise(BLANK))
    # no base span: the text as it is; else every character of one is a blank
    rest = F.when(F.col("__some"), F.when(F.size("__base") == 0, t).otherwise(F.array_join(either(either(chars["assign"], chars["access"]), chars["hex"]), ""))).otherwise("")
    out = out.withColumn("__rest", rest).withColumn("__found", F.regexp_extract_all("__rest", F.lit(CANDIDATE), 0))
    likely = F.filter(_located(F.col("__rest"), CANDIDATE, F.col("__found")), lambda s: mixed(s["match"]))
    out = out.withColumn("__likely", likely)
    moved = lambda s: F.transform(_high_entropy(s["match"]), lambda e: F.struct((s["start"] + e["start"]).alias("start"), (s["start"] + e["end"]).alias("end"), e["match"].alias("match")))
    high = F.filter(F.flatten(F.transform("__likely", moved)), lambda e: mixed(e["match"]) & ~e["match"].rlike(ALLOWED))
    out = out.withColumn("secret_spans", F.when(F.size("__likely") > 0, F.array_sort(F.concat("__base", _kind(high, "entropy")))).otherwise(F.col("__base")))
    return out.drop("__base", "__some", "__rest", "__found", "__likely", *names.values())


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("secret_spans", lambda s: s["order"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("secret_spans", lambda s: s["order"] < KINDS.index("entropy"))
    return out.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), number("entropy"))


def _sql() -> str:
    keyword = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    link = r"[\"'']?\x20*[:=]\x20*[\"'']?"
    patterns = {"assign": keyword + link + "[A-Za-z0-9+/_.=-]+", "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    located = " UNION ALL ".join(
        f"SELECT n, '{k}' AS kind, {i} AS ord, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')" for i, (k, p) in enumerate(patterns.items())
    )
    hexes, terms = limit(THRESHOLDS["hex"]), TERMS[1:]
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({located}),
s AS MATERIALIZED (
  SELECT n, kind, ord, found[i] AS m, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start
  FROM f, unnest(range(1, len(found) + 1)) u(i)
), base AS MATERIALIZED (
  SELECT n, kind, ord, start, start + length(m) AS stop FROM s
  WHERE kind = 'hex' OR (kind = 'access' AND length(m) >= 18) OR (kind = 'assign' AND length(regexp_extract(m, '^{keyword}{link}(.*)$', 1)) >= 12)
), w AS (
  SELECT n, m, start AS place, start + i - 1 AS spot, m[i:i + {WINDOW - 1}] AS win
  FROM s, unnest(range(1, length(m) - {WINDOW - 2})) u(i)
  WHERE kind = 'entropy' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
), q AS (
  SELECT n, m, place, spot FROM w
  WHERE list_sum(list_transform(list_distinct(string_split(win, '')), lambda c: ({terms})[length(win) - length(replace(win, c, ''))]))
    <= CASE WHEN NOT regexp_matches(win, '[^0-9]') THEN -1 WHEN NOT regexp_matches(win, '[^0-9a-fA-F]') THEN {hexes} ELSE {limit(THRESHOLDS["base64"])} END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = w.n AND b.start < spot + {WINDOW} AND spot < b.stop)
), i AS (
  SELECT *, CASE WHEN spot - lag(spot) OVER (PARTITION BY n, place ORDER BY spot) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM q
), j AS (
  SELECT *, sum(fresh) OVER (PARTITION BY n, place ORDER BY spot) AS island FROM i
), h AS (
  SELECT n, min(spot) AS start, max(spot) + {WINDOW} AS stop, substring(m, CAST(min(spot) - place + 1 AS BIGINT), CAST(max(spot) - min(spot) + {WINDOW} AS BIGINT)) AS part FROM j GROUP BY n, place, island, m
), a AS (
  SELECT * FROM base UNION ALL
  SELECT n, 'entropy', 3, start, stop FROM h WHERE regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]') AND NOT regexp_matches(part, '{ALLOWED}')
), g AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM a GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN g USING (n)
"""


SQL = _sql()
