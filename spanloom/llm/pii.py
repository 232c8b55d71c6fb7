"""Format-preserving pseudonyms for personal data, in DataFrame functions.

Numbers and dates are validated, then permuted within their format by a keyed Feistel
network, so equal values get equal pseudonyms in every document and no two values
share one:

* mail     the letters and digits of the part before the @, each within its class
* phone    + and 8 to 15 digits, or 3-3-4 digits of a North American number: the
           digits after the country code
* card     Luhn-valid numbers of 13 to 19 digits, unbroken or in groups of 4-4-4-4,
           4-6-4 and 4-6-5: all digits but the last, which is computed anew, so the
           pseudonym is valid too
* ssn      ddd-dd-dddd with an area, group and serial that can be issued: its number
           among the 898 * 99 * 9999 that can be
* ip       dotted quads: two halves of 16 bits
* date     real days from 1800 to 2199 as year-month-day (with ``-``, ``/`` or ``.``),
           day.month.year or month/day/year: the day's number in the 400-year cycle of
           146,097 = 189 * 773 days, so one day has one pseudonym in all orders

Nothing else changes.  Every pattern either has a bounded length or takes a run of
characters whole and once (possessive), so time is linear in the text and no pattern
recurses, however long a run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: For tests and queries; a deployment passes its own secret key.
KEY = "example key, replace in use"
ROUNDS = 8
KINDS = ("mail", "phone", "card", "ssn", "ip", "date")
NAME = "[A-Za-z0-9._%+-]"
#: A run of name characters is tried from its start; within one, after another match, a name has 64 characters at most.
MAIL = rf"(?:(?<!{NAME}){NAME}++|\G{NAME}{{1,64}}+)@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = (
    r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[0-9](?:[ .-]?[0-9]){7,14}|\([0-9]{3}\)[ .-]?[0-9]{3}[.-][0-9]{4}"
)
GROUPED = r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
SLASHED = r"(?<![0-9/])[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}(?![0-9/])"
NUMBER = r"[0-9]++(?:[-.][0-9]++)*+"
#: Leftmost, and at one place the first of these; what a match is gets decided afterwards.
FOUND = f"{MAIL}|{PHONE}|{GROUPED}|{SLASHED}|{NUMBER}"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9]{2})|)"
AREAS, GROUPS, SERIALS = 898, 99, 9999
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS, DAY_PARTS = "1800-01-01", 146_097, (189, 773)


def _mac(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half), 256)


def _number(hexes: Column, at: Column, size: int) -> Column:
    return F.conv(F.substring(hexes, at, F.lit(size)), 16, 10).cast("long")


def _shifted(text: Column, mac: Column) -> Column:
    """Each letter or digit moved within its class by a byte of the mac (which repeats past 32 characters)."""

    def moved(c: Column, i: Column, by_bytes: Column) -> Column:
        by = _number(by_bytes, (i % 32) * 2 + 1, 2)
        out = c
        for letters in (DIGITS, LOWER, UPPER):
            n, at = len(letters), F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.substring(F.lit(letters), ((at - 1 + by) % n + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    # the mac is made once, not once a character
    return let(mac, lambda m: F.array_join(F.transform(F.split(text, ""), lambda c, i: moved(c, i, m)), ""))


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of strings that keeps the class of every character; other characters stay."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))

    def step(x: Column, i: Column) -> Column:
        left = F.when(x["a"] == "", "").otherwise(_shifted(x["a"], _mac(key, kind, i, x["b"])))
        return F.when(i % 2 == 0, F.struct(x["a"].alias("a"), _shifted(x["b"], _mac(key, kind, i, x["a"])).alias("b"))).otherwise(F.struct(left.alias("a"), x["b"].alias("b")))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(out["a"], out["b"])


def permuted_number(value: Column, left: int, right: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left*right-1."""
    start = F.struct(F.floor(value / right).cast("long").alias("a"), (value % right).cast("long").alias("b"))

    def step(x: Column, i: Column) -> Column:
        a = (x["a"] + _number(_mac(key, kind, i, x["b"].cast("string")), F.lit(1), 12)) % left
        b = (x["b"] + _number(_mac(key, kind, i, x["a"].cast("string")), F.lit(1), 12)) % right
        return F.struct(F.when(i % 2 == 0, x["a"]).otherwise(a).alias("a"), F.when(i % 2 == 0, b).otherwise(x["b"]).alias("b"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return out["a"] * right + out["b"]


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column, odd: int) -> Column:
    """Sum of the digits from the right, where those at distance odd, odd+2 .. are doubled."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == odd, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x)


def _refilled(shape: Column, digits: Column) -> Column:
    """The digits of shape replaced, one after the other; other characters stay."""
    parts = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda x, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(x["out"], F.substring(digits, x["at"], F.lit(1))).alias("out"), (x["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(x["out"], c).alias("out"), x["at"].alias("at")))
    return F.aggregate(parts, start, step)["out"]


def _iso(m: Column) -> Column:
    """A date as yyyy-MM-dd, whichever of the orders it is in; null for other shapes."""
    part = lambda at, size: F.substring(m, at, size)
    return (
        F.when(m.rlike(r"^[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}$"), F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2)))
        .when(m.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
        .when(m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    )


def _day(m: Column) -> Column:
    return F.try_to_date(_iso(m), "yyyy-MM-dd")


def kind_of(m: Column, before: Column, after: Column) -> Column:
    """What a match is, from itself and the characters around it; null: nothing."""
    free_left, free = ~before.rlike("[A-Za-z0-9_]$"), ~before.rlike("[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_]")
    first, last = (F.lit(x).cast("date") for x in (FIRST_DAY, "2199-12-31"))
    return (
        F.when(m.contains("@"), "mail")
        .when(~m.rlike("^[0-9]") & free & F.length(_only_digits(m)).between(8, 15), "phone")
        .when(~m.rlike("^[0-9]"), None)
        .when(free_left & ~after.rlike("^[A-SU-Za-z0-9_]") & _day(m).between(first, last), "date")
        .when(~free, None)
        .when(m.rlike("^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$") & (_luhn(_only_digits(m), 1) % 10 == 0), "card")
        .when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[2-9][0-9]{2}([-.])[2-9][0-9]{2}\1[0-9]{4}$"), "phone")
        .when(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
    )


def _new_ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, size).cast("long") for at, size in ((1, 3), (5, 2), (8, 4)))
    index = ((area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1) * SERIALS + serial - 1

    def written(n: Column) -> Column:
        place = F.floor(n / (GROUPS * SERIALS))
        parts = (F.when(place >= 665, place + 2).otherwise(place + 1), F.floor(n / SERIALS) % GROUPS + 1, n % SERIALS + 1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), size, "0") for x, size in zip(parts, (3, 2, 4))))

    return let(permuted_number(index, AREAS, GROUPS * SERIALS, key, "ssn"), written)


def _new_date(m: Column, key: str) -> Column:
    day = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(day, *DAY_PARTS, key, "date").cast("int"))

    def written(d: Column) -> Column:
        iso = F.date_format(d, "yyyy-MM-dd")
        return F.when(m.rlike("^[0-9]{4}"), F.replace(iso, F.lit("-"), F.substring(m, 5, 1))).when(F.substring(m, 3, 1) == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))

    return let(new, written)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    mail = F.concat(permuted_text(local, key, "mail"), F.substring(m, F.length(local) + 1, F.length(m)))
    code = F.regexp_extract(m, COUNTRY, 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    phone = F.concat(code, _refilled(rest, permuted_text(_only_digits(rest), key, "phone")))
    digits = _only_digits(m)
    body = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = let(body, lambda b: _refilled(m, F.concat(b, ((10 - _luhn(b, 0) % 10) % 10).cast("string"))))
    quad = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + F.try_to_number(x, F.lit("999")).cast("long"))
    ip = let(permuted_number(quad, 65536, 65536, key, "ip"), lambda n: F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))
    new = {"mail": mail, "phone": phone, "card": card, "ssn": _new_ssn(m, key), "ip": ip, "date": _new_date(m, key)}
    out = m
    for name, value in new.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def pseudonymized(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymized, and ``pii_counts``: kind to number of values.

    A null text stays null, and an empty one empty; both have no values.  Equal values
    of one kind get equal pseudonyms whatever their document, row or neighbours.  All
    other columns pass through; an existing pii_counts is replaced.
    """
    t = F.col(f"`{text}`")
    # most texts hold neither a digit nor an @ and skip everything else
    out = docs.withColumn("__found", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(FOUND), 0)))
    out = out.withColumn("__gaps", F.when(F.size("__found") > 0, F.split(t, FOUND, -1)))
    at = lambda i: F.get("__gaps", i)
    # only what the neighbouring characters can decide is kept of the gaps
    out = out.withColumn("__kinds", F.transform("__found", lambda m, i: F.struct(m.alias("m"), kind_of(m, F.right(at(i), F.lit(1)), F.left(at(i + 1), F.lit(1))).alias("kind"))))
    out = out.withColumn("__new", F.transform("__kinds", lambda x: pseudonym(x["m"], x["kind"], key)))
    whole = F.array_join(F.flatten(F.zip_with("__gaps", F.concat("__new", F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")
    some = F.size(F.filter("__kinds", lambda x: x["kind"].isNotNull())) > 0
    count = lambda k: F.coalesce(F.size(F.filter("__kinds", lambda x: x["kind"] == k)), F.lit(0))
    counts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(count, KINDS)))
    counts = F.when(F.size("__found") > 0, counts).otherwise(F.create_map(*(F.lit(x) for k in KINDS for x in (k, 0))))
    columns = {text: F.when(some, whole).otherwise(t), "pii_counts": counts}
    return out.withColumns(columns).drop("__found", "__gaps", "__kinds", "__new")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymized(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", *(F.col("pii_counts")[k].cast("long").alias(f"n_{k}") for k in KINDS))
