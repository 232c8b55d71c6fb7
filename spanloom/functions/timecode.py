"""Timecodes to seconds at three levels of strictness, and seconds to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_lenient(value: Column) -> Column:
    """MM:SS.mmm or HH:MM:SS.mmm, with a comma or point; parts may pass 59."""
    parts = F.split(F.replace(F.trim(value), F.lit(","), F.lit(".")), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 2, number(0) * 60 + number(1)).when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def seconds_strict(value: Column) -> Column:
    """Plain non-negative seconds, or [HH:]MM:SS with minutes and seconds below 60; else null."""
    text = F.trim(value.cast("string"))
    plain = text.try_cast("double")
    form = r"^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d+))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, form, i), F.lit("")), F.lit("0")).try_cast("int")
    fraction = F.concat(F.lit("0."), F.coalesce(F.nullif(F.regexp_extract(text, form, 4), F.lit("")), F.lit("0"))).try_cast("double")
    stamp = F.when(text.rlike(form) & (part(2) < 60) & (part(3) < 60), part(1) * 3600 + part(2) * 60 + part(3) + fraction)
    return F.coalesce(F.when(plain >= 0, plain), F.when(plain.isNull(), stamp))


def seconds_or_null(value: Column) -> Column:
    """Plain seconds or a lenient stamp; null where neither parses or the result is negative."""
    found = F.coalesce(value.cast("string").try_cast("double"), seconds_lenient(value.cast("string")))
    return F.when(found >= 0, found)


def _parts(seconds: Column, unit: int) -> tuple[Column, Column, Column, Column]:
    total = F.floor(F.greatest(seconds, F.lit(0.0)) * unit + (0.5 if unit == 1000 else 0)).cast("long")
    return F.floor(total / (3600 * unit)), F.floor(total / (60 * unit)) % 60, F.floor(total / unit) % 60, total % unit


def stamp(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm; SRT has a comma for the mark."""
    h, m, s, f = _parts(seconds, 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, f)


def ass_stamp(seconds: Column) -> Column:
    """H:MM:SS.cc, centiseconds cut off."""
    h, m, s, f = _parts(seconds, 100)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, f)


def minute_stamp(seconds: Column) -> Column:
    total = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d", F.floor(total / 60), total % 60)


def day_of(value: Column) -> Column:
    """The date of an ISO timestamp, or of its first ten characters; else null."""
    return F.coalesce(F.try_to_timestamp(value).cast("date"), F.try_to_date(F.substring(F.trim(value), 1, 10), "yyyy-MM-dd"))


def age_hours(published: Column, collected: Column) -> Column:
    """Hours from publication to collection, at least 0, to three digits."""
    micros = F.unix_micros(collected.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))
    return F.when(micros.isNotNull(), F.round(F.greatest(micros, F.lit(0)) / 3.6e9, 3))
