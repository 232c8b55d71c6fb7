"""Column forms of the engine's value rules.  Malformed values become defaults, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that mean yes and no in the data.
TRUE_WORDS = ("1", "true", "yes", "sim", "on", "enabled")
FALSE_WORDS = ("0", "false", "no", "não", "nao", "off", "disabled")


def finite_or_null(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite_or(value: Column, default: float) -> Column:
    return F.coalesce(finite_or_null(value), F.lit(float(default)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def bounded_score(value: Column, default: float = 50.0) -> Column:
    return clamp(finite_or(value, default), 0.0, 100.0)


def floored_or_null(value: Column, low: float, high: float) -> Column:
    """Null below the lower bound, but the upper bound above it."""
    x = finite_or_null(value)
    return F.when(x >= low, F.least(x, F.lit(high)))


def flag(value: Column, default: bool = False) -> Column:
    """Text or number as a boolean; what isn't finite or known is the default."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    known = F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)
    return F.coalesce(known, F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number != 0), F.lit(default))


def flag_nonzero(value: Column, default: bool = False) -> Column:
    """As ``flag``, but any number except 0 is true, NaN and infinities too."""
    text = F.lower(F.trim(value.cast("string")))
    known = F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)
    return F.coalesce(known, F.isnan(text.try_cast("double")) | (text.try_cast("double") != 0), F.lit(default))


def tri_state(value: Column) -> Column:
    """True, false, or null for anything else."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def one_of(value: Column, allowed: list[str] | tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def first_text(*columns: Column) -> Column:
    """The first of the columns that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def labels(value: Column, most: int | None = 12) -> Column:
    """Labels of a text separated by comma, semicolon or bar: trimmed, distinct, the first ``most``."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return parts if most is None else F.slice(F.array_distinct(parts), 1, most)


def scrubbed(value: Column) -> Column:
    """Empty where the text holds a link, a file path or a long token."""
    return F.when(value.rlike(r"(?i)https?://|www\.|[a-z]:\\|(?:^|\s)/(?:home|users|mnt|var|tmp)/|[A-Za-z0-9_-]{32,}"), F.lit("")).otherwise(F.coalesce(value, F.lit("")))


def valid_interval(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (end > start), F.lit(False))


def repaired_end(start: Column, end: Column, least: float = 0.1) -> Column:
    """An end that isn't after its start becomes start + least."""
    return F.when(F.coalesce(end > start, F.lit(False)), end).otherwise(start + least)


def whole(value: Column) -> Column:
    """Truncated toward zero."""
    x = finite_or_null(value)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def non_negative(value: Column) -> Column:
    """The number, or null where it is negative or malformed; an empty value counts as 0."""
    x = finite_or_null(value)
    return F.when(value.isNull() | (F.trim(value.cast("string")) == ""), F.lit(0.0)).otherwise(F.when(x >= 0, x))


def settings_value(overrides: Column, key: str, default: str) -> Column:
    """A setting from a map of overrides, else the default."""
    return F.coalesce(F.try_element_at(overrides, F.lit(key)), F.lit(default))
