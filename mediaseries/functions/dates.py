"""Date and time expressions. Times are UTC: the session time zone is pinned by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import BLANKS, strip_quotes

# The two layouts tried after epoch seconds, each behind the shape a text must have.
PATTERNS = (
    (r"^[0-9]{1,2}:[0-9]{1,2} [AaPp][Mm] - ", ("h:m a - d MMM yyyy",)),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", ("yyyy-M-d",)),
)

# Layouts met in exports of posts, tried in this order once the fixed ones have failed.
FREE_PATTERNS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T", ("yyyy-M-d'T'H:m:s[.SSSSSS][.SSS][XXX][X]",)),
    (
        r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]",
        ("yyyy-M-d H:m:s[.SSSSSS][.SSS][ ][XXX][X]", "yyyy-M-d H:m[XXX]"),
    ),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]", ("yyyy/M/d[ H:m[:s]]",)),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", ("M/d/yyyy[ H:m[:s]]", "M/d/yyyy h:m[:s] a")),
    (r"^[A-Za-z]{3,9} [0-9]{1,2} [0-9]", ("MMM d H:m:s Z yyyy",)),
    (r"^[A-Za-z]{3,9} [0-9]{1,2},", ("MMM d, yyyy[ H:m[:s]]", "MMMM d, yyyy[ H:m[:s]]")),
    (r"^[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}", ("d MMM yyyy[ H:m[:s]][ Z]", "d MMMM yyyy[ H:m[:s]]")),
)

#: Two numbers, either of which may be the day, and a year.
DAY_MONTH = r"^\s*\"?([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}"
#: The same layouts for sources that put the day before the month.
DAY_FIRST = tuple((shape, tuple(p.replace("M/d/yyyy", "d/M/yyyy") for p in patterns)) for shape, patterns in FREE_PATTERNS)

_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_MIN_EPOCH, _MAX_EPOCH = -62135596800.0, 253402300799.0


def epoch_timestamp(text: Column) -> Column:
    """Seconds since 1970 in any decimal notation, NULL outside years 1 to 9999."""
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    in_range = number.between(F.lit(_MIN_EPOCH), F.lit(_MAX_EPOCH))
    return F.timestamp_micros(F.when(in_range, F.bround(number * 1e6).cast("long")))


def _read(text: Column, layouts) -> list[Column]:
    """One attempt per layout, made only for texts of its shape: a failed attempt is dear."""
    return [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
        for shape, patterns in layouts
        for pattern in patterns
    ]


def parse_datetime(raw: Column | str, free: Sequence[tuple[str, Sequence[str]]] = FREE_PATTERNS) -> Column:
    """Timestamp from epoch seconds, then the fixed layouts, then free-form layouts, else NULL."""
    text = F.btrim(strip_quotes(raw), F.lit(BLANKS))
    bare = F.regexp_replace(text, _WEEKDAY, "")
    return F.coalesce(epoch_timestamp(text), *_read(text, PATTERNS), *_read(bare, free))


def standard_datetime(text: Column | str) -> Column:
    """Timestamp from a text in the standard format, NULL from any other."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(has_standard_format(c), c.try_cast("timestamp"))


def has_standard_format(c: Column | str) -> Column:
    """True where a text starts as ``YYYY-MM-DD HH:MM:SS``."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}")


def month_key(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(date: Column | str) -> Column:
    return F.trunc(date, "MM")
