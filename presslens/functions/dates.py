"""Date text to timestamps, by a fixed list of formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy",
)

WEEKDAY_RE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +"
FRACTION_RE = r"(:\d\d)[.,]\d+"
ZONE_RE = r"(?<=\d) ?(?:Z|UTC|GMT|[A-Z]{3}|[+-]\d\d:?\d\d)$"


def local_text(value: Column) -> Column:
    """A date text without weekday, fractions of a second and time zone."""
    text = F.regexp_replace(F.btrim(value), WEEKDAY_RE, "")
    return F.regexp_replace(F.regexp_replace(text, FRACTION_RE, "$1"), ZONE_RE, "")


def parse_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits; NULL for anything else, ``N/A`` included.

    The time is the one that the text shows, in its own zone.
    """
    text = local_text(value)
    return F.coalesce(
        *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    )


def day_of(value: Column) -> Column:
    """The date of a date text as ``YYYY-MM-DD``; NULL for what is none."""
    return F.date_format(parse_date(value), "yyyy-MM-dd")
