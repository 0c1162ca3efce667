"""Dates kept as text: parsing the spellings that occur, and open bounds of half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The open bounds 0001-01-01 and 9999-12-31 as days since 1970-01-01.
OPEN_START_DAY = -719162
OPEN_END_DAY = 2932896

_SPELLING = r"^(\d{4})(?:-(\d{1,2})-(\d{1,2})(?:[T ].*)?|/(\d{1,2})/(\d{1,2})|(\d{2})(\d{2})|年(\d{1,2})月(\d{1,2})日)$"


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(value, r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$", "")


def parse_date(value: Column) -> Column:
    """Date of ``2004-11-23``, ``2004-11-23T00:00:00Z``, ``2004/11/23``, ``20041123`` or ``2004年11月23日``; null for anything else."""
    v = strip(F.translate(value, "０１２３４５６７８９－／", "0123456789-/"))
    # Of the spellings' groups only one pair takes part in a match; the others are empty.
    return F.when(v.rlike(_SPELLING), F.regexp_replace(v, _SPELLING, "$1-$2$4$6$8-$3$5$7$9").try_cast("date"))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def _day(value: Column, open_day: int) -> Column:
    # Most dates are plain; they need one match and no cleaning.
    plain = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_date(value.try_cast("date")))
    return plain.when(is_blank(value), F.lit(open_day)).otherwise(F.unix_date(parse_date(value)))


def start_day(value: Column) -> Column:
    """First day of a half-open interval as days since 1970; null or blank is the open start; an unreadable date gives null."""
    return _day(value, OPEN_START_DAY)


def end_day(value: Column) -> Column:
    """End day (not included) as days since 1970; null, blank and 9999-12-31 are the open end; an unreadable date gives null."""
    return _day(value, OPEN_END_DAY)


def day_text(day: Column) -> Column:
    return F.date_from_unix_date(day).cast("string")
