"""Timecodes, epoch milliseconds and half-even rounding as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: strict and lenient clock formats
STRICT = r"^(\d{2,}):([0-5]\d):([0-5]\d),(\d{3})$"
LENIENT = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})[,.](\d{1,3})$"


def to_ms(clock: Column, strict: bool = True) -> Column:
    """``HH:MM:SS,mmm`` to milliseconds; null when malformed."""
    pattern = STRICT if strict else LENIENT

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(clock, pattern, i).try_cast("long"), F.lit(0))

    milli = F.rpad(F.regexp_extract(clock, pattern, 4), 3, "0").try_cast("long")
    total = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + milli
    return F.when(clock.rlike(pattern), total)


def from_ms(ms: Column) -> Column:
    """Milliseconds to ``HH:MM:SS,mmm``."""
    sec = F.floor(ms / 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, (ms % 1000).cast("long")
    )


def epoch_ms(ts: Column) -> Column:
    """Wall-clock timestamp to milliseconds, whatever the session time zone."""
    second = F.date_part(F.lit("SECOND"), ts)
    whole = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1000
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000 + whole + F.floor(second * 1000).cast("long")


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)
