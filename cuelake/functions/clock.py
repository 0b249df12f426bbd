"""Times of day and offsets as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hms(seconds: Column) -> Column:
    """HH:MM:SS, rounded half to even."""
    s = F.bround(seconds.cast("decimal(18,3)"), 0).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), F.pmod((s / 60).cast("long"), F.lit(60)), F.pmod(s, F.lit(60)))


def hms_ms(ms: Column, separator: str) -> Column:
    """HH:MM:SS and milliseconds, as captions write them."""
    s = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(ms, F.lit(1000)))


def short(ms: Column) -> Column:
    """[MM:SS], or [H:MM:SS] from an hour on; fractions are dropped."""
    s = F.floor(ms / 1000)
    minutes = F.format_string("[%02d:%02d]", F.floor(s / 60), F.pmod(s, F.lit(60)))
    hours = F.format_string("[%d:%02d:%02d]", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))
    return F.when(s >= 3600, hours).otherwise(minutes)


def seconds_of(text: Column) -> Column:
    """Whole seconds of H:MM:SS, M:SS or S."""
    return F.aggregate(F.transform(F.split(text, ":"), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x)


def ms_of(text: Column) -> Column:
    """Milliseconds of H:MM:SS.mmm, MM:SS.mmm, with a comma or a point."""
    parts = F.split(F.regexp_replace(text, ",", "."), r"\.")
    whole = seconds_of(parts.getItem(0))
    return whole * 1000 + F.coalesce(F.rpad(F.try_element_at(parts, F.lit(2)), 3, "0").cast("long"), F.lit(0))
