"""Column functions for stored times: DOS words, Unix seconds, file times of 100 ns ticks, nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 100 ns ticks from 1601 to 1970.
EPOCH_TICKS = 116444736000000000
_DEC = "decimal(38,0)"


def _field(raw: Column, shift: int, mask: int) -> Column:
    return F.shiftright(raw, shift).bitwiseAND(mask)


def dos_fields(raw: Column) -> Column:
    """year, month, day, hour, minute, second of a DOS word; null where month or day is zero; nothing else is checked."""
    f = F.struct((_field(raw, 25, 127) + 1980).alias("year"), _field(raw, 21, 15).alias("month"), _field(raw, 16, 31).alias("day"), _field(raw, 11, 31).alias("hour"), _field(raw, 5, 63).alias("minute"), (raw.bitwiseAND(31) * 2).alias("second"))
    return F.when((_field(raw, 21, 15) != 0) & (_field(raw, 16, 31) != 0), f)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a proleptic Gregorian date; a day past the month's end runs on into the next."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def dos_to_unix(raw: Column, offset: int = 0) -> Column:
    """Unix seconds of a DOS word in a zone `offset` seconds east of UTC; null for zero and for invalid fields."""
    f = dos_fields(raw)
    ok = (raw != 0) & (f["month"] <= 12) & (f["hour"] <= 23) & (f["minute"] <= 59) & (f["second"] <= 59)
    at = days_from_civil(f["year"], f["month"], f["day"]) * 86400 + f["hour"] * 3600 + f["minute"] * 60 + f["second"] - offset
    return F.when(ok & (at >= 0), at.cast("long"))


def unix_to_dos(seconds: Column) -> Column:
    """DOS word of Unix seconds, rounded down to two seconds; null outside 1980 to 2107. Session time zone: UTC."""
    t = F.timestamp_seconds(seconds)
    word = (F.year(t) - 1980).cast("long") * (1 << 25) + F.month(t) * (1 << 21) + F.day(t) * (1 << 16) + F.hour(t) * (1 << 11) + F.minute(t) * 32 + F.floor(F.second(t) / 2)
    return F.when(F.year(t).between(1980, 2107), word.cast("long"))


def ticks_to_ns(ticks: Column) -> Column:
    return (ticks.cast(_DEC) - EPOCH_TICKS) * 100


def format_ticks(ticks: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss and seven digits of 100 ns."""
    seconds = F.floor((ticks - EPOCH_TICKS) / 10000000).cast("long")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ticks - EPOCH_TICKS, F.lit(10000000)).cast("string"), 7, "0"))


def split_ns(ns: Column) -> Column:
    """seconds and a remainder that is never negative."""
    second = F.lit(1000000000).cast(_DEC)
    r = F.pmod(ns, second)  # first: a quotient of decimals is rounded to six digits, and may round up to the next second
    return F.struct(((ns - r) / second).cast("long").alias("seconds"), r.cast("long").alias("nanoseconds"))
