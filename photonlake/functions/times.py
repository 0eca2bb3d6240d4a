"""Capture times are seconds since 1970 of the camera's clock read as UTC: 0 is undated, negative is before 1970."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_start(year: int) -> int:
    return int(dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def taken_year(at: Column) -> Column:
    """The year, null when undated."""
    return F.when(at != 0, F.year(F.timestamp_seconds(at)))


def taken_label(at: Column) -> Column:
    return F.when(at > 0, F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd")).otherwise("----------")


def month_label(at: Column) -> Column:
    return F.when(at != 0, F.date_format(F.timestamp_seconds(at), "MMMM yyyy")).otherwise("")


def exif_time(text: Column, offset: Column | None = None) -> Column:
    """Seconds of an EXIF or ISO time; fractions are dropped, an offset +hh:mm is subtracted, year 0000 is none (0)."""
    bare = F.regexp_replace(F.trim(text), r"[.,]\d+$", "")
    stamp = F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss")))
    seconds = F.unix_timestamp(stamp)
    if offset is not None:
        sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
        known = F.regexp_like(offset, F.lit(r"^[+-]\d\d:\d\d$"))
        shift = sign * (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 5, 2).try_cast("int") * 60)
        seconds = seconds - F.when(known, shift).otherwise(0)
    return F.coalesce(F.when(~F.startswith(bare, F.lit("0000")), seconds), F.lit(0)).cast("long")


def gps_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column, limit: float) -> Column:
    """Signed degrees; null outside the limit (90 or 180) or with a part missing."""
    v = degrees + minutes / 60 + seconds / 3600
    signed = F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)
    return F.when(F.abs(signed) <= limit, signed)


def lens_name(make: Column, model: Column) -> Column:
    """Maker and model of a lens; the maker is left out when the model already starts with it."""
    return F.when(F.coalesce(make, F.lit("")) == "", F.coalesce(model, F.lit(""))).when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))


def lens_range(short: Column, long: Column, fast: Column, slow: Column) -> Column:
    """A zoom's range as 24-70mm f/2.8-4; equal ends are written once."""
    num = lambda c: F.regexp_replace(F.format_string("%.1f", c.cast("double")), r"\.0$", "")
    span = lambda a, b: F.when(a == b, num(a)).otherwise(F.concat(num(a), F.lit("-"), num(b)))
    return F.concat(span(short, long), F.lit("mm f/"), span(fast, slow))


def shutter_label(exposure: Column) -> Column:
    """1/250 s below a third of a second, else seconds with a decimal."""
    return F.when(exposure <= 0, "").when(exposure < 0.3, F.concat(F.lit("1/"), F.round(1 / exposure).cast("long").cast("string"), F.lit(" s"))).otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", exposure), r"\.0$", ""), F.lit(" s")))
