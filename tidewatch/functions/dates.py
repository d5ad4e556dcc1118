"""Dates found in dirty text. Bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
RFC_TIME = r"(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4}) (\d{1,2}:\d{2}(?::\d{2})?)\s*(GMT|UTC|UT|Z|[+-]\d{4})?"
YMD = r"(\d{4})[-年./](\d{1,2})[-月./](\d{1,2})"
YMD_SPACED = r"(\d{4})\s*[-年./]\s*(\d{1,2})\s*[-月./]\s*(\d{1,2})"


def _ntz(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def parse_rfc_datetime(text: Column, zone_hours: float = 0.0) -> Column:
    """RFC-822 time as a local time in the zone ``zone_hours`` east of UTC."""
    def part(i: int) -> Column:
        return F.regexp_extract(text, RFC_TIME, i)

    months = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    at = F.instr(months, F.lower(part(2)))
    month = F.when(at % 3 == 1, F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"))
    clock = F.lpad(part(4), F.when(F.length(part(4)) > 5, 8).otherwise(5), F.lit("0"))
    local = _ntz(F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), clock))
    offset = part(5)
    minutes = F.when(offset.rlike(r"^[+-]\d{4}$"),
                     F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
                     * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int"))
                     ).otherwise(0)
    shift = F.make_interval(mins=F.lit(int(zone_hours * 60)) - minutes)
    return local + shift


def parse_pub_datetime(value: Column, zone_hours: float = 0.0) -> Column:
    """Publication time: RFC-822, ISO with T, 'date time', else the first ten characters as a date."""
    text = F.nullif(F.trim(value), F.lit(""))
    has_clock = F.contains(text, F.lit(":"))
    rfc_like = F.contains(text, F.lit(",")) & has_clock & text.rlike(r"GMT|\+|-")
    iso = F.when(text.rlike(ISO_TIME), _ntz(F.replace(F.replace(text, F.lit(" "), F.lit("T")), F.lit(","), F.lit("."))))
    day = F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), _ntz(F.substring(text, 1, 10)))
    rest = (F.when(F.contains(text, F.lit("T")), F.coalesce(iso, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)))
            .when(F.contains(text, F.lit(" ")) & has_clock, iso)
            .when(F.length(text) >= 10, day))
    return F.coalesce(F.when(rfc_like, parse_rfc_datetime(text, zone_hours)), rest)


def parse_event_datetime(value: Column) -> tuple[Column, Column]:
    """(time, is it a bare date) without the RFC-822 form; a bare date must be the whole text."""
    text = F.nullif(F.trim(value), F.lit(""))
    timed = F.contains(text, F.lit("T")) | (F.contains(text, F.lit(" ")) & F.contains(text, F.lit(":")))
    iso = F.when(text.rlike(ISO_TIME), _ntz(F.replace(F.replace(text, F.lit(" "), F.lit("T")), F.lit(","), F.lit("."))))
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _ntz(text))
    ts = F.when(timed, iso).otherwise(day)
    return ts, F.coalesce(~timed & ts.isNotNull(), F.lit(False))


def parse_track_ts(value: Column) -> Column:
    """ISO time with an optional Z."""
    text = F.trim(value)
    return F.when(text.rlike(ISO_TIME) | text.rlike(r"^\d{4}-\d{2}-\d{2}$"), _ntz(text))


def extract_ymd(text: Column, spaced: bool = False) -> Column:
    """First year-month-day in the text, zero padded; NULL if there is none."""
    pattern = YMD_SPACED if spaced else YMD

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    return F.when(part(1) != "", F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"),
                                          F.lpad(part(3), 2, "0")))


def extract_valid_date(text: Column) -> Column:
    return extract_ymd(text).try_cast("date")


def feed_entry_date(published: Column, updated: Column, zone_hours: float = 0.0) -> Column:
    """Parsed published time, parsed updated time, else the first date inside either text."""
    def found(c: Column) -> Column:
        return extract_valid_date(c).cast("timestamp_ntz")

    return F.coalesce(parse_pub_datetime(published, zone_hours), parse_pub_datetime(updated, zone_hours),
                      F.when(published.isNotNull(), found(published)).otherwise(found(updated)))


def format_date(value: Column) -> Column:
    text = F.trim(F.coalesce(value, F.lit("")))
    return (F.when(F.contains(text, F.lit("T")), F.substring_index(text, "T", 1))
            .when(F.contains(text, F.lit(" ")) & F.contains(text, F.lit(":")), F.substring_index(text, " ", 1))
            .when(F.length(text) >= 10, F.substring(text, 1, 10))
            .otherwise(text))


def date_of_text(value: Column) -> Column:
    ten = F.substring(value, 1, 10)
    return F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), ten.try_cast("date"))


def cut_fraction(value: Column) -> Column:
    return F.substring_index(value, ".", 1)


def epoch_date(seconds: Column, zone_hours: float = 0.0) -> Column:
    """Calendar day of an epoch second in the zone ``zone_hours`` east of UTC, as text."""
    days = F.floor((seconds + int(zone_hours * 3600)) / 86400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
