"""Time stamps of log lines: normalising, casting and guessing the year."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java_regex, strip
from .text import with_value

# English abbreviations as the log formats write them.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_MONTH = "(" + "|".join(MONTHS) + ")"
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_CLOCK = r"(2[0-3]|[01]\d|\d):([0-5]\d|\d):([0-5]\d|\d)"
_OFFSET = r"(?:\s+(?:[+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|Z))?"

# day/month/year:clock, with or without an offset
_SLASHED = java_regex(rf"^{_DAY}/{_MONTH}/(\d{{4}}):{_CLOCK}{_OFFSET}$", ignore_case=True)
# month day clock year; a fraction is read only behind a weekday
_SPELLED = java_regex(
    rf"^(?:(?:{'|'.join(WEEKDAYS)})\s+|(?!.*\.)){_MONTH}\s+{_DAY}\s+{_CLOCK}(?:\.\d{{1,6}})?\s+(\d{{4}})$",
    ignore_case=True,
)
_YEARLESS = java_regex(rf"^{_MONTH}\s+{_DAY}\s+{_CLOCK}$", ignore_case=True)


# The layouts servers really write, on days every month has: these need no calendar.
_NAMES = "(?:" + "|".join(m.capitalize() for m in MONTHS) + ")"
_TIME = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_SAFE_DAY = "(?:0[1-9]|1[0-9]|2[0-8])"
_USUAL_ACCESS = rf"^{_SAFE_DAY}/{_NAMES}/[1-9][0-9]{{3}}:{_TIME} [+-][0-9]{{2}}[0-5][0-9]$"
_USUAL_ERROR = (
    rf"^(?:{'|'.join(d.capitalize() for d in WEEKDAYS)}) {_NAMES} {_SAFE_DAY} {_TIME}"
    r"(?:\.[0-9]{1,6})? [1-9][0-9]{3}$"
)
_USUAL = rf"^{_NAMES} (?: [1-9]|0[1-9]|[12][0-9]|3[01]) {_TIME}$"


def normalize_timestamp(raw: Column) -> Column:
    """``Mon dd HH:MM:SS`` of a web time stamp; its first 20 characters if unknown.

    Year, fraction and offset are left out, nothing is converted. The day must
    exist in the stated year.
    """
    usual_access = F.concat(
        F.substring(raw, 4, 3),
        F.lit(" "),
        F.substring(raw, 1, 2),
        F.lit(" "),
        F.substring(raw, 13, 8),
    )
    clean = strip(F.trim(raw, F.lit("[]")))
    same_order = F.regexp_replace(clean, _SLASHED, "$2 $1 $4:$5:$6 $3")
    spelled = F.regexp_replace(same_order, _SPELLED, "$1 $2 $6|$3:$4:$5")

    def render(pieces: Column) -> Column:
        date = F.regexp_replace(F.substring_index(pieces, "|", 1), r"\s+", " ")
        day = F.when(F.contains(pieces, F.lit("|")), F.try_to_date(F.initcap(date), "MMM d yyyy"))
        clock = _two_digits(F.substring_index(pieces, "|", -1))
        return F.concat(F.date_format(day, "MMM dd"), F.lit(" "), clock)

    return (
        F.when(raw.rlike(_USUAL_ACCESS), usual_access)
        .when(raw.rlike(_USUAL_ERROR), F.substring(raw, 5, 15))
        .otherwise(F.coalesce(with_value(spelled, render), F.substring(raw, 1, 20)))
    )


def source_year(raw: Column) -> Column:
    """The year that a web time stamp states; null where it has no layout that states one."""
    clean = strip(F.trim(raw, F.lit("[]")))
    year = F.coalesce(
        F.nullif(F.regexp_extract(clean, _SLASHED, 3), F.lit("")), F.nullif(F.regexp_extract(clean, _SPELLED, 6), F.lit(""))
    )
    return (
        F.when(raw.rlike(_USUAL_ACCESS), F.substring(raw, 8, 4))
        .when(raw.rlike(_USUAL_ERROR), F.substring(raw, -4, 4))
        .otherwise(year)
        .cast("int")
    )


def source_offset(raw: Column) -> Column:
    """The offset from UTC behind ``day/month/year:clock``, as written; null without one."""
    clean = strip(F.trim(raw, F.lit("[]")))
    stated = F.when(clean.rlike(_SLASHED), F.regexp_extract(clean, r"\s([+-][0-9:.]+|[Zz])$", 1))
    return F.when(raw.rlike(_USUAL_ACCESS), F.substring(raw, -5, 5)).otherwise(F.nullif(stated, F.lit("")))


def _two_digits(clock: Column) -> Column:
    return F.regexp_replace(clock, r"\b(\d)\b", "0$1")


def usual_layout(timestamp: Column) -> Column:
    """``Mon dd HH:MM:SS`` at fixed places; null if it is no time stamp."""
    pieces = F.regexp_replace(timestamp, _YEARLESS, "$1|$2|$3:$4:$5")
    unusual = F.concat(
        F.initcap(F.substring_index(pieces, "|", 1)),
        F.lit(" "),
        F.lpad(F.trim(F.substring_index(F.substring_index(pieces, "|", 2), "|", -1)), 2, " "),
        F.lit(" "),
        _two_digits(F.substring_index(pieces, "|", -1)),
    )
    return F.when(timestamp.rlike(_USUAL), timestamp).when(timestamp.rlike(_YEARLESS), unusual)


def infer_datetime(stamp: Column, now: datetime, stated: Column | None = None) -> Column:
    """The latest time up to ``now`` with the fields of ``stamp``, this year or the last.

    ``stamp`` has the usual layout. A 29 February is no valid day: a stamp without
    a year is read in a common year. The year ``stated``, if not null, is taken as it is.
    """
    names = F.lit("".join(m.capitalize() for m in MONTHS))
    month = F.floor((F.position(F.substring(stamp, 1, 3), names) + 2) / 3).cast("int")
    day = F.trim(F.substring(stamp, 5, 2)).cast("int")
    clock = F.substring(stamp, 8, 8)
    hour, minute, second = (F.substring(stamp, i, 2).cast("int") for i in (8, 11, 14))
    moment = (now.month, now.day, now.strftime("%H:%M:%S"))
    in_future = F.struct(month, day, clock) > F.struct(*[F.lit(v) for v in moment])
    year = F.when(in_future, now.year - 1).otherwise(now.year)
    guessed = F.when(~((month == 2) & (day == 29)), year)
    if stated is not None:
        guessed = F.coalesce(stated, guessed)
    return F.try_make_timestamp_ntz(guessed, month, day, hour, minute, second)


def epoch_micros(moment: Column) -> Column:
    """Microseconds on the wall clock since 1970, whatever the session time zone."""
    hours = F.unix_date(moment.cast("date")).cast("bigint") * 24 + F.hour(moment)
    seconds = (hours * 60 + F.minute(moment)) * 60
    fraction = F.extract(F.lit("SECOND"), moment) * 1_000_000
    return seconds * 1_000_000 + fraction.cast("bigint")
