"""Date and time functions.  Texts and timestamps are both accepted; the session's time zone is UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.strings import col

# What each specifier means as a pattern of Spark.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh"}
MYSQL = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "p": "a", "j": "DDD"}


def pattern(text: str, names: dict[str, str]) -> str:
    """A Spark pattern of a %-pattern; other letters are quoted."""
    out = []
    for piece in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+|%$", text):
        if piece[0] == "%" and len(piece) == 2:
            if piece == "%%":
                out.append("%")
            elif piece[1] in names:
                out.append(names[piece[1]])
            else:
                raise ValueError(f"unknown specifier {piece}")
        else:
            out.append(f"'{piece}'" if piece[0].isalpha() else piece.replace("'", "''"))
    return "".join(out)


def strftime(c: Column | str, fmt: str) -> Column:
    if "%s" in fmt:
        parts = re.split(r"(%s)", fmt)
        return F.concat(*(F.unix_timestamp(col(c).cast("timestamp")).cast("string") if p == "%s" else strftime(c, p) for p in parts if p))
    return F.date_format(col(c), pattern(fmt, STRFTIME))


def str_to_date(c: Column | str, fmt: str) -> Column:
    return F.try_to_timestamp(col(c), F.lit(pattern(fmt, MYSQL)))


def date(c: Column | str) -> Column:
    return F.to_date(col(c))


def time(c: Column | str) -> Column:
    return F.date_format(col(c), "HH:mm:ss")


def datetime(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def julian_day(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp")) / 86_400e6 + 2440587.5


def weekday(c: Column | str) -> Column:
    """0 = Sunday."""
    return F.dayofweek(col(c)) - 1


def year_week(c: Column | str) -> Column:
    """ISO year times 100 plus ISO week."""
    return F.extract(F.lit("YEAROFWEEK"), col(c)) * 100 + F.weekofyear(col(c))


def day_name(c: Column | str) -> Column:
    return F.date_format(col(c), "EEEE")


def month_name(c: Column | str) -> Column:
    return F.date_format(col(c), "MMMM")


_MICROS = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}


def timestamp_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """Whole units from start to end; months, quarters and years are differences of calendar fields."""
    a, b, unit = col(start), col(end), unit.upper()
    if unit in _MICROS:
        micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
        return ((micros - micros % _MICROS[unit]) / _MICROS[unit]).cast("bigint")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    quarters = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    return {"MONTH": months, "QUARTER": quarters, "YEAR": F.year(b) - F.year(a)}[unit].cast("bigint")


_UNITS = {"second": "secs", "minute": "mins", "hour": "hours", "day": "days", "week": "weeks", "month": "months", "year": "years"}


def modify(c: Column | str, *modifiers: str) -> Column:
    """Modifiers from left to right: '+N unit', '-N unit', 'start of day|month|year'."""
    out = col(c).cast("timestamp")
    for m in modifiers:
        if start := re.fullmatch(r"start of (day|month|year)", m.strip()):
            out = F.date_trunc(start[1], out)
        elif step := re.fullmatch(r"([+-]?\d+) (second|minute|hour|day|week|month|year)s?", m.strip()):
            out = out + F.make_interval(**{_UNITS[step[2]]: F.lit(int(step[1]))})
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return out


def make_date(year: Column | str, day: Column | str) -> Column:
    return F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), (col(day) - 1).cast("int"))


def make_time(h: Column | str, m: Column | str, s: Column | str) -> Column:
    return F.format_string("%02d:%02d:%02d", col(h), col(m), col(s))


def seconds_to_time(c: Column | str) -> Column:
    n = col(c).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)


def time_to_seconds(c: Column | str) -> Column:
    p = F.split(col(c), ":")
    return p[0].cast("bigint") * 3600 + p[1].cast("bigint") * 60 + F.coalesce(F.get(p, F.lit(2)).cast("bigint"), F.lit(0))


def to_days(c: Column | str) -> Column:
    """Days since year 0 by the proleptic calendar."""
    return F.datediff(col(c), F.lit("1970-01-01").cast("date")) + 719528


def from_days(c: Column | str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (col(c) - 719528).cast("int"))


def start_of(unit: str, c: Column | str) -> Column:
    return F.date_trunc(unit, col(c))


def end_of(unit: str, c: Column | str) -> Column:
    """The last microsecond of the day, week (Monday first), month or year."""
    step = {"day": F.make_interval(days=F.lit(1)), "week": F.make_interval(weeks=F.lit(1)), "month": F.make_interval(months=F.lit(1)), "year": F.make_interval(years=F.lit(1))}[unit]
    return start_of(unit, c) + step - F.expr("INTERVAL 1 MICROSECOND")


def is_leap_year(c: Column | str) -> Column:
    y = F.year(col(c))
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_month(c: Column | str) -> Column:
    return F.dayofmonth(F.last_day(col(c)))


def is_weekend(c: Column | str) -> Column:
    return F.dayofweek(col(c)).isin(1, 7)


def age(born: Column | str, at: Column | str) -> Column:
    return F.floor(F.months_between(col(at), col(born)) / 12)


def minute(c: Column | str) -> Column:
    return F.minute(col(c))


def second(c: Column | str) -> Column:
    return F.second(col(c))


def from_unix(c: Column | str) -> Column:
    return F.timestamp_seconds(col(c))


def parts(c: Column | str) -> Column:
    """Struct of the calendar fields."""
    t = col(c).cast("timestamp")
    fields = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t), "weekday": weekday(t), "yearday": F.dayofyear(t)}
    return F.struct(*(v.cast("int").alias(k) for k, v in fields.items()))


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    x, y = col(a).cast("timestamp"), col(b).cast("timestamp")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def before(a: Column | str, b: Column | str) -> Column:
    return compare(a, b) < 0


def after(a: Column | str, b: Column | str) -> Column:
    return compare(a, b) > 0


def equal(a: Column | str, b: Column | str) -> Column:
    return compare(a, b) == 0


def between(c: Column | str, low: Column | str, high: Column | str) -> Column:
    """Both ends count."""
    return (compare(c, low) >= 0) & (compare(c, high) <= 0)


def add(c: Column | str, n: int, unit: str) -> Column:
    return modify(c, f"{n:+d} {unit.rstrip('s')}")


def days_in_year(c: Column | str) -> Column:
    return F.when(is_leap_year(c), 366).otherwise(365)


def is_workday(c: Column | str) -> Column:
    return ~is_weekend(c)


def parse_duration(c: Column | str) -> Column:
    """Seconds (double) of a text such as 1h30m, 250ms or -2.5s; NULL for anything else."""
    scale = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    text = F.regexp_replace(col(c), "^[+-]", "")
    pieces = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)"), F.lit(0))

    def seconds(x: Column) -> Column:
        unit = F.regexp_extract(x, r"[a-zµ]+$", 0)
        factor = F.lit(1.0)
        for name, value in scale.items():
            factor = F.when(unit == name, value).otherwise(factor)
        return F.regexp_extract(x, r"^[0-9.]+", 0).cast("double") * factor

    total = F.aggregate(pieces, F.lit(0.0), lambda acc, x: acc + seconds(x))
    good = text.rlike(r"^(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:ns|us|µs|ms|s|m|h))+$")
    return F.when(good, F.when(col(c).startswith("-"), -total).otherwise(total)).when(col(c).isin("0", "+0", "-0"), 0.0)


def format_duration(c: Column | str) -> Column:
    """Seconds as days, hours, minutes and seconds; 0s for none."""
    n = col(c).cast("bigint")
    fields = ((F.floor(n / 86400), "d"), (F.floor(n / 3600) % 24, "h"), (F.floor(n / 60) % 60, "m"), (n % 60, "s"))
    text = F.concat_ws(" ", *(F.when(v > 0, F.concat(v.cast("bigint").cast("string"), F.lit(unit))) for v, unit in fields))
    return F.when(n.isNotNull(), F.when(text == "", "0s").otherwise(text))


def convert_timezone(c: Column | str, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), col(c).cast("timestamp_ntz"))
