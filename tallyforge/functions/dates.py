"""Dates out of text as column expressions: one guard and pattern for each format, in order of priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCEL = "excel"
# The formats read, in order of priority; the last is a spreadsheet's day number.
FORMATS = [
    "%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%d/%m/%Y", "%d/%m/%y", "%Y/%m/%d", "%d-%b-%Y", "%d-%b-%y", "%b %d, %Y", "%m-%d-%Y", "%d-%m-%Y",
    "%d.%m.%Y", "%B %d, %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%d %B, %Y", "%d %b, %Y", "%Y%m%d", EXCEL,
]
_PARTS = {"%Y": (r"\d{4}", "yyyy"), "%y": (r"\d{2}", "yy"), "%m": (r"\d{1,2}", "M"), "%d": (r"\d{1,2}", "d"), "%b": ("[A-Za-z]{3}", "MMM"), "%B": ("[A-Za-z]{3,9}", "MMMM")}


def _guard_and_pattern(name: str) -> tuple[str, str]:
    """The regular expression that a text of the format matches, and Spark's pattern; numbers without a separator have two digits."""
    guard, pattern = name.replace(".", r"\."), name
    for directive, (expression, letters) in _PARTS.items():
        packed = directive in ("%m", "%d") and "%Y%m%d" in name
        guard, pattern = guard.replace(directive, r"\d{2}" if packed else expression), pattern.replace(directive, letters * 2 if packed else letters)
    return guard, pattern


TWINS = {"%m/%d/%Y": "%d/%m/%Y", "%m-%d-%Y": "%d-%m-%Y", "%m/%d/%y": "%d/%m/%y"}
EXCEL_LOW, EXCEL_HIGH = 30_000, 60_000


def strip_time(value: Column) -> Column:
    """The text without a time of day after the date, trimmed."""
    clock, zone = r"\d\d?(?::\d\d){1,2}(?:\.\d+)?", r"(?: *(?:Z|[+-]\d\d:?\d\d))?"
    return F.regexp_replace(F.trim(value), f"(?:T| ){clock}{zone}$", "")


def parse_format(value: Column, name: str) -> Column:
    """The date, if the text has this format and is a day of the calendar. Two-digit years from 69 on are of the last century."""
    return _parse(strip_time(value), name)


def _parse(text: Column, name: str) -> Column:
    """The same of a text without a time."""
    if name == EXCEL:
        number = F.when(text.rlike(r"^\d{5}(\.\d+)?$"), F.floor(text.try_cast("double")).cast("int"))
        return F.when(number.between(EXCEL_LOW, EXCEL_HIGH), F.date_add(F.lit("1899-12-30").cast("date"), number))
    guard, pattern = _guard_and_pattern(name)
    day = F.when(text.rlike(f"^(?:{guard})$"), F.to_date(F.try_to_timestamp(F.initcap(text) if "MMM" in pattern else text, F.lit(pattern))))
    if pattern.endswith("yy") and not pattern.endswith("yyyy"):
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day


def parsed_by_format(value: Column) -> Column:
    """What each of FORMATS reads in the text, as an array: where several questions are asked of a value, it is parsed once."""
    return F.transform(F.array(strip_time(value)), lambda text: F.array(*[_parse(text, n) for n in FORMATS]))[0]


def of_format(parsed: Column, column_format: Column) -> Column:
    """The item of ``parsed_by_format`` that a format's name asks for."""
    return F.get(parsed, (F.array_position(F.array(*[F.lit(n) for n in FORMATS]), column_format) - 1).cast("int"))


def parse_excel(value: Column) -> Column:
    """A spreadsheet's day number, 30000 to 60000 (days since 1899-12-30; a fraction is the time)."""
    return parse_format(value, EXCEL)


def parse_any(value: Column) -> Column:
    return F.coalesce(*[parse_format(value, n) for n in FORMATS])


def parse_date(value: Column, column_format: str | None = None) -> Column:
    """By the column's format first, then by any."""
    return F.coalesce(parse_format(value, column_format), parse_any(value)) if column_format else parse_any(value)


def read_date(parsed: Column, column_format: Column) -> Column:
    """The same of ``parsed_by_format``, with the format's name in a column."""
    return F.coalesce(of_format(parsed, column_format), F.get(F.array_compact(parsed), F.lit(0)))


def ambiguous_off_format(value: Column, parsed: Column, column_format: Column) -> Column:
    """Whether a value off its column's format can be read day first and month first: two different numbers of at most 12."""
    numbers = r"^(\d{1,2})[-/](\d{1,2})[-/]\d{2,4}"
    first, second = (F.regexp_extract(F.trim(value), numbers, k).try_cast("int") for k in (1, 2))
    return F.coalesce((first != second) & (F.greatest(first, second) <= 12) & of_format(parsed, column_format).isNull(), F.lit(False))


def infer_formats(df: DataFrame, column: str, group: list[str], parsed: str | None = None) -> DataFrame:
    """group, format, n_parsed, ambiguous: the format that reads most of a column, the earlier one on ties.

    Ambiguous if the day-first twin reads as many and changes a date. One aggregation over all formats; no second pass. ``parsed`` names a
    column of ``parsed_by_format``, if there is one."""
    if parsed is None:
        df, parsed = df.withColumn("_parsed", parsed_by_format(F.col(column))), "_parsed"
    item = lambda n: F.get(F.col(parsed), F.lit(FORMATS.index(n)))
    counts = [F.count(item(n)).alias(f"_n{i}") for i, n in enumerate(FORMATS)]
    differs = [F.count_if(item(a) != item(b)).alias(f"_d{FORMATS.index(a)}") for a, b in TWINS.items()]
    counted = df.groupBy(*group).agg(*counts, *differs)
    most = F.greatest(*[F.col(f"_n{i}") for i in range(len(FORMATS))])
    best = F.coalesce(*[F.when((F.col(f"_n{i}") == most) & (most > 0), F.lit(n)) for i, n in enumerate(FORMATS)])
    ambiguous = F.lit(False)
    for a, b in TWINS.items():
        i, j = FORMATS.index(a), FORMATS.index(b)
        ambiguous = ambiguous | ((best == a) & (F.col(f"_n{i}") == F.col(f"_n{j}")) & (F.col(f"_d{i}") > 0))
    return counted.select(*group, best.alias("format"), most.cast("long").alias("n_parsed"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def weekday_date(month: Column, day: Column, weekday: Column, anchors: Column) -> Column:
    """The date of that month, day and weekday (Monday 0) nearest to the latest anchor, at most 183 days off; null if none.

    ``anchors`` is an array of dates; years from one before the first to one after the last are tried."""
    years = F.sequence(F.year(F.array_min(anchors)) - 1, F.year(F.array_max(anchors)) + 1)
    text = lambda y: F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int"))
    days = F.filter(F.transform(years, lambda y: text(y).try_cast("date")), lambda d: d.isNotNull() & (F.weekday(d) == weekday))
    off = F.transform(days, lambda d: F.struct(F.abs(F.datediff(d, F.array_max(anchors))).alias("off"), d.alias("d")))
    near = F.array_min(off)
    return F.when(near["off"] <= 183, near["d"])


def week_bounds(day: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the day's week."""
    monday = F.date_sub(day, F.weekday(day))
    return monday, F.date_add(monday, 6)


def days_left_band(days: Column) -> Column:
    """overdue, 0-30, 31-60, 61-90; null beyond."""
    return F.when(days < 0, "overdue").when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90")


_WEEKDAY = r"(?i)\b(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAY_FORMS = (r"^(\d{1,2})/(\d{1,2})$", r"^(\d{1,2}) ?([a-z]{3})[a-z]*\.?$", r"^([a-z]{3})[a-z]*\.? ?(\d{1,2})$")


def _day_parts(header: Column) -> tuple[Column, Column, Column, Column]:
    """(weekday with Monday 0, month, day, what is left beside the weekday) of a header."""
    plain = F.trim(F.regexp_replace(F.lower(header), r"\s+", " "))
    weekday = F.array_position(F.array(*[F.lit(d) for d in "mon tue wed thu fri sat sun".split()]), F.regexp_extract(plain, _WEEKDAY, 1)) - 1
    rest = F.regexp_replace(F.regexp_replace(plain, _WEEKDAY, ""), r"^[ ,]+|[ ,]+$", "")
    slash, day_first, month_first = _DAY_FORMS
    number = lambda form, k: F.regexp_extract(rest, form, k).try_cast("int")
    named = lambda form, k: F.nullif(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(rest, form, k)).cast("int"), F.lit(0))
    month = F.coalesce(number(slash, 1), named(day_first, 2), named(month_first, 1))
    day = F.coalesce(number(slash, 2), number(day_first, 1), number(month_first, 2))
    return F.when(weekday >= 0, weekday), month, day, rest


def names_day(header: Column) -> Column:
    """Whether a header names a day as 'Mon 09/14', '09/14', '18 Sep', 'Sep 18' or a date with its year."""
    _, month, day, rest = _day_parts(header)
    return F.coalesce((month.isNotNull() & day.isNotNull()) | F.when(rest.rlike(r"\d{4}"), parse_any(rest).isNotNull()), F.lit(False))


def schedule_day(header: Column, anchors: Column) -> Column:
    """struct(day, issue) of a schedule's column. A date with its year stands for itself; else the year is that in which the weekday fits
    nearest to the latest of the anchors, or that of the nearest such day. No day is 'schedule_dates:header', a day of another weekday
    'day_mismatch:header'."""
    weekday, month, day, rest = _day_parts(header)
    whole = F.when(rest.rlike(r"\d{4}"), parse_any(rest))
    last = F.array_max(anchors)
    made = F.transform(F.array(*[F.year(last) + k for k in (-1, 0, 1)]), lambda y: F.format_string("%04d-%02d-%02d", y, month, day).try_cast("date"))
    near = F.array_min(F.transform(F.array_compact(made), lambda d: F.struct(F.abs(F.datediff(d, last)).alias("off"), d.alias("d"))))
    known = month.isNotNull() & day.isNotNull() & last.isNotNull()
    found = F.coalesce(whole, F.when(known & weekday.isNotNull(), weekday_date(month, day, weekday, anchors)), F.when(known, near["d"]))
    issue = F.when(found.isNull(), F.concat(F.lit("schedule_dates:"), header)).when(F.weekday(found) != weekday, F.concat(F.lit("day_mismatch:"), header))
    return F.struct(found.alias("day"), issue.alias("issue"))
