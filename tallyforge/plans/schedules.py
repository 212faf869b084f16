"""Schedules as they come in files - a row a person, a column a day - to shifts: dates of day columns, legends, letter codes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates, text
from tallyforge.operators.matching import header_similarity
from tallyforge.sources.landing import headers

from .pack import Pack

#: Fields that say who a row of a schedule is about.
PLACES = ("person.full_name", "person.role", "person.facility")
_CLOCK = r"\d{1,2}(?::\d{2})?\s*[ap]?m?"
_TOKEN = rf"(?i)\b({_CLOCK}\s*(?:-|–|—|to)\s*{_CLOCK})(?!\w|:\d)"


def anchors(records: DataFrame) -> list[date]:
    """The distinct first and last days of pay periods, in order: as many as the calendar has at most. Other dates lie years off and
    give a schedule no year."""
    days = F.explode(F.array(F.col("fields")["pay.period_start"].try_cast("date"), F.col("fields")["pay.period_end"].try_cast("date")))
    return [r["d"] for r in records.select(days.alias("d")).filter("d is not null").distinct().orderBy("d").collect()]


def legends(notes: DataFrame) -> DataFrame:
    """notes(table_id, note) to (table_id, start_min, end_min, hours): the hours that a sentence gives to every token in it."""
    sentences = notes.select("table_id", F.explode(F.split("note", r"(?i)(?<=[a-z])\.(?=\s)|[;\n]")).alias("s"))
    hours = F.regexp_extract("s", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*h(?:(?:ou)?rs?)?\b", 1).try_cast("double")
    tokens = sentences.withColumn("hours", hours).filter("hours is not null").select("table_id", "hours", F.explode(F.regexp_extract_all("s", F.lit(_TOKEN), F.lit(1))).alias("token"))
    # exploded, so that the long expression stands once in the plan, whatever is asked of it
    read = tokens.select("table_id", "hours", F.explode(F.array(text.parse_shift(F.col("token")))).alias("t")).filter("t.kind = 'shift'")
    return read.groupBy("table_id", F.col("t.start_min").alias("start_min"), F.col("t.end_min").alias("end_min")).agg(F.max("hours").alias("hours"))


def letter_codes(notes: DataFrame) -> DataFrame:
    """notes(table_id, note) to (table_id, code, token): capital letters that stand for a token, as 'D = 7a-3p' or 'Day (D) 7a-3p'."""
    parts = notes.select("table_id", F.explode(F.split("note", r"[,;\n]")).alias("s"))
    named, bracket = F.regexp_extract("s", r"\b([A-Z]{1,3})\s*[:=]", 1), F.regexp_extract("s", r"\(([A-Z]{1,3})\)", 1)
    read = parts.select("table_id", F.when(named != "", named).otherwise(bracket).alias("code"), F.regexp_extract("s", _TOKEN, 1).alias("token"))
    return read.filter("code <> '' and token <> ''").groupBy("table_id", "code").agg(F.min("token").alias("token"))


def find_schedules(cells: DataFrame, pack: Pack, least_days: int = 3) -> list[tuple[str, dict[str, str], list[str]]]:
    """(table_id, {field: column}, day columns) of the tables of which three headers or more name a day and one names people. Tables
    are metadata, a few headers each."""
    named = headers(cells).withColumn("days", F.filter("columns", lambda c: dates.names_day(c)))
    out = []
    for r in named.filter(F.size("days") >= least_days).orderBy("table_id").collect():
        rest = [c for c in r["columns"] if c not in r["days"]]
        best = {f: max(((header_similarity(c, pack.fields[f].synonyms), c) for c in rest), default=(0.0, "")) for f in PLACES}
        found = {f: c for f, (score, c) in best.items() if score >= 0.8}
        if "person.full_name" in found:
            out.append((r["table_id"], found, r["days"]))
    return out


def hours_rule(computed: Column, legend: Column) -> tuple[Column, Column]:
    """(hours, their source): the times count, the legend checks them ('both' where it agrees) or stands in."""
    off = F.coalesce(F.abs(computed - legend) > 0.01, F.lit(False))
    source = F.when(computed.isNull(), F.when(legend.isNull(), "unknown").otherwise("legend")).when(legend.isNotNull() & ~off, "both").otherwise("computed")
    return F.coalesce(computed, legend), source


def schedule_tables(cells: DataFrame, found: list[tuple[str, dict[str, str], list[str]]], anchor_days: list[date], pack: Pack, notes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of the schedules ``found`` among the cells.

    rows: record_id, table_id, full_name, role, facility, work_date, token, shift, hours, hours_source, legend_hours - as ``engine.schedule_rows`` gives
    them, for all tables in one job. A facility that the row lacks is looked for in the sheet's and then the file's name. issues: record_id,
    parse_issues ('shift:cell', and on a table's first row 'schedule_dates:header' and 'day_mismatch:header').
    A cell without a date, or of a day off, gives no shift."""
    spark = cells.sparkSession
    roles = spark.createDataFrame([(t, c, f.split(".")[1]) for t, m, _ in found for f, c in m.items()], "table_id string, col_name string, field string")
    named = spark.createDataFrame([(t, c) for t, _, days in found for c in days], "table_id string, col_name string")
    known_days = F.array(*[F.lit(d) for d in anchor_days]).cast("array<date>")
    day = named.withColumn("d", dates.schedule_day(F.col("col_name"), known_days)).select("table_id", "col_name", F.col("d.day").alias("work_date"), F.col("d.issue").alias("issue"))
    who = cells.join(roles, ["table_id", "col_name"]).groupBy("table_id", "src_row", "sheet", "file_name").agg(*[F.max(F.when(F.col("field") == f.split(".")[1], F.col("value"))).alias(f.split(".")[1]) for f in PLACES])
    vocab = lambda v: [(a, c) for a, c in pack.aliases(v)]
    place = F.coalesce(*[text.alias_in_text(F.coalesce(F.col(c), F.lit("")), [(text.clean_text(a), k) for a, k in vocab("facilities")]) for c in ("facility", "sheet", "file_name")]) if vocab("facilities") else F.col("facility")
    role = F.create_map(*[F.lit(x) for a, k in {text.clean_text(a): k for a, k in vocab("roles")}.items() for x in (a, k)])[text.clean(F.col("role"))] if vocab("roles") else F.col("role")
    key = F.concat(F.lit("S-"), F.substring(F.sha1(F.concat_ws("|", "table_id", "src_row")), 1, 12))
    people = who.select("table_id", "src_row", key.alias("record_id"), "full_name", role.alias("role"), place.alias("facility"))
    long = cells.join(day, ["table_id", "col_name"]).join(people, ["table_id", "src_row"]).withColumn("token", F.trim("value"))
    if notes is None:
        notes = spark.createDataFrame([], "table_id string, note string")
    codes = letter_codes(notes).select("table_id", F.col("code").alias("token"), F.col("token").alias("_means"))
    long = long.join(codes, ["table_id", "token"], "left").select("*", F.explode(F.array(text.parse_shift(F.coalesce("_means", "token")))).alias("shift"))
    known = legends(notes).select("table_id", "start_min", "end_min", F.col("hours").alias("_legend"))
    long = long.withColumns({"start_min": F.col("shift.start_min"), "end_min": F.col("shift.end_min")}).join(known, ["table_id", "start_min", "end_min"], "left")
    hours, source = hours_rule(F.col("shift.hours"), F.col("_legend"))
    long = long.withColumns({"hours": hours, "hours_source": source})
    worked = (F.col("shift.kind") == "shift") & F.col("work_date").isNotNull()
    rows = long.filter(worked).select("record_id", "table_id", "full_name", "role", "facility", "work_date", "token", "shift", "hours", "hours_source", F.col("_legend").alias("legend_hours"))
    wrong = F.when(F.col("shift.kind").isNull(), F.concat(F.lit("shift:"), "token"))
    cell = long.select("record_id", wrong.alias("issue")).filter("issue is not null")
    first = people.groupBy("table_id").agg(F.min_by("record_id", "src_row").alias("record_id"))
    head = day.filter("issue is not null").join(first, "table_id").select("record_id", "issue")
    issues = cell.unionByName(head).groupBy("record_id").agg(F.array_sort(F.collect_list("issue")).alias("parse_issues"))
    return rows, issues
