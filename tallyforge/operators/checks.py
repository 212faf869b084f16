"""The catalogue of data-quality checks over gold views, and the engine that runs them.

A check is a function of (views, settings) to drafts: entity_ids, facility_id, period_start, period_end, message, key,
severity. Every join is an equi-join with the range as residual; correlated subqueries are aggregates joined back. Time
only enters as ``settings.as_of``. A check that fails becomes one CHECK-ERROR draft and stops nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled
from .intervals import longest_coverage, overlapping_pairs
from .issues import fingerprint

Views = dict[str, DataFrame]


@dataclass(frozen=True)
class Settings:
    as_of: date
    hours_tol_abs: float = 2.0
    hours_tol_rel: float = 0.05
    expiry_high_days: int = 30
    expiry_medium_days: int = 60
    daily_limit: float = 16.0
    coverage_hours: float = 8.0
    licensed_roles: tuple[str, ...] = ("RN", "LPN", "CNA")
    coverage_role: str = "RN"


CHECKS: dict[str, tuple[str, str, Callable[[Views, Settings], DataFrame]]] = {}
DRAFT = "entity_ids array<string>, facility_id string, period_start date, period_end date, message string, key string, severity string, evidence array<string>"


def check(check_id: str, severity: str, title: str):
    """Registers a check; a draft without a severity has this one, one without a message this title."""

    def register(fn):
        CHECKS[check_id] = (severity, title, fn)
        return fn

    return register


def drafts(df: DataFrame, entities: Column | list[Column], *, facility: Column | None = None, start: Column | None = None, end: Column | None = None, message: Column | None = None, key: Column | None = None, severity: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """``evidence``: the rows that the finding rests on, as 'table:id' (see ``listed`` and ``one_row``)."""
    null = F.lit(None)
    ids = F.array(*entities) if isinstance(entities, list) else entities
    return df.select(
        ids.cast("array<string>").alias("entity_ids"), (null if facility is None else facility).cast("string").alias("facility_id"),
        (null if start is None else start).cast("date").alias("period_start"), (null if end is None else end).cast("date").alias("period_end"),
        (null if message is None else message).cast("string").alias("message"), (null if key is None else key).cast("string").alias("key"),
        (null if severity is None else severity).cast("string").alias("severity"), (F.array() if evidence is None else evidence).cast("array<string>").alias("evidence"),
    )


def _one(value: str) -> Column:
    """The value that all rows of the group share, else null."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


def listed(table: str, row_id: str, *order: str, most: int | None = None) -> Column:
    """The ids of a group's rows as 'table:id', by ``order`` and then id; the first ``most`` of them, if given."""
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col(row_id).isNotNull(), F.struct(*order, F.col(row_id).alias("_id"))))), lambda r: F.concat(F.lit(f"{table}:"), r["_id"]))
    return F.slice(rows, 1, most) if most else rows


def one_row(table: str, *row_ids: str) -> Column:
    return F.array_compact(F.array(*[F.concat(F.lit(f"{table}:"), F.col(c)) for c in row_ids]))


def _days(value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda d: F.date_format(d, "yyyy-MM-dd")), ", ")


@check("COV-RN-DAILY", "CRITICAL", "Nurse coverage below the daily minimum")
def coverage(v: Views, s: Settings) -> DataFrame:
    """Per facility and week (Monday to Sunday, all weeks its shifts touch): days whose longest merged span is too short. Shifts
    without a facility count for none; they are one finding of their own."""
    nurse = v["shifts"].filter((F.col("role") == s.coverage_role) & F.col("facility_id").isNotNull() & F.col("start_ts").isNotNull())
    monday = F.date_sub("work_date", F.weekday("work_date"))
    span = v["shifts"].filter("facility_id is not null").groupBy("facility_id").agg(F.min(monday).alias("lo"), F.date_add(F.max(monday), 6).alias("hi"))
    days = span.withColumn("day", F.explode(F.sequence("lo", "hi"))).select("facility_id", "day")
    covered = longest_coverage(nurse, ["facility_id"], "start_ts", "end_ts")
    short = days.join(covered, ["facility_id", "day"], "left").filter(F.coalesce("covered_minutes", F.lit(0.0)) < s.coverage_hours * 60)
    week = short.withColumn("monday", F.date_sub("day", F.weekday("day"))).groupBy("facility_id", "monday").agg(_days("day").alias("days"), F.count("*").alias("n"))
    held = nurse.groupBy("facility_id", F.date_sub("work_date", F.weekday("work_date")).alias("monday")).agg(listed("shifts", "shift_id", "start_ts", most=10).alias("evidence"))
    found = drafts(week.join(held, ["facility_id", "monday"], "left"), [F.col("facility_id")], facility=F.col("facility_id"), start=F.col("monday"), end=F.date_add("monday", 6), message=F.concat(F.lit("Too little coverage on "), F.col("days")), key=F.col("days"), evidence=F.coalesce("evidence", F.array().cast("array<string>")))
    lost = v["shifts"].filter("facility_id is null")
    some = lost.orderBy("shift_id").limit(10).agg(listed("shifts", "shift_id").alias("evidence"))
    n = lost.agg(F.count("*").alias("n")).filter("n > 0")
    return found.unionByName(drafts(n.join(some), F.array(), message=F.format_string("%d shifts without a facility count for no coverage", "n"), key=F.lit("no-facility"), severity=F.lit("MEDIUM"), evidence=F.col("evidence")))


@check("FAC-MISMATCH", "MEDIUM", "Shifts away from the home facility")
def facility_mismatch(v: Views, s: Settings) -> DataFrame:
    away = v["shifts"].join(v["persons"].select("person_id", "home_facility"), "person_id").filter("facility_id <> home_facility")
    grouped = away.groupBy("person_id", "facility_id", "home_facility").agg(F.count("*").alias("n"), F.min("work_date").alias("first"), F.max("work_date").alias("last"), listed("shifts", "shift_id", "work_date").alias("evidence"))
    return drafts(grouped, [F.col("person_id")], facility=F.col("facility_id"), start=F.col("first"), end=F.col("last"), message=F.format_string("%d shifts away from %s", "n", "home_facility"), evidence=F.col("evidence"))


@check("HR-DUP-ROW", "MEDIUM", "One employee id on several differing rows")
def duplicate_rows(v: Views, s: Settings) -> DataFrame:
    rows = v["records"].filter("template = 'hr_roster' and employee_id is not null").withColumn("id", F.upper("employee_id"))
    grouped = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("content").alias("contents"), listed("records", "record_id").alias("evidence")).filter("n > 1 and contents > 1")
    return drafts(grouped, [F.col("id")], message=F.format_string("%d rows, %d contents", "n", "contents"), key=F.col("id"), evidence=F.col("evidence"))


@check("HR-HIRE-DATE", "MEDIUM", "Hire date after the first activity or in the future")
def hire_date(v: Views, s: Settings) -> DataFrame:
    paid = v["pay_periods"].groupBy("person_id").agg(F.min("period_end").alias("first_paid"))
    worked = v["shifts"].groupBy("person_id").agg(F.min("work_date").alias("first_worked"))
    rows = v["persons"].filter("hire_date is not null").join(paid, "person_id", "left").join(worked, "person_id", "left").withColumn("first", F.least("first_paid", "first_worked"))
    late = rows.filter((F.col("hire_date") > F.lit(s.as_of)) | (F.col("hire_date") > F.col("first")))
    return drafts(late, [F.col("person_id")], start=F.col("hire_date"), end=F.col("hire_date"), message=F.concat(F.lit("Hired "), F.col("hire_date").cast("string"), F.lit(", first activity "), F.coalesce(F.col("first").cast("string"), F.lit("none"))))


@check("HRS-DAILY-EXCESS", "HIGH", "More hours in a day than the limit")
def daily_excess(v: Views, s: Settings) -> DataFrame:
    grouped = v["shifts"].groupBy("person_id", "work_date").agg(F.sum("hours").alias("total"), _one("facility_id").alias("facility"), listed("shifts", "shift_id").alias("evidence")).filter(F.col("total") > s.daily_limit)
    return drafts(grouped, [F.col("person_id")], facility=F.col("facility"), start=F.col("work_date"), end=F.col("work_date"), message=F.concat(F.round("total", 2).cast("string"), F.lit(" hours")), evidence=F.col("evidence"))


def scheduled_hours(v: Views) -> DataFrame:
    """Pay periods with the hours scheduled within them at the same facility (null matches null)."""
    p, sh = v["pay_periods"].alias("p"), v["shifts"].alias("s")
    on = (F.col("p.person_id") == F.col("s.person_id")) & F.col("p.facility_id").eqNullSafe(F.col("s.facility_id")) & F.col("s.work_date").between(F.col("p.period_start"), F.col("p.period_end"))
    columns = ["pay_id", "person_id", "facility_id", "period_start", "period_end", "hours_paid"]
    return p.join(sh, on, "left").groupBy(*[F.col(f"p.{c}").alias(c) for c in columns]).agg(F.coalesce(F.sum("s.hours"), F.lit(0.0)).alias("scheduled"), F.count("s.hours").alias("n_shifts"), F.array_sort(F.collect_list(F.concat(F.lit("shifts:"), F.col("s.shift_id")))).alias("evidence"))


@check("HRS-PAID-VS-SCHED", "HIGH", "Hours paid differ from hours scheduled")
def paid_vs_scheduled(v: Views, s: Settings) -> DataFrame:
    """Beyond the greater of the absolute and the relative tolerance; unknown paid hours never fire."""
    off = scheduled_hours(v).filter(F.abs(F.col("hours_paid") - F.col("scheduled")) > F.greatest(F.lit(s.hours_tol_abs), F.col("hours_paid") * s.hours_tol_rel))
    return drafts(off, [F.col("person_id")], facility=F.col("facility_id"), start=F.col("period_start"), end=F.col("period_end"), message=F.concat(F.lit("paid "), F.round("hours_paid", 2).cast("string"), F.lit(", scheduled "), F.round("scheduled", 2).cast("string")), key=F.col("pay_id"), evidence=F.concat(one_row("pay_periods", "pay_id"), F.col("evidence")))


@check("ID-DUP-LICENSE", "CRITICAL", "One licence number held by several persons")
def duplicate_license(v: Views, s: Settings) -> DataFrame:
    grouped = v["credentials"].filter("number is not null and holder_id is not null").groupBy("number").agg(F.array_sort(F.collect_set("holder_id")).alias("holders"), listed("credentials", "credential_id").alias("evidence")).filter(F.size("holders") > 1)
    return drafts(grouped, F.col("holders"), message=F.concat(F.lit("Held by "), F.array_join("holders", ", ")), key=F.col("number"), evidence=F.col("evidence"))


def _latest_shift(v: Views) -> DataFrame:
    return v["shifts"].groupBy(F.col("person_id").alias("holder_id")).agg(F.max("work_date").alias("last_shift"))


@check("LIC-EXPIRED-NOT-WORKING", "MEDIUM", "Expired licence, no shift since")
def expired_not_working(v: Views, s: Settings) -> DataFrame:
    expired = v["credentials"].filter(F.col("expires_on") < F.lit(s.as_of)).join(_latest_shift(v), "holder_id", "left").filter("last_shift is null or last_shift <= expires_on")
    return drafts(expired, [F.col("credential_id"), F.coalesce("holder_id", F.lit(""))], start=F.col("expires_on"), end=F.col("expires_on"), evidence=one_row("credentials", "credential_id"))


@check("LIC-EXPIRING", "MEDIUM", "Licence about to expire")
def expiring(v: Views, s: Settings) -> DataFrame:
    left = F.datediff("expires_on", F.lit(s.as_of))
    rows = v["credentials"].withColumn("left", left).filter(F.col("left").between(0, s.expiry_medium_days))
    severity = F.when(F.col("left") <= s.expiry_high_days, "HIGH").otherwise("MEDIUM")
    return drafts(rows, [F.col("credential_id")], start=F.col("expires_on"), end=F.col("expires_on"), message=F.format_string("%d days left", "left"), severity=severity, evidence=one_row("credentials", "credential_id"))


@check("LIC-EXPIRY-MISSING", "HIGH", "Licence without an expiry date")
def expiry_missing(v: Views, s: Settings) -> DataFrame:
    return drafts(v["credentials"].filter("expires_on is null and holder_kind = 'person'"), [F.col("credential_id")], evidence=one_row("credentials", "credential_id"))


@check("LIC-NONE-FOR-ROLE", "CRITICAL", "Licensed role without any licence")
def none_for_role(v: Views, s: Settings) -> DataFrame:
    rows = v["shifts"].filter(F.col("role").isin(*s.licensed_roles)).join(v["credentials"].select(F.col("holder_id").alias("person_id")), "person_id", "left_anti")
    grouped = rows.groupBy("person_id", "role").agg(F.min("work_date").alias("first"), F.max("work_date").alias("last"), F.count("*").alias("n"), listed("shifts", "shift_id", "work_date").alias("evidence"))
    return drafts(grouped, [F.col("person_id")], message=F.format_string("%d shifts as %s", "n", "role"), key=F.col("role"), evidence=F.col("evidence"))


@check("LIC-SCOPE", "CRITICAL", "No licence in scope of the role worked")
def out_of_scope(v: Views, s: Settings) -> DataFrame:
    held = v["credentials"].select(F.col("holder_id").alias("person_id"), F.col("type").alias("license_type")).distinct()
    in_scope = held.join(v["role_scope"], "license_type").select("person_id", "role").distinct()
    rows = v["shifts"].join(v["role_scope"].select("role").distinct(), "role", "left_semi").join(held.select("person_id").distinct(), "person_id", "left_semi").join(in_scope, ["person_id", "role"], "left_anti")
    grouped = rows.groupBy("person_id", "role").agg(F.count("*").alias("n"), _one("facility_id").alias("facility"), listed("shifts", "shift_id", "work_date").alias("evidence"))
    return drafts(grouped, [F.col("person_id")], facility=F.col("facility"), message=F.format_string("%d shifts as %s", "n", "role"), key=F.col("role"), evidence=F.col("evidence"))


@check("LIC-TYPE-MISMATCH", "MEDIUM", "Licence number of another type")
def type_mismatch(v: Views, s: Settings) -> DataFrame:
    prefix = F.regexp_extract("number", r"^([A-Z]+)-?[0-9]", 1)
    rows = v["credentials"].withColumn("prefix", prefix).join(v["role_scope"].select(F.col("license_type").alias("prefix")).distinct(), "prefix", "left_semi").filter("prefix <> type")
    return drafts(rows, [F.col("credential_id")], message=F.concat(F.col("prefix"), F.lit(" is not "), F.col("type")), key=F.col("number"), evidence=one_row("credentials", "credential_id"))


@check("LIC-WORKED-EXPIRED", "CRITICAL", "Shifts worked after the licence expired")
def worked_expired(v: Views, s: Settings) -> DataFrame:
    """In scope of the role, and no other licence in scope valid that day. A licence last verified before it expired may have been renewed."""
    c = v["credentials"].filter("holder_id is not null").select("credential_id", F.col("holder_id").alias("person_id"), F.col("type").alias("license_type"), "expires_on", "last_verified")
    shifts = v["shifts"].select("shift_id", "person_id", "role", "work_date").join(v["role_scope"], "role")
    scoped = shifts.join(c, ["person_id", "license_type"])
    day = ["person_id", "role", "work_date"]
    valid = scoped.filter("expires_on >= work_date").select(*day).distinct()
    late = scoped.filter("work_date > expires_on").join(valid, day, "left_anti")
    days = F.array_join(F.transform(F.array_sort(F.collect_set("work_date")), lambda d: F.date_format(d, "yyyy-MM-dd")), ",")
    grouped = late.groupBy("person_id", "credential_id", "expires_on", "last_verified").agg(days.alias("days"), F.min("work_date").alias("first"), F.max("work_date").alias("last"), listed("shifts", "shift_id", "work_date").alias("evidence"))
    note = F.when(F.col("last_verified") < F.col("expires_on"), ". Last verified before the expiry date: a renewal may exist").otherwise("")
    return drafts(grouped, [F.col("credential_id"), F.col("person_id")], start=F.col("first"), end=F.col("last"), message=F.concat(F.lit("Worked "), F.col("days"), note), key=F.col("expires_on").cast("string"), evidence=F.concat(one_row("credentials", "credential_id"), F.col("evidence")))


@check("PAY-DUPLICATE", "HIGH", "One pay period with several ids or hours")
def duplicate_pay(v: Views, s: Settings) -> DataFrame:
    """Of a person, facility and period; rows alike in both are a harmless copy, a missing id is an id of its own."""
    rows = v["records"].filter("template = 'payroll' and period_start is not null and period_end is not null").join(v["persons"].select("person_id"), "person_id", "left_semi")
    ids, amounts = F.count_distinct(F.coalesce("pay_id", F.lit(""))), F.count_distinct("hours_paid")
    grouped = rows.groupBy("person_id", "facility_id", "period_start", "period_end").agg(ids.alias("ids"), amounts.alias("amounts"), listed("records", "record_id").alias("evidence")).filter("ids > 1 or amounts > 1")
    key = F.concat(F.date_format("period_start", "yyyy-MM-dd"), F.coalesce("facility_id", F.lit("")))
    return drafts(grouped, [F.col("person_id")], facility=F.col("facility_id"), start=F.col("period_start"), end=F.col("period_end"), message=F.format_string("%d ids, %d amounts", "ids", "amounts"), key=key, evidence=F.col("evidence"))


@check("PAY-HOURS-INVALID", "HIGH", "Paid hours missing or impossible")
def hours_invalid(v: Views, s: Settings) -> DataFrame:
    days = F.datediff("period_end", "period_start") + 1
    most = 100 * F.greatest(F.lit(1), F.ceil(days / 7))
    bad = v["pay_periods"].filter(F.col("hours_paid").isNull() | (F.col("hours_paid") < 0) | (F.col("hours_paid") > F.coalesce(most, F.lit(100))))
    return drafts(bad, [F.col("person_id")], facility=F.col("facility_id"), start=F.col("period_start"), end=F.col("period_end"), message=F.coalesce(F.round("hours_paid", 2).cast("string"), F.lit("missing")), key=F.col("pay_id"), evidence=one_row("pay_periods", "pay_id"))


@check("PAY-NO-HR", "HIGH", "Paid, but not on the roster")
def paid_unknown(v: Views, s: Settings) -> DataFrame:
    rows = v["pay_periods"].join(v["persons"].filter("not has_hr").select("person_id"), "person_id")
    grouped = rows.groupBy("person_id").agg(F.count("*").alias("n"), F.min("period_start").alias("first"), F.max("period_end").alias("last"), listed("pay_periods", "pay_id", "period_start").alias("evidence"))
    return drafts(grouped, [F.col("person_id")], message=F.format_string("%d pay periods", "n"), evidence=F.col("evidence"))


@check("PAY-PERIOD-INVALID", "MEDIUM", "Pay period backwards or over two weeks")
def period_invalid(v: Views, s: Settings) -> DataFrame:
    days = F.datediff("period_end", "period_start") + 1
    return drafts(v["pay_periods"].withColumn("n", days).filter("n < 1 or n > 14"), [F.col("person_id")], facility=F.col("facility_id"), start=F.col("period_start"), end=F.col("period_end"), message=F.format_string("%d days", "n"), key=F.col("pay_id"), evidence=one_row("pay_periods", "pay_id"))


@check("PAY-PERIOD-OVERLAP", "HIGH", "Pay periods of one person overlap")
def period_overlap(v: Views, s: Settings) -> DataFrame:
    valid = v["pay_periods"].filter("period_start <= period_end")
    pairs = overlapping_pairs(valid, ["person_id", "facility_id"], "pay_id", "period_start", "period_end", closed=True, bucket_seconds=28 * 86_400)
    return drafts(pairs, [F.col("person_id")], facility=F.col("facility_id"), start=F.greatest("a_period_start", "b_period_start"), end=F.least("a_period_end", "b_period_end"), key=F.concat_ws("|", "a_pay_id", "b_pay_id"), evidence=one_row("pay_periods", "a_pay_id", "b_pay_id"))


@check("ROLE-MISMATCH", "MEDIUM", "Role differs from the roster's")
def role_mismatch(v: Views, s: Settings) -> DataFrame:
    paid = v["records"].filter("template = 'payroll' and role is not null").select("person_id", "role", F.lit("payroll").alias("source"))
    worked = v["shifts"].filter("role is not null").select("person_id", "role", F.lit("schedule").alias("source"))
    rows = paid.unionByName(worked).join(v["persons"].filter("has_hr").select("person_id", F.col("role").alias("hr_role")), "person_id").filter("role <> hr_role")
    grouped = rows.groupBy("person_id", "role", "hr_role").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    return drafts(grouped, [F.col("person_id")], message=F.concat(F.col("role"), F.lit(" in "), F.col("sources"), F.lit(", "), F.col("hr_role"), F.lit(" on the roster")), key=F.col("role"))


@check("SCHED-NO-HR", "MEDIUM", "Scheduled, but not on the roster")
def scheduled_unknown(v: Views, s: Settings) -> DataFrame:
    rows = v["shifts"].join(v["persons"].filter("not has_hr").select("person_id"), "person_id")
    grouped = rows.groupBy("person_id").agg(F.count("*").alias("n"), _one("facility_id").alias("facility"), listed("shifts", "shift_id", "work_date").alias("evidence"))
    return drafts(grouped, [F.col("person_id")], facility=F.col("facility"), message=F.format_string("%d shifts", "n"), evidence=F.col("evidence"))


@check("SHIFT-OVERLAP", "HIGH", "Shifts of one person overlap")
def shift_overlap(v: Views, s: Settings) -> DataFrame:
    pairs = overlapping_pairs(v["shifts"].filter("start_ts < end_ts"), ["person_id"], "shift_id", "start_ts", "end_ts", bucket_seconds=86_400, keep=["facility_id"])
    facility = F.when(F.col("a_facility_id") == F.col("b_facility_id"), F.col("a_facility_id"))
    return drafts(pairs, [F.col("person_id")], facility=facility, start=F.to_date("a_start_ts"), end=F.to_date("b_start_ts"), key=F.concat_ws("|", "a_shift_id", "b_shift_id"), evidence=one_row("shifts", "a_shift_id", "b_shift_id"))


#: What a parse issue of a record becomes; other kinds are PARSE-<KIND>, LOW.
PARSE_CHECKS = {"row_incomplete": ("ROW-INCOMPLETE", "MEDIUM"), "date": ("PARSE-DATE", "MEDIUM"), "ambiguous_date": ("PARSE-DATE-AMBIGUOUS", "MEDIUM"), "shift": ("PARSE-SHIFT", "MEDIUM"), "number": ("PARSE-NUMBER", "MEDIUM"), "fuzzy_vocab": ("PARSE-FUZZY-VOCAB", "LOW")}


def parse_issue_drafts(records: DataFrame) -> DataFrame:
    """Drafts out of records(record_id, parse_issues): check_id and severity by the kind before ':'; an unreadable expiry is HIGH."""
    rows = records.select("record_id", F.explode("parse_issues").alias("issue")).withColumn("kind", F.split_part("issue", F.lit(":"), F.lit(1))).withColumn("detail", F.expr("substring(issue, length(kind) + 2)"))
    table = F.create_map(*[F.lit(x) for kind, (c, s) in PARSE_CHECKS.items() for x in (kind, f"{c}|{s}")])
    named = F.coalesce(table[F.col("kind")], F.concat(F.lit("PARSE-"), F.upper(F.replace("kind", F.lit("_"), F.lit("-"))), F.lit("|LOW")))
    severity = F.when((F.col("kind") == "date") & F.col("detail").contains("expires_on"), "HIGH").otherwise(F.split_part(named, F.lit("|"), F.lit(2)))
    return rows.select(F.split_part(named, F.lit("|"), F.lit(1)).alias("check_id"), severity.alias("severity"), F.array("record_id").alias("entity_ids"), F.col("detail").alias("message"), F.col("issue").alias("key"))


def run_checks(views: Views, settings: Settings, only: list[str] | None = None, more: dict | None = None, apart: bool = True) -> DataFrame:
    """Drafts of all checks with check_id, severity, title and fingerprint. ``more`` adds checks of a pack by name.

    A check's drafts may name another check_id, as those of files and records do. Each check is computed and kept on its own (``apart``), so that one that fails at work, inside an executor too, is one CHECK-ERROR
    draft and stops nothing else. Without ``apart`` the result is one lazy plan, in which only a plan that can't be made is caught."""
    spark = next(iter(views.values())).sparkSession
    out = None
    for check_id, (severity, title, fn) in sorted({**CHECKS, **(more or {})}.items()):
        if only and check_id not in only:
            continue
        try:
            found = fn(views, settings)
            found = found if "evidence" in found.columns else found.withColumn("evidence", F.array().cast("array<string>"))
            for column in ("facility_id", "period_start", "period_end"):
                if column not in found.columns:
                    found = found.withColumn(column, F.lit(None).cast("string" if column == "facility_id" else "date"))
            found = settled(found) if apart else found
        except Exception as e:
            found = drafts(spark.range(1), [F.lit(check_id)], message=F.lit(f"{type(e).__name__}: {e}"[:500]), severity=F.lit("HIGH"))
            check_id, title = "CHECK-ERROR", "A check failed"
        found = (found if "check_id" in found.columns else found.withColumn("check_id", F.lit(check_id))).withColumn("title", F.lit(title))
        found = found.withColumn("severity", F.coalesce("severity", F.lit(severity))).withColumn("message", F.coalesce("message", "title"))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("fingerprint", fingerprint(F.col("check_id"), F.col("entity_ids"), F.col("period_start"), F.col("period_end"), F.col("key")))
