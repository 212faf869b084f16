"""Workloads of the sizes that the baseline's figures are given for, made of the driver's tables: 5,000 records of 1,000 people to
resolve, a CSV file of 200,000 rows to read, and three files of 1,000 employees from landing to findings."""

from __future__ import annotations

import csv
import io
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import checks
from tallyforge.operators.matching import map_tables
from tallyforge.sources.landing import parse_files, read_files
from tallyforge.sources.parsing import extract_csv

from . import engine
from .check_queries import SETTINGS
from .pack import STAFFING

_SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se".split()


def _word(k: int) -> str:
    return "".join(_SYLLABLES[k // 30**j % 30] for j in range(4))


def _people(spark: SparkSession, sf_dir: str, n: int) -> list[tuple[int, str, str, str, str]]:
    """(key, given, family, role, facility) of ``n`` people, a name each."""
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").orderBy("o_orderkey").limit(n).collect()]
    return [(k, _word(k * 7919 + 11).title(), _word(k * 104729 + 5).title(), ("RN", "LPN", "CNA")[k % 3], f"F{k % 5}") for k in keys]


def resolve_records(spark: SparkSession, sf_dir: str, n: int = 1000) -> DataFrame:
    """record_id and person_id of five records a person: one of the roster, four of other tables."""
    rows = []
    for k, given, family, role, facility in _people(spark, sf_dir, n):
        rows.append((f"h{k}", "hr", "hr_roster", True, f"{given} {family}", f"E{k}", None, None, role, facility))
        rows += [(f"{t}{k}", t, "payroll", False, form, None, None, None, role, facility) for t, form in (("p", f"{family.upper()}, {given.upper()}"), ("q", f"{given} {family}"), ("l", f"{family}, {given}"), ("s", f"{given} {family} {role}"))]
    schema = "record_id string, table_id string, template string, is_hr boolean, name string, employee_id string, credential_number string, credential_type string, role string, facility string"
    return engine.resolve(spark.createDataFrame(rows, schema), STAFFING)[0]


def csv_text(n: int = 200_000) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(["payroll_id", "employee_name", "job_code", "hours_paid", "period_start"])
    writer.writerows((i, f"{_word(i)}, {_word(i * 31)}", ("RN", "LPN", "CNA")[i % 3], i % 80, "2026-09-14") for i in range(n))
    return out.getvalue().encode()


def extract_rows(data: bytes) -> int:
    """Rows of the one table in a CSV file; header found and table built."""
    return len(extract_csv(data)[0].rows)


def employee_pipeline(spark: SparkSession, sf_dir: str, n: int = 1000) -> DataFrame:
    """Roster, payroll and licences of ``n`` employees from files to findings."""
    people = _people(spark, sf_dir, n)
    files = {
        "hr_roster.csv": (["employee_id", "first_name", "last_name", "job_title", "license_number", "license_expiration", "hire_date"], [(f"E{k}", g, f, r, f"{r}-{500000 + k}", "2027-05-31", "2020-02-03") for k, g, f, r, _ in people]),
        "payroll.csv": (["payroll_id", "employee_name", "job_code", "period_start", "period_end", "hours_paid"], [(f"P{k}", f"{f.upper()}, {g.upper()}", r, "2026-09-14", "2026-09-20", 36 + k % 9) for k, g, f, r, _ in people]),
        "licenses.csv": (["license_number", "name_on_license", "license_type", "expiration_date", "last_verified"], [(f"{r}-{500000 + k}", f"{g} {f}", r, "2027-05-31" if k % 9 else "2026-09-15", "2026-09-01") for k, g, f, r, _ in people]),
    }
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tallyforge-files-')}"
    path = folder.removeprefix("file://")
    for name, (head, rows) in files.items():
        os.makedirs(f"{path}/in", exist_ok=True)
        with open(f"{path}/in/{name}", "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(head)
            writer.writerows(rows)
    cells = engine.settled(parse_files(read_files(spark, f"{folder}/in")))
    records = engine.settled(engine.silver(spark, cells, map_tables(cells, STAFFING), STAFFING))
    persons = engine.person_records(records, None, STAFFING)
    owners = engine.settled(engine.resolve(persons, STAFFING)[0])
    claims = engine.claims(records, owners)
    best = engine.settled(engine.golden(claims, STAFFING))
    views = engine.gold_views(spark, records, None, owners, persons, claims, best, STAFFING)
    return checks.run_checks({k: engine.settled(v) for k, v in views.items()}, SETTINGS, apart=False)
