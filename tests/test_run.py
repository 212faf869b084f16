"""A folder of four files to findings, twice; schedules, contracts and SQL checks on small data."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import checks, sql_checks
from tallyforge.operators.ranking import unique_ids
from tallyforge.plans import contracts, run, schedules, serving
from tallyforge.plans.pack import STAFFING

AS_OF = checks.Settings(as_of=date(2026, 9, 21))
FILES = {
    "staff.csv": "employee_id,first_name,last_name,job_title,facility,license_number,license_expiration,hire_date\nE31,Nora,Quinn,RN,Bayside,RN-400100,2027-05-31,2020-02-03\nE32,Omar,Vance,CNA,Riverdale,CNA-400200,2027-02-28,2021-06-14\n",
    "pay.csv": 'payroll_id,employee_name,job_code,facility_code,period_start,period_end,hours_paid\nP1,"QUINN, NORA",RN,BAY,2026-09-14,2026-09-20,16\nP1,"VANCE, OMAR",CNA,RVD,2026-09-14,2026-09-20,24\n',
    "plan bayside.csv": "Staff,Role,Mon 09/14,Tue 09/15,Wed 09/16,Thu 09/18\nNora Quinn,RN,7a-3p,OFF,7a-3p,what\n",
    "plan riverdale.csv": "Staff,Role,Mon 09/14,Tue 09/15,Wed 09/16\nOmar Vance,CNA,D,D,3p-11p\n",
    "vendors.csv": "organization_name,document_type,expiration_date,last_verified\nAcme Linen,insurance,2026-09-30,2026-01-05\nBay Oxygen,contract,2027-12-31,2026-01-05\n",
    "licences.csv": "license_number,name_on_license,license_type,expiration_date,last_verified\nRN-400100,Nora Quinn,RN,2027-05-31,2026-09-01\nCNA-400200,Omar Strand,CNA,2027-02-28,2026-09-01\n",
    "odd.bin": "\0\1\2",
}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    for name, body in FILES.items():
        (folder / name).write_text(body)
    check = sql_checks.sql_check("-- id: SQL-LONG\n-- severity: LOW\n-- title: Long shift\nSELECT array(person_id) AS entity_ids, facility_id, work_date AS period_start, work_date AS period_end, CAST(NULL AS STRING) AS message, shift_id AS key FROM {shifts} WHERE hours >= 8 AND work_date <= :as_of")
    out = run.run(spark, f"file://{folder}", STAFFING, AS_OF, "r1", more=dict([check]))
    path = f"file://{tmp_path_factory.mktemp('out')}"
    out.write(path)
    return out, path, folder


def test_run_reads_every_file(done, spark):
    out, path, _ = done
    assert {r["file_name"]: r["status"] for r in out.tables["files"].collect()}["odd.bin"] == "quarantined"
    assert {r["template"] for r in out.tables["tables"].collect()} == {"hr_roster", "payroll", "license", "organisation"}
    assert spark.read.parquet(f"{path}/gold_persons").count() == 2
    held = {r["credential_id"]: (r["holder_kind"], r["holder_id"]) for r in out.tables["gold_credentials"].collect()}
    assert held == {"RN-400100": ("person", "P-E31"), "CNA-400200": ("person", "P-E32"), "ORG:acme-linen:insurance": ("organisation",) + ("ORG:acme-linen:insurance",), "ORG:bay-oxygen:contract": ("organisation",) + ("ORG:bay-oxygen:contract",)}


def test_run_schedules(done):
    out, _, _ = done
    shifts = {(r["person_id"], str(r["work_date"])): (r["facility_id"], r["hours"]) for r in out.tables["gold_shifts"].collect()}
    assert shifts == {("P-E31", "2026-09-14"): ("FAC-BAY", 8.0), ("P-E31", "2026-09-16"): ("FAC-BAY", 8.0), ("P-E32", "2026-09-16"): ("FAC-RVD", 8.0)}
    found = {(r["check_id"], r["key"]) for r in out.tables["drafts"].collect()}
    assert ("PARSE-DAY-MISMATCH", "day_mismatch:Thu 09/18") in found and ("PARSE-SHIFT", "shift:what") in found
    assert ("FILE-QUARANTINED", "FILE-QUARANTINED") in found and sum(c == "SQL-LONG" for c, _ in found) == 3
    assert [r["entity_ids"] for r in out.tables["drafts"].filter("check_id = 'ID-NAME-DIFFERS-ON-LICENSE'").collect()] == [["CNA-400200", "P-E32"]]
    assert not any(c == "CHECK-ERROR" for c, _ in found)


def test_pay_ids_are_unique(done, spark):
    ids = [r["pay_id"] for r in done[0].tables["gold_pay_periods"].collect()]
    assert len(set(ids)) == 2 and "P1" in ids
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", None, 1), ("d", "", 1)], "r string, w string, t int")
    assert {r["r"]: r["id"] for r in unique_ids(rows, "w", "r", "t", "id").collect()} == {"a": "a", "b": "x", "c": "c", "d": "d"}


def test_second_run_keeps_what_people_set(done, spark):
    out, _, folder = done
    known = out.tables["issues"].withColumns({"status": F.lit("accepted"), "owner": F.lit("ann")})
    again = run.run(spark, f"file://{folder}", STAFFING, AS_OF, "r2", known=known, contracts=out.contracts)
    rows = again.tables["issues"].collect()
    gone = {r["check_id"] for r in rows if not r["active"]}
    assert gone == {"SQL-LONG"} and all(r["status"] == "accepted" and r["owner"] == "ann" and r["first_seen_run"] == "r1" for r in rows)
    assert {r["status"] for r in again.tables["tables"].collect()} == {"contract"}


def test_schedule_days(spark):
    rows = [("Mon 09/14", "2026-09-14", None), ("09/14", "2026-09-14", None), ("2026-09-16", "2026-09-16", None), ("Friday 18 Sep", "2026-09-18", None), ("Sep 18", "2026-09-18", None),
            ("Thu 01/01", "2027-01-01", "day_mismatch:Thu 01/01"), ("Mon 09/15", "2026-09-15", "day_mismatch:Mon 09/15"), ("02/30", None, "schedule_dates:02/30"), ("Notes", None, "schedule_dates:Notes"), ("", None, "schedule_dates:")]
    known = F.array(F.lit(date(2026, 9, 14)), F.lit(date(2026, 9, 20)))
    df = spark.createDataFrame(rows, "h string, day string, issue string")
    for r in df.withColumn("d", dates.schedule_day(F.col("h"), known)).withColumn("is", dates.names_day(F.col("h"))).collect():
        assert (str(r["d"]["day"]) if r["d"]["day"] else None, r["d"]["issue"]) == (r["day"], r["issue"]), r["h"]
        assert r["is"] == (r["h"] not in ("Notes", "")), r["h"]
    none = spark.createDataFrame([("Mon 09/14",)], "h string").select(dates.schedule_day(F.col("h"), F.array().cast("array<date>")).alias("d")).first()["d"]
    assert none["day"] is None and none["issue"] == "schedule_dates:Mon 09/14"


def test_legends_and_codes(spark):
    notes = spark.createDataFrame([("t", "7a-3p, 3p-11p are 8 hours. 7a-7p is 11.5 hrs; D = 7a-3p, Night (N) 11p-7a"), ("u", None)], "table_id string, note string")
    assert {(r["start_min"], r["end_min"]): r["hours"] for r in schedules.legends(notes).collect()} == {(420, 900): 8.0, (900, 1380): 8.0, (420, 1140): 11.5}
    assert {r["code"]: r["token"] for r in schedules.letter_codes(notes).collect()} == {"D": "7a-3p", "N": "11p-7a"}
    cells = spark.createDataFrame([("f", "x.csv", "t", None, 1, i, c, v) for i, (c, v) in enumerate([("Staff", "Ann Lee"), ("Mon 09/14", "D"), ("Tue 09/15", "7a-7p"), ("Wed 09/16", "off")])], "file_id string, file_name string, table_id string, sheet string, src_row long, col_idx int, col_name string, value string")
    found = schedules.find_schedules(cells, STAFFING)
    assert found == [("t", {"person.full_name": "Staff"}, ["Mon 09/14", "Tue 09/15", "Wed 09/16"])]
    rows, issues = schedules.schedule_tables(cells, found, [date(2026, 9, 14)], STAFFING, notes)
    assert {(str(r["work_date"]), r["hours"], r["hours_source"]) for r in rows.collect()} == {("2026-09-14", 8.0, "both"), ("2026-09-15", 12.0, "computed")}
    assert issues.isEmpty() and {r["token"]: r["legend_hours"] for r in rows.collect()} == {"D": 8.0, "7a-7p": 11.5}


def test_contracts(spark):
    old = spark.createDataFrame([("payroll", 2, ["id", "week 37", "hours"])], "template string, version int, columns array<string>")
    new = spark.createDataFrame([("a", "payroll", ["ID", "Week 38", "Hours"]), ("b", "payroll", ["id", "week 1", "hours", "site"]), ("c", "roster", ["x"])], "table_id string, template string, columns array<string>")
    got = {r["table_id"]: r for r in contracts.new_versions(old, new).collect()}
    assert {k: r["version"] for k, r in got.items()} == {"a": 3, "b": 4, "c": 1} and got["c"]["contract_id"].startswith("roster:v1:")
    assert {r["table_id"]: r["drift"] for r in contracts.drifted(new, old).collect()} == {"a": False, "b": True, "c": False}
    made = contracts.new_versions(old, new)
    assert [r["table_id"] for r in contracts.approve(made, [got["a"]["contract_id"]]).filter("approved").collect()] == ["a"]
    waiting = spark.createDataFrame([("a", "review", 0.6), ("b", "unknown", 0.1), ("c", "mapped", 0.9)], "table_id string, status string, confidence double")
    assert [(r["table_id"], r["task"]) for r in contracts.review_queue(waiting).collect()] == [("a", "schema_mapper"), ("b", "new_source_modeler")]


def test_sql_check_reports_rows_that_cannot_be_findings(spark):
    view = {"shifts": spark.createDataFrame([("a", "HIGH"), ("b", "BAD"), (None, None)], "person_id string, sev string")}
    name, check = sql_checks.sql_check("-- id: X\n-- severity: LOW\n-- title: T\nSELECT array(person_id) AS entity_ids, NULL AS facility_id, NULL AS period_start, NULL AS period_end, NULL AS message, sev AS severity FROM {shifts}")
    rows = checks.run_checks(view, AS_OF, only=["X"], more={name: check}).collect()
    assert sorted((r["check_id"], r["severity"], r["message"]) for r in rows) == [("CHECK-ERROR", "HIGH", "1 rows could not be reported, as of severity 'BAD'"), ("X", "HIGH", "T: a"), ("X", "LOW", "T: unknown entity")]


def test_person_detail(done):
    t = done[0].tables
    views = {k.removeprefix("gold_"): v for k, v in t.items() if k.startswith("gold_")}
    issues = t["drafts"].withColumns({"status": F.lit("open"), "active": F.lit(True)}).dropDuplicates(["fingerprint"])
    got = serving.person_detail("P-E31", views, issues, t["claims"], t["golden_values"], t["links"], t["person_records"], AS_OF.as_of)
    assert [r["days_left"] for r in got["credentials"].collect()] == [(date(2027, 5, 31) - AS_OF.as_of).days]
    assert got["person"].first()["open_issues"] == got["issues"].count() > 0
    assert {r["entity_id"] for r in got["golden"].collect()} == {"P-E31", "RN-400100"} and all(r["claims"] for r in got["golden"].collect())
    assert [str(r["work_date"]) for r in got["shifts"].collect()] == ["2026-09-14", "2026-09-16"] and got["links"].count() > 0
