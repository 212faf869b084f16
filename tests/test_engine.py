"""The worked example end to end: two people, four sources, six findings."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks
from tallyforge.operators.matching import map_tables
from tallyforge.plans import engine
from tallyforge.plans.pack import STAFFING, load_pack
from tallyforge.sources.landing import parse_files, read_files

HR = """employee_id,first_name,last_name,job_title,facility,phone,license_number,license_expiration,hire_date
E201,Sofia,Reyes,RN,Bayside,718-555-0201,RN-551203,2027-05-31,2020-02-03
E202,Marcus,Bell,CNA,Riverdale,718-555-0202,CNA-771045,2026-12-31,2021-06-14
"""
PAY = """payroll_id,employee_name,job_code,facility_code,period_start,period_end,hours_paid
P1,"REYES, SOFIA",RN,BAY,2026-09-14,2026-09-20,36
P2,"BELL, MARCUS",CNA,RVD,2026-09-14,2026-09-20,48
"""
LIC = """license_number,name_on_license,license_type,expiration_date,last_verified
RN-551203,Sofia Reyes,RN,2027-05-31,2026-09-01
CNA-771045,Marcus Bell,CNA,2026-09-15,2026-09-01
"""
DAYS = {f"d{k}": f"2026-09-{14 + k}" for k in range(7)}
GRID = [("Bayside", "Sofia Reyes", "RN", "7a-3p", "7a-3p", "OFF", "7a-7p", "OFF", "7a-3p", "OFF"), ("Riverdale", "Marc Bell", "CNA", "3p-11p", "OFF", "3p-11p", "3p-11p", "3p-11p", "3p-11p", "OFF")]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    for name, body in (("hr_roster.csv", HR), ("payroll.csv", PAY), ("licenses.csv", LIC)):
        (folder / name).write_text(body)
    (folder / "odd.bin").write_bytes(b"\0\1\2")
    cells = parse_files(read_files(spark, f"file://{folder}")).cache()
    maps = map_tables(cells, STAFFING)
    records = engine.silver(spark, cells, maps, STAFFING).cache()
    grid = spark.createDataFrame(GRID, ["title", "Staff", "Role", *DAYS])
    schedule = engine.schedule_rows(grid, DAYS, STAFFING)
    persons = engine.person_records(records, schedule, STAFFING)
    owners, links = engine.resolve(persons, STAFFING)
    owners = owners.cache()
    claims = engine.claims(records, owners)
    best = engine.golden(claims, STAFFING).cache()
    views = {k: v.cache() for k, v in engine.gold_views(spark, records, schedule, owners, persons, claims, best, STAFFING).items()}
    return {"cells": cells, "maps": maps, "records": records, "owners": owners, "links": links, "claims": claims, "best": best, "views": views, "persons": persons, "folder": folder}


def test_files_and_maps(world):
    status = {r["file_name"]: r["status"] for r in world["cells"].select("file_name", "status").distinct().collect()}
    assert status == {"hr_roster.csv": "parsed", "payroll.csv": "parsed", "licenses.csv": "parsed", "odd.bin": "quarantined"}
    assert sorted(m.template for _, _, m, s in world["maps"] if s == "mapped") == ["hr_roster", "license", "payroll"]
    known = {}
    map_tables(world["cells"], STAFFING, known)
    assert {s for *_, s in map_tables(world["cells"], STAFFING, known)} == {"contract"}


def test_two_persons_of_four_records(world):
    by = {}
    for r in world["owners"].collect():
        by.setdefault(r["person_id"], []).append(r["record_id"])
    assert {k: len(v) for k, v in by.items()} == {"P-E201": 4, "P-E202": 4}
    link = [r for r in world["links"].collect() if any("nickname" in x for x in r["reasons"])]
    assert link and all(r["prob"] >= 0.95 for r in link)


def test_golden_expiry_is_the_licence_service_s(world):
    row = world["best"].filter("entity_id = 'CNA-771045' and attribute = 'expires_on'").first()
    assert (row["golden"], row["golden_source"], row["has_conflict"]) == ("2026-09-15", "license", True)
    assert not world["best"].filter("entity_id = 'RN-551203' and attribute = 'expires_on'").first()["has_conflict"]


def test_findings(world):
    settings = checks.Settings(as_of=date(2026, 9, 21))
    more = {"SRC-CONFLICT": ("MEDIUM", "Sources disagree", lambda v, s: engine.conflict_drafts(world["best"], world["claims"])), "ID-FUZZY-LINK": ("INFO", "Linked by a similar name", lambda v, s: engine.fuzzy_link_drafts(world["links"], world["persons"]))}
    found = checks.run_checks(world["views"], settings, more=more).collect()
    got = sorted((r["check_id"], r["severity"]) for r in found)
    assert got == sorted([("LIC-WORKED-EXPIRED", "CRITICAL"), ("COV-RN-DAILY", "CRITICAL"), ("COV-RN-DAILY", "CRITICAL"), ("HRS-PAID-VS-SCHED", "HIGH"), ("SRC-CONFLICT", "MEDIUM"), ("ID-FUZZY-LINK", "INFO")])
    by = {r["check_id"]: r for r in found}
    assert by["HRS-PAID-VS-SCHED"]["message"] == "paid 48.0, scheduled 40.0" and by["HRS-PAID-VS-SCHED"]["entity_ids"] == ["P-E202"]
    assert by["LIC-WORKED-EXPIRED"]["message"] == "Worked 2026-09-16,2026-09-17,2026-09-18,2026-09-19. Last verified before the expiry date: a renewal may exist"
    assert [e.split(":")[0] for e in by["LIC-WORKED-EXPIRED"]["evidence"]] == ["credentials", *["shifts"] * 4]
    again = checks.run_checks(world["views"], settings, more=more).collect()
    assert {r["fingerprint"] for r in again} == {r["fingerprint"] for r in found}


def test_export(world):
    rows = engine.pbj(world["views"], STAFFING, checks.Settings(as_of=date(2026, 9, 21))).collect()
    got = {(r["employee_id"], r["work_date"].day): (r["hours"], r["job_code"], r["status"], r["note"]) for r in rows}
    ready, late = (7, "ready", None), (10, "needs_signoff", "paid 48, scheduled 40")
    assert got == {("E201", 14): (8, *ready), ("E201", 15): (8, *ready), ("E201", 17): (12, *ready), ("E201", 19): (8, *ready), **{("E202", d): (8, *late) for d in (14, 16, 17, 18, 19)}}


def test_known_content_is_skipped(world, spark):
    known = world["cells"].select("file_id", "status").distinct()
    left = read_files(spark, f"file://{world['folder']}", known).select("file_name").collect()
    assert [r["file_name"] for r in left] == ["odd.bin"]  # quarantined files are tried again


def test_failing_check_stops_nothing(world):
    def broken(v, s):
        raise ValueError("no such view")

    out = checks.run_checks(world["views"], checks.Settings(as_of=date(2026, 9, 21)), only=["BROKEN", "LIC-EXPIRY-MISSING"], more={"BROKEN": ("LOW", "x", broken)}).collect()
    assert [(r["check_id"], r["severity"]) for r in out] == [("CHECK-ERROR", "HIGH")]


def test_check_that_fails_in_an_executor(world):
    def broken(v, s):
        return checks.drafts(v["persons"], [F.col("person_id")], message=F.raise_error(F.concat(F.lit("bad row "), F.col("person_id"))))

    out = checks.run_checks(world["views"], checks.Settings(as_of=date(2026, 9, 21)), only=["BROKEN", "HRS-PAID-VS-SCHED"], more={"BROKEN": ("LOW", "x", broken)}).collect()
    assert sorted(r["check_id"] for r in out) == ["CHECK-ERROR", "HRS-PAID-VS-SCHED"]


def test_pack_from_folder(tmp_path):
    (tmp_path / "pack.json").write_text(json.dumps({"fields": {"a.b": {"kind": "date", "synonyms": ["b"]}}, "templates": {"t": {"required": ["a.b"], "one_of": [["a.b"]]}}, "vocab": {"v": {"X": ["x."]}}}))
    pack = load_pack(tmp_path)
    assert pack.fields["a.b"].kind == "date" and pack.templates[0].fields == ("a.b",) and pack.aliases("v") == [("X", "X"), ("x.", "X")]
