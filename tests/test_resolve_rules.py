"""What must not be linked: suffixes, licence numbers of one type, records with initials only; and links by people."""

import pytest

from tallyforge.plans import engine
from tallyforge.plans.pack import STAFFING

# record_id, table_id, template, name, employee_id, credential_number, credential_type, facility
ROWS = [
    ("a1", "t1", "payroll", "Cole Hart Jr.", None, None, None, "F1"), ("a2", "t2", "schedule", "Cole Hart Sr.", None, None, None, "F1"),
    ("b1", "t1", "hr_roster", "Ana Ruiz", "E1", "RN-1", "RN", "F2"), ("b2", "t2", "license", "Ana Ruiz", None, "RN-2", "RN", "F2"), ("b3", "t3", "license", "Ana Ruiz", None, "LPN-3", "LPN", "F2"),
    ("c1", "t1", "payroll", "M. Bell", None, None, None, "F3"), ("c2", "t2", "schedule", "M. Bell", None, None, None, "F3"),
    ("d1", "t1", "payroll", "Nora Oak", None, None, None, "F4"), ("d2", "t2", "payroll", "Nils Oak", None, None, None, "F4"), ("d3", "t3", "schedule", "N. Oak", None, None, None, "F4"),
    ("e1", "t1", "payroll", "Lea Voss", None, None, None, "F5"), ("e2", "t3", "schedule", "L. Voss", None, None, None, "F5"),
    ("f1", "t1", "payroll", "Ida Kern", None, None, None, "F6"), ("f2", "t2", "payroll", "Ulf Zorn", None, None, None, "F7"),
]


@pytest.fixture(scope="module")
def person(spark):
    rows = [(r[0], r[1], r[2], r[2] == "hr_roster", *r[3:7], "RN", r[7]) for r in ROWS]
    persons = spark.createDataFrame(rows, "record_id string, table_id string, template string, is_hr boolean, name string, employee_id string, credential_number string, credential_type string, role string, facility string")
    people = [("f1", "f2", 20.0, 1.0, ["human"]), ("a1", "a2", 20.0, 1.0, ["human"]), ("f1", "gone", 20.0, 1.0, ["human"])]
    extra = spark.createDataFrame(people, "a string, b string, weight double, prob double, reasons array<string>")
    return {r["record_id"]: r["person_id"] for r in engine.resolve(persons, STAFFING, extra=extra)[0].collect()}


def test_facts_keep_people_apart(person):
    assert person["a1"] != person["a2"]  # even where someone linked them
    assert person["b1"] != person["b2"] and person["b1"] == person["b3"] == "P-E1"


def test_initials_join_one_group_or_none(person):
    assert person["c1"] != person["c2"]
    assert len({person["d1"], person["d2"], person["d3"]}) == 3
    assert person["e1"] == person["e2"]


def test_links_by_people_count(person):
    assert person["f1"] == person["f2"] and "gone" not in person
