from datetime import date

from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import checks, drafts


def test_header_days(spark):
    names = ["Mon 09/14", "09/14", "2026-09-14", "14 Sep", "Sep 14", "Staff", "12/31"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, v string")
    got = [r["d"] for r in rows.select("i", dates.schedule_day(F.col("v"), F.array(F.lit(date(2026, 9, 20))))["day"].alias("d")).orderBy("i").collect()]
    assert got == [date(2026, 9, 14)] * 5 + [None, date(2026, 12, 31)]


def test_status_and_legend(spark):
    files = spark.createDataFrame([("f1", "parsed", None), ("f2", "quarantined", "no bid"), ("f3", "failed", "x")], "file_id string, status string, error string")
    assert sorted((r["check_id"], r["entity_ids"][0]) for r in drafts.file_drafts(files).collect()) == [("FILE-FAILED", "f3"), ("FILE-QUARANTINED", "f2")]
    shifts = spark.createDataFrame([("f", "r1", "7a-3p", 8.0, 7.5), ("f", "r2", "7a-3p", 8.0, 7.5), ("f", "r3", "7a-7p", 12.0, 12.0)], "file_id string, record_id string, token string, hours double, legend_hours double")
    assert [r["key"] for r in drafts.legend_mismatch_drafts(shifts).collect()] == ["7a-3p"]


def test_identities(spark):
    owners = spark.createDataFrame([("a", "P-1"), ("b", "P-2"), ("c", "P-1")], "record_id string, person_id string")
    scored = spark.createDataFrame([("a", "b", 0.8, "gray"), ("a", "c", 0.8, "gray"), ("b", "c", 0.99, "auto")], "a string, b string, prob double, zone string")
    assert [r["entity_ids"] for r in drafts.gray_pair_drafts(scored, owners).collect()] == [["P-1", "P-2"]]
    assert [r["entity_ids"] for r in drafts.identity_conflict_drafts(scored.filter("zone = 'auto'"), owners).collect()] == [["P-1", "P-2"]]
    names = spark.createDataFrame([("c1", "p", "bell", "bell"), ("c2", "p", "bell", "reyes"), ("c3", "p", "smith", "smyth")], "credential_id string, person_id string, licence_family string, person_family string")
    assert [r["entity_ids"][0] for r in drafts.name_differs_drafts(names).collect()] == ["c2"]


def test_decisions(spark):
    decided = spark.createDataFrame([("t1", "x", "f"), ("t1", "y", "g"), ("t2", "x", "f"), ("t2", "y", "f"), ("t3", "x", "f")], "table_id string, col_name string, field string")
    shares = spark.createDataFrame([("t1", "x", "f", 0.9), ("t1", "y", "g", 1.0), ("t2", "x", "f", 1.0), ("t2", "y", "f", 1.0), ("t3", "x", "f", 1.0)], "table_id string, col_name string, field string, share double")
    assert {r["table_id"]: r["accepted"] for r in drafts.accepted_maps(decided, shares, ["f", "g"]).collect()} == {"t1": True, "t2": False, "t3": False}
    rows = spark.createDataFrame([(1, 2), (1, 3), (5, 4)], "later int, earlier int")
    assert drafts.swapped_columns(rows, "later", "earlier") and not drafts.swapped_columns(rows, "earlier", "later")


def test_parse_issue_drafts(spark):
    rows = spark.createDataFrame([("r1", ["date:credential.expires_on=x", "row_incomplete:a,b", "odd_kind:z"]), ("r2", [])], "record_id string, parse_issues array<string>")
    got = sorted((r["check_id"], r["severity"]) for r in checks.parse_issue_drafts(rows).collect())
    assert got == [("PARSE-DATE", "HIGH"), ("PARSE-ODD-KIND", "LOW"), ("ROW-INCOMPLETE", "MEDIUM")]
