from datetime import date

from tallyforge.plans import serving
from tallyforge.sources import layout


def test_pages():
    assert layout.looks_like_schedule("Mon 1 Tue 2 Wed 3") and layout.looks_like_schedule("7a-3p 3p-11p 11p-7a") and not layout.looks_like_schedule("monthly report")
    got = layout.page_contexts([(0, "Bayside"), (1, "Week 1"), (5, "Legend: D is 8 hours")], [(2, 4), (6, 8)])
    assert got == [{"title": "Bayside", "subtitle": "Week 1", "footnote": "Legend: D is 8 hours"}, {"title": "Bayside", "subtitle": None, "footnote": None}]


def test_words_to_cells(spark):
    words = [(1, 0.0, 30.0, 10.0, 10.0, "Staff"), (1, 60.0, 75.0, 11.0, 10.0, "Mon"), (1, 0.0, 20.0, 30.0, 10.0, "Ann"), (1, 22.0, 40.0, 30.0, 10.0, "Lee"), (1, 60.0, 80.0, 31.0, 10.0, "7a-3p")]
    cells = layout.words_to_cells(spark.createDataFrame(words, "page long, x0 double, x1 double, top double, size double, word string"))
    assert {(r["line"], r["col"]): r["cell"] for r in cells.collect()} == {(0, 0): "Staff", (0, 1): "Mon", (1, 0): "Ann Lee", (1, 1): "7a-3p"}
    assert layout.grid_scores(cells, ["staff"]).first()["score"] == 1.0


def test_serving(spark, tmp_path):
    issues = spark.createDataFrame([("f1", "A", "LOW", "open", None, None, ["P-1"], True), ("f2", "B", "CRITICAL", "open", None, None, ["C-1", "P-2"], True), ("f3", "B", "HIGH", "closed", None, None, ["P-1"], True), ("f4", "C", "HIGH", "open", None, None, ["P-1"], False)], "fingerprint string, check_id string, severity string, status string, owner string, note string, entity_ids array<string>, active boolean")
    persons = spark.createDataFrame([("P-1", "Ann"), ("P-2", "Bob")], "person_id string, display_name string")
    assert [(r["fingerprint"], r["display_name"]) for r in serving.issue_list(issues, persons).collect()] == [("f2", "Bob"), ("f3", "Ann"), ("f1", "Ann")]
    assert [r["fingerprint"] for r in serving.issue_list(issues, persons, person_id="P-1", status="open").collect()] == ["f1"]
    assert [(r["person_id"], r["open_issues"]) for r in serving.people_list(persons, issues, "an").collect()] == [("P-1", 1)]
    assert {(r["severity"], r["status"]): r["n"] for r in serving.summary(issues).collect()} == {("LOW", "open"): 1, ("CRITICAL", "open"): 1, ("HIGH", "closed"): 1}
    patch = spark.createDataFrame([("f1", "closed", "ann", None)], "fingerprint string, status string, owner string, note string")
    assert {r["fingerprint"]: r["status"] for r in serving.patch_issues(issues, patch).collect()} == {"f1": "closed", "f2": "open", "f3": "closed", "f4": "open"}
    held = spark.createDataFrame([("c1", date(2026, 9, 1)), ("c2", date(2026, 10, 1)), ("c3", date(2027, 9, 1)), ("c4", None)], "credential_id string, expires_on date")
    assert [(r["credential_id"], r["band"]) for r in serving.credential_horizon(held, date(2026, 9, 21)).collect()] == [("c1", "overdue"), ("c2", "0-30")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(tuple(r) for r in serving.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "x"), (3, "y")]
    path = f"file://{tmp_path}/t"
    serving.replace_tables(old, path, "k")
    serving.replace_tables(new, path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "x"), (3, "y")]
