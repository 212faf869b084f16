"""The baseline's workloads give the results that they must."""

from tallyforge.plans import shapes


def test_every_person_is_found_once(spark, sf_dir):
    rows = shapes.resolve_records(spark, sf_dir, 60).collect()
    by = {}
    for r in rows:
        by.setdefault(r["person_id"], set()).add(r["record_id"][1:])
    assert len(rows) == 300 and len(by) == 60 and all(len(keys) == 1 for keys in by.values())


def test_csv_rows():
    assert shapes.extract_rows(shapes.csv_text(500)) == 500
