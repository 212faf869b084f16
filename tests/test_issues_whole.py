"""The whole-table issue queries take in every row, and meet every case."""

from tallyforge.plans import catalogue


def test_merge_counts_every_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    rows = {r["fingerprint"]: r for r in catalogue.QUERIES["issue_merge"](spark, sf_dir).collect()}
    assert set(rows) == {f"{e['event_type']}-{e['user_id']}-{e['ts'].hour}" for e in events}
    late = sum(e["ts"].day >= 11 for e in events)
    assert sum(int(r["message"]) for r in rows.values() if r["active"]) == late
    assert {(r["status"], r["active"]) for r in rows.values()} == {("accepted", True), ("accepted", False), ("open", True)}


def test_evidence_names_every_order(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    items = [i.split(":") for r in catalogue.QUERIES["evidence_enrich"](spark, sf_dir).collect() for i in r["evidence"].split(" | ")]
    assert sorted(int(i[0]) for i in items) == sorted(o["o_orderkey"] for o in orders)
    assert sum(int(i[2]) for i in items if i[1] == "record") == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert {i[1] for i in items} == {"record", "note"}
