from pyspark.sql import functions as F

from tallyforge.streaming import incremental


def test_ingest_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    calls = []
    (tmp_path / "in/a.csv").write_text("name,n\nann,1\nbob,2\n")
    run = lambda: incremental.ingest_stream(spark, f"file://{tmp_path}/in", out, check, lambda df, n: calls.append(df.count()))
    run()
    (tmp_path / "in/copy.csv").write_text("name,n\nann,1\nbob,2\n")
    (tmp_path / "in/b.csv").write_text("name,n\ncid,3\neve,4\n")
    run()
    run()
    got = spark.read.parquet(out)
    assert got.filter("col_name = 'name'").count() == 4 and got.select("file_id").distinct().count() == 2
    assert len(calls) == 2


def test_event_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    rows = lambda n: spark.createDataFrame([("k", f"p{i}", i) for i in range(n)], "kind string, payload string, at long")
    last = incremental.append_events(spark, log, rows(3), 0)
    last = incremental.append_events(spark, log, rows(2), last)
    assert last == 5
    assert [r["seq"] for r in incremental.replay_events(spark, log, 3).collect()] == [4, 5]
    assert [r["seq"] for r in incremental.replay_events(spark, log, 9).collect()] == [1, 2, 3, 4, 5]


def test_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = incremental.windowed_counts(events, "ts", "event_type", "6 hours")
    assert counted.agg(F.sum("n")).first()[0] == events.count()
