"""What a Python worker keeps once its task is over, and how many files a table of few rows takes."""

import os

import pyarrow as pa

from tallyforge.llm import chunk_tokens, common
from tallyforge.llm.components import connected_components


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_memory_is_given_back():
    pins = []

    def run(batches):
        blocks = []
        for _ in range(3000):  # freed blocks under one that stays are the allocator's to keep
            blocks.append(bytes(bytearray(b"x") * 65536))
        pins.append(bytes(bytearray(b"x") * 65536))
        yield from batches

    common.give_back()
    begin = resident_mb()
    batch = pa.record_batch([pa.array([1])], ["a"])
    assert list(run(iter([batch]))) == [batch]
    assert resident_mb() - begin > 100
    assert list(common.frugal(run)(iter([batch]))) == [batch]
    assert resident_mb() - begin < 50


def test_caches_of_other_operators_are_emptied(monkeypatch):
    monkeypatch.setattr(chunk_tokens, "ChunkEncoder", lambda path, rule: object())
    known = chunk_tokens.encoder("a", "word")
    list(common.frugal(lambda batches: batches, keep=True)(iter([])))
    assert chunk_tokens.encoder("a", "word") is known
    list(common.frugal(lambda batches: batches)(iter([])))
    assert chunk_tokens.encoder("a", "word") is not known
    chunk_tokens.encoder.cache_clear()


def test_few_rows_take_few_files(spark):
    scratch, rows = common.Scratch(spark, "files"), spark.range(0, 25_000, 1, 50)
    assert len(scratch.table("all", rows).inputFiles()) == 50
    some = scratch.table("some", rows, 25_000)
    assert len(some.inputFiles()) == 3 and some.distinct().count() == 25_000


def test_components_take_few_files(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.range(300).selectExpr("id as a", "id + if(id % 10 < 9, 1, 0) as b")
        out = connected_components(links, common.Scratch(spark, "files"))
        assert len(out.inputFiles()) == 1
        assert {tuple(r) for r in out.collect()} == {(i, i // 10 * 10) for i in range(300)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
