import hashlib
import io
import re
from collections import defaultdict

import pytest

from tallyforge.llm import mixing, queries, warc
from tests.llm.conftest import words


def fill(sizes, weights, cap):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * unit > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * unit for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


def check_mix(rows, docs, off=4):
    assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"] is not None) == sorted((d["doc_id"], len(words(d["text"]))) for d in docs if d["doc_id"] is not None)
    assert len(rows) == len(docs)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = fill(sizes, (5, 2, 1), 3)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(off, want[s] / 200)
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_mix_query(spark, sf_dir):
    rows = queries.op2_mixing(spark, sf_dir).collect()
    check_mix(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(rows) == sorted(queries.op2_mixing(spark, sf_dir).collect())


def test_mix_odd(odd_docs, make_docs):
    plan = mixing.mix(mixing.word_sizes(odd_docs), block_words=50)
    check_mix(mixing.taken_words(plan).collect(), odd_docs.collect())
    blocks = plan.pieces.filter("words > 0").groupBy("source_no", "block").agg({"words": "sum"}).collect()
    length = {r["source_no"]: r["block_words"] for r in plan.targets.collect()}
    assert all(r[2] <= length[r[0]] for r in blocks) and sum(r[2] == length[r[0]] for r in blocks) >= len(blocks) - len(length)
    none = make_docs([])
    assert mixing.taken_words(mixing.mix(mixing.word_sizes(none))).count() == 0
    assert mixing.mixed(none).count() == 0
    mixed = mixing.mixed(odd_docs, block_words=50)
    assert mixed.columns == odd_docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == pytest.approx(sum(len(words(r["text"])) for r in odd_docs.collect()), rel=0.01)


def test_schedule_is_even(make_docs):
    docs = make_docs([(i, "w " * 40, "en", f"s{i % 3}") for i in range(300)])
    plan = mixing.mix(mixing.word_sizes(docs), block_words=16, least_slots=50)
    slots = sorted((r["slot"], r["source_no"]) for r in plan.schedule.collect())
    assert [s for s, _ in slots] == list(range(750))
    share = {r["source_no"]: r["target"] / 12000 for r in plan.targets.collect()}
    for n in range(50, len(slots), 50):
        for s, part in share.items():
            assert abs(sum(x == s for _, x in slots[:n]) - n * part) < 4
    taken = {r["source_no"]: r["take"] for r in plan.targets.collect()}
    assert taken == {s: min(16 * sum(x == s for _, x in slots), 12000) for s in taken}  # the slots set what is taken


def golden(n, parts, start):
    """Source of each slot by the rule itself: ``parts`` are shares in order."""
    out = []
    for i in range(n):
        x, upto = (start + i * (5**0.5 - 1) / 2) % 1, 0.0
        for s, p in enumerate(parts, 1):
            upto += p
            if x < upto or s == len(parts):
                out.append(s)
                break
    return out


def test_mix_comes_in_slot_order(make_docs):
    """Documents of one block each: the sources of the rows must be those of the slots, for either schedule."""
    docs = make_docs([(i, f"w{i} " * 10, "en", f"s{i % 3}") for i in range(300)])
    seen = []
    for start in (0.5, 0.123):
        rows = mixing.mixed(docs, partitions=5, block_words=10, least_slots=10, start=start).collect()
        want = golden(300, [5 / 8, 2 / 8, 1 / 8], start)
        assert [int(r["source"][1]) + 1 for r in rows] == want
        seen.append([r["doc_id"] for r in rows])
    assert seen[0] != seen[1]


def test_repeated_rows_and_names(spark):
    """Two sources of two equal rows each, and columns whose names the operator uses itself."""
    rows = [(i // 2, "one two three four five six seven eight nine ten eleven", f"s{i // 2}", i, "h", 5, 0.5) for i in (0, 1, 2, 3)]
    rows = [(*r[:3], r[0], *r[4:]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long, _h string, copy int, place double")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    out = got.collect()
    n = {s: sum(len(words(r["text"])) for r in out if r["source"] == s) for s in ("s0", "s1")}
    plan = {r["source"]: r["take"] for r in mixing.mix(mixing.word_sizes(docs)).targets.collect()}
    assert n == plan and abs(n["s0"] - 44 * 5 / 7) <= 2 and abs(n["s1"] - 44 * 2 / 7) <= 2
    assert all((r["_h"], r["copy"], r["place"], r["key"]) == ("h", 5, 0.5, r["doc_id"]) for r in out)
    nulls = spark.createDataFrame([(None, "a b", "x", "p"), (None, "a b", "p", None), (None, "a b", None, "p")], "doc_id long, text string, source string, lang string")
    assert sum(len(words(r["text"])) for r in mixing.mixed(nulls).collect()) == pytest.approx(6, abs=2)


def test_many_sources(spark, make_docs):
    docs = make_docs([(i, "w " * (1 + i % 50), "en", f"s{i % 400}") for i in range(3000)])
    check_mix(mixing.taken_words(mixing.mix(mixing.word_sizes(docs))).collect(), docs.collect())


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, keep long")


def want_records(rows):
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        first = max(ids) if len(body) >= 1000 and len(groups[html or ""]) > 1 and ids else page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), *(("response", None) if first == page_id else ("revisit", first))))
    return sorted(out, key=str)


def test_warc(spark):
    rows = [(1, "http://a/ b\r\nX: y", "é" * 500, "d", 1), (2, None, "é" * 500, "d", 1), (3, "u", "short", "d", 1), (4, "u", "short", "d", 1), (5, "u", None, "d", 1), (6, "u", "", None, None), (None, "u", "é" * 500, None, None), (7, "u", "z" * 999, "d", 1), (8, "u", "z" * 999, "d", 1)]
    rows += [(100 + i, "u", "copy " * 300, "d", 1) for i in range(50)] + [(9, "u", "WARC/1.1\r\n\r\n" * 90000, "d", 1)]
    for size in (1 << 28, 2000):
        manifest = warc.write_warc(pages(spark, rows), most_file_bytes=size)
        got = [tuple(r) for r in warc.read_warc(manifest).drop("url").collect()]
        assert sorted(got, key=str) == want_records(rows)
    texts = {r["page_id"]: r["payload"] for r in warc.read_warc(manifest, with_payload=True).collect()}
    assert texts[149] == b"copy " * 300 and texts[100] is None and texts[5] == b""
    assert warc.read_warc(warc.write_warc(pages(spark, []))).count() == 0


def test_warc_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op10_warc(spark, sf_dir).collect()), key=str) == want_records(rows)


def test_warc_reader_checks():
    record = warc.make_record(1, "u", b"hello" * 100, None)
    both = record + warc.make_record(2, "u", b"", 1)
    for chunk in (1, 7, 1 << 16):
        heads = [h for h, _ in warc.WarcReader(io.BytesIO(both), chunk)]
        assert [h["warc-type"] for h in heads] == ["response", "revisit"] and heads[1]["warc-refers-to"] == "<urn:x-page:1>"
    import gzip

    plain = gzip.decompress(record)
    for bad in (record[:-9], b"junk" + record, gzip.compress(plain.replace(b"hello", b"jello", 1)), gzip.compress(re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 5\r\n\r\nHTTP", plain)), gzip.compress(plain.replace(b"WARC/1.1", b"HTTP/1.1"))):
        with pytest.raises(ValueError):
            list(warc.WarcReader(io.BytesIO(bad)))
