"""The stages against brute-force versions of what they do, each on its own input, and all of them in a row."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.conftest import words
from tests.llm.test_minhash import brute as near
from tests.llm.test_mixing_and_warc import fill
from tests.llm.test_tokens_and_packing import check_packing, crc, library


@pytest.fixture(scope="module")
def world(spark):
    """Documents in two languages with near copies, shared passages, texts without letters, nulls and a repeated id."""
    rng = random.Random(6)
    pools = {"en": ["the", "cat", "house", "with", "them", "and", "were", "dogs"], "fr": ["les", "chats", "maison", "avec", "elle", "était", "dans", "une"]}
    passage = " ".join(rng.choice(pools["en"]) + str(rng.randrange(900)) for _ in range(55))
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choice(pools[lang]) + rng.choice(["", "", "s", "x", str(i)]) for _ in range(rng.randrange(5, 90)))
        rows.append((i, text + (f"\n{passage}" if i % 7 == 0 else ""), lang, f"src{i % 4}"))
    base = rows[40][1].split()
    rows += [(200 + k, " ".join([*base[:-1], f"end{k}"]), rows[40][2], "src1") for k in range(6)]
    rows += [(300, None, "en", "src1"), (301, "", "en", None), (302, "12 34 $$", "fr", "src2"), (303, rows[5][1], "en", None), (303, "the house with the cat and dogs", "en", "src0")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select(cp.COLUMNS)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_language_id(spark, world):
    out = cp.identify_language(spark, world, "")
    assert out.columns == cp.COLUMNS
    want = Counter((i, t) for i, t in texts(world) if i not in (300, 301, 302))
    assert Counter(texts(out)) == want  # what has letters of a known language stays
    given = {r["doc_id"]: r["lang"] for r in world.collect()}
    rows = out.collect()
    assert sum(r["lang"] == given[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_near_dedup(spark, world):
    """Rows of one doc_id are judged apart: one 303 copies document 5 and goes, the other stays; repeats of a row are one."""
    more = world.unionByName(world.filter("doc_id in (10, 303)")).unionByName(world.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    out = Counter(texts(cp.drop_near_duplicates(spark, more, "")))
    rows = [(i, t) for i, t in texts(world)]
    found = near([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    want, seen = Counter(), set()
    for k in order:
        if found[k][1] not in seen or not found[k][0]:
            want[rows[k]] += 1
            seen.add(found[k][1])
    want[(None, dict(rows)[12])] += 1
    assert out == want
    plain = world.filter("doc_id <> 303")
    assert Counter(texts(cp.drop_near_duplicates(spark, plain, ""))) == Counter({r: n for r, n in want.items() if r[0] not in (None, 303)})


def test_odd_tables(spark, world):
    """Extra columns of clashing names, nulls and repeated rows pass every stage."""
    rows = world.unionByName(world.filter("doc_id < 5")).withColumns({"_h": F.lit("x"), "key": F.lit(1), "sequence_id": F.lit("y"), "letters": F.lit(2), "place": F.lit(3)})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.columns == cp.COLUMNS and out.count() > 0
    assert cp.STAGES[-1][1](spark, rows, "").count() >= rows.count()


def test_substring_dedup(spark, world):
    out = dict(texts(cp.remove_repeated_passages(spark, world, "")))
    first = {}
    for i, t in texts(world):
        w = words(t)
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    for i, t in texts(world):
        if i == 303:
            continue
        w = words(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        if gone and len(gone) == len(w):
            assert i not in out
        else:
            assert out[i] == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else t)


def test_mixing(spark, world):
    size, got = defaultdict(int), defaultdict(int)
    for r in world.collect():
        size[r["source"]] += len(words(r["text"]))
    given = defaultdict(set)
    for i, t in texts(world):
        given[i].add(t)
    for r in cp.mix_sources(spark, world, "").collect():
        got[r["source"]] += len(words(r["text"]))
        assert any((t or "") == r["text"] or words(t)[: len(words(r["text"]))] == words(r["text"]) for t in given[r["doc_id"]])
    for s, target in fill(size, (5, 2, 1), 3).items():
        assert got[s] == pytest.approx(target, abs=4)


def test_packing(spark, world):
    unique = world.filter("doc_id <> 303")
    bins, least = check_packing(cp.pack_sequences(spark, unique, "").collect(), texts(unique), 4096)
    assert bins <= least + 1


def test_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.cache()
        assert docs.columns == cp.COLUMNS
        counts.append(docs.count())
    assert counts[1] >= 0.99 * counts[0] and counts[2] < counts[1]
    rows = cp.run(spark, sf_dir)
    last = Counter(texts(docs))  # what the stage before kept, packed by the library's own ids
    lib, bins, want = library("word_bpe_49k.json"), defaultdict(list), Counter()
    for (i, t), n in last.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.update({(i, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])): n for k, s in enumerate(range(0, len(ids), 4096))})
    got = rows.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_empty(spark, world):
    none = world.filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, "").count() == 0
