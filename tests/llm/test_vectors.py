import math
import random

import numpy as np
import pytest

from tallyforge.llm import cap_dedup, queries, topk
from tallyforge.llm.common import Scratch
from tests.llm.test_minhash import roots

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "k") for i, v in rows], SCHEMA)


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, cosine):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if valid(v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in ok]
    links, n = [], {i: 0 for i, _ in rows}
    for x, (i, a) in enumerate(unit):
        for y, (j, b) in enumerate(unit):
            if x != y and len(a) == len(b) and a @ b >= cosine:
                n[i] += 1
                links.append((i, j))
    r = roots([i for i, _ in rows], links)
    return {i: (n[i], r[i], r[i] == i) for i, _ in rows}


def odd_vectors():
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(20)] + [(200 + i, [x * 2.5 for x in base[5]]) for i in range(3)]
    rows += [(300 + i, [x + rng.gauss(0, 0.05) for x in base[7]]) for i in range(80)]
    rows += [(400 + i, [x + rng.gauss(0, 0.3) for x in base[9]]) for i in range(60)]
    return [*rows, (500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [float("inf")] + [0.0] * 15), (505, [None] * 16), (506, [1.0, 2.0]), (507, [1.0, 2.1]), (508, [3.0])]


def test_near_vectors(spark):
    rows = odd_vectors()
    want = brute_links(rows, 0.9)
    for block in (2048, 16):
        got = {r["vec_id"]: tuple(r)[1:] for r in cap_dedup.near_vectors(table(spark, rows), 0.9, block=block).collect()}
        assert got == want
    assert cap_dedup.near_vectors(table(spark, [])).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.905 * a + math.sqrt(1 - 0.905**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, c]).astype(np.float32))]
    got = {r["vec_id"]: r["component_id"] for r in cap_dedup.near_vectors(table(spark, rows)).collect()}
    assert sum(got[1500 + i] == i for i in range(1500)) >= 1497


def test_tables_grow_with_the_codes():
    rates = [cap_dedup.meeting_rate(64, cap_dedup.code_size(n, 10, 24), 10, 0.9, 11, pairs=400) for n in (10_000, 10_000_000)]
    assert rates[0] > rates[1] > 0.5
    few, many = (cap_dedup.tables_needed(r, 1e-3) for r in rates)
    assert few < many and (1 - rates[1]) ** many <= 1e-3 < (1 - rates[1]) ** (many - 1)


def brute_top(rows, k):
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if valid(v)]
    out = []
    for i, a in q:
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in q if j != i and len(a) == len(b))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rows = odd_vectors() + [(600 + i, [0.5] * 16) for i in range(9)] + [(650, [0.5] * 16), (700, [1e6] * 16)]
    vectors = topk.quantised(table(spark, rows))
    for sizes in ({}, {"block": 4, "shard_rows": 40, "chunk_rows": 3}, {"shard_rows": 10, "most_leaves": 4, "most_sample": 20}):
        got = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5, **sizes).collect()
        assert sorted(tuple(r) for r in got) == brute_top(rows, 5)
    none = topk.quantised(table(spark, []))
    assert topk.top_k(none, none).count() == 0 and topk.top_k(vectors, none).count() == 0
    assert topk.top_k(vectors.filter("vec_id = 508"), vectors).count() == 0


def test_large_components(spark):
    rows = [(0, [3e4, 1.0]), (50, [-4e4, 2e6]), (1, [1e6, -1e6]), (2, [4e6, 7.0])]
    vectors = topk.quantised(table(spark, rows))
    assert sorted(tuple(r) for r in topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=2).collect()) == brute_top(rows, 2)
    for bad in ([1e30, 0.0], [5e307, 0.0], [3e7, 0.0]):
        with pytest.raises(Exception, match="vec_id 9"):
            topk.quantised(spark.createDataFrame([(9, bad)], "vec_id long, embedding array<double>")).collect()


def test_bounds_past_64_bits():
    x = np.array([[1 << 61, -(1 << 61)]])
    assert topk._exact(x, np.array([[4, -4], [-4, 4], [1, 1]])).tolist() == [[1 << 62, -(1 << 62), 0]]


def test_queries_go_only_where_they_may_find(spark):
    """Far clusters of vectors: a query must meet few leaves, and another table five times as large moves five times as much."""
    rng = np.random.default_rng(6)
    met = []
    for n in (400, 2000):
        centers = rng.integers(-200, 200, (16, 16))
        x = (centers[np.arange(n) % 16] + rng.integers(-3, 4, (n, 16))) / 256
        vectors = topk.quantised(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
        scratch = Scratch(spark, "test")
        topk.top_k(vectors.filter("vec_id % 5 = 0"), vectors, shard_rows=n // 16, scratch=scratch).count()
        met.append(spark.read.parquet(f"{scratch.path}/rest").count() / (n / 5))
    assert met[0] < 6 and met[1] < 6


def test_blocks_prune():
    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (40, 16))
    v = (centers[:, None, :] + rng.integers(-3, 4, (40, 50, 16))).reshape(-1, 16).astype(np.int64)
    ids = np.arange(len(v))
    blocks = topk.build_blocks(ids, v, 64)
    assert sorted(np.concatenate([b[0] for b in blocks]).tolist()) == ids.tolist() and max(len(b[0]) for b in blocks) <= 64
    scored = []

    class Counted(list):
        def __getitem__(self, at):
            scored.append(at)
            return list.__getitem__(self, at)

    topk.search_blocks(Counted(blocks), ids[:1], v[:1], 5, np.array([topk.NONE]))
    assert len(scored) < len(blocks) / 3


def test_queries(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op5_topk(spark, sf_dir).collect()) == brute_top(rows, 5)
    assert {r["vec_id"]: tuple(r)[1:] for r in queries.op9_cap_dedup(spark, sf_dir).collect()} == brute_links(rows, 0.9)
