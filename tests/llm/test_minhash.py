import random
from itertools import combinations

import numpy as np

from tallyforge.llm import bytetext as bt
from tallyforge.llm import minhash, queries
from tallyforge.llm.common import Scratch
from tallyforge.llm.components import connected_components
from tests.llm.conftest import words


def shingles(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs if i is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    r = roots(sets, links)
    return {i: (len(sets[i]), r[i], r[i] == i) for i in sets}


def test_superminhash_is_the_sequential_algorithm():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 7, 40, 500)]
    m = 20
    got = minhash.superminhash(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), m)
    for row, s in zip(got, sets, strict=True):
        want = [int(minhash.EMPTY)] * m
        for e in s.tolist():
            order = list(range(m))
            for layer in range(m):
                x = int(bt.mix(np.array([(e + (layer + 1) * minhash.SEED) % 2**64], np.uint64))[0])
                pick = layer + ((x & 0xFFFFFFFF) * (m - layer) >> 32)
                order[layer], order[pick] = order[pick], order[layer]
                want[order[layer]] = min(want[order[layer]], layer << 56 | x >> 8)
        assert row.tolist() == want


def test_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, 300, 600]), 180)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    nodes = {x for link in links if link[0] != link[1] for x in link}
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == roots(nodes, [x for x in links if x[0] != x[1]]) and len(got) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def family(rng, n, base_words=60):
    """Texts in copies: near ones at all distances, chains of small edits, and a large group."""
    out = []
    for f in range(n):
        text = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
        for _ in range(30 if f == 0 else 4):
            text = list(text)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(base_words)] = f"e{rng.randrange(9999)}"
            out.append(" ".join(text))
    return out


def test_near_duplicates(make_docs):
    rng = random.Random(4)
    texts = family(rng, 25)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(2000 + i, texts[0].upper()) for i in range(40)] + [(3000, None), (3001, ""), (3002, "a b"), (3003, "A  b"), (3004, "a"), (3005, " \n ")]
    for block in (2048, 8):
        got = minhash.near_duplicates(make_docs(rows), words=4, percent=80, block=block).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, 4, 80)
        assert len(got) == len(rows)


def test_near_duplicates_odd(odd_docs, make_docs):
    got = minhash.near_duplicates(odd_docs, words=4).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == brute(rows, 4, 80)
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 1, None, True)]
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op7_minhash(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, 4, 80)
