import hashlib
import random
from collections import Counter

import numpy as np

from tallyforge.llm import queries
from tallyforge.llm import substring_dedup as sd
from tests.llm.conftest import words


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def got(docs, width):
    return Counter(tuple(r) for r in sd.digests(sd.remove_repeats(docs, width)).collect())


def test_against_brute_force(make_docs):
    rng = random.Random(8)
    texts = []
    passages = [" ".join(f"p{rng.randrange(300)}" for _ in range(rng.choice([9, 10, 11, 30]))) for _ in range(6)]
    for _ in range(120):
        parts = [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(12))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append("  ".join(parts) + rng.choice(["", "\n", " é"]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900 + i, texts[3]) for i in range(30)] + [(-5, texts[7])]
    rng.shuffle(rows)
    for width in (10, 3, 1):
        assert got(make_docs(rows), width) == brute(rows, width)


def test_odd(odd_docs, make_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(odd_docs, 50) == brute(rows, 50)
    assert got(odd_docs, 2) == brute(rows, 2)
    cleaned = sd.remove_repeats(odd_docs, 2)
    assert cleaned.columns == [*odd_docs.columns, "n_words", "n_removed", "kept_text"]
    assert {r["doc_id"]: r["kept_text"] for r in cleaned.collect()}[1] is None
    assert sd.remove_repeats(make_docs([]), 50).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    total, size = Counter(), 1 << 12
    parts, merged = [], np.zeros(2 * size, np.uint8)
    for _ in range(30):
        keys, counts = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64) % np.uint64(3000) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)
        parts.append(keys)
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        sd.add_sketch(merged, *sd.partition_sketch(keys, counts, size))
    once = 0
    for keys in parts:
        for k, flag in zip(keys.tolist(), sd.repeated_in_sketch(keys, merged).tolist(), strict=True):
            assert flag or total[k] < 2
            once += not flag
    assert once > 100  # and it does tell keys of one document


def test_order_of_partitions_does_not_matter():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    sketches = [sd.partition_sketch(np.sort(rng.choice(keys, 100, replace=False)), np.ones(100, np.int64), 256) for _ in range(8)]
    merged = []
    for order in (range(8), reversed(range(8))):
        merged.append(np.zeros(512, np.uint8))
        for k in order:
            sd.add_sketch(merged[-1], *sketches[k])
    assert (merged[0] == merged[1]).all()


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op1_substring_dedup(spark, sf_dir).collect()) == brute(rows, 50)
