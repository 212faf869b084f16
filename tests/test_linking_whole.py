"""The link queries over all of lineitem, and constrained clusters, against union-find in one thread."""

import random
from collections import defaultdict

import pytest

from tallyforge.operators.linking import constrained_clusters
from tallyforge.plans import catalogue


def greedy(links, facts):
    """Cluster of each id by links in order; ``facts``: id to a tuple of values."""
    parent, held = {i: i for i in facts}, {i: [{v} - {None, ""} for v in f] for i, f in facts.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in sorted((-p, a, b) for a, b, p in links if a in facts and b in facts):
        x, y = sorted((find(a), find(b)))
        if x != y and all(len(s | t) <= 1 for s, t in zip(held[x], held[y], strict=True)):
            parent[y] = x
            held[x] = [s | t for s, t in zip(held[x], held[y], strict=True)]
    return {i: find(i) for i in facts}


@pytest.mark.parametrize("n_facts", [1, 2])
def test_constrained_clusters_follow_the_order(spark, n_facts):
    rng = random.Random(n_facts)
    ids = [f"r{i}" for i in range(120)]
    facts = {i: tuple(rng.choice(["1", "2", "", None, None, None]) for _ in range(n_facts)) for i in ids}
    links = [(rng.choice(ids), rng.choice([*ids, "gone"]), rng.choice([0.5, 0.7, 0.9, rng.random()])) for _ in range(260)]
    names = [f"f{k}" for k in range(n_facts)]
    nodes = spark.createDataFrame([(i, *f) for i, f in facts.items()], ", ".join(f"{c} string" for c in ["id", *names]))
    got = constrained_clusters(spark.createDataFrame(links, "a string, b string, prob double"), nodes, "id", names).collect()
    assert {r["id"]: r["cluster"] for r in got} == greedy(links, facts) and len(got) == len(ids)


def test_queries_link_all_of_lineitem(spark, sf_dir):
    rows = [(r["l_orderkey"], r["l_partkey"], float(r["l_quantity"]) / 50) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()]
    nodes = {n for o, p, _ in rows for n in (f"{o * 10}", f"{p * 10 + 1}")}
    want = greedy([(f"{o * 10}", f"{p * 10 + 1}", 1.0) for o, p, _ in rows], {n: (None,) for n in nodes})
    groups = defaultdict(list)
    for n, c in want.items():
        groups[c].append(n)
    least = {n: min(g) for g in groups.values() for n in g}
    assert {r["node"]: r["component"] for r in catalogue.QUERIES["components"](spark, sf_dir).collect()} == least
    facts = {f"o{o}": (f"o{o}",) for o, _, _ in rows} | {f"p{p}": (None,) for _, p, _ in rows}
    want = greedy([(f"o{o}", f"p{p}", q) for o, p, q in rows], facts)
    assert {r["id"]: r["cluster"] for r in catalogue.QUERIES["constrained_clusters"](spark, sf_dir).collect()} == want
