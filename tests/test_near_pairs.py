"""Pairs that can be links, joined by bucket and names at once, against all pairs of the blocks."""

import random

import pytest

from tallyforge.operators import linking
from tallyforge.plans import engine
from tallyforge.plans.pack import STAFFING

RULES = [["number"], ["soundex", "facility"], ["family3", "initial"]]
BLOCKS_ONLY = linking.Weights(of=linking.Weights().of | {"family_part": 6.0})


@pytest.mark.parametrize(("weights", "cap", "twice"), [(None, 200, False), (None, 12, False), (None, 12, True), (BLOCKS_ONLY, 12, False)])
def test_no_link_is_lost(spark, weights, cap, twice):
    from pyspark.sql import functions as F

    weights, rng = weights or linking.Weights(), random.Random(cap)
    names = [f"{g} {f}{s}" for g in ("Stephen", "Stefan", "Steph", "Bob", "Robert", "Rob", "S.", "Jo", "Joan") for f in ("Hartmann", "Hartman", "Hartmann-Oak", "Harting", "Oak") for s in ("", " Jr.")]
    ids = [f"r{i:03}" for i in range(160)] + ["r003", "r004"] * twice
    rows = [(i, rng.choice("tuv"), rng.choice([*names, "Oak", None]), rng.choice(["n1", "n2", "", None, None]), rng.choice(["RN", "LPN", None]), rng.choice(["F1", "F1", "F2", None])) for i in ids]
    if twice:
        rows[-2:] = [(*rows[3][:1], "w", *rows[3][2:]), (*rows[4][:1], "w", *rows[4][2:])]
    keyed = linking.person_keys(spark.createDataFrame(rows, "id string, t string, name string, number string, role string, facility string"), "name", spark.createDataFrame([("bob", "robert")], "nickname string, formal string"))
    keyed = keyed.withColumns({"soundex": F.col("key.soundex"), "family3": F.substring("key.family", 1, 3), "initial": F.col("key.initial")}).cache()
    score = lambda pairs, least: sorted(tuple(map(str, r)) for r in linking.score_joined(pairs, weights, least).collect())
    blocks = linking.block_pairs(keyed, RULES, "id", "t", cap, "facility", linking.SCORED)
    for least in (4.25, 6.5):
        near = linking.near_pairs(keyed, RULES, "id", "t", weights, least, cap, "facility")
        assert score(near, least) == score(blocks, least) != []
    assert (linking.near_outcomes(weights, 4.25) is None) == (weights is BLOCKS_ONLY)


def test_resolve_makes_no_pairs_of_strangers(spark, monkeypatch):
    """One bucket of 200 people in two tables: of 40,000 pairs, those of one name are made."""
    met, score = [], linking.score_joined
    monkeypatch.setattr(linking, "score_joined", lambda both, *rest, **more: (met.append(both.count()), score(both, *rest, **more))[1])
    word = lambda n: "".join(("ba", "do", "ku", "li", "me", "na", "ro", "se")[n // 8**j % 8] for j in range(3))
    rows = [(f"{t}{n}", t, t, False, f"K{word(n * 37)} Bar{word(n)}", None, None, None, "RN", "F1") for n in range(200) for t in ("p", "q")]
    persons = spark.createDataFrame(rows, "record_id string, table_id string, template string, is_hr boolean, name string, employee_id string, credential_number string, credential_type string, role string, facility string")
    person = {r["record_id"]: r["person_id"] for r in engine.resolve(persons, STAFFING)[0].collect()}
    assert all(person[f"p{n}"] == person[f"q{n}"] for n in range(200)) and len(set(person.values())) == 200
    assert met == [200]


def test_clusters_of_whole_names_are_made_once(spark, monkeypatch):
    """Without records of initials only and links by people nothing changes after the first clusters; an empty ``extra`` asks for both."""
    calls, made = [], linking.constrained_clusters
    monkeypatch.setattr(linking, "constrained_clusters", lambda *args: (calls.append(1), made(*args))[1])
    rng = random.Random(2)
    rows = [(f"r{n:02}", rng.choice("tuv"), rng.choice(["hr_roster", "payroll"]), f"{g} {f}", rng.choice([f"E{n}", None]), None, None, "RN", rng.choice(["F1", "F2"])) for n in range(60) for g, f in [(rng.choice(["Ana", "Anna", "Rob"]), rng.choice(["Voss Jr.", "Voss", "Foss", "Kern"]))]]
    persons = spark.createDataFrame([(*r[:3], r[2] == "hr_roster", *r[3:]) for r in rows], "record_id string, table_id string, template string, is_hr boolean, name string, employee_id string, credential_number string, credential_type string, role string, facility string")
    none = spark.createDataFrame([], "a string, b string, weight double, prob double, reasons array<string>")
    once, links = engine.resolve(persons, STAFFING)
    assert len(calls) == 1
    twice, same = engine.resolve(persons, STAFFING, extra=none)
    assert len(calls) == 3 and sorted(once.collect()) == sorted(twice.collect())
    assert sorted(map(str, links.collect())) == sorted(map(str, same.select(links.columns).collect()))


def test_resolution_tells_customers_apart_beyond_its_names(spark, tmp_path):
    from tallyforge.plans import catalogue

    spark.createDataFrame([(k + 810_000 * m,) for k in range(4) for m in range(3)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["record_id"]: r["person_id"] for r in catalogue.QUERIES["resolution"](spark, str(tmp_path)).collect()}
    assert got == {f"{t}{k + 810_000 * m}": f"P-E{k + 810_000 * m}" for k in range(4) for m in range(3) for t in "hpql"}
