import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import bytetext as bt
from tallyforge.llm import queries, toxicity


def graded(make_docs, spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        grade = 0 if i % 3 else 1 + i % 2
        text = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(rng.randrange(5, 40))]
        if not grade and i % 2:
            text.append("kindly")
        if grade:
            text.insert(rng.randrange(len(text)), ["Nasty!", "vilest"][grade - 1])
        rows.append((i, " ".join(text)))
        labels.append((i, grade))
    return make_docs(rows), spark.createDataFrame([*labels, (5000, 1), (1, None), (None, 1)], "doc_id long, grade int")


def test_severity_is_ordered(make_docs, spark):
    model = toxicity.fit(*graded(make_docs, spark))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert (model.weights > 0).any() and (model.weights < 0).any()
    filler = "wabx wcdx wefx wghx wijx wklx " * 3
    docs = make_docs([(1, "clean words"), (2, filler + "NASTY"), (3, filler + "vilest"), (4, None), (5, ""), (6, "wabx " * 100_000 + "vilest"), (6, "nasty"), (7, "vilest " * 30)])
    got = toxicity.predict(docs, model)
    assert got.columns == [*docs.columns, "severity", "p_toxic", "toxic"]
    rows = got.collect()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["toxic"] for i in (1, 2, 3, 4, 5, 7)] == [False, True, True, False, False, True] and len(rows) == 8
    assert by[1]["severity"] < by[2]["severity"] < by[3]["severity"] <= by[7]["severity"] <= 2
    long = next(r for r in rows if r["doc_id"] == 6 and len(r["text"]) > 9)
    assert not long["toxic"] and long["severity"] < by[2]["severity"] < next(r for r in rows if r["doc_id"] == 6 and r["text"] == "nasty")["severity"]


def naive_features(text):
    """{feature: value} by the definition; features are named, not hashed."""
    low = (text or "").lower()
    found = re.findall(r"[a-z\x80-\U0010ffff]+", low)
    names = Counter(("w", w) for w in found)
    for w in found:
        raw = w.encode()
        names.update(("p", raw[:n]) for n in range(4, 11) if len(raw) > n)
    names.update(("s", x) for x in re.findall(r"[!-/:-@\[-`{-~]+", low))
    return {f: math.log(1 + 100 * n / (len(found) + 50)) for f, n in names.items()}


def naive_hash(kind, name):
    raw = name if isinstance(name, bytes) else name.encode()
    h = bt.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
    return int((bt.mix(h) if kind == "p" else h)[0])


def test_prediction_against_the_definition(make_docs, spark):
    model = toxicity.fit(*graded(make_docs, spark))
    texts = ["A nasty, vilest!! wabx wabx", "", "vilestness ## é naïve x9y --", None, "nasty"] + [" ".join(["wabx", "wcdx", "nasty"][: i % 3 + 1] * i) for i in range(12)]
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    rows = {r["doc_id"]: r for r in toxicity.predict(make_docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        score = sum(weights.get(naive_hash(*f), 0.0) * v for f, v in naive_features(t).items())
        over = [1 / (1 + math.exp(-(score - b))) for b in model.thresholds]
        assert rows[i]["severity"] == pytest.approx(sum(over)) and rows[i]["p_toxic"] == pytest.approx(over[0])


def naive_likelihood(w, b, features, grade, ridge):
    total = -ridge / 2 * sum(x * x for x in w)
    for f, g in zip(features, grade, strict=True):
        score = sum(w[k] * v for k, v in f.items())
        over = [1.0, *(1 / (1 + math.exp(-(score - x))) for x in b), 0.0]
        total += math.log(over[g] - over[g + 1])
    return total


def test_fit_is_at_the_top_of_the_likelihood():
    rng = np.random.default_rng(3)
    features = [{int(k): float(v) for k, v in zip(rng.choice(4, 2, replace=False), rng.random(2), strict=True)} for _ in range(400)]
    true = [-1.0, 0.0, 1.5, 3.0]
    latent = [sum(true[k] * v for k, v in f.items()) + rng.logistic() for f in features]
    grade = np.array([int(x > 0.5) + int(x > 2.0) for x in latent])
    row = np.repeat(np.arange(400), 2)
    column, value = (np.array([x for f in features for x in part(f)]) for part in (dict.keys, dict.values))
    w, b = toxicity.fit_ordinal(row, column, value, grade, 4, 2, rounds=3000)
    best = toxicity.penalised_likelihood(w, b, row, column, value, grade, 0.02)
    assert best == pytest.approx(naive_likelihood(w, b, features, grade.tolist(), 0.02))
    for step in (0.05, -0.05):
        for k in range(4):
            assert naive_likelihood(w + step * np.eye(4)[k], b, features, grade.tolist(), 0.02) <= best + 1e-4
        for k in range(2):
            assert naive_likelihood(w, b + step * np.eye(2)[k], features, grade.tolist(), 0.02) <= best + 1e-4


def test_the_greatest_grade_counts(make_docs, spark):
    docs = make_docs([(i, f"text {i}" if i % 2 else f"text {i} bad") for i in range(40)])
    labels = [(i, g) for i in range(40) for g in ((0, 1) if i % 2 == 0 else (0,))]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, grade int"), least_chi=3.0) for x in (labels, labels[::-1])]
    assert (models[0].weights == models[1].weights).all() and toxicity.severity(pa.array(["bad"]), models[0])[1][0] > 0.5


def test_no_labels(make_docs, odd_docs, spark):
    none = (odd_docs, spark.createDataFrame([], "doc_id long, grade int"))
    got = toxicity.predict(odd_docs, toxicity.fit(*none)).collect()
    assert len(got) == odd_docs.count() and not any(r["toxic"] for r in got)
    assert toxicity.predict(make_docs([]), toxicity.fit(*none)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (4, 1, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in toxicity.grades(labels).collect()} == {1: 0, 2: 2, 3: 1, 4: None, 5: 1}


def test_query_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in queries.op6_toxicity(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    bad = [r["toxic"] for r in held if labels[r["doc_id"]]]
    clean = [r["toxic"] for r in held if not labels[r["doc_id"]]]
    assert sum(bad) >= 0.9 * len(bad)
    assert sum(clean) <= 0.03 * len(clean)


def test_held_out_severity_by_grade(spark):
    """Grade 2 holds documents whose insults the junk around them has overwritten, so not all can be told."""
    sf_dir = "/root/testdata/sf0.1"
    grades = {r["doc_id"]: r["grade"] for r in toxicity.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    held = [(grades[r["doc_id"]], r["severity"]) for r in queries.op6_toxicity(spark, sf_dir).collect() if r["held_out"] and grades.get(r["doc_id"]) is not None]
    mean = [np.mean([s for g, s in held if g == k]) for k in range(3)]
    assert mean[0] < 0.05 and 0.8 < mean[1] < 1.3
    assert np.mean([s > 1.5 for g, s in held if g == 2]) > 0.3 > 0.1 > np.mean([s > 1.5 for g, s in held if g == 1])
