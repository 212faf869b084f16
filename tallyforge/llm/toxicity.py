"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document has a feature for every lower-cased word (letters only), for the first 4 to 10 bytes of its longer words, so inflected and
compounded forms share weights, and for every run of ASCII symbols. A feature's value grows with its share of the text:
log(1 + 100 * occurrences / (words + 50)); one insult in twenty thousand words weighs next to nothing, a text full of them much.
The features kept are those of greatest chi-square between the documents above and below some grade, whichever way they point.
One weight vector serves all thresholds: P(grade > k) = sigmoid(w . x - b_k), b ascending; the output is the expected grade,
the sum of P(grade > k) over the thresholds.

Fitted on a bounded sample, at most about ``most_documents`` labelled documents, those of least hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, run_bounds, text_slices
from .language_id import _lower

_WORD = np.zeros(256, bool)
_WORD[[*range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
PREFIXES = range(4, 11)


@dataclass
class Model:
    features: np.ndarray  # ascending 64-bit hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade above 0


def features_of(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash, value), a feature once a row, ordered by row and hash; only features in the ascending array ``known`` if given."""
    buf, offsets = _lower(texts)
    letters = np.where(_WORD[buf], buf, 0x20).astype(np.uint8)
    starts, ends, first = bt.word_spans(letters, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(offsets) - 1), n_words)
    rows, hashes = [row], [bt.span_hashes(letters, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        hashes.append(bt.mix(bt.span_hashes(letters, starts[long], starts[long] + n)))
    symbols = np.where(_SYMBOL[buf], buf, 0x20).astype(np.uint8)
    starts, ends, first = bt.word_spans(symbols, offsets)
    rows.append(np.repeat(np.arange(len(offsets) - 1), np.diff(first)))
    hashes.append(bt.span_hashes(symbols, starts, ends))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    if known is not None:
        keep = np.isin(h, known)
        row, h = row[keep], h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    bounds = run_bounds(row, h)
    at = bounds[:-1]
    return row[at], h[at], np.log1p(100 * np.diff(bounds) / (n_words[row[at]] + 50))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def penalised_likelihood(w: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, ridge: float) -> float:
    """The sum over rows of log P(grade), where P(grade = k) = P(grade > k - 1) - P(grade > k), less half of ``ridge`` times w . w."""
    score = np.bincount(row, weights=w[column] * value, minlength=len(grade))
    over = np.concatenate([np.ones((len(grade), 1)), _sigmoid(score[:, None] - b[None, :]), np.zeros((len(grade), 1))], axis=1)
    at = np.arange(len(grade))
    return float(np.log(np.maximum(over[at, grade] - over[at, grade + 1], 1e-9)).sum() - ridge / 2 * (w @ w))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, n_thresholds: int, ridge: float = 0.02, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of greatest ``penalised_likelihood``, by gradient steps with momentum over all rows.

    Thresholds are a first value plus exponentials of the gaps, so they stay in order."""
    n = len(grade)
    w = np.zeros(n_features)
    share = [np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(n_thresholds)]
    b = np.maximum.accumulate(np.array([np.log((1 - s) / s) for s in share]) + np.arange(n_thresholds) * 1e-3)
    first, gaps = b[0], np.log(np.maximum(np.diff(b), 1e-3))
    mean = [np.zeros(n_features), 0.0, np.zeros(len(gaps))]
    square = [np.zeros(n_features), 0.0, np.zeros(len(gaps))]
    at = np.arange(n)
    for step in range(1, rounds + 1):
        b = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights=w[column] * value, minlength=n)
        over = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - b[None, :]), np.zeros((n, 1))], axis=1)  # P(grade >= k)
        slope = over * (1 - over)
        chance = np.maximum(over[at, grade] - over[at, grade + 1], 1e-9)
        d_score = (slope[at, grade] - slope[at, grade + 1]) / chance
        d_b = np.zeros(n_thresholds)
        for k in range(n_thresholds):
            d_b[k] = -(slope[grade == k + 1, k + 1] / chance[grade == k + 1]).sum() + (slope[grade == k, k + 1] / chance[grade == k]).sum()
        g = [np.bincount(column, weights=d_score[row] * value, minlength=n_features) - ridge * w, d_b.sum(), np.cumsum(d_b[:0:-1])[::-1] * np.exp(gaps)]
        for j in range(3):
            mean[j] = 0.9 * mean[j] + 0.1 * g[j]
            square[j] = 0.999 * square[j] + 0.001 * g[j] ** 2
        move = [0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) for m, s in zip(mean, square, strict=True)]
        w, first, gaps = w + move[0], first + move[1], gaps + move[2]
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, graded: DataFrame, most_documents: int = 12_000, most_features: int = 2000, least_documents: int = 5, least_chi: float = 50.0, seed: int = 1) -> Model:
    """Fits on the whole texts of ``docs(doc_id, text)`` that ``graded(doc_id, grade)`` names with a grade of 0 or more (a few grades).

    Of more than ``most_documents`` grades a sample by hash is taken; that table is broadcast, so texts are not shuffled to be found. A
    doc_id, or a text, of several grades has the greatest of them; a text counts once however often it occurs. Rows without a doc_id or text
    take no part. Without rows, or with one grade only, all documents get severity 0."""
    known = graded.filter("grade is not null and grade >= 0 and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    some = known.filter(part <= min(1.0, most_documents / max(known.count(), 1)))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.table("sample", rows.groupBy("text").agg(F.max("grade").alias("grade")).select("grade", "text"))
    n_by_grade = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    levels, total = sorted(n_by_grade), sum(n_by_grade.values())
    if len(levels) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))

    def count(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text", 8 << 20):
                row, h, _ = features_of(rows.column(1))
                grade = rows.column(0).to_numpy()[row]
                order = np.lexsort((h, grade))
                bounds = run_bounds(grade[order], h[order])
                at = order[bounds[:-1]]
                yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(grade[at]), pa.array(np.diff(bounds))], ["feature", "grade", "n"])

    counted = sample.mapInArrow(count, "feature long, grade int, n long").groupBy("feature")
    counted = counted.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("grade") > g, F.col("n")).otherwise(0)).alias(f"above{k}") for k, g in enumerate(levels[:-1])])
    chi = []
    for k, g in enumerate(levels[:-1]):
        share = sum(n for x, n in n_by_grade.items() if x > g) / total
        chi.append(F.pow(F.col(f"above{k}") - F.col("n") * share, 2) / (F.col("n") * (share * (1 - share))) / (1 - F.col("n") / total + 1e-9))
    most = F.greatest(*chi) if len(chi) > 1 else chi[0]
    chosen = counted.filter(F.col("n") >= least_documents).withColumn("chi", most).filter(F.col("chi") > least_chi).orderBy(F.desc("chi"), "feature").limit(most_features)
    features = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64).view(np.uint64))

    def sparse(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text"):
                row, h, value = features_of(rows.column(1), features)
                at = np.searchsorted(row, np.arange(rows.num_rows + 1)).tolist()
                column, value = np.searchsorted(features, h).astype("<i4"), value.astype("<f8")
                parts = [(column[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([rows.column(0), *[pa.array([p[j] for p in parts], pa.binary()) for j in range(2)]], ["grade", "columns", "values"])

    gathered = sorted(sample.mapInArrow(sparse, "grade int, columns binary, values binary").collect())  # bounded by most_documents and most_features
    scratch.close()
    columns, values = [np.frombuffer(r["columns"], "<i4") for r in gathered], [np.frombuffer(r["values"], "<f8") for r in gathered]
    level = np.searchsorted(levels, [r["grade"] for r in gathered])
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate(columns), np.concatenate(values), level, len(features), len(levels) - 1)
    return Model(features, weights, thresholds)


def severity(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and the probability of a grade over 0, of each text."""
    if not len(model.thresholds):
        return np.zeros(len(texts)), np.zeros(len(texts))
    row, h, value = features_of(texts, model.features)
    score = np.bincount(row, weights=model.weights[np.searchsorted(model.features, h)] * value, minlength=len(texts))
    over = _sigmoid(score[:, None] - model.thresholds[None, :])
    return over.sum(axis=1), over[:, 0]


def predict(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic (of a grade over 0) and toxic (p_toxic >= ``least``) added.

    Whole texts count; a null or empty text has no features and so the severity that the thresholds alone give. Rows are judged
    alone; repeats and extra columns change nothing. A severity needs no words known to the model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_features
    names = docs.columns
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at = names.index("text")

    def judge(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, f"c{at}"):
                grade, chance = severity(rows.column(at), shared.value)
                yield pa.record_batch([*rows.columns, pa.array(grade), pa.array(chance), pa.array(chance >= least)], [*rows.schema.names, "severity", "p_toxic", "toxic"])

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(judge, f"{schema}, severity double, p_toxic double, toxic boolean").toDF(*names, "severity", "p_toxic", "toxic")


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of ``labels(doc_id, quality, toxic)``: 0 not toxic, 1 toxic, 2 toxic and of low quality, which
    no use redeems; null where toxic is null. An order of harm is the most that two yes-or-no labels give."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
