"""Language of texts by nearest centroid of normalised TF-IDF n-gram vectors.

A text's terms are its byte n-grams of 1 to 4 bytes within lower-cased letter runs (each run with a space on either
side), hashed into ``dims`` places. Counts are damped (log(1 + n)), weighted by inverse document frequency and normalised.
Each language has several centroids, fitted by spherical k-means on its sample; a text goes to the language of the
centroid of greatest cosine. A text is rejected if it has no letter, or if its distance (1 - cosine) to every centroid is
over the limit for its nearest language and its number of distinct terms. Any text comes nearer to every centroid as its terms
grow in number, so random letters at length score above short texts of a language; among texts of as many terms they stand apart.

The model is fitted on a bounded sample: at most ``per_language`` labelled documents of a language, those of least hash, and of all
languages together at most ``most_rows`` or one of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, frugal, text_slices

UNKNOWN = "und"
_RUN = np.zeros(256, bool)
_RUN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * several, dims)
    owner: np.ndarray  # index of the language of each centroid
    limits: np.ndarray  # (languages, classes of distinct terms): a text whose best cosine is below its own is rejected

    @property
    def dims(self) -> int:
        return len(self.idf)


def term_counts(buf: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Damped n-gram counts (rows x dims, float32) of lower-cased texts; ``dims`` is a power of two."""
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, dims), np.float32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for i in range(n_rows):
        text = buf[offsets[i] : offsets[i + 1]]
        counts = np.zeros(dims, np.int64)
        for at in range(0, len(text), 1 << 20):
            x = text[max(0, at - 3) : at + (1 << 20)]
            run = _RUN[x]
            keep = run.copy()  # a space before and after each run, longer gaps in one
            keep[1:] |= run[:-1]
            y = np.where(run, x, 0x20)[keep]
            if not len(y):
                continue
            y = np.concatenate([[0x20], y]).astype(np.uint32)
            h = np.zeros(len(y), np.uint32)
            for k in range(4):
                m = len(y) - k
                if m <= 0:
                    break
                h = h[:m] + (y[k:] + np.uint32(1)) * _ODD[k]
                z = h ^ (h >> np.uint32(15)) if k else h[y != 0x20]  # a lone space says nothing
                z = z * np.uint32(0x2C1B3C6D + 2 * k)
                counts += np.bincount((z >> shift).astype(np.int64), minlength=dims)
        out[i] = np.log1p(counts)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    low = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    batch = pa.record_batch([low], ["text"])
    for _, buf, offsets in text_slices(batch, "text", 1 << 62):
        return buf, offsets
    return np.zeros(0, np.uint8), np.zeros(1, np.int64)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.choice(len(x), 1)]
    while len(centers) < k:  # the next one is far from those there are
        far = 1 - (x @ centers.T).max(axis=1)
        far = np.maximum(far, 0) ** 2
        if far.sum() <= 0:
            break
        centers = np.vstack([centers, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (near == c).any():
                mean = x[near == c].mean(axis=0)
                centers[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers


def _term_class(counts: np.ndarray) -> np.ndarray:
    """Class of each row by its number of distinct terms: two to an octave."""
    return np.floor(2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(np.int64)


def _limits(v: np.ndarray, y: np.ndarray, classes: np.ndarray, n_classes: int, centroids: int, spread: float, floor: float, least: int, seed: int) -> np.ndarray:
    """The limit of each language and class: mean less ``spread`` standard deviations of the cosines of its sample texts to centroids
    that were fitted without them (four folds). A class of under ``least`` texts borrows from the nearest ones; a language of
    under ``least`` has ``floor``."""
    rng, fold, cosine = np.random.default_rng(seed), np.arange(len(v)) % 4, np.zeros(len(v))
    n_languages = int(y.max()) + 1
    out = np.full((n_languages, n_classes), floor)
    if not any((y == k).sum() >= least for k in range(n_languages)):
        return out
    for f in range(4):
        parts = [v[(fold != f) & (y == k)] for k in range(n_languages)]
        table = np.vstack([_spherical_kmeans(p, centroids, 10, rng) for p in parts if len(p)])
        cosine[fold == f] = (v[fold == f] @ table.T).max(axis=1)
    for k in range(n_languages):
        own, at = cosine[y == k], classes[y == k]
        if len(own) < least:
            continue
        for c in range(n_classes):
            far = np.abs(at - c)
            some = own[far <= np.sort(far)[least - 1]]
            out[k, c] = some.mean() - spread * some.std()
    return out


def has_letter(text: str = "text") -> Column:
    """Whether a text holds a letter (Unicode's L classes: neither digits, nor fractions, nor numerals)."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, per_language: int = 400, centroids: int = 4, dims: int = 4096, margin: float = 0.4, most_rows: int = 100_000, seed: int = 1, spread: float = 4.0, least: int = 50) -> Model:
    """Fits on ``labelled(doc_id, text, lang)``: whole texts of rows with a letter and a non-null lang, the ``per_language`` of least hash
    of each language; where there are so many languages that this is over ``most_rows``, equally fewer of each, but one at least (the bound of what
    the driver gathers: one vector each). Every language that a labelled text has is learned. Rows equal in doc_id, text and lang count
    once. The limits of rejection lie ``spread`` standard deviations under the mean cosine of sample texts of that language and number of
    terms; a language with under ``least`` of them has ``margin`` times the cosine to its nearest centroid that a thousandth of the
    sample falls below. Without rows the model knows no language. No text is shuffled but the sample's."""
    scratch = Scratch(labelled.sparkSession, "language")
    named = labelled.filter(F.col("lang").isNotNull() & has_letter()).withColumn("_h", F.xxhash64("doc_id", "text", F.lit(seed)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_h"))
    ranked = scratch.table("ranked", named.select("lang", "_h").withColumn("_r", rank).filter(F.col("_r") <= per_language))
    n_languages = ranked.agg(F.count_distinct("lang").alias("n")).first()["n"]
    per = max(1, min(per_language, most_rows // max(n_languages, 1)))
    wanted = ranked.filter(F.col("_r") <= per).select(F.col("lang").alias("_l"), F.col("_h").alias("_k")).distinct()
    near = named.select("lang", "_h", "text").join(F.broadcast(wanted), (F.col("lang") == F.col("_l")) & (F.col("_h") == F.col("_k")))
    sample = near.groupBy("lang", "_h").agg(F.first("text").alias("text")).select("lang", "text")

    def vectors(batches):
        for batch in batches:
            if batch.num_rows:
                found = term_counts(*_lower(batch.column(1)), dims)
                yield pa.record_batch([batch.column(0), pa.array([row.tobytes() for row in found], pa.binary())], ["lang", "counts"])

    rows = sorted((r["lang"], bytes(r["counts"])) for r in sample.mapInArrow(frugal(vectors), "lang string, counts binary").collect())
    scratch.close()
    if not rows:
        return Model([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0, np.int64), np.zeros((0, 1)))
    languages = sorted({lang for lang, _ in rows})
    y = np.array([languages.index(lang) for lang, _ in rows])
    x = np.stack([np.frombuffer(c, np.float32) for _, c in rows])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    v, rng = _vectors(x, idf), np.random.default_rng(seed)
    centers = [_spherical_kmeans(v[y == k], centroids, 10, rng) for k in range(len(languages))]
    table = np.vstack(centers).astype(np.float32)
    floor = margin * float(np.quantile((v @ table.T).max(axis=1), 0.001))
    limits = _limits(v, y, _term_class(x), 2 * dims.bit_length(), centroids, spread, floor, least, seed)
    return Model(languages, idf, table, np.repeat(np.arange(len(centers)), [len(c) for c in centers]), limits)


def classify(texts: pa.Array, letters: np.ndarray, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (the greatest cosine, 0 to 1) and rejection of each text; ``letters`` is ``has_letter`` of each."""
    n = len(texts)
    best, score, limit = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    if model.languages:
        buf, offsets = _lower(texts)
        for at in range(0, n, 256):
            to = min(at + 256, n)
            cut = offsets[at : to + 1]
            counts = term_counts(buf[cut[0] : cut[-1]], cut - cut[0], model.dims)
            cosine = _vectors(counts, model.idf) @ model.centroids.T
            top = cosine.argmax(axis=1)
            best[at:to], score[at:to] = model.owner[top], cosine[np.arange(to - at), top]
            limit[at:to] = model.limits[best[at:to], _term_class(counts)]
    known = letters & bool(model.languages)
    score = np.where(known, np.clip(score, 0, 1), 0.0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score, ~known | (score < limit)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added.

    lang_pred is a learned language, ``und`` for a null text or one without a letter (those are rejected with score 0).
    Only the text is looked at. Rows are judged alone: repeats, ties of doc_id and extra columns of any name change nothing, and of equal
    cosines the language first by name wins. Texts of any length are read whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit
    names = docs.columns
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at = names.index("text")

    def judge(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, f"c{at}"):
                lang, score, rejected = classify(rows.column(at), rows.column(len(names)).to_numpy(zero_copy_only=False), shared.value)
                yield pa.record_batch([*rows.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*rows.schema.names[:-1], "lang_pred", "score", "rejected"])

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("letters", has_letter(f"c{at}"))
    return plain.mapInArrow(frugal(judge), f"{schema}, lang_pred string, score double, rejected boolean").toDF(*names, "lang_pred", "score", "rejected")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the ids, by crc32 of the id as text; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
