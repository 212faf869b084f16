"""Near-duplicate vectors by spherical-cap filters from a structured random product code.

For each of a few tables a random rotation splits a unit vector in two halves, each scored against a random code of
directions; a table's filters are all pairs of code words. Every vector has a cap of its own around it, as wide as is needed for
``filters`` directions of a table to exceed its threshold; list decoding finds those from the best words of either half, never
scoring all pairs. Vectors meet in the filters they share, at first as a byte a component with the length of the rounding error: that
bounds every cosine, and only members that may have a partner come back whole. Pairs are verified then in double precision, and
a pair is counted in the least filter that it shares.

Codes grow with the number of vectors, so that a filter holds about ``bucket`` of them at any size. Longer codes part near vectors
more often; as many tables are made as pairs at the least cosine itself need, by a simulation with the very code, to meet with a chance
of 1 - ``missed``. Buckets emit a row per member, never pairs; those over ``block`` members are split into blocks that meet
pairwise in tasks of their own.
"""

from __future__ import annotations

import hashlib
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_with_hot_keys, key_groups, run_bounds, vectors_of
from .components import connected_components


def code_size(n: int, filters: int, bucket: int) -> int:
    """Words of each of a table's two codes for n vectors."""
    return max(filters, ceil(sqrt(n * filters / bucket)))


def meeting_rate(dim: int, size: int, filters: int, cosine: float, seed: int, pairs: int = 2000) -> float:
    """The share of random pairs at ``cosine`` itself that share a filter of one table."""
    rng, code, met = np.random.default_rng([seed, 1]), make_code(max(dim, 16), size, seed), 0
    for at in range(0, pairs, 100):
        a, b = (rng.standard_normal((min(100, pairs - at), dim)) for _ in range(2))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        x, y = list_decode(a, *code, filters), list_decode(cosine * a + sqrt(max(0.0, 1 - cosine**2)) * b, *code, filters)
        met += int((x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).sum())
    return met / pairs


def tables_needed(rate: float, missed: float) -> int:
    """Tables that all miss a pair with a chance of at most ``missed``."""
    return max(1, ceil(log(missed) / log(min(max(1 - rate, 1e-9), 1 - 1e-9))))


def make_code(dim: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation of the space and two codes of unit directions, one for each part of it."""
    rng = np.random.default_rng([seed, dim, size])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    codes = []
    for part in (dim // 2, dim - dim // 2):
        words = rng.standard_normal((size, part))
        codes.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return rotation, codes


def list_decode(unit: np.ndarray, rotation: np.ndarray, codes: list[np.ndarray], filters: int) -> np.ndarray:
    """The ``filters`` directions that each unit vector is nearest to (rows x filters): all over its own cap's threshold.
    The best sums of two lists come from the best of each, so only those are paired."""
    dim, size = len(rotation), len(codes[0])
    x = unit @ rotation[: unit.shape[1]]  # short vectors are filled up with zeros
    a, b = x[:, : dim // 2] @ codes[0].T, x[:, dim // 2 :] @ codes[1].T
    best_a, best_b = (np.argpartition(-s, filters - 1, axis=1)[:, :filters] for s in (a, b))
    sums = (np.take_along_axis(a, best_a, 1)[:, :, None] + np.take_along_axis(b, best_b, 1)[:, None, :]).reshape(len(x), -1)
    top = np.argpartition(-sums, filters - 1, axis=1)[:, :filters]
    return np.take_along_axis(best_a, top // filters, 1) * size + np.take_along_axis(best_b, top % filters, 1)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte for each component, the scale of each vector, and the length of what rounding leaves out (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    short = np.rint(unit / scale[:, None]).astype(np.int8)
    return short, scale, np.linalg.norm(unit - short * scale[:, None], axis=1) + 1e-9


def _clean(batches):
    for batch in batches:
        n = batch.num_rows
        keys, dims, raws = [None] * n, np.zeros(n, np.int32), [None] * n
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for rows, x in vectors_of(batch.column(1)):
            scale = np.abs(x).max(axis=1)
            good = (scale > 0) & named[rows]
            rows, x, scale = rows[good], x[good], scale[good][:, None]
            unit = x / np.linalg.norm(x / scale, axis=1, keepdims=True) / scale
            dims[rows] = x.shape[1]
            for i, u in zip(rows.tolist(), unit.astype("<f8"), strict=True):
                raws[i] = u.tobytes()
                keys[i] = hashlib.md5(raws[i]).hexdigest()
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.string()), pa.array(dims), pa.array(raws, pa.binary())], ["vec_id", "key", "dim", "unit"])


def near_vectors(vectors: DataFrame, cosine: float = 0.9, bucket: int = 24, missed: float = 1e-3, filters: int = 10, block: int = 2048, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do those without a
    vec_id (kept, null component). Only vectors of one length are compared. Each row counts as a vector, also where ids repeat.
    Vectors of equal direction are one node. Other columns (labels too) are not read. An empty table stays empty. A link at the least
    cosine itself is missed with a chance of about ``missed``, a nearer one less often; no link is made below it.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    rows = scratch.table("rows", vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_clean, "vec_id long, key string, dim int, unit binary"))
    nodes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    nodes = scratch.table("nodes", nodes)
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length
    words = {d: code_size(n, filters, bucket) for d, n in sizes.items()}
    tables = {d: tables_needed(meeting_rate(d, words[d], filters, cosine, seed), missed) if n > 1 else 1 for d, n in sizes.items()}

    def decode(batches):
        made = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in made:
                    made[d] = [make_code(max(d, 16), words[d], seed + k) for k in range(tables[d])]
                part = batch.filter(pa.array(dims == d))
                step = max(16, min(512, (1 << 22) // words[d]))
                for at in range(0, part.num_rows, step):
                    piece = part.slice(at, step)
                    unit = np.frombuffer(b"".join(piece.column(3).to_pylist()), "<f8").reshape(-1, d)
                    found = np.concatenate([list_decode(unit, *code, filters) + k * words[d] ** 2 for k, code in enumerate(made[d])], axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                    short, scale, error = quantise(unit)
                    yield pa.record_batch([*piece.columns, lists, pa.array([r.tobytes() for r in short], pa.binary()), pa.array(scale), pa.array(error)], [*piece.schema.names, "filters", "short", "scale", "error"])

    decoded = nodes.select("rep", "copies", "dim", "unit").mapInArrow(decode, "rep long, copies long, dim int, unit binary, filters array<bigint>, short binary, scale double, error double")
    decoded = scratch.table("decoded", decoded)
    # first only bytes a component meet; those whose bytes rule out every partner in a filter go no further there
    members = decoded.select("rep", "dim", "short", "scale", "error", F.explode("filters").alias("filter"))
    counts = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count("*").alias("size")).filter("size > 1")
    members = members.join(counts, ["dim", "filter"])
    chunks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    members = members.select("dim", "filter", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "short", "scale", "error")
    place = ["dim", "filter", "low", "high"]

    def may_meet(batches):
        for table in key_groups(batches, place):
            dim, name, low, high, own, rep = (table.column(k).to_numpy() for k in range(6))
            scale, error = (table.column(k).to_numpy() for k in (7, 8))
            bounds = run_bounds(dim, name, low, high)
            shorts, keep = table.column(6).combine_chunks(), []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                x = np.frombuffer(b"".join(shorts.slice(s, e - s).to_pylist()), np.int8).reshape(e - s, dim[s]).astype(np.float32) * scale[s:e, None].astype(np.float32)
                most = error[s:e]
                near = x @ x.T + most[:, None] + most[None, :] + most[:, None] * most[None, :] >= cosine - 1e-4
                np.fill_diagonal(near, False)
                if low[s] != high[s]:
                    near &= own[s:e, None] != own[None, s:e]
                keep.append(s + np.flatnonzero(near.any(axis=1)))
            if keep and len(at := np.concatenate(keep)):
                yield pa.record_batch([pa.array(c[at]) for c in (dim, name, low, high, own, rep)], [*place, "own", "rep"])

    dealt = members.repartition(*place).sortWithinPartitions(*place)
    some = scratch.table("some", dealt.mapInArrow(may_meet, "dim int, filter long, low int, high int, own int, rep long"))
    members = some.join(decoded.select("rep", "copies", "unit", "filters").hint("merge"), "rep").select(*place, "own", "rep", "copies", "unit", "filters")

    def meet(batches):
        for table in key_groups(batches, place):
            dim, name, low, high, own, rep, copies = (table.column(k).to_numpy() for k in range(7))
            bounds = run_bounds(dim, name, low, high)
            units, lists = table.column(7).combine_chunks(), table.column(8).combine_chunks()
            out: list[list[np.ndarray]] = [[], [], []]
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                x = np.frombuffer(b"".join(units.slice(s, e - s).to_pylist()), "<f8").reshape(e - s, dim[s])
                link = (x @ x.T) >= cosine
                np.fill_diagonal(link, False)
                if low[s] != high[s]:
                    link &= own[s:e, None] != own[None, s:e]
                if not link.any():
                    continue
                some = np.flatnonzero(link.any(axis=1))
                link = link[np.ix_(some, some)]
                least = np.arange(len(some))
                while True:
                    lower = np.minimum(least, np.where(link, least[None, :], len(some)).min(axis=1))
                    if (lower == least).all():
                        break
                    least = lower
                part = lists.slice(s, e - s).take(pa.array(some))
                flat = part.flatten().to_numpy()
                owner = np.repeat(np.arange(len(some)), part.value_lengths().to_numpy())
                before = flat < name[s]
                named, column = np.unique(flat[before], return_inverse=True)
                held = np.zeros((len(some), len(named)), np.float32)
                held[owner[before], column] = 1
                new = link & ((held @ held.T) < 0.5)
                ids = rep[s:e][some]
                out[0].append(ids)
                out[1].append(new @ copies[s:e][some])
                out[2].append(ids[least])
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["rep", "links", "root"])

    dealt = members.repartition(*place).sortWithinPartitions(*place)
    met = scratch.table("met", dealt.mapInArrow(meet, "rep long, links long, root long").groupBy("rep", "root").agg(F.sum("links").alias("links")))
    groups = connected_components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = nodes.select("key", "rep", "copies").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "copies")
    found = scratch.table("found", found.filter("n_links > 0"))
    out = join_with_hot_keys(rows.select("vec_id", "key"), found, "key", "copies", "vec_id")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    scratch.drop("decoded", "some")
    return out
