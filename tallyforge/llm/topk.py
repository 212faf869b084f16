"""Exact top-k by inner product over integer vectors, with block-at-a-time pruning.

The index keeps vectors in blocks of near ones: a block row holds the ids, the block's forward index (its vectors as one
matrix) and the greatest and least value of every term (dimension). For a query, a block's bound is the sum over the terms of
weight times that extreme; blocks are taken in falling order of bounds, and a query stops when the next bound is below
its k-th score. Equal bounds are still scored, as a smaller id may win a tie.

Blocks stand in leaves: ranges of vectors that a tree of median cuts, fitted on a bounded sample, tells apart; a leaf of many
vectors has several shards, by hash. Each query is first searched in the leaf it would itself stand in, which gives a k-th score that its
answer cannot be below. It is then sent only to the other leaves whose own summed extremes reach that score. Queries meet a shard in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, vectors_of

NONE = -(1 << 62)


def quantised(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, dim, v) with v = floor(factor * x) of every component in double precision, as little-endian int64 bytes; rows without an
    id, null vectors, empty ones, and vectors with a null or non-finite component are left out.

    Scores are 64-bit integers: a vector whose product with itself would pass 2^62 is an error that names it, as no score of it
    could be told from a wrong one."""

    def floor(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows, x in vectors_of(batch.column(1)):
                keep = ids.take(pa.array(rows)).is_valid().to_numpy(zero_copy_only=False)
                rows = rows[keep]
                with np.errstate(over="ignore"):
                    x = np.floor(factor * x[keep])
                    large = np.flatnonzero(~((x * x).sum(axis=1) < 2.0**62))
                if len(large):
                    raise ValueError(f"vec_id {ids[int(rows[large[0]])].as_py()}: components times {factor} are too large for 64-bit scores")
                raw = x.astype("<i8")
                yield pa.record_batch([ids.take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(floor, "vec_id long, dim int, v binary")


def _matrix(raws, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<i8").reshape(-1, dim)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in 64-bit integers; through double precision where no partial sum can leave its exact range. Vectors as of
    ``quantised`` have products under 2^62, but bounds may pass it: those stay at the edge, which keeps their order against scores."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return x @ y.T
    wide = x.astype(object) @ y.astype(object).T
    return np.clip(wide, -(1 << 62), 1 << 62).astype(np.int64)


def fit_tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of a complete tree of median cuts with ``leaves`` (a power of two) ends, in the order of a heap. Each cut is
    along the line from the mean of its part of the sample to the farthest vector there."""
    dim = sample.shape[1]
    ways, cuts = np.zeros((leaves - 1, dim)), np.zeros(leaves - 1)
    parts = {0: np.arange(len(sample))}
    for node in range(leaves - 1):
        part = parts.pop(node)
        if len(part):
            x = sample[part].astype(np.float64)
            x = x - x.mean(axis=0)
            ways[node] = x[np.argmax(np.abs(x).sum(axis=1))]
            ways[node] /= max(np.linalg.norm(ways[node]), 1e-300)
            along = sample[part].astype(np.float64) @ ways[node]
            cuts[node] = np.median(along)
            right = along > cuts[node]
        else:
            right = np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return ways, cuts


def leaf_of(v: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each vector."""
    ways, cuts = tree
    node, x = np.zeros(len(v), np.int64), v.astype(np.float64)
    while len(cuts) and node[0] < len(cuts):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, ways[node]) > cuts[node])
    return node - len(cuts)


def build_blocks(ids: np.ndarray, v: np.ndarray, block: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, forward index, greatest, least) of blocks of near vectors: a tree of median cuts along the widest term."""
    todo, out = [np.arange(len(ids))], []
    while todo:
        part = todo.pop()
        if len(part) <= block:
            out.append((ids[part], v[part], v[part].max(axis=0), v[part].min(axis=0)))
            continue
        x = v[part].astype(np.float64)
        centre = x[np.argmax(np.abs(x - x.mean(axis=0)).sum(axis=1))]  # towards the farthest one, and away from it
        order = np.argsort(x @ (centre - x.mean(axis=0)), kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


def search_blocks(blocks: list, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best k (scores, ids) of each query among the blocks, without the row of its own id; what cannot reach ``floor`` may lack."""
    n = len(query_ids)
    if not blocks or not n:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    high, low = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    bound = _exact(np.maximum(q, 0), high) + _exact(np.minimum(q, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    scores, ids = np.full((n, k), NONE, np.int64), np.full((n, k), 1 << 62, np.int64)
    active = np.arange(n)
    for step in range(len(blocks)):
        at = order[active, step]
        go = bound[active, at] >= np.maximum(scores[active, k - 1], floor[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], at[by][1:] != at[by][:-1], [True]]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = active[by[s:e]]
            names, forward = blocks[at[by[s]]][:2]
            found = _exact(q[rows], forward)
            found[query_ids[rows][:, None] == names[None, :]] = NONE
            both = np.concatenate([scores[rows], found], axis=1)
            owner = np.concatenate([ids[rows], np.broadcast_to(names, found.shape)], axis=1)
            best = np.lexsort((owner, -both), axis=1)[:, :k] if both.shape[1] <= 4 * k else _top(both, owner, k)
            scores[rows], ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(owner, best, 1)
    return [(s[s > NONE], i[s > NONE]) for s, i in zip(scores, ids, strict=True)]


def _top(both: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's best k by (score falling, id rising)."""
    out = np.zeros((len(both), k), np.int64)
    edge = -np.partition(-both, k - 1, axis=1)[:, k - 1]
    for r in range(len(both)):
        some = np.flatnonzero(both[r] >= edge[r])
        out[r] = some[np.lexsort((owner[r, some], -both[r, some]))[:k]]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = 64, shard_rows: int = 8192, chunk_rows: int = 8192, most_leaves: int = 1024, most_sample: int = 32_768, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the best k candidates of each query; inputs as of ``quantised``.

    Ties go to the smaller vec_id. Candidates of the query's own id, or of another length, are not its candidates. Of queries
    that share an id, the one of least (length, bytes) is asked; candidates that share an id count each. With fewer than k
    candidates there are fewer ranks; an empty side gives no rows. The tree is fitted on about ``most_sample`` vectors of
    a length, those of least hash, and has at most ``most_leaves`` leaves (the bounds of what is gathered and broadcast); all vectors are
    indexed. Inputs should be written tables.
    """
    spark = candidates.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    queries = scratch.table("queries", queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v"))
    dims = {r["dim"]: r["n"] for r in candidates.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length
    part = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(9)), 11) / F.lit(float(1 << 53))
    trees = {}
    for dim, n in dims.items():
        leaves = 1
        while leaves < most_leaves and leaves * shard_rows < n:
            leaves *= 2
        some = candidates.filter((F.col("dim") == dim) & (part < most_sample / n)).select("v").collect() if leaves > 1 else []
        sample = _matrix(sorted(bytes(r["v"]) for r in some), dim)
        trees[dim] = fit_tree(sample, leaves) if leaves > 1 else (np.zeros((0, dim)), np.zeros(0))
    shared = spark.sparkContext.broadcast(trees)

    def place(batches):
        for batch in batches:
            own = batch.column(1).to_numpy()
            leaf = np.zeros(len(own), np.int32)
            for dim in np.unique(own).tolist():
                rows = np.flatnonzero(own == dim)
                if dim in shared.value:
                    leaf[rows] = leaf_of(_matrix(batch.column(2).take(pa.array(rows)).to_pylist(), dim), shared.value[dim])
                else:
                    leaf[rows] = -1  # no candidate has that length
            yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    placed = scratch.table("placed", candidates.select("vec_id", "dim", "v").mapInArrow(place, "vec_id long, dim int, v binary, leaf int"))
    sizes = scratch.table("sizes", placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards")))
    index = placed.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("shards")).cast("int"))

    def blocks_of(table: pa.Table) -> pa.Table:
        dim, leaf, shard = (table.column(c)[0].as_py() for c in ("dim", "leaf", "shard"))
        made = build_blocks(table.column("vec_id").to_numpy(), _matrix(table.column("v").to_pylist(), dim), block)
        raw = lambda x: np.ascontiguousarray(x, "<i8").tobytes()
        n = len(made)
        return pa.table([*[pa.array([x] * n, pa.int32()) for x in (dim, leaf, shard)], *[pa.array([raw(b[j]) for b in made], pa.binary()) for j in range(4)]], ["dim", "leaf", "shard", "ids", "forward", "high", "low"])

    stored = index.select("dim", "leaf", "shard", "vec_id", "v").groupBy("dim", "leaf", "shard").applyInArrow(blocks_of, "dim int, leaf int, shard int, ids binary, forward binary, high binary, low binary")
    stored = scratch.table("blocks", stored)

    def boxes(batches):
        """Extremes over the blocks of each leaf, of what one task reads."""
        held = {}
        for batch in batches:
            for dim, leaf, high, low in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                high, low = np.frombuffer(high, "<i8"), np.frombuffer(low, "<i8")
                a, b = held.get((dim, leaf), (high, low))
                held[dim, leaf] = (np.maximum(a, high), np.minimum(b, low))
        names = sorted(held)
        yield pa.record_batch([pa.array([d for d, _ in names], pa.int32()), pa.array([x for _, x in names], pa.int32()), *[pa.array([held[x][j].tobytes() for x in names], pa.binary()) for j in range(2)]], ["dim", "leaf", "high", "low"])

    merge = lambda t: pa.Table.from_batches(list(boxes(t.select(["dim", "leaf", "high", "low"]).to_batches())))
    box_schema = "dim int, leaf int, high binary, low binary"
    found_boxes = stored.select("dim", "leaf", "high", "low").mapInArrow(boxes, box_schema).groupBy("dim", "leaf").applyInArrow(merge, box_schema).collect()  # at most most_leaves of each length
    bounds = spark.sparkContext.broadcast({d: tuple(np.stack([np.frombuffer(r[j], "<i8") for r in found_boxes if r["dim"] == d]) for j in (2, 3)) + (np.array([r["leaf"] for r in found_boxes if r["dim"] == d]),) for d in dims})

    def search(key, queries_of: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])
        if not queries_of.num_rows or not blocks.num_rows:
            return empty
        dim = key[0].as_py()
        whole = [tuple(np.frombuffer(b[j], "<i8").reshape(*((-1, dim) if j == 1 else (-1,))) for j in range(4)) for b in zip(*(blocks.column(c).to_pylist() for c in ("ids", "forward", "high", "low")), strict=True)]
        q_ids = queries_of.column("vec_id").to_numpy()
        found = search_blocks(whole, q_ids, _matrix(queries_of.column("v").to_pylist(), dim), k, queries_of.column("floor").to_numpy())
        return pa.table([pa.array(np.repeat(q_ids, [len(s) for s, _ in found])), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "vec_id", "score"])

    def asked_of(side: DataFrame) -> DataFrame:
        """The best k of each query of ``side(dim, leaf, vec_id, v, floor)`` in each shard of its leaf, one chunk of queries and one shard a call."""
        chunks = side.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("chunks"))
        cut = F.broadcast(sizes.join(chunks, ["dim", "leaf"]))  # a row a leaf
        asking = side.join(cut, ["dim", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("chunks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        asking = asking.select("dim", "leaf", "shard", "chunk", "vec_id", "v", "floor")
        blocks = stored.join(cut, ["dim", "leaf"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        blocks = blocks.select(F.col("dim").alias("_d"), F.col("leaf").alias("_l"), F.col("shard").alias("_s"), F.col("chunk").alias("_c"), "ids", "forward", "high", "low")
        return asking.groupBy("dim", "leaf", "shard", "chunk").cogroup(blocks.groupBy("_d", "_l", "_s", "_c")).applyInArrow(search, "query_id long, vec_id long, score long")

    def reached(batches):
        """The leaves other than its own whose summed extremes reach the query's floor."""
        for batch in batches:
            own = batch.column(1).to_numpy()
            for dim in np.unique(own).tolist():
                high, low, leaf = bounds.value[dim]
                rows = np.flatnonzero(own == dim)
                for at in range(0, len(rows), 1024):
                    some = batch.take(pa.array(rows[at : at + 1024]))
                    q = _matrix(some.column(2).to_pylist(), dim)
                    bound = _exact(np.maximum(q, 0), high) + _exact(np.minimum(q, 0), low)
                    go = (bound >= some.column(4).to_numpy()[:, None]) & (leaf[None, :] != some.column(3).to_numpy()[:, None])
                    i, j = np.nonzero(go)
                    yield pa.record_batch([pa.array(leaf[j].astype(np.int32)), *some.select([0, 1, 2, 4]).take(pa.array(i)).columns], ["leaf", "vec_id", "dim", "v", "floor"])

    home = scratch.table("home", queries.mapInArrow(place, "vec_id long, dim int, v binary, leaf int").filter("leaf >= 0"))
    begun = scratch.table("begun", asked_of(home.select("dim", "leaf", "vec_id", "v", F.lit(NONE).alias("floor"))))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floor = begun.withColumn("r", rank).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = home.join(floor, "vec_id", "left").select("vec_id", "dim", "v", "leaf", F.coalesce("least", F.lit(NONE)).alias("floor"))
    rest = scratch.table("rest", rest.mapInArrow(reached, "leaf int, vec_id long, dim int, v binary, floor long"))
    found = begun.unionByName(asked_of(rest))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
