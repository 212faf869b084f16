"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Each packing partition runs best-fit decreasing and compares its
bins with a lower bound from dual-feasible functions; a partition that meets the bound is certified. Partitions with a
gap hand over all bins that are not full, certified ones their emptiest bin (the loss of rounding up once a partition), and
the documents handed over are packed again together, over fewer partitions. Rounds go on until the pieces handed over fit one
partition, none is handed over, or a round packs them in no fewer bins than they came in; each round but the last so saves a bin.
The same bound over all pieces (``least_sequences``) shows how far the whole packing can be from the best.
Only (doc_id, piece, length) rows move; texts and tokens never do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import encoder
from .common import Scratch, frugal, text_slices


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of bins that dual-feasible functions prove: rounding u(k) for k < 20, and the threshold family for every threshold."""
    return lower_bound_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def lower_bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same of the number of items of each length from 0 to ``capacity``."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 20):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    below, size_below = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)
    large = below[-1] - below[capacity - t]  # longer than capacity - t: each counts as a whole bin
    middle = size_below[capacity - t] - size_below[t - 1]
    return max(best, int((large + -(-middle // capacity)).max(initial=0)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the fill of each bin. Bins by room left; a bit set finds the tightest that fits."""
    order = np.argsort(-lengths, kind="stable")
    where, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            rooms[left].append(b)
            bits |= 1 << left
    return where, offset, np.array(fill, np.int64)


def document_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, rule: str = "word") -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32. A null text is empty: its end id alone.

    Every row is a document of its own, whatever repeats; a null doc_id stays null. A text of any length is encoded whole, then
    cut. An empty table has no pieces. Other columns are not read."""

    def cut(batches):
        known = encoder(tokenizer_path, rule)
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text"):
                flat, at = known.encode(buf, offsets)
                flat, at = np.insert(flat, at[1:], end_id), at + np.arange(rows.num_rows + 1)
                lens = np.diff(at)
                parts = -(-lens // capacity)
                row = np.repeat(np.arange(rows.num_rows), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, lens[row] - start)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at[row] + start).tolist(), (at[row] + start + length).tolist(), strict=True)]
                yield pa.record_batch([rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(cut, keep=True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_partition: int = 50_000) -> DataFrame:
    """Adds sequence_id, offset, certified (whether its partition's bins meet the partition's bound) and least_sequences (the bound
    over all pieces) to ``pieces`` (length > 0 and <= capacity).

    One row each, whatever repeats; equal rows are dealt over all partitions by their place in the table. Columns of those four
    names are replaced, others pass through. An empty table stays empty."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = pieces.drop("sequence_id", "offset", "certified", "least_sequences")
    names = pieces.columns
    # the place is written with the row, so a lost task deals the same rows again
    plain = pieces.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("length", F.col(f"c{names.index('length')}").cast("long"))
    left = scratch.table("pieces", plain.withColumn("place", F.monotonically_increasing_id()))
    columns = left.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)
    counts = {r["length"]: r["n"] for r in left.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length, so at most capacity
    least = lower_bound_of_counts(np.array([counts.get(k, 0) for k in range(capacity + 1)], np.int64), capacity)

    def packed(number: int, last: bool):
        def run(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            partition = table.column("_p")[0].as_py()
            lengths = table.column("length").to_numpy()
            where, offset, fill = best_fit_decreasing(lengths, capacity)
            certified = len(fill) <= lower_bound(lengths, capacity)
            open_bins = fill < capacity
            if certified:
                emptiest = np.zeros(len(fill), bool)
                emptiest[np.argmin(fill)] = True
                open_bins &= emptiest
            moved = open_bins[where] & (not last)
            ids = (number << 56) | (partition << 24) | where
            yield from table.select(columns).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("certified", pa.array(np.full(len(where), certified))).append_column("_moved", pa.array(moved)).to_batches()

        return run

    done, number, came_in = [], 0, None
    while True:
        parts = max(1, -(-left.count() // rows_per_partition))
        dealt = left.withColumn("_p", F.pmod(F.xxhash64("place", F.lit(number)), F.lit(parts)).cast("int")).repartitionById(parts, F.col("_p"))
        out = scratch.table(f"round{number}", dealt.mapInArrow(frugal(packed(number, parts == 1)), f"{fields}, sequence_id long, offset long, certified boolean, _moved boolean"))
        first = F.col("offset") == 0  # a bin has one row there
        bins = out.agg(F.count_if(first).alias("all"), F.count_if(first & F.col("_moved")).alias("moved")).first()
        if parts == 1 or not bins["moved"] or (came_in is not None and bins["all"] >= came_in):
            done.append(out)
            break
        done.append(out.filter("not _moved"))
        left, came_in, number = out.filter("_moved").select(*columns), bins["moved"], number + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    scratch.drop("pieces")
    kept = [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]
    return result.select(*kept, "sequence_id", "offset", "certified", F.lit(least).cast("long").alias("least_sequences"))
