"""Removal of passages that also stand in an earlier document.

A window is ``width`` consecutive words. A word goes if some window over it starts, word for word, in a document of
smaller doc_id; windows are judged on the input.

1. Count-min prefilter. The key of a window is the least hash among its grams of half its width, so equal windows have
   equal keys and neighbours mostly share them: about one key in thirteen windows. The key space is cut in shards, each with a sketch of
   two rows of cells, as many as its keys need. Each partition of documents counts its own cells (documents of a key, up to two are
   told apart); the partitions' cells are added up shard by shard, in a stream that holds one sketch. Then the keys meet the
   merged sketch, a batch's distinct keys once each: the lesser of a key's two cells is at least the number of documents that hold
   the key, and so at least those that hold any window of it. No estimate is too low, so no repeated window is lost.
2. The second pass takes only windows whose key is estimated repeated, and groups them by two independent 64-bit hashes of their
   words. Two different windows agree in those 128 bits with a chance of under 1e-14 even among 1e12 windows.
3. The texts are read once more, and the words under the repeated windows go.

Copies of a whole earlier text need no windows: all of their words go (if they have a window at all).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, frugal, join_with_hot_keys, shuffle_partitions, text_slices

ROW = np.uint64(0x9FB21C651E98DF25)
OTHER = 0x2545F4914F6CDD1D


def window_keys(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, row and key of every window of every row."""
    half = max(1, width // 2)
    index, rows = bt.gram_rows(first, width)
    if not len(index):
        return index, rows, np.zeros(0, np.uint64)
    return index, rows, bt.sliding_min(bt.gram_hashes(words, half), width - half + 1)[index]


def _word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = bt.word_spans(buf, offsets)
    return starts, ends, first, bt.span_hashes(buf, starts, ends)


def cells_of(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each key in either row of a sketch of ``size`` (a power of two) cells a row."""
    mask = np.uint64(size - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask).astype(np.int64)


def partition_sketch(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A partition's own sketch: its cells that are not empty (second row after the first), and their counts up to two."""
    a, b = cells_of(keys, size)
    cells, which = np.unique(np.concatenate([a, size + b]), return_inverse=True)
    total = np.zeros(len(cells), np.int64)
    np.add.at(total, which, np.concatenate([counts, counts]))
    return cells.astype(np.uint32), np.minimum(total, 2).astype(np.uint8)


def add_sketch(merged: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> None:
    """Adds a partition's sketch to ``merged`` (both rows' counts one after another), which keeps at most two."""
    merged[cells] = np.minimum(merged[cells] + counts, 2)


def repeated_in_sketch(keys: np.ndarray, merged: np.ndarray) -> np.ndarray:
    """Which keys the merged sketch estimates to stand in two documents or more."""
    a, b = cells_of(keys, len(merged) // 2)
    return np.minimum(merged[a], merged[len(merged) // 2 + b]) >= 2


def _batch_keys(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """(shard, batch, keys, counts, which, docs, ths): the distinct keys of each batch of texts by shard, the number of its documents that
    hold each, and those documents as (index of the key, doc_id, th)."""

    def run(batches):
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text"):
                _, _, first, words = _word_hashes(buf, offsets)
                _, row, key = window_keys(words, first, width)
                if not len(key):
                    continue
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
                row, key = row[new], bt.mix(key[new])
                order = np.lexsort((row, key))
                row, key = row[order], key[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
                row, key = row[new], key[new]
                shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # keys ascend, so shards do
                at = np.searchsorted(shard, np.arange(shards + 1))
                doc, th = (rows.column(k).to_numpy() for k in (0, 1))
                name, out = uuid.uuid4().int >> 65, []
                for s in np.flatnonzero(np.diff(at)).tolist():
                    part = slice(at[s], at[s + 1])
                    distinct, which, count = np.unique(key[part], return_inverse=True, return_counts=True)
                    out.append((s, name, len(distinct), distinct.tobytes(), np.minimum(count, 2).astype(np.uint8).tobytes(), which.astype("<u4").tobytes(), doc[row[part]].astype("<i8").tobytes(), th[row[part]].astype("<i8").tobytes()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "batch", "n", "keys", "counts", "which", "docs", "ths"])

    return docs.select("doc_id", "th", "text").mapInArrow(frugal(run), "shard int, batch long, n long, keys binary, counts binary, which binary, docs binary, ths binary")


def _estimated_repeated(docs: DataFrame, width: int, shards: int, scratch: Scratch) -> DataFrame:
    """(doc_id, th, keys): the keys of each document that the merged sketch estimates to stand in several documents."""
    batches = scratch.table("keys", _batch_keys(docs, width, shards))  # written once: a batch keeps its name if an executor is lost
    n = batches.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = 1 << max(4, (4 * (n[1] // shards + 1) - 1).bit_length())  # cells a row: four for each key, were none in two batches

    def sketch(stream):
        held: dict[int, list] = {}
        rows = 0

        def out():
            made = [(s, *partition_sketch(*(np.concatenate(x) for x in zip(*parts, strict=True)), size)) for s, parts in sorted(held.items())]
            return pa.record_batch([pa.array([s for s, *_ in made], pa.int32()), pa.array([c.tobytes() for _, c, _ in made], pa.binary()), pa.array([k.tobytes() for *_, k in made], pa.binary())], ["shard", "cells", "counts"])

        for batch in stream:
            for s, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(s, []).append((np.frombuffer(keys, "<u8"), np.frombuffer(counts, np.uint8)))
                rows += len(counts)
            if rows > 1 << 20:
                yield out()
                held, rows = {}, 0
        if held:
            yield out()

    def merge(stream):
        shard, merged = None, None
        for batch in stream:
            for s, cells, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if s != shard:
                    if merged is not None:
                        yield _sketch_row(shard, merged)
                    shard, merged = s, np.zeros(2 * size, np.uint8)
                add_sketch(merged, np.frombuffer(cells, "<u4"), np.frombuffer(counts, np.uint8))
        if merged is not None:
            yield _sketch_row(shard, merged)

    def ask(stream):
        shard, merged = None, None
        for batch in stream:
            names, kept = [], []
            for s, name, keys in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name is None:
                    shard, merged = s, np.unpackbits(np.frombuffer(keys, np.uint8)) * np.uint8(2)
                    continue
                if s != shard:
                    raise ValueError(f"keys of shard {s} came without its sketch")
                often = repeated_in_sketch(np.frombuffer(keys, "<u8"), merged)
                if often.any():
                    names.append((s, name))
                    kept.append(np.packbits(often).tobytes())
            yield pa.record_batch([pa.array([s for s, _ in names], pa.int32()), pa.array([n for _, n in names], pa.int64()), pa.array(kept, pa.binary())], ["shard", "batch", "often"])

    def documents(stream):
        for batch in stream:
            found = []
            for n, keys, which, doc, th, often in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                which = np.frombuffer(which, "<u4")
                keep = np.unpackbits(np.frombuffer(often, np.uint8), count=n).astype(bool)[which]
                found.append((np.frombuffer(doc, "<i8")[keep], np.frombuffer(th, "<i8")[keep], np.frombuffer(keys, "<u8")[which[keep]].view(np.int64)))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["doc_id", "th", "key"])

    sketches = batches.select("shard", "keys", "counts").mapInArrow(frugal(sketch), "shard int, cells binary, counts binary")
    merged = sketches.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(frugal(merge), "shard int, bits binary")
    merged = scratch.table("sketch", merged)
    # a shard's sketch comes before the keys that ask it
    questions = merged.select("shard", F.lit(None).cast("long").alias("batch"), F.col("bits").alias("keys")).union(batches.select("shard", "batch", "keys"))
    often = questions.repartition(shards, "shard").sortWithinPartitions("shard", F.col("batch").asc_nulls_first()).mapInArrow(frugal(ask), "shard int, batch long, often binary")
    found = batches.join(often.hint("merge"), ["shard", "batch"]).select("n", "keys", "which", "docs", "ths", "often")
    return found.mapInArrow(frugal(documents), "doc_id long, th long, key long").groupBy("doc_id", "th").agg(F.collect_list("key").alias("keys"))


def _sketch_row(shard: int, merged: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([shard], pa.int32()), pa.array([np.packbits(merged >= 2).tobytes()], pa.binary())], ["shard", "bits"])


def _windows(docs: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """(hash, more, doc_id, th, word): each window of the documents in ``repeated`` whose key is among the document's repeated ones;
    hash and more are two hashes of its words from word hashes of their own."""

    def emit(batches):
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text", 2 << 20):
                starts, ends, first, words = _word_hashes(buf, offsets)
                index, row, key = window_keys(words, first, width)
                keys = rows.column(3)
                flat = keys.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(rows.num_rows, dtype=np.uint64), np.diff(keys.offsets.to_numpy()))
                # keys are looked up with their row, as one hash of both
                keep = np.isin(bt.mix(bt.mix(key) ^ (row.astype(np.uint64) * ROW)), bt.mix(flat ^ (owner * ROW)))
                index, row = index[keep], row[keep]
                if not len(index):
                    continue
                whole = bt.gram_hashes(words, width)[index]
                more = bt.gram_hashes(bt.span_hashes(buf, starts, ends, OTHER), width)[index]
                doc, th = (rows.column(k).to_numpy() for k in (0, 1))
                word = (index - first[:-1][row]).astype(np.int32)
                for cut in range(0, len(whole), 100_000):
                    part = slice(cut, cut + 100_000)
                    yield pa.record_batch([pa.array(whole[part].view(np.int64)), pa.array(more[part].view(np.int64)), pa.array(doc[row[part]]), pa.array(th[row[part]]), pa.array(word[part])], ["hash", "more", "doc_id", "th", "word"])

    joined = docs.join(repeated.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "keys")
    return joined.mapInArrow(frugal(emit), "hash long, more long, doc_id long, th long, word int")


def find_repeats(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, th, all, words): what to remove from a document - everything, or the windows that start at ``words``.

    ``docs(doc_id, th, text)``; th is xxhash64(text), which with the doc_id names a row."""
    spark = docs.sparkSession
    named = docs.filter("doc_id is not null and text is not null")
    equal = named.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("earliest"), F.count("*").alias("rows"))
    equal = scratch.table("equal", equal.filter("rows > 1"))
    copies = join_with_hot_keys(named.select("doc_id", "th", F.md5("text").alias("digest")), equal, "digest", "rows", "doc_id")
    copies = scratch.table("copies", copies.filter("earliest < doc_id").select("doc_id", "th").distinct())
    repeated = _estimated_repeated(named, width, shuffle_partitions(spark), scratch).join(copies, ["doc_id", "th"], "left_anti")
    repeated = scratch.table("repeated", repeated)
    windows = scratch.table("windows", _windows(named, repeated, width))
    earliest = windows.groupBy("hash", "more").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("earliest < latest").drop("latest")
    # written first: a join of two plain tables is one whose hot keys adaptive execution splits
    later = windows.join(scratch.table("earliest", earliest).hint("merge"), ["hash", "more"]).filter("doc_id > earliest")
    starts = later.groupBy("doc_id", "th").agg(F.collect_set("word").alias("words"))
    found = starts.select("doc_id", "th", F.lit(False).alias("all"), "words")
    found = found.union(copies.select("doc_id", "th", F.lit(True), F.lit(None).cast("array<int>")))
    found = scratch.table("found", found)
    scratch.drop("keys", "sketch", "equal", "copies", "repeated", "windows", "earliest")
    return found


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space) added.

    A null text has no words, and its kept_text is null; a text without removals keeps its words, joined alike. Rows without a
    doc_id neither lose words nor make others lose any. Rows that repeat a doc_id and its text are one document; rows of
    one doc_id and different texts never take words from each other. Texts of any length are read whole. An empty table stays empty.
    Extra columns of any name pass through.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    names = docs.columns
    keyed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    found = find_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), width, scratch)
    joined = keyed.join(found.withColumnsRenamed({"doc_id": "_f", "th": "_ft"}).hint("merge"), (F.col("_id") == F.col("_f")) & (F.col("_th") == F.col("_ft")), "left")
    at = names.index("text")
    schema = ", ".join(f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(names)))

    def clean(batches):
        for batch in batches:
            batch = batch.rename_columns([*batch.schema.names[: len(names)], "all", "words"])
            for rows, buf, offsets in text_slices(batch, f"c{at}"):
                starts, ends, first = bt.word_spans(buf, offsets)
                gone = np.zeros(len(starts) + 1, np.int32)
                windows = rows.column(len(names) + 1)
                if windows.null_count < len(windows):
                    begin = windows.flatten().to_numpy() + np.repeat(first[:-1], windows.value_lengths().fill_null(0).to_numpy())
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + width, -1)
                kept = np.cumsum(gone[:-1]) == 0
                whole = rows.column(len(names)).fill_null(False).to_numpy(zero_copy_only=False) & (np.diff(first) >= width)
                kept &= ~np.repeat(whole, np.diff(first))
                removed = np.diff(np.concatenate([[0], np.cumsum(~kept)])[first])
                texts = _joined(buf, starts[kept], ends[kept], np.concatenate([[0], np.cumsum(kept)])[first])
                texts = pa.compute.if_else(rows.column(at).is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.record_batch([*[rows.column(i) for i in range(len(names))], pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), texts], [*rows.schema.names[: len(names)], "n_words", "n_removed", "kept_text"])

    columns = [f"c{i}" for i in range(len(names))]
    out = joined.select(*columns, "all", "words").mapInArrow(frugal(clean), f"{schema}, n_words long, n_removed long, kept_text string")
    return out.toDF(*names, "n_words", "n_removed", "kept_text")


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each row's words joined by one space."""
    lens = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(lens)])
    index = np.repeat(starts - to[:-1], lens) + np.arange(to[-1])
    padded = np.append(buf, 0x20).astype(np.uint8)
    out = padded[np.minimum(index, len(buf))]
    out[to[1:] - 1] = 0x20
    # a row's text ends before its last space: spaces between rows are left out
    filled = np.diff(first) > 0
    last = to[first[1:][filled]] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    offsets = to[first] - np.concatenate([[0], np.cumsum(filled)])
    data = out[keep]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what ``remove_repeats`` returns; a null text counts as empty."""
    return cleaned.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
