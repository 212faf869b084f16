"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format (little-endian), one file per range of doc_id, files and documents ascending:

* head: ``TFIDS001``, u32 number of ranks, u32[ranks] the token id of each rank (rank 0 is the most frequent id);
* blocks: ``BLCK``, u32 documents, u64 ids, u64 control bytes, u64 data bytes, u32 crc32 of what follows; then u8[documents]
  1 where the doc_id is null, i64[documents] doc_ids, i64[documents] numbers of ids, the control bytes, the data bytes.

A control byte holds four 2-bit lengths less one, of the ids in order from the low bits; the data bytes hold each rank in
that many bytes. Decoding looks the lengths of a control byte up in a 256 x 4 table.

Plan: tokens are made once and written; a per-partition histogram gives the ranks (its size is the vocabulary's, which
bounds what is sent to the tasks); ids, not texts, are shuffled by ranges of doc_id whose bounds come from the id column.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import binary_column, encoder
from .common import Scratch, shuffle_partitions, text_slices

MAGIC, BLOCK = b"TFIDS001", b"BLCK"
HEAD = struct.Struct("<4sIQQQI")
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of 32-bit ranks."""
    lens = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lens - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4) < lens[:, None]
    return control, ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lens = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lens) - lens
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lens > k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def open_shared(uri: str, mode: str):
    """A stream on a file of the shared folder: local paths and every store that pyarrow's file systems reach."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_stream(path)


def write_block(out, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> None:
    control, data = encode_ranks(ranks)
    body = b"".join([null.astype(np.uint8).tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control.tobytes(), data.tobytes()])
    out.write(HEAD.pack(BLOCK, len(doc_ids), len(ranks), len(control), len(data), zlib.crc32(body)))
    out.write(body)


def read_file(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, null flags, numbers of ids, token ids) of each block in order; a damaged block raises ValueError."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("token file ends early")
        return data

    if take(8) != MAGIC:
        raise ValueError("not a token file")
    table = np.frombuffer(take(4 * struct.unpack("<I", take(4))[0]), "<u4")
    while head := stream.read(HEAD.size):
        mark, docs, ids, n_control, n_data, crc = HEAD.unpack(head)
        body = take(17 * docs + n_control + n_data)
        if mark != BLOCK or zlib.crc32(body) != crc:
            raise ValueError("token block is damaged")
        raw = np.frombuffer(body, np.uint8)
        doc_ids, counts = raw[docs : 9 * docs].view("<i8"), raw[9 * docs : 17 * docs].view("<i8")
        control, data = raw[17 * docs : 17 * docs + n_control], raw[17 * docs + n_control :]
        yield doc_ids, raw[:docs].astype(bool), counts, table[decode_ranks(control, data, ids)]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, rule: str = "byte", block_ids: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Writes the token files of ``docs(doc_id, text)`` and returns their manifest (part, path, n_docs, n_ids, bytes, base).

    Null texts are empty and hold the end id alone; null doc_ids come first; rows that repeat a doc_id follow one another,
    equal ids in no fixed order unless their token ids differ; other columns are not read. An empty table has no files.
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "token-ids", keep=True), partitions or max(shuffle_partitions(spark), 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    steps = [i / parts for i in range(1, parts)] or [0.5]
    cuts = np.array(ids.agg(F.percentile_approx("doc_id", steps, 10 * parts).alias("cuts")).first()["cuts"] or [], np.int64)

    def tokenize(batches):
        known = encoder(tokenizer_path, rule)
        for batch in batches:
            for rows, buf, offsets in text_slices(batch.select(["doc_id", "text"]), "text"):
                flat, at = known.encode(buf, offsets)
                n = rows.num_rows
                flat, at = np.insert(flat, at[1:], end_id).astype(np.uint32), at + np.arange(n + 1)
                doc_id = rows.column(0)
                part = np.searchsorted(cuts, doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left").astype(np.int32)
                small = flat.astype(np.uint16) if not len(flat) or flat.max() < 65536 else flat
                yield pa.record_batch([pa.array(part), doc_id, pa.array(np.full(n, small.dtype.itemsize, np.int8)), binary_column(small, at)], ["part", "doc_id", "width", "ids"])

    tokens = scratch.table("ids", ids.mapInArrow(tokenize, "part int, doc_id long, width byte, ids binary"))

    def histogram(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width in (2, 4):
                rows = batch.filter(pa.compute.equal(batch.column(0), width))
                if rows.num_rows:
                    seen = np.bincount(np.frombuffer(b"".join(rows.column(1).to_pylist()), f"<u{width}"))
                    if len(seen) > len(total):
                        seen, total = total, seen
                    total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    counted = tokens.select("width", "ids").mapInArrow(histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = np.array([r["id"] for r in counted.orderBy(F.desc("n"), "id").collect()], np.uint32)  # the vocabulary at most
    ranks = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    ranks[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast((order, ranks))
    folder = f"{scratch.path}/files"

    def write(batches):
        order, ranks = shared.value
        out = path = part = None
        n_docs = n_ids = waiting = 0
        held: list[tuple] = []

        def flush():
            doc_ids, null, counts, pieces = ([x for h in held for x in h[k]] for k in range(4))
            write_block(out, np.array(doc_ids, np.int64), np.array(null, bool), np.array(counts, np.int64), ranks[np.concatenate(pieces)])
            held.clear()

        def done():
            if held:
                flush()
            size = out.tell()
            out.close()
            return pa.record_batch([pa.array([part], pa.int32()), [path], [n_docs], [n_ids], [size]], ["part", "path", "n_docs", "n_ids", "bytes"])

        for batch in batches:
            for p, doc_id, width, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    if out is not None:
                        yield done()
                    part, n_docs, n_ids, waiting = p, 0, 0, 0
                    path = f"{folder}/part-{p:08d}-{uuid.uuid4().hex}.ids"  # of one attempt; the manifest names the ones that count
                    out = open_shared(path, "w")
                    out.write(MAGIC + struct.pack("<I", len(order)) + order.astype("<u4").tobytes())
                piece = np.frombuffer(raw, f"<u{width}")
                held.append(([doc_id or 0], [doc_id is None], [len(piece)], [piece]))
                n_docs, n_ids, waiting = n_docs + 1, n_ids + len(piece), waiting + len(piece)
                if waiting >= block_ids:
                    flush()
                    waiting = 0
        if out is not None:
            yield done()

    schema = "part int, path string, n_docs long, n_ids long, bytes long"
    files = tokens.select("part", "doc_id", "width", "ids").repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.crc32("ids"))
    manifest = scratch.table("manifest", files.select("part", "doc_id", "width", "ids").mapInArrow(write, schema))
    scratch.drop("ids")
    rows = sorted(manifest.collect(), key=lambda r: r["part"])  # as many as partitions
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r["n_ids"]
    return spark.createDataFrame(out, f"{schema}, base long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids (array of long), ids_crc32."""
    return _read(manifest, True)


def token_digests(manifest: DataFrame) -> DataFrame:
    """As ``read_token_files``, without the ids."""
    return _read(manifest, False)


def _read(manifest: DataFrame, with_ids: bool) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_shared(path, "r") as stream:
                    for doc_ids, null, counts, ids in read_file(stream):
                        at = np.concatenate([[0], np.cumsum(counts)])
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        columns = [pa.array(doc_ids, mask=null), pa.array(start + at[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                        yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        start += int(at[-1])

    n = max(1, manifest.count())
    return manifest.select("path", "base", "part").repartitionById(n, F.col("part")).select("path", "base").mapInArrow(read, schema)
