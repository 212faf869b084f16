import io
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import chunk_tokens, packing, queries, token_output


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


TEXTS = ["", " ", "a  b", "\n\n x   y", "it's  we'LL  ", "é́ é   z", "tabs\tand\x0bmore\x0c!", "!!  ??", "　 a", "1234 5,678", "<|endoftext|> <|startoftext|>", "a,b.c-d'e' f's. x!'s A%%%B ,a .5a,5", "ΣΑΣ Σ İ", " ́x", "a  b", "x  b"]
TEXTS += ["x <|endoftext|> y", "a<|endoftext|><|endoftext|>b's <|endof", "text|> <|ENDOFTEXT|>", "w <|startoftext|>7  <|endoftext|>"]


@pytest.mark.parametrize(("name", "rule"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunked_ids_equal_the_library(name, rule):
    own, lib = chunk_tokens.ChunkEncoder(public_tokenizers.path(name), rule, most_ids=200), library(name)
    for texts in (TEXTS, TEXTS[::-1], ["only"], [""]):
        raw = [t.encode() for t in texts]
        ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_stream_coding_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 8], np.uint32)
    control, data = token_output.encode_ranks(ranks)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1 + 1
    assert token_output.decode_ranks(control, data, len(ranks)).tolist() == ranks.tolist()
    control, data = token_output.encode_ranks(ranks[:0])
    assert token_output.decode_ranks(control, data, 0).tolist() == []


def test_damage_is_found():
    out = io.BytesIO()
    out.write(token_output.MAGIC + struct.pack("<I", 2) + np.array([5, 9], "<u4").tobytes())
    token_output.write_block(out, np.array([1]), np.array([False]), np.array([3]), np.array([0, 1, 0], np.uint32))
    raw = out.getvalue()
    assert next(token_output.read_file(io.BytesIO(raw)))[3].tolist() == [5, 9, 5]
    for bad in (raw[:-1], raw[:-1] + b"\x07", b"x" + raw[1:]):
        with pytest.raises(ValueError):
            list(token_output.read_file(io.BytesIO(bad)))


def test_token_files(odd_docs):
    lib = library("byte_bpe_50k.json")
    got = token_output.read_token_files(token_output.write_token_files(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), partitions=3, block_ids=100)).collect()
    want = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect()]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(want, key=str)
    at = 0
    ordered = sorted(got, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)


def test_token_query(spark, sf_dir):
    lib = library("byte_bpe_50k.json")
    at = 0
    got = {r["doc_id"]: r for r in queries.op3_token_output(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d["text"], add_special_tokens=False).ids + [0]
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], at, len(ids), crc(ids))
        at += len(ids)


def test_empty_tables(make_docs):
    none = make_docs([])
    assert token_output.token_digests(token_output.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert packing.pack(packing.document_pieces(none, public_tokenizers.path("word_bpe_49k.json"), 1)).count() == 0


def check_packing(rows, texts, capacity):
    lib = library("word_bpe_49k.json")
    bins = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc_id, text in texts:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc_id, k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // capacity)


def test_packing_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    bins, least = check_packing(queries.op8_packing(spark, sf_dir).collect(), [(d["doc_id"], d["text"]) for d in docs], 4096)
    assert bins <= least + 1


def test_packing_odd(odd_docs):
    rows = packing.pack(packing.document_pieces(odd_docs, public_tokenizers.path("word_bpe_49k.json"), 1, capacity=64), capacity=64, rows_per_partition=7).collect()
    bins, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 64)
    assert bins <= least + 1


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 3000))]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), capacity=100, rows_per_partition=200).collect()
    assert len(out) == 3000
    assert len({r["sequence_id"] for r in out}) <= -(-sum(n for _, n in rows) // 100) + 2


def test_equal_rows_are_dealt_out(spark):
    rows = spark.range(3000).selectExpr("cast(null as long) as doc_id", "10L as length", "'x' as sequence_id", "id % 2 as _p")
    out = packing.pack(rows, capacity=100, rows_per_partition=100)
    assert out.columns == ["doc_id", "length", "_p", "sequence_id", "offset", "certified", "least_sequences"]
    got = out.collect()
    assert len(got) == 3000 and len({r["sequence_id"] for r in got}) == 300 and {r["least_sequences"] for r in got} == {300}


def test_lower_bound():
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([50, 50, 51]), 100) == 2
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.array([], np.int64), 100) == 0
