"""Token ids of many texts by the tokenizers library, each distinct chunk of text encoded once.

Both rules cut only where the tokenizer's own pre-tokenization must cut too, so joining the chunks' ids gives exactly
the ids of the whole text:

* ``byte``: before a space that a visible character follows (byte-level BPE whose words may start with one space);
* both: between an ASCII letter and ASCII punctuation other than an apostrophe;
* ``word``: at ASCII white space, which belongs to no chunk (tokenizers that drop white space).

The library finds a tokenizer's added tokens (such as an end-of-text mark) in a text before anything else; rows that hold one are
encoded whole by it.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from . import bytetext as bt
from .common import FORGET

_MARK = "\u0e59".encode()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_VISIBLE = np.ones(256, bool)
_VISIBLE[:0x21] = False
_VISIBLE[0x7F] = False
_VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # these may begin a Unicode space


class ChunkEncoder:
    """Encodes slices of texts; keeps the ids of chunks seen, ``most_ids`` at most."""

    def __init__(self, path: str, rule: str, most_ids: int = 6 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.rule, self.most_ids = rule, most_ids
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stop = np.flatnonzero(_LETTER[buf[:-1]] & _STOP[buf[1:]]) + 1
        if self.rule == "word":
            starts, ends, first = bt.word_spans(buf, offsets)
            stop = np.setdiff1d(stop, starts, assume_unique=True)  # a row that begins with one
            starts, ends = np.concatenate([starts, stop]), np.concatenate([ends, stop])
            starts.sort()
            ends.sort()
            return starts, ends, np.searchsorted(starts, offsets)
        cut = np.zeros(len(buf) + 1, bool)
        cut[: len(buf) - 1] = (buf[:-1] == 0x20) & _VISIBLE[buf[1:]]
        cut[stop] = True
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(buf)) if len(starts) else starts, np.searchsorted(starts, offsets)

    def _joinable(self, text: bytes) -> bool:
        """Whether the chunk's ids are the same with the mark after and before it."""
        if _MARK in text:
            return False
        first, last = text[0], text[-1]
        return self.rule == "word" or ((first == 0x20 or _LETTER[first]) and last < 0x80 and last > 0x20 and not 0x30 <= last <= 0x39)

    def _encode_chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, their numbers by chunk, and which chunks those are. Most chunks go in long strings, a mark after each: a digit that every
        pre-tokenizer here splits off, so its ids (found again as a sequence, which no other text has) end the chunk's."""
        joinable = np.fromiter(map(self._joinable, texts), bool, len(texts))
        flat, lens = [], np.zeros(len(texts), np.int64)
        at = np.flatnonzero(joinable)
        for k in range(0, len(at), 8192):
            part = at[k : k + 8192]
            text = b"".join([texts[i] + _MARK for i in part]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            size = len(ids) - len(self.mark) + 1
            marks = np.flatnonzero(np.logical_and.reduce([ids[j : size + j] == x for j, x in enumerate(self.mark)]))
            if len(marks) != len(part):
                raise ValueError("the tokenizer does not keep the mark between chunks apart")
            keep = np.ones(len(ids), bool)
            for j in range(len(self.mark)):
                keep[marks + j] = False
            lens[part] = np.diff(np.concatenate([[-len(self.mark)], marks])) - len(self.mark)
            flat.append(ids[keep])
        other = np.flatnonzero(~joinable)
        for e, i in zip(self.tokenizer.encode_batch_fast([texts[i].decode() for i in other], add_special_tokens=False), other.tolist(), strict=True):
            lens[i] = len(e.ids)
            flat.append(np.array(e.ids, np.uint32))
        order = np.concatenate([at, other])
        return np.concatenate(flat), lens[order], order

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        flat, lens, order = self._encode_chunks(texts)
        starts = np.zeros(len(texts), np.int64)
        starts[order] = self.used + np.cumsum(lens) - lens
        lens = lens[np.argsort(order)]
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.len = np.insert(self.keys, at, keys), np.insert(self.start, at, starts), np.insert(self.len, at, lens)

    def _rows_with_added(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows that hold an added token of the tokenizer, ascending."""
        data, found = buf.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                whole = at + len(token) <= offsets[row + 1]
                if whole:
                    found.add(row)
                at = data.find(token, int(offsets[row + 1]) if whole else at + 1)
        return np.array(sorted(found), np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and each row's (and the end's) offset among them: what the library's encode gives for each
        row's text with add_special_tokens=False."""
        whole = self._rows_with_added(buf, offsets)
        if not len(whole):
            return self._encode_by_chunk(buf, offsets)
        bytes_of, chunked = np.diff(offsets), np.ones(len(offsets) - 1, bool)
        chunked[whole] = False
        flat, at = self._encode_by_chunk(buf[np.repeat(chunked, bytes_of)], np.concatenate([[0], np.cumsum(bytes_of[chunked])]))
        others = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([buf[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole.tolist()], add_special_tokens=False)]
        lens = np.zeros(len(chunked), np.int64)
        lens[chunked], lens[whole] = np.diff(at), [len(x) for x in others]
        out, own = np.zeros(int(lens.sum()), np.uint32), np.repeat(chunked, lens)
        out[own], out[~own] = flat, np.concatenate(others)
        return out, np.concatenate([[0], np.cumsum(lens)])

    def _encode_by_chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self._spans(buf, offsets)
        keys, some, which = np.unique(bt.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if self.used > self.most_ids:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data = buf.tobytes()
            self._learn(keys[new], [data[starts[i] : ends[i]] for i in some[new].tolist()])
            at = np.searchsorted(self.keys, keys)
        lens = self.len[at][which]
        before = np.concatenate([[0], np.cumsum(lens)])
        if not len(lens):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        index = np.repeat(self.start[at][which] - before[:-1], lens) + np.arange(before[-1])
        return self.ids[index], before[first]


@functools.lru_cache(2)
def encoder(path: str, rule: str) -> ChunkEncoder:
    """The Python worker's own encoder, kept from task to task with the chunks it knows."""
    return ChunkEncoder(path, rule)


FORGET.append(encoder.cache_clear)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of ``data``; offsets count its items."""
    size = data.dtype.itemsize
    out = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64) * size), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(pa.binary())
