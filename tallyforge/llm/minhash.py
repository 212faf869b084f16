"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and grouping.

A signature position holds the least (layer, fraction) over the elements of a set, where an element visits all positions
in an order of its own, one a layer. Layers are done for all elements of many documents at once and end for a document
as soon as every position is filled: later layers can't lower anything (early stopping).

Candidates are found in band buckets without all pairs of a bucket. First each document is linked to at most two bucket
centres (the members that meet most others): the one met in most bands, and the one that meets most. Verified links make groups. Then buckets
that still hold several groups compare members of different groups, blockwise: at first for the best partner in each other group, and
after those links are made, for all likely pairs that are left. Both sides of every join grow with the input, so all
are sort-merge joins, also where a small input's could be broadcast. Equal sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, frugal, join_with_hot_keys, key_groups, run_bounds, text_slices
from .components import connected_components

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SEED = 0x9E3779B97F4A7C15


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row one after another, and the rows' offsets: k words, or all of a shorter text's."""
    low = bt.lower_ascii(buf)
    starts, ends, first = bt.word_spans(low, offsets)
    words = bt.span_hashes(low, starts, ends)
    n = np.diff(first)
    index, rows = bt.gram_rows(first, k)
    grams = bt.gram_hashes(words, k)[index] if len(index) else np.zeros(0, np.uint64)
    at = np.searchsorted(rows, np.arange(len(n) + 1))
    whole = bt.whole_hashes(words, first)
    out = []
    for i in range(len(n)):
        if n[i] >= k:
            x = np.sort(grams[at[i] : at[i + 1]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(whole[i : i + 1] if n[i] else whole[:0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum([0, *map(len, out)])


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int, most: int = 1 << 16) -> np.ndarray:
    """Signatures (rows x m, 64-bit; EMPTY throughout for an empty set) of the rows' element hashes; m <= 256.

    Rows are taken in groups of about ``most`` elements, which bounds the elements' orders held (m bytes each)."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append(_superminhash(elements[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], m))
        at = to
    return np.concatenate(out) if out else np.zeros((0, m), np.uint64)


def _superminhash(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    n_rows = len(offsets) - 1
    sig = np.full(n_rows * m, EMPTY, np.uint64)
    rows = np.repeat(np.arange(n_rows), np.diff(offsets))
    active, first, order = elements, None, None
    todo = rows
    for layer in range(m):
        if not len(active):
            break
        x = bt.mix(active + np.uint64((layer + 1) * SEED & 0xFFFFFFFFFFFFFFFF))
        pick = (layer + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - layer) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if layer == 0:
            position = first = pick
        elif layer == 1:
            position = np.where(pick == first, 0, pick)  # index 0 went where the first pick was
            second = pick
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8), (len(active), 1))
                line = np.arange(len(active))
                for step, took in ((0, first), (1, second)):
                    order[line, took] = order[line, step]
            line = np.arange(len(active))
            position = order[line, pick].astype(np.int64)
            order[line, pick] = order[line, layer]
        np.minimum.at(sig, todo * m + position, np.uint64(layer << 56) | (x >> np.uint64(8)))
        open_rows = (sig.reshape(n_rows, m) == EMPTY).any(axis=1)
        keep = open_rows[todo]
        if not keep.all():
            active, todo, first = active[keep], todo[keep], first[keep]
            if layer >= 1:
                second = second[keep]
            if order is not None:
                order = order[keep]
    return sig.reshape(n_rows, m)


def signatures(docs: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """doc_id, n (set size), set_id (of the whole set), sig (16 bits a position) of each document of ``docs(doc_id, text)``."""
    m = bands * band_rows

    def sign(batches):
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text", 1 << 20):
                elements, at = shingle_sets(buf, offsets, words)
                short = bt.mix(superminhash(elements, at, m).ravel() + np.uint64(1)).astype(np.uint16)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(e, dtype=np.uint64)]) for e in (elements, bt.mix(elements ^ np.uint64(SEED)))]
                parts = [(s[at[1:]] - s[at[:-1]]) for s in sums]
                set_ids = [f"{a:016x}{b:016x}{n:x}" for a, b, n in zip(parts[0].tolist(), parts[1].tolist(), np.diff(at).tolist(), strict=True)]
                raw = short.astype("<u2").tobytes()
                yield pa.record_batch([rows.column(0), pa.array(np.diff(at)), pa.array(set_ids), pa.array([raw[2 * m * i : 2 * m * (i + 1)] for i in range(rows.num_rows)], pa.binary())], ["doc_id", "n", "set_id", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(sign), "doc_id long, n long, set_id string, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, m: int, least: float) -> DataFrame:
    """The pairs whose signatures agree in at least the share ``least`` of positions."""

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, m) for k in (2, 3))
                keep = (x == y).sum(axis=1) >= least * m
                yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(frugal(agree), "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc_id, elements, short): the full shingle sets of the documents in ``wanted(doc_id)``, and 16 bits of each element."""

    def sets(batches):
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text"):
                elements, at = shingle_sets(buf, offsets, words)
                raw, small = elements.astype("<u8").tobytes(), bt.mix(elements).astype("<u2").tobytes()
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                yield pa.record_batch([rows.column(0), pa.array([raw[8 * a : 8 * b] for a, b in spans], pa.binary()), pa.array([small[2 * a : 2 * b] for a, b in spans], pa.binary())], ["doc_id", "elements", "short"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    return texts.mapInArrow(frugal(sets), "doc_id long, elements binary, short binary")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union| of their full shingle sets."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")).hint("merge"), "a").join(full.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")).hint("merge"), "b")
    return joined.select("a", "b", "ea", "eb").mapInArrow(frugal(compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 36, band_rows: int = 5, block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text)``.

    Links join documents whose sets of distinct ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``percent``/100 or more. A null text or one without words has an empty set and no links. Rows that share a doc_id
    are one document for linking. Rows without a doc_id take no part: they are kept, with a null component. A pair at the
    threshold itself shares no band with probability (1 - 0.8^5)^36 < 7e-7. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch, m = Scratch(spark, "minhash"), bands * band_rows
    signed = scratch.table("signed", signatures(docs, words, bands, band_rows))
    taking = signed.filter("n > 0 and doc_id is not null")
    copies = taking.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    n_rows = signed.count()
    copies = scratch.table("copies", copies.filter("rows > 1"), n_rows)
    nodes = join_with_hot_keys(signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")), copies, "set_id", "rows", "doc_id")
    nodes = scratch.table("nodes", nodes.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), n_rows)
    sigs = taking.join(copies.select("set_id", "rep").hint("merge"), "set_id", "left").filter("rep is null or rep = doc_id").select("doc_id", "sig")
    sigs = scratch.table("sigs", sigs)

    def band_keys(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").astype(np.uint64).reshape(-1, bands, band_rows)
                h = np.broadcast_to(bt.mix(np.arange(1, bands + 1, dtype=np.uint64)), x.shape[:2]).copy()
                for r in range(band_rows):
                    h = bt.mix(h ^ (x[:, :, r] + np.uint64(1)))
                yield pa.record_batch([pa.array(h.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int16), len(x))), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["bucket", "band", "doc_id"])

    members = sigs.mapInArrow(frugal(band_keys), "bucket long, band short, doc_id long")
    shared = members.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("size")).filter("low < high")
    members = scratch.table("members", members.join(shared.select("bucket", "size").hint("merge"), "bucket"))
    full = scratch.table("full", _full_sets(docs, members.select("doc_id").distinct(), words))
    least = percent / 100 - 0.13  # over four standard deviations of an estimate from 180 positions
    same = nodes.filter("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # first links, to the centres of buckets: members that meet the most others over all their buckets
    met = members.groupBy("doc_id").agg(F.sum("size").alias("met"))
    centre = members.join(met.hint("merge"), "doc_id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("minus"))).alias("c"))
    centre = centre.select("bucket", F.col("c.met").alias("met"), (-F.col("c.minus")).alias("centre"))
    near = members.join(centre.hint("merge"), "bucket").filter("centre <> doc_id").groupBy("doc_id", "centre").agg(F.count("*").alias("n"), F.first("met").alias("met"))
    most = lambda *by: F.max(F.struct(*by, F.col("centre").alias("c")))["c"]
    chosen = near.groupBy("doc_id").agg(most("n", "met").alias("most"), most("met", "n").alias("widest"))
    pairs = chosen.select(F.explode(F.array_distinct(F.array("most", "widest"))).alias("x"), F.col("doc_id").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = scratch.table("links0", _verified(_likely(pairs, sigs, m, least), full, percent))
    # then across the groups that still share a bucket: a best partner in each other group, and at last all likely pairs
    for number, best_only in ((1, True), (2, False)):
        groups = connected_components(links.union(same), scratch, f"cc{number}")
        crossed = scratch.table(f"crossed{number}", _across_groups(members, groups, sigs, full, m, band_rows, least, percent, block, best_only, scratch, f"grouped{number}").distinct())
        more = scratch.table(f"links{number}", _verified(crossed, full, percent))
        links = links.union(more)
    if not more.isEmpty():
        groups = connected_components(links.union(same), scratch, "cc3")
    scratch.drop("signed", "copies", "sigs", "members", "full", "crossed1", "crossed2", "grouped1", "grouped2")
    out = nodes.join(groups.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _may_reach(a: np.ndarray, b: np.ndarray, shorts: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets can be similar enough, by an upper bound of their intersection; ``a`` is in runs of equal values."""
    out = np.zeros(len(a), bool)
    seen = np.zeros(1 << 16, bool)
    bounds = run_bounds(a)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.frombuffer(shorts[a[s]], "<u2")
        seen[own] = True
        others = [np.frombuffer(shorts[k], "<u2") for k in b[s:e].tolist()]
        sizes = np.array([len(x) for x in others])
        common = np.minimum(np.add.reduceat(seen[np.concatenate(others)].astype(np.int64), np.cumsum(sizes) - sizes), len(own))
        out[s:e] = 100 * common >= percent * (sizes + len(own) - common)
        seen[own] = False
    return out


def _across_groups(members: DataFrame, groups: DataFrame, sigs: DataFrame, full: DataFrame, m: int, band_rows: int, least: float, percent: int, block: int, best_only: bool, scratch: Scratch, name: str) -> DataFrame:
    """Likely pairs (a, b) within a bucket whose members are in different groups, block by block; with ``best_only`` each
    member gives the one that agrees most of each other group.

    A pair must agree in enough positions, and its elements' 16 bits must allow the similarity: counting equal ones can
    only overstate the intersection. So what leaves a bucket is all but the links themselves, however many it compares."""
    grouped = members.select("bucket", "band", "doc_id", "size").join(groups.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id"))
    grouped = scratch.table(name, grouped.select("bucket", "band", "doc_id", "size", "group"))
    mixed = grouped.groupBy("bucket").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x < y").select("bucket")
    rows = grouped.join(mixed.hint("merge"), "bucket", "left_semi").join(sigs.hint("merge"), "doc_id").join(full.select("doc_id", "short").hint("merge"), "doc_id")
    chunks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "group", "sig", "band", "short")

    def compare(batches):
        for table in key_groups(batches, ["bucket", "low", "high"]):
            bucket, low, high, own, doc, group = (table.column(k).to_numpy() for k in range(6))
            band = table.column(7).to_numpy()
            sig = np.frombuffer(b"".join(table.column(6).to_pylist()), "<u2").reshape(-1, m)
            shorts = table.column(8).to_pylist()
            bounds = run_bounds(bucket, low, high)
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for at in range(s, e, 256):
                    to = min(at + 256, e)
                    apart = (group[at:to, None] != group[None, s:e]) & (doc[at:to, None] < doc[None, s:e])
                    if low[s] != high[s]:
                        apart &= own[at:to, None] != own[None, s:e]
                    i, j = np.nonzero(apart)
                    for cut in range(0, len(i), 1 << 15):
                        a, b = at + i[cut : cut + (1 << 15)], s + j[cut : cut + (1 << 15)]
                        agree = (sig[a] == sig[b]).sum(axis=1)
                        likely = agree >= least * m
                        a, b, agree = a[likely], b[likely], agree[likely]
                        if len(a):  # a pair counts in the first band that it shares
                            bands = (sig[a] == sig[b]).reshape(len(a), -1, band_rows).all(axis=2)
                            here = bands.argmax(axis=1) == band[s]
                            a, b, agree = a[here], b[here], agree[here]
                        if len(a):
                            allowed = _may_reach(a, b, shorts, percent)
                            a, b, agree = a[allowed], b[allowed], agree[allowed]
                        if best_only and len(a):
                            # each of the two sides names its best partner in the other's group
                            pick = np.zeros(len(a), bool)
                            for x, y in ((a, b), (b, a)):
                                order = np.lexsort((-agree, group[y], doc[x]))
                                first = run_bounds(doc[x][order], group[y][order])[:-1]
                                pick[order[first]] = True
                            a, b = a[pick], b[pick]
                        if len(a):
                            out.append((doc[a], doc[b]))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])
                    out = []

    dealt = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(frugal(compare), "a long, b long")
