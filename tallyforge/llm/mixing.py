"""Mixing sources to target weights by a low-discrepancy schedule.

Targets are filled like water: sources share all sizes by weight, none takes more than ``cap`` times its own, and the
excess is shared again. Slot i of the schedule has the golden-ratio point frac(start + i * 0.618...), which falls into one source's
part of the cumulative targets; the slots of a source are ranked, and its k-th slot gets the k-th of its equal blocks of words. The
blocks are cut from the source's documents in hashed order, pass after pass. So the slots that a source is dealt set what is
taken of it, and the mix comes out in their order.

A count of slots is off its share by a few at most, so a block must be small against the target: sources of under ``least_slots``
blocks are scheduled among themselves with blocks a sixteenth as long, and so on down to single words. The schedules run side by
side: slot i of n stands at (i + 1/2) / n of the mix.

No step gathers a source, or all sources, in one task: running sums are taken within chunks and based on a table of chunk sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, frugal, shuffle_partitions, spread_prefix, text_slices

GOLDEN = 0.6180339887498949
GOLDEN_STEP = (GOLDEN * (1 << 20)) % 1.0
PARTS = 1024  # targets are placed on the line to a 1024th of a word, in integers, so that neighbours share their bounds
RUN = 1 << 16


@dataclass
class Mix:
    """targets: a row per source; schedule: (source_no, block, slot, place); pieces: a row for each part of a document in a block, and
    one without a block for a document of which nothing is taken."""

    targets: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, null told from any value: with the doc_id it names the rows that are equal throughout."""
    values = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() or f.dataType.typeName() == "variant" else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*[x for v in values for x in (v, v.isNull())])


def word_sizes(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, source, key and size (words; 0 for a null text) of every document; the key is a hash of the text by default."""

    def count(batches):
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text"):
                _, _, first = bt.word_spans(buf, offsets)
                yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), pa.array(np.diff(first).astype(np.int64))], ["doc_id", "source", "key", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.xxhash64("text") if key is None else key).alias("key"), "text")
    return rows.mapInArrow(frugal(count), "doc_id long, source string, key long, size long")


def source_targets(units: DataFrame, weights: tuple[float, ...], cap: float, scratch: Scratch) -> DataFrame:
    """source, source_no (by code point, null last), source_size, target, and part: the range of sources that a row stands in.

    ``units(source, size, n)``. The level of the water is found in rounds of one aggregate each: sources that it fills count with their
    most, until no more are filled."""
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = scratch.table("ranked", by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("part", F.shiftright("at", 33))
    before, rows = 0, []
    for r in sorted(ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each written partition
        rows.append((r["part"], before))
        before += r["n"]
    base = units.sparkSession.createDataFrame(rows or [(0, 0)], "part long, before long")
    numbered = ranked.join(F.broadcast(base), "part").withColumn("source_no", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = scratch.table("sources", numbered.select("source", "source_no", "source_size", "part", w.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    total = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    full, open_weight, n_full = 0.0, total["w"], -1
    while True:
        level = (total["t"] - full) / open_weight if open_weight else float("inf")
        over = F.col("most") <= F.col("w") * F.lit(level)
        r = filled.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if r["n"] == n_full:
            break
        full, open_weight, n_full = r["most"], r["w"], r["n"]
    target = F.when(over, F.col("most")).otherwise(F.col("w") * F.lit(level))
    return filled.select("source", "source_no", "source_size", target.alias("target"), "most", "part")


def _point(i: Column, start: float) -> Column:
    """frac(start + i * golden ratio), exact to 1e-9 for any i: the high and low parts of i are multiplied on their own."""
    high, low = F.shiftright(i, 20).cast("double"), i.bitwiseAND(F.lit((1 << 20) - 1)).cast("double")
    turns = high * F.lit(GOLDEN_STEP) + low * F.lit(GOLDEN) + F.lit(start)
    return turns - F.floor(turns)


def _schedule(targets: DataFrame, blocks: list[int], start: float, scratch: Scratch) -> DataFrame:
    """(source_no, block, slot, place) of the slots of all schedules; ``targets`` has level, the index of a source's block length."""
    spark = targets.sparkSession
    line = targets.withColumn("t", F.round(F.col("target") * PARTS).cast("long")).filter("t > 0")
    sums = line.groupBy("level", "part").agg(F.sum("t").alias("s"), F.count("*").alias("n")).collect()  # a row for each written partition and level
    out = None
    for level, words in enumerate(blocks):
        own = sorted((r["part"], r["s"], r["n"]) for r in sums if r["level"] == level)
        if not own:
            continue
        total, n_sources = sum(s for _, s, _ in own), sum(n for *_, n in own)
        base = spark.createDataFrame([(p, sum(s for q, s, _ in own if q < p)) for p, *_ in own], "part long, base long")
        upto = F.col("base") + F.sum("t").over(W.partitionBy("part").orderBy("source_no"))
        laid = line.filter(F.col("level") == level).join(F.broadcast(base), "part").withColumn("upto", upto)
        laid = laid.select("source_no", ((F.col("upto") - F.col("t")) / F.lit(float(total))).alias("low"), (F.col("upto") / F.lit(float(total))).alias("high"))
        # slots meet sources through a grid over [0, 1): each slot has one cell, each source the cells that it touches
        cells = 4 * n_sources
        touched = laid.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells)))))
        n_slots = -(-total // (PARTS * words))
        slots = spark.range(n_slots).select(F.col("id").alias("slot"), _point(F.col("id"), start).alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
        slots = slots.join(touched, "cell").filter("x >= low and x < high")
        slots = slots.select("source_no", "slot", ((F.col("slot") + 0.5) / F.lit(float(n_slots))).alias("place"), F.lit(1).alias("one"))
        out = slots if out is None else out.unionByName(slots)
    if out is None:
        return spark.createDataFrame([], "source_no long, block long, slot long, place double")
    ranked = spread_prefix(out, "source_no", ["slot"], F.shiftright("slot", 11), "one", "block", scratch)
    return ranked.select("source_no", "block", "slot", "place")


def mix(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, block_words: int = 2048, least_slots: int = 1024, seed: int = 7, start: float = 0.5, scratch: Scratch | None = None) -> Mix:
    """Plans the mix of ``sizes(doc_id, source, key, size)``.

    Null sources are one source, the last. Sources without words have target 0. What is taken of a source differs from its target by a few
    blocks, and a block is at most a ``least_slots``-th of the target or one word; no document is taken more than ``cap`` times. Rows
    equal in all four columns are documents of their own that lie side by side (``copy`` numbers them). An empty table gives
    empty tables. The same rows give the same mix in any order and partitioning; another ``start`` is another schedule.
    """
    spark = sizes.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    names = ["doc_id", "source", "key", "size"]
    units = scratch.table("units", sizes.groupBy(*names).agg(F.count("*").alias("n")))
    blocks = [max(1, block_words)]
    while blocks[-1] > 1:
        blocks.append(max(1, blocks[-1] // 16))
    level = F.lit(len(blocks) - 1)
    for i in reversed(range(len(blocks) - 1)):
        level = F.when(F.col("target") >= least_slots * blocks[i], F.lit(i)).otherwise(level)
    targets = source_targets(units, weights, cap, scratch).withColumn("level", level)
    targets = scratch.table("targets", targets.withColumn("block_words", F.element_at(F.array(*[F.lit(b).cast("long") for b in blocks]), F.col("level") + 1)))
    schedule = scratch.table("schedule", _schedule(targets, blocks, start, scratch))
    counts = schedule.groupBy("source_no").agg(F.count("*").alias("slots"))
    take = F.least(F.coalesce("slots", F.lit(0)) * F.col("block_words"), F.floor("most"))
    used = targets.join(counts, "source_no", "left").select("source", "source_no", "source_size", "target", "block_words", take.cast("long").alias("take"))
    used = scratch.table("used", used)
    placed = units.join(used.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("words", F.col("size") * F.col("n")).withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(seed)), 2))
    bits = max(0, (max(1, units.count()) // 2_000).bit_length())
    rows = spread_prefix(placed, "source_no", ["_h", "doc_id", "key", "size"], F.shiftright("_h", 62 - bits), "words", "at", scratch).drop("_h", "words")
    # copies in two steps, so that no array holds all of a row's
    rows = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, "n") - 1))).drop("_run", "n")
    rows = rows.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    # positions in the source's stream, passes one after another: [pass * source_size + at, ... + size), cut at take
    passes = F.when((F.col("size") > 0) & (F.col("take") > F.col("at")), F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - F.col("at") - 1) / F.col("source_size"))))
    spans = rows.withColumn("pass", F.explode_outer(passes)).withColumn("low", F.col("pass") * F.col("source_size") + F.col("at")).withColumn("high", F.least(F.col("low") + F.col("size"), "take"))
    block = lambda p: F.floor(p / F.col("block_words"))
    spans = spans.withColumn("block", F.explode_outer(F.sequence(block(F.col("low")), block(F.col("high") - 1))))
    begin = F.col("block") * F.col("block_words")
    pieces = spans.withColumn("piece_low", F.greatest("low", begin)).withColumn("piece_high", F.least("high", begin + F.col("block_words")))
    pieces = pieces.join(schedule, ["source_no", "block"], "left")
    words = F.when(F.col("slot").isNotNull(), F.col("piece_high") - F.col("piece_low")).otherwise(F.lit(0)).cast("long")
    pieces = pieces.select(*names, "copy", "source_no", "source_size", "target", "pass", "low", "block", "slot", "place", (F.col("piece_low") - F.col("low")).alias("from_word"), words.alias("words"))
    return Mix(used, schedule, pieces)


def taken_words(plan: Mix) -> DataFrame:
    """The plan's documents with ``taken``: the words that its slots take of each, repeats counted."""
    keys = ["doc_id", "source", "key", "size", "copy", "source_size", "target"]
    return plan.pieces.groupBy(*keys).agg(F.sum("words").alias("taken")).drop("copy")


def mixed(docs: DataFrame, partitions: int | None = None, **how) -> DataFrame:
    """The mix of ``docs(doc_id, source, text, ...)`` (parameters as of ``mix``): columns as in ``docs``, rows in the order of the slots.

    Each whole pass over a document gives the document, the pass that its source's last block ends in the first words of it, joined by one
    space; n_chars, if there, is counted anew. A null text, or one without words, is not taken. Rows equal throughout give as many
    passes as each of them has; rows that share a doc_id, or only their text, are documents of their own. Columns of any name pass
    through. Rows come range by range of the mix and sorted within; an empty table stays empty.
    """
    spark = docs.sparkSession
    scratch, names = Scratch(spark, "mixed"), docs.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*place.values())
    plain = plain.withColumn("key", row_hash(plain)).withColumn("id", F.coalesce(F.col(place["doc_id"]).cast("long"), F.lit(-1)))
    sized = plain.select(F.col(place["doc_id"]).alias("doc_id"), F.col(place["source"]).alias("source"), "key", F.col(place["text"]).alias("text"))
    plan = mix(word_sizes(sized, F.col("key")), scratch=scratch, **how)
    passes = plan.pieces.filter("words > 0").groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id"), "key", "copy", "pass", "size", "source_no", "low").agg(F.sum("words").alias("taken"), F.min("place").alias("place"))
    once = plain.dropDuplicates(["id", "key"])  # equal rows are one text on its way, taken as often as all of them
    rows = once.join(passes.hint("merge"), ["id", "key"])
    text = F.col(place["text"])
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    rows = rows.withColumn(place["text"], F.when(F.col("taken") < F.col("size"), cut).otherwise(text))
    if "n_chars" in place:
        rows = rows.withColumn(place["n_chars"], F.length(place["text"]).cast(docs.schema["n_chars"].dataType))
    # places are even over [0, 1), so ranges of them are of even size without a sample
    n = partitions or shuffle_partitions(spark)
    rows = rows.withColumn("_p", F.floor(F.col("place") * n).cast("int")).repartitionById(n, F.col("_p")).sortWithinPartitions("_p", "place", "source_no", "low")
    return rows.select(*[F.col(c).alias(name) for name, c in place.items()])
