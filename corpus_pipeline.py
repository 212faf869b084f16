"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing - each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import language_id, minhash, mixing, packing, queries, substring_dedup
from tallyforge.llm.common import Scratch
from tallyforge.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or too far from every language go (null and empty texts too); lang becomes the predicted one.

    Whole texts are judged, each row alone: repeated rows and rows of one doc_id share nothing, a null doc_id or source stays.
    Columns beyond those of documents are dropped, whatever their names; an empty table stays empty."""
    ship(spark)
    model = language_id.fit(docs.filter(~language_id.is_held_out()))
    kept = language_id.predict(docs.select(COLUMNS), model).filter("not rejected")
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    A document is a doc_id with its text. Rows that repeat both are one document, and the least of them stays; of a doc_id with several
    texts all but the one of least hash come after all other documents, in order of their hashes. Null and empty texts, and rows without a
    doc_id, stay. Further columns are dropped; an empty table stays empty."""
    ship(spark)
    docs, scratch = docs.select(COLUMNS), Scratch(spark, "near-rows")
    named = docs.filter("doc_id is not null").withColumn("_th", F.xxhash64("text"))
    shared = named.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n"), F.min("_th").alias("_first")).filter("n > 1").select("_d", "_first")
    shared = scratch.table("shared", shared)
    repeats = not shared.isEmpty()
    if repeats:
        named = named.join(shared.hint("merge"), F.col("doc_id") == F.col("_d"), "left")
        other = F.col("_first").isNotNull() & (F.col("_th") != F.col("_first"))
        named = named.withColumn("_id", F.when(other, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "_th"), 3)).otherwise(F.col("doc_id")))
        named = scratch.table("named", named.select("_id", *COLUMNS))
    else:
        named = named.select(F.col("doc_id").alias("_id"), *COLUMNS)
    found = minhash.near_duplicates(named.select(F.col("_id").alias("doc_id"), "text"), words=5, percent=80).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    kept = named.join(found.hint("merge"), F.col("_id") == F.col("_kept"), "left_semi")
    if repeats:
        kept = kept.groupBy("_id").agg(F.min(F.struct(*sorted(COLUMNS, key=lambda c: c == "text"))).alias("r")).select("r.*")
    return kept.select(COLUMNS).unionByName(docs.filter("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds go; so do documents of which nothing is left.

    What stays of a text keeps its words, joined by one space; untouched texts (null and empty ones too) stay as they are. Rows that share a
    doc_id take nothing from each other, and rows without one neither lose nor take; whole texts are read. Further columns are dropped;
    an empty table stays empty."""
    ship(spark)
    cleaned = substring_dedup.remove_repeats(docs.select(COLUMNS), width=50).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).withColumn("text", text).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix; the last pass over a source may end inside a document.

    Null sources are one source. Texts without words are not taken. Rows that repeat are documents of their own, each with its share of
    passes; a row comes once for each pass. Further columns are dropped; an empty table stays empty."""
    ship(spark)
    return mixing.mixed(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: the pieces of documents and where they lie.

    Every row is a document, repeats and null doc_ids too; a null text is empty, a long one is cut. Columns other than doc_id and text are
    not read; an empty table stays empty."""
    ship(spark)
    pieces = packing.document_pieces(docs, queries._tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and tokenizers are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again as the next one's documents; a stage's table is
    deleted once the next one's is written, the last one's when the driver ends."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return docs
