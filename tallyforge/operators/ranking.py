"""Which of several rows counts: newest per key, survivorship by source, the one-to-one guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, key: list[str], received: str, row_id: str) -> DataFrame:
    """The newest row of each key; unknown times count as oldest, ties go to the least id."""
    order = W.partitionBy(*key).orderBy(F.col(received).desc_nulls_last(), F.col(row_id))
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def normalised(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def priority_rank(source: str, priority: list[str]) -> Column:
    """Place of the source in the list; unlisted ones come after all."""
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    return F.when(at > 0, at).otherwise(F.lit(len(priority) + 1)).cast("int")


def survivorship(claims: DataFrame, key: list[str], value: str, source: str, priority: list[str], observed: str, tie: list[str], claim_id: str) -> DataFrame:
    """The golden value of each key: by source priority, then newest, then ``tie``; with the ids of claims that say otherwise.

    key, value, claim_id, source, has_conflict, conflict_ids (in the same order as the ranking)."""
    order = [priority_rank(source, priority), F.col(observed).desc_nulls_last(), *[F.coalesce(F.col(t), F.lit(0)) if t.endswith("_row") else F.col(t) for t in tie], F.col(claim_id)]
    ranked = claims.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    top = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c)))
    grouped = ranked.groupBy(*key).agg(
        top(value).alias("golden"), top(claim_id).alias("golden_claim"), top(source).alias("golden_source"),
        F.array_sort(F.collect_list(F.struct("_rank", F.col(value).cast("string").alias("v"), F.col(claim_id).alias("c")))).alias("_all"),
    )
    other = F.filter("_all", lambda s: ~normalised(s["v"]).eqNullSafe(normalised(F.col("golden"))))
    return grouped.withColumn("conflict_ids", F.transform(other, lambda s: s["c"])).withColumn("has_conflict", F.size("conflict_ids") > 0).drop("_all")


def one_to_one_guard(links: DataFrame, subject: str, owner: str, weight: str, margin: float) -> DataFrame:
    """The best owner of each subject, or none: a lead under ``margin`` over the next owner is ambiguous.

    subject, owner (null if ambiguous), best, lead (null with one owner), ambiguous."""
    best = links.groupBy(subject, owner).agg(F.max(weight).alias("best"))
    order = W.partitionBy(subject).orderBy(F.col("best").desc(), F.col(owner))
    ranked = best.withColumn("_rank", F.row_number().over(order)).withColumn("lead", F.col("best") - F.lead("best").over(order)).filter("_rank = 1")
    ambiguous = F.coalesce(F.col("lead") < F.lit(margin), F.lit(False))
    return ranked.withColumn("ambiguous", ambiguous).select(subject, F.when(~ambiguous, F.col(owner)).alias(owner), "best", "lead", "ambiguous")


def unique_names(df: DataFrame, group: list[str], position: str, name: str) -> DataFrame:
    """Names made unique within a group in order of position: n, n_2, n_3."""
    number = F.row_number().over(W.partitionBy(*group, name).orderBy(position))
    return df.withColumn(name, F.when(number > 1, F.concat_ws("_", F.col(name), number)).otherwise(F.col(name)))


def unique_ids(df: DataFrame, wanted: str, fallback: str, received: str, out: str) -> DataFrame:
    """``wanted`` as the id of the newest row that has it (least ``fallback`` on ties), ``fallback`` of all others and of rows without one."""
    place = F.row_number().over(W.partitionBy(wanted).orderBy(F.col(received).desc_nulls_last(), F.col(fallback)))
    held = F.coalesce(F.col(wanted), F.lit("")) != ""
    return df.withColumn("_place", place).withColumn(out, F.when(held & (F.col("_place") == 1), F.col(wanted)).otherwise(F.col(fallback))).drop("_place")
