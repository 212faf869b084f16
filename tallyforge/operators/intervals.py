"""Interval operators: overlaps, merged coverage, splits at midnight, and the one period that holds a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlapping_pairs(df: DataFrame, key: list[str], row_id: str, start: str, end: str, *, closed: bool = False, bucket_seconds: int | None = None, keep: list[str] = ()) -> DataFrame:
    """Pairs (a, b; a's id is the smaller) of one key's intervals that overlap: half-open, or closed at both ends. Null keys match.

    With ``bucket_seconds`` intervals are cut into time buckets first, so a key with very many intervals meets only those near
    in time; a pair counts in the bucket where its later start lies. Without, the join is on the key with the range as residual.
    """
    ends = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
    names = [row_id, start, end, *keep]
    left = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"a_{c}") for c in names])
    right = df.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"b_{c}") for c in names])
    on = [F.col(f"_k{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(key))]
    if bucket_seconds:
        number = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000 * bucket_seconds))
        for side, name in (("a", "_kb"), ("b", "_rb")):
            spans = F.sequence(number(F.col(f"{side}_{start}")), number(F.col(f"{side}_{end}")))
            left, right = (left.withColumn(name, F.explode(spans)), right) if side == "a" else (left, right.withColumn(name, F.explode(spans)))
        on += [F.col("_kb") == F.col("_rb"), F.col("_kb") == F.greatest(number(F.col(f"a_{start}")), number(F.col(f"b_{start}")))]
    on += [F.col(f"a_{row_id}") < F.col(f"b_{row_id}"), ends(F.col(f"a_{start}"), F.col(f"b_{end}")), ends(F.col(f"b_{start}"), F.col(f"a_{end}"))]
    both = left.join(right, _all(on))
    return both.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], *[f"a_{c}" for c in names], *[f"b_{c}" for c in names])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def merged_spans(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Islands of each key's intervals, overlapping or touching ones merged: key, span_start, span_end."""
    order = W.partitionBy(*key).orderBy(start, end)
    seen = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", (F.col(start) > seen).cast("int")).withColumn("_island", F.sum(F.coalesce("_new", F.lit(0))).over(order))
    return marked.groupBy(*key, "_island").agg(F.min(start).alias("span_start"), F.max(end).alias("span_end")).drop("_island")


def day_parts(df: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval cut at midnights: day, part_start, part_end added, a row a day. Empty intervals give none."""
    days = F.sequence(F.to_date(start), F.to_date(F.expr(f"{end} - INTERVAL 1 MICROSECOND")))
    cut = df.filter(F.col(start) < F.col(end)).withColumn("day", F.explode(days))
    midnight = F.col("day").cast("timestamp_ntz")
    return cut.withColumn("part_start", F.greatest(F.col(start), midnight)).withColumn("part_end", F.least(F.col(end), midnight + F.expr("INTERVAL 1 DAY")))


def longest_coverage(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key, day, covered_minutes: the longest merged span of each day, intervals cut to the day."""
    spans = merged_spans(day_parts(df, start, end), [*key, "day"], "part_start", "part_end")
    return spans.groupBy(*key, "day").agg(F.max(minutes_between(F.col("span_start"), F.col("span_end"))).alias("covered_minutes"))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60_000_000.0)


def period_of_day(days: DataFrame, periods: DataFrame, key: list[str], day: str, start: str, end: str, prefer: str, row_id: str) -> DataFrame:
    """``days`` with the one period that holds the day: the same ``prefer`` value first, then the earliest start, then the least id.
    An unknown ``prefer`` value, of the day or the period, is as good as a different one.

    A left range join and a rank; the days are keyed by (key, day, prefer)."""
    named = periods.select(*[F.col(k).alias(f"_p_{k}") for k in key], F.col(prefer).alias("_prefer"), *[c for c in (row_id, start, end)])
    on = _all([F.col(k) == F.col(f"_p_{k}") for k in key] + [F.col(day).between(F.col(start), F.col(end))])
    joined = days.join(named, on, "left")
    rank = W.partitionBy(*key, day, prefer).orderBy(F.coalesce(F.col("_prefer") == F.col(prefer), F.lit(False)).desc(), F.col(start).asc_nulls_last(), F.col(row_id).asc_nulls_last())
    return joined.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank", "_prefer", *[f"_p_{k}" for k in key])
