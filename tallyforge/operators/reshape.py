"""Wide to long and back: claims from records, golden tables from claims, shift grids, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_claims(records: DataFrame, entity: str, attributes: list[str], keep: list[str] = ()) -> DataFrame:
    """A row for each attribute of a record that has a value (not null, not blank): entity_id, attribute, value."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = records.select(F.col(entity).alias("entity_id"), *keep, F.explode(pairs).alias("c"))
    return long.select("entity_id", *keep, "c.attribute", "c.value").filter("value is not null and value <> ''")


def pivot_wide(claims: DataFrame, attributes: list[str]) -> DataFrame:
    """A row per entity with a column per attribute; the attributes are given, so no pass over the data finds them."""
    return claims.groupBy("entity_id").agg(*[F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes])


def shift_grid(shifts: DataFrame, group: list[str], day: str, cell: str) -> DataFrame:
    """A row per group with ``days``: the cells as JSON text by day, in order of days."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(day).cast("string").alias("d"), F.col(cell).cast("string").alias("c"))))
    return shifts.groupBy(*group).agg(F.array_join(F.transform(entries, lambda e: F.concat(e["d"], F.lit("="), e["c"])), ";").alias("days"))


def profile(df: DataFrame, table_id: str, columns: list[str], validators: dict[str, str]) -> DataFrame:
    """A row per column: rows, nulls (or blank), distinct values, and the share of values that each validator (a regular expression)
    matches in full; with fewer than two values the share is of two. Columns are unpivoted, so the table is read once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", F.when(F.col("p.value") != "", F.col("p.value")).alias("value"))
    hits = [F.sum(F.coalesce(F.col("value").rlike(f"^(?:{rule})$").cast("int"), F.lit(0))).alias(f"_hit_{name}") for name, rule in validators.items()]
    out = long.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value").isNull().cast("int")).cast("long").alias("n_null"), F.count_distinct("value").alias("n_distinct"), F.count("value").alias("_n"), *hits)
    shares = [F.round(F.col(f"_hit_{name}") / F.greatest(F.col("_n"), F.least(F.lit(2), F.col("n_rows"))), 6).alias(f"share_{name}") for name in validators]
    return out.select(F.lit(table_id).alias("table_id"), "column", "n_rows", "n_null", "n_distinct", *shares)
