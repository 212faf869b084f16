"""Remembered column maps of sources: versions by template, sources that changed, approval, and tables that wait for a person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators.matching import header_jaccard

#: Who is asked about a table by its status.
TASKS = {"review": "schema_mapper", "unknown": "new_source_modeler"}


def new_versions(contracts: DataFrame, fresh: DataFrame, order: str = "table_id") -> DataFrame:
    """fresh(template, columns, ...) with fingerprint, version (one after the template's last; several in order) and contract_id, not approved."""
    last = contracts.groupBy("template").agg(F.max("version").alias("_last"))
    number = F.row_number().over(W.partitionBy("template").orderBy(order))
    out = fresh.join(last, "template", "left").withColumn("fingerprint", text.header_fingerprint(F.col("columns"))).withColumn("version", F.coalesce("_last", F.lit(0)) + number).drop("_last")
    name = F.concat(F.col("template"), F.lit(":v"), F.col("version").cast("string"), F.lit(":"), F.substring("fingerprint", 1, 8))
    return out.withColumns({"contract_id": name, "approved": F.lit(False)})


def drifted(tables: DataFrame, contracts: DataFrame, least: float = 0.5) -> DataFrame:
    """tables(table_id, template, columns) with drift: whether a contract(template, columns) of another header shares half of its columns with it.
    Headers are metadata: a join by template meets a few rows."""
    old = contracts.select("template", F.col("columns").alias("_old")).distinct()
    other = text.header_fingerprint(F.col("columns")) != text.header_fingerprint(F.col("_old"))
    near = F.coalesce(other & (header_jaccard(F.col("columns"), F.col("_old")) >= least), F.lit(False))
    found = tables.join(old, "template", "left").groupBy("table_id").agg(F.bool_or(near).alias("drift"))
    return tables.join(found, "table_id")


def approve(contracts: DataFrame, contract_ids: list[str]) -> DataFrame:
    return contracts.withColumn("approved", F.col("approved") | F.col("contract_id").isin(*contract_ids))


def review_queue(tables: DataFrame) -> DataFrame:
    """tables(table_id, status, confidence, ...) that wait for a person, each with its task, surest first."""
    task = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])[F.col("status")]
    return tables.withColumn("task", task).filter("task is not null").orderBy(F.desc("confidence"), "table_id")
