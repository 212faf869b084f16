"""Issues: fingerprints, evidence, and the merge of a run's findings with what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
CSV_COLUMNS = ["fingerprint", "check_id", "severity", "title", "message", "entities", "facility_id", "period_start", "period_end", "status", "owner", "note", "first_seen_run", "evidence"]


def text_or_none(value: Column) -> Column:
    """A value as it is written into an id: null is the text None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def fingerprint(check_id: Column, entity_ids: Column, period_start: Column, period_end: Column, key: Column) -> Column:
    """16 hex digits of sha1 over check, sorted entity ids, period and key: the same finding has it in every run."""
    return F.substring(F.sha1(F.concat_ws("|", check_id, F.array_join(F.array_sort(entity_ids), ","), text_or_none(period_start), text_or_none(period_end), F.coalesce(key, F.lit("")))), 1, 16)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def merge_issues(known: DataFrame, found: DataFrame, run_id: str) -> DataFrame:
    """The next state of all issues. A finding met before keeps status, owner, note and first_seen_run, and takes the new
    text; one not found again is inactive; of equal fingerprints in one run the last (largest ``seq``) counts.

    known: fingerprint, check_id, severity, message, status, owner, note, first_seen_run, last_seen_run, active.
    found: fingerprint, check_id, severity, message, seq."""
    last = found.withColumn("_n", F.row_number().over(W.partitionBy("fingerprint").orderBy(F.col("seq").desc()))).filter("_n = 1")
    k, f = known.alias("k"), last.alias("f")
    both = k.join(f, F.col("k.fingerprint") == F.col("f.fingerprint"), "full_outer")
    seen = F.col("f.fingerprint").isNotNull()
    pick = lambda c: F.when(seen, F.col(f"f.{c}")).otherwise(F.col(f"k.{c}")).alias(c)
    return both.select(
        F.coalesce("f.fingerprint", "k.fingerprint").alias("fingerprint"), pick("check_id"), pick("severity"), pick("message"),
        F.coalesce("k.status", F.lit("open")).alias("status"), F.col("k.owner").alias("owner"), F.col("k.note").alias("note"),
        F.coalesce("k.first_seen_run", F.lit(run_id)).alias("first_seen_run"),
        F.when(seen, F.lit(run_id)).otherwise(F.col("k.last_seen_run")).alias("last_seen_run"), seen.alias("active"),
    )


def enrich_evidence(issues: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence of every issue from its references in one job: an item for each reference, with the record's place and row.

    issues: issue_id, refs array<string>; records: ref, source, locator, raw. A reference without a record is a note."""
    refs = issues.select("issue_id", F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(records, "ref", "left")
    item = F.struct("pos", "ref", F.when(F.col("locator").isNull(), F.lit("note")).otherwise(F.lit("record")).alias("kind"), "source", "locator", "raw")
    items = found.groupBy("issue_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return issues.join(items, "issue_id", "left")


def issues_csv(issues: DataFrame, columns: list[str] = CSV_COLUMNS) -> DataFrame:
    """Active issues as rows of text, worst first: entities joined by '; ', evidence by ' | '."""
    rows = issues.filter("active").withColumn("entities", F.array_join("entity_ids", "; ")).withColumn("evidence", F.array_join("evidence_text", " | "))
    present = [c for c in columns if c in rows.columns]
    return rows.orderBy(severity_rank(F.col("severity")), "check_id", "fingerprint").select(*[F.col(c).cast("string").alias(c) for c in present])
