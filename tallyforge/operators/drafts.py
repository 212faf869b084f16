"""Findings that stages make beside the checks: files and tables, legends, identities, and decisions from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.similarity import jaro_winkler, similarity_column

from .checks import drafts

#: What becomes of a file or table by its status: check and severity.
FILE_CHECKS = {"quarantined": ("FILE-QUARANTINED", "HIGH"), "failed": ("FILE-FAILED", "HIGH")}
TABLE_CHECKS = {"unknown": ("TABLE-UNMAPPED", "HIGH"), "review": ("MAPPING-REVIEW", "MEDIUM"), "empty": ("TABLE-EMPTY", "LOW")}


def _by_status(df: DataFrame, table: dict[str, tuple[str, str]], entity: str, message: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for k, (c, s) in table.items() for x in (k, f"{c}|{s}")])
    rows = df.withColumn("_n", names[F.col("status")]).filter("_n is not null")
    found = drafts(rows.withColumn("_c", F.split_part("_n", F.lit("|"), F.lit(1))), [F.col(entity)], message=F.col(message), key=F.col("_c"), severity=F.split_part("_n", F.lit("|"), F.lit(2)))
    return found.withColumn("check_id", F.col("key"))


def file_drafts(files: DataFrame) -> DataFrame:
    """files(file_id, status, error): quarantined and failed ones."""
    return _by_status(files, FILE_CHECKS, "file_id", "error")


def table_drafts(tables: DataFrame) -> DataFrame:
    """tables(table_id, status, note): unmapped, to be reviewed, empty."""
    return _by_status(tables, TABLE_CHECKS, "table_id", "note")


def legend_mismatch_drafts(shifts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """LEGEND-MISMATCH, one for each file and token: hours by the times differ from the legend's. The times win.

    shifts: file_id, record_id, token, hours (by the times), legend_hours."""
    off = shifts.filter(F.abs(F.col("hours") - F.col("legend_hours")) > tolerance)
    grouped = off.groupBy("file_id", "token").agg(F.min("hours").alias("h"), F.min("legend_hours").alias("l"), F.count("*").alias("n"))
    return drafts(grouped, [F.col("file_id")], message=F.concat(F.col("token"), F.lit(": "), F.col("l").cast("string"), F.lit(" by the legend, "), F.col("h").cast("string"), F.lit(" by its times")), key=F.col("token"))


def gray_pair_drafts(scored: DataFrame, owners: DataFrame) -> DataFrame:
    """ID-GRAY-PAIR: likely links (zone 'gray' of a, b, prob, zone) between records that ended up as different persons."""
    rows = _with_persons(scored.filter("zone = 'gray'"), owners).filter("pa <> pb")
    return drafts(rows, F.array_sort(F.array("pa", "pb")), message=F.concat(F.lit("Perhaps one person, probability "), F.round("prob", 3).cast("string")), key=F.concat_ws("|", "a", "b"))


def identity_conflict_drafts(links: DataFrame, owners: DataFrame) -> DataFrame:
    """ID-CONFLICT: strong links whose ends a fact kept apart; one for each pair of persons."""
    rows = _with_persons(links, owners).filter("pa <> pb").select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"), "prob")
    grouped = rows.groupBy("x", "y").agg(F.max("prob").alias("p"))
    return drafts(grouped, F.array("x", "y"), message=F.lit("Linked, but facts differ"), key=F.concat_ws("|", "x", "y"))


def ambiguous_drafts(guarded: DataFrame, subject: str) -> DataFrame:
    """ID-AMBIGUOUS: subjects of ``one_to_one_guard`` whose best two owners are too close."""
    return drafts(guarded.filter("ambiguous"), [F.col(subject)], message=F.concat(F.lit("Two owners within "), F.round("lead", 2).cast("string"), F.lit(" bits")))


def name_differs_drafts(licences: DataFrame, least: float = 0.85) -> DataFrame:
    """ID-NAME-DIFFERS-ON-LICENSE: licences(credential_id, person_id, licence_family, person_family) with dissimilar family names."""
    rows = licences.filter("licence_family is not null and person_family is not null and licence_family <> person_family")
    rows = rows.filter(similarity_column(jaro_winkler, F.col("licence_family"), F.col("person_family")) < least)
    return drafts(rows, [F.col("credential_id"), F.col("person_id")], message=F.concat_ws(" / ", "licence_family", "person_family"))


def _with_persons(links: DataFrame, owners: DataFrame) -> DataFrame:
    of = lambda end, out: owners.select(F.col("record_id").alias(end), F.col("person_id").alias(out))
    return links.join(of("a", "pa"), "a").join(of("b", "pb"), "b")


def accepted_maps(decisions: DataFrame, shares: DataFrame, required: list[str], least: float = 0.8) -> DataFrame:
    """table_id and accepted of mapping decisions(table_id, col_name, field): each field once, all required ones there, and at least
    ``least`` of each column's values valid. shares: table_id, col_name, field, share."""
    rows = decisions.join(shares, ["table_id", "col_name", "field"], "left")
    grouped = rows.groupBy("table_id").agg(F.count("*").alias("n"), F.count_distinct("field").alias("fields"), F.collect_set("field").alias("names"), F.min(F.coalesce("share", F.lit(0.0))).alias("worst"))
    return grouped.select("table_id", ((F.col("n") == F.col("fields")) & (F.size(F.array_except(F.array(*[F.lit(f) for f in required]), "names")) == 0) & (F.col("worst") >= least)).alias("accepted"))


def swapped_columns(rows: DataFrame, later: str, earlier: str) -> bool:
    """Whether a pair of date columns is the wrong way round in more than half of the rows."""
    bad = rows.agg(F.avg((F.col(later) < F.col(earlier)).cast("double")).alias("s")).first()["s"]
    return bool(bad and bad > 0.5)
