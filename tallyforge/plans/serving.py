"""The read side: dashboards, lists, the shift grid, the credential horizon, and table rewrites."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import days_left_band
from tallyforge.operators.issues import severity_rank


def all_of(filters: dict[str, object]) -> Column:
    """The conjunction of equality filters; None leaves its column free."""
    return reduce(lambda x, y: x & y, [F.col(c) == v for c, v in filters.items() if v is not None], F.lit(True))


def summary(issues: DataFrame) -> DataFrame:
    """Active issues by severity and status."""
    return issues.filter("active").groupBy("severity", "status").agg(F.count("*").alias("n"))


def files_with_tables(files: DataFrame, tables: DataFrame) -> DataFrame:
    """Files by arrival, each with the list of its tables and their templates."""
    nested = tables.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "template", "n_rows"))).alias("tables"))
    return files.join(nested, "file_id", "left").orderBy("received_at", "file_id")


def issue_list(issues: DataFrame, persons: DataFrame, person_id: str | None = None, **filters) -> DataFrame:
    """Active issues that pass the filters (and name the person, if given), worst first, with the first person's name."""
    rows = issues.filter("active").filter(all_of(filters))
    if person_id is not None:
        rows = rows.filter(F.array_contains("entity_ids", person_id))
    named = rows.withColumn("_person", F.get(F.filter("entity_ids", lambda i: i.startswith("P-")), F.lit(0)))
    named = named.join(persons.select(F.col("person_id").alias("_person"), "display_name"), "_person", "left").drop("_person")
    return named.orderBy(severity_rank(F.col("severity")), "check_id", "fingerprint")


def people_list(persons: DataFrame, issues: DataFrame, search: str | None = None) -> DataFrame:
    """Persons by name with their number of open issues; ``search`` is part of a name or id, of any case."""
    open_issues = issues.filter("active and status = 'open'").select(F.explode(F.array_distinct("entity_ids")).alias("person_id")).groupBy("person_id").agg(F.count("*").alias("open_issues"))
    rows = persons.join(open_issues, "person_id", "left").withColumn("open_issues", F.coalesce("open_issues", F.lit(0)))
    if search:
        rows = rows.filter(F.col("display_name").ilike(f"%{search}%") | F.col("person_id").ilike(f"%{search}%"))
    return rows.orderBy("display_name", "person_id")


def person_detail(person_id: str, views: dict[str, DataFrame], issues: DataFrame, claims: DataFrame, golden: DataFrame, links: DataFrame, owners: DataFrame, as_of: date) -> dict[str, DataFrame]:
    """What is known of one person, a table a part: person (with open_issues), credentials (with days_left), golden (each with its claims in
    order of time), links of their records, shifts by day, and the issues that name them. Each is a filter or a join on the ids of one person."""
    me = F.lit(person_id)
    held = views["credentials"].filter(F.col("holder_id") == me).withColumn("days_left", F.datediff("expires_on", F.lit(as_of)))
    mine = held.select(F.col("credential_id").alias("entity_id")).unionByName(views["persons"].filter(F.col("person_id") == me).select(F.col("person_id").alias("entity_id"))).distinct()
    said = claims.join(F.broadcast(mine), "entity_id", "left_semi").groupBy("entity_id", "attribute").agg(F.array_sort(F.collect_list(F.struct("observed_at", "claim_id", "source", "value"))).alias("claims"))
    records = F.broadcast(owners.filter(F.col("person_id") == me).select("record_id"))
    ends = [links.join(records, links[end] == records["record_id"], "left_semi") for end in ("a", "b")]
    return {
        "person": people_list(views["persons"].filter(F.col("person_id") == me), issues),
        "credentials": held,
        "golden": golden.join(F.broadcast(mine), "entity_id", "left_semi").join(said, ["entity_id", "attribute"], "left"),
        "links": ends[0].unionByName(ends[1]).dropDuplicates(["a", "b"]),
        "shifts": views["shifts"].filter(F.col("person_id") == me).orderBy("work_date", "shift_id"),
        "issues": issue_list(issues, views["persons"], person_id),
    }


def runs_list(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs, the newest first, with the number of files of each."""
    n = files.groupBy("run_id").agg(F.count("*").alias("file_count"))
    return runs.join(n, "run_id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0))).orderBy(F.desc("started_at"), "run_id")


def shift_grid(views: dict[str, DataFrame], first: date, last: date, as_of: date) -> DataFrame:
    """A row per facility and person: cells by day, hours as a nurse by day, and whether any licence is unexpired."""
    shifts = views["shifts"].filter(F.col("work_date").between(F.lit(first), F.lit(last)))
    daily = shifts.groupBy("facility_id", "person_id", "work_date").agg(F.array_join(F.array_sort(F.collect_list(F.date_format("start_ts", "HH:mm"))), "/").alias("cell"), F.sum(F.when(F.col("role") == "RN", F.col("hours")).otherwise(0.0)).alias("rn"))
    grid = daily.groupBy("facility_id", "person_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("work_date", "cell")))).alias("cells"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("work_date", "rn")))).alias("rn_hours"))
    valid = views["credentials"].filter(F.col("expires_on") >= F.lit(as_of)).select(F.col("holder_id").alias("person_id")).distinct().withColumn("license_valid", F.lit(True))
    return grid.join(valid, "person_id", "left").withColumn("license_valid", F.coalesce("license_valid", F.lit(False)))


def credential_horizon(credentials: DataFrame, as_of: date) -> DataFrame:
    """Credentials with days left and their band, soonest first; those over 90 days off are left out."""
    rows = credentials.withColumn("days_left", F.datediff("expires_on", F.lit(as_of)))
    return rows.withColumn("band", days_left_band(F.col("days_left"))).filter("band is not null").orderBy("days_left", "credential_id")


def patch_issues(issues: DataFrame, patches: DataFrame) -> DataFrame:
    """The state with status, owner and note of patches(fingerprint, status, owner, note) set where they are not null."""
    p = patches.select("fingerprint", *[F.col(c).alias(f"_{c}") for c in ("status", "owner", "note")])
    out = issues.join(p, "fingerprint", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "owner", "note")}).select(*issues.columns)


def upsert(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The next version of a table: rows replace those of equal key. Parquet has no merge, so the caller writes it anew."""
    return current.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def replace_tables(rows: DataFrame, path: str, partition: str = "table_id") -> None:
    """Writes the rows, replacing only the partitions that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
