"""One run of the whole engine over a folder of files: cells, maps, silver, persons, gold, findings, each stage a written table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import checks, drafts, issues, linking
from tallyforge.operators.graph import settled
from tallyforge.operators.matching import Mapping, map_tables
from tallyforge.sources.landing import parse_files, read_files

from . import contracts as ct
from . import engine, schedules
from .pack import Pack


@dataclasses.dataclass
class Run:
    """The tables of a run by name, and the contracts that it used or made."""

    tables: dict[str, DataFrame]
    contracts: dict[str, Mapping]

    def write(self, path: str) -> None:
        """All tables as Parquet under the folder, replacing those of the run before."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def run(spark: SparkSession, path: str, pack: Pack, settings: checks.Settings, run_id: str, known: DataFrame | None = None, contracts: dict[str, Mapping] | None = None, more: dict | None = None, notes: DataFrame | None = None, extra_links: DataFrame | None = None) -> Run:
    """Reads, maps, normalises, links, decides, checks. ``known``: the issues of the run before, which keep what people set of them;
    ``more``: further checks by id (``sql_checks.load_sql_checks``); ``notes``: (table_id, note) legends of schedules;
    ``extra_links``: (a, b, weight, prob, reasons) that people decided on. Schedules are dated by the pay periods of this very run, so a
    payroll that comes later dates them anew."""
    contracts = {} if contracts is None else contracts
    files = read_files(spark, path)
    cells = settled(parse_files(files))
    table_files = cells.filter("table_id is not null").select("file_id", "table_id").distinct()
    received = settled(table_files.join(files.select("file_id", F.col("received_at").alias("received")), "file_id").select("table_id", "received"))
    found = schedules.find_schedules(cells, pack)
    names = [t for t, _, _ in found]
    plain = cells.filter(F.col("table_id").isNull() | ~F.col("table_id").isin(*names)) if names else cells
    maps = map_tables(plain, pack, contracts)
    records = settled(engine.silver(spark, plain, maps, pack))
    rows, cell_issues = schedules.schedule_tables(cells, found, schedules.anchors(records), pack, notes) if found else (None, None)
    if rows is not None:
        rows = settled(rows)
        cell_issues = settled(cell_issues)
    persons = settled(engine.person_records(records, rows, pack))
    owners, links, scored = engine.resolve_all(persons, pack, extra=extra_links)
    owners, links = settled(owners), settled(links)
    said = settled(engine.claims(records, owners))
    best = settled(engine.golden(said, pack))
    views = {k: settled(v) for k, v in engine.gold_views(spark, records, rows, owners, persons, said, best, pack, received).items()}

    tables = spark.createDataFrame([(t, m.template, cols, float(m.confidence), s) for t, cols, m, s in maps], "table_id string, template string, columns array<string>, confidence double, status string")
    status = cells.groupBy("file_id", "file_name").agg(F.max("status").alias("status"), F.max("error").alias("error"))
    noted = tables.withColumn("note", F.format_string("confidence %.2f", "confidence"))
    parsed = records.select("record_id", "parse_issues") if cell_issues is None else records.select("record_id", "parse_issues").unionByName(cell_issues)
    stages = {
        "SRC-CONFLICT": ("MEDIUM", "Sources disagree", lambda v, s: engine.conflict_drafts(best, said)),
        "ID-FUZZY-LINK": ("INFO", "Linked by a similar name", lambda v, s: engine.fuzzy_link_drafts(links, persons)),
        "ID-GRAY-PAIR": ("MEDIUM", "Perhaps one person", lambda v, s: drafts.gray_pair_drafts(scored, owners)),
        "ID-CONFLICT": ("HIGH", "Linked, but facts differ", lambda v, s: drafts.identity_conflict_drafts(links.filter("prob >= 0.95"), owners)),
        "FILES": ("HIGH", "A file could not be read", lambda v, s: drafts.file_drafts(status)),
        "TABLES": ("HIGH", "A table could not be mapped", lambda v, s: drafts.table_drafts(noted)),
        "PARSE": ("MEDIUM", "A value could not be read for sure", lambda v, s: checks.parse_issue_drafts(parsed)),
        "ID-NAME-DIFFERS-ON-LICENSE": ("MEDIUM", "Another family name on the licence", lambda v, s: drafts.name_differs_drafts(_licence_names(persons, owners))),
        **(more or {}),
    }
    if rows is not None:
        at = rows.join(table_files, "table_id").select("file_id", "record_id", "token", F.col("shift.hours").alias("hours"), "legend_hours")
        stages["LEGEND-MISMATCH"] = ("MEDIUM", "Hours differ from the legend's", lambda v, s: drafts.legend_mismatch_drafts(at))
    drafted = settled(checks.run_checks(views, settings, more=stages))
    numbered = drafted.withColumn("seq", F.monotonically_increasing_id())
    if known is None:
        known = spark.createDataFrame([], "fingerprint string, check_id string, severity string, message string, status string, owner string, note string, first_seen_run string, last_seen_run string, active boolean")
    state = settled(issues.merge_issues(known, numbered.select("fingerprint", "check_id", "severity", "message", "seq"), run_id))
    person_records = linking.best_prob(links, owners.join(records.select("record_id", "template"), "record_id", "left"), "record_id")
    out = {"files": status, "tables": tables, "review_queue": ct.review_queue(tables), "records": records, "links": links, "person_records": person_records, "claims": said, "golden_values": best, "drafts": drafted, "issues": state}
    out |= {f"gold_{k}": v for k, v in views.items()} | {"pbj": engine.pbj(views, pack, settings)}
    if rows is not None:
        out["shifts_silver"] = rows
    return Run(out, contracts)


def _licence_names(persons: DataFrame, owners: DataFrame) -> DataFrame:
    """credential_id, person_id and the family names on the licence and on the roster."""
    named = linking.person_keys(persons, "name").withColumn("family", F.col("key.family")).join(owners, "record_id")
    roster = named.filter("is_hr").groupBy("person_id").agg(F.min("family").alias("person_family"))
    licences = named.filter("template = 'license' and credential_number is not null")
    return licences.select(F.col("credential_number").alias("credential_id"), "person_id", F.col("family").alias("licence_family")).join(roster, "person_id")
