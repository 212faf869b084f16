"""Checks written as SQL files. A file begins with comment lines ``-- id: X``, ``-- severity: HIGH``, ``-- title: T``; its statement names views
in braces (``{shifts}``) and settings as ``:as_of``, and returns entity_ids, facility_id, period_start, period_end, message, and may return
key, severity and evidence."""

from __future__ import annotations

import re
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import Settings, Views, drafts
from .issues import SEVERITIES


def header(text: str) -> dict[str, str]:
    """The names and values of the comment lines before the statement."""
    out = {}
    for line in text.splitlines():
        if line.strip() and not line.startswith("--"):
            break
        name, colon, value = line[2:].partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def sql_check(text: str):
    """(id, (severity, title, function)) of a file's text, as ``run_checks`` takes them in ``more``.

    A row whose severity is none of the five can't be a finding: it is left out, and all such rows of the file are one CHECK-ERROR."""
    meta = header(text)
    severity, title = meta["severity"], meta["title"]

    def run(v: Views, s: Settings) -> DataFrame:
        spark = next(iter(v.values())).sparkSession
        values = {k: x for k, x in asdict(s).items() if re.search(rf":{k}\b", text) and not isinstance(x, tuple)}
        named = {k: x for k, x in v.items() if f"{{{k}}}" in text}
        rows = spark.sql(text, args=values, **named)
        ids = F.filter(F.col("entity_ids").cast("array<string>"), lambda i: i.isNotNull())
        col = lambda c: F.col(c) if c in rows.columns else F.lit(None)
        evidence = F.coalesce(F.col("evidence"), F.array()) if "evidence" in rows.columns else F.array()
        found = rows.withColumn("_severity", F.coalesce(col("severity").cast("string"), F.lit(severity)))
        good = F.col("_severity").isin(*SEVERITIES)
        told = F.coalesce(col("message").cast("string"), F.concat(F.lit(f"{title}: "), F.when(F.size(ids) > 0, F.array_join(ids, ", ")).otherwise("unknown entity")))
        out = drafts(found.filter(good), F.coalesce(ids, F.array().cast("array<string>")), facility=col("facility_id"), start=col("period_start"), end=col("period_end"), message=told, key=F.coalesce(col("key").cast("string"), F.lit("")), severity=F.col("_severity"), evidence=evidence)
        bad = found.filter(~good).agg(F.count("*").alias("n"), F.min("_severity").alias("s")).filter("n > 0")
        told = F.format_string("%d rows could not be reported, as of severity '%s'", F.col("n"), F.col("s"))
        lost = drafts(bad, [F.lit(meta["id"])], message=told, key=F.lit(meta["id"]), severity=F.lit("HIGH"))
        return out.withColumn("check_id", F.lit(meta["id"])).unionByName(lost.withColumn("check_id", F.lit("CHECK-ERROR")))

    return meta["id"], (severity, title, run)


def load_sql_checks(folder: str | Path) -> dict:
    """The checks of a folder's ``*.sql`` files by id."""
    return dict(sql_check(p.read_text()) for p in sorted(Path(folder).glob("*.sql")))
