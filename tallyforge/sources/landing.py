"""Landing files: content-addressed, parsed in tasks to one long table of text cells, known content skipped."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsing import PARSERS, run_auction

CELLS = "file_id string, file_name string, parser string, status string, error string, table_id string, sheet string, src_row long, col_idx int, col_name string, value string"


def read_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """file_id (sha256), file_name, received_at, length, content of the files under a path; without those whose id is in
    ``known(file_id, status)``, unless they were quarantined or failed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.sha2("content", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("received_at"), "length", "content")
    if known is not None:
        done = known.filter(~F.col("status").isin("quarantined", "failed")).select("file_id").distinct()
        files = files.join(done, "file_id", "left_anti")
    return files.dropDuplicates(["file_id"])


def parse_files(files: DataFrame, least: float = 0.5) -> DataFrame:
    """The cells of all tables of ``files(file_id, file_name, content)``: a row a cell (null cells left out), or one row with a status of
    'quarantined' (no parser bids enough) or 'failed' for a file without tables."""

    def parse(batches):
        for batch in batches:
            for file_id, name, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                winner, bids = run_auction(content, least)
                rows, status, error = [], "parsed", None
                if winner is None:
                    status, error = "quarantined", "; ".join(f"{b.parser} {b.score:.2f} {b.reason}" for b in bids)
                else:
                    try:
                        for n, t in enumerate(PARSERS[winner][1](content)):
                            table_id = hashlib.sha256(f"{file_id}|{n}".encode()).hexdigest()[:16]
                            rows += [(table_id, t.sheet, line, i, c, v) for r, line in zip(t.rows, t.lines, strict=True) for i, (c, v) in enumerate(zip(t.columns, r, strict=True)) if v is not None]
                    except Exception as e:  # one broken file is its own failure
                        status, error, rows = "failed", f"{type(e).__name__}: {e}", []
                rows = rows or [(None,) * 6]
                for at in range(0, len(rows), 50_000):
                    part = rows[at : at + 50_000]
                    fixed = [[file_id] * len(part), [name] * len(part), [winner] * len(part), [status] * len(part), [error] * len(part)]
                    kinds = [pa.string()] * 7 + [pa.int64(), pa.int32(), pa.string(), pa.string()]
                    columns = [*fixed, *map(list, zip(*part, strict=True))]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in CELLS.split(", ")])

    return files.select("file_id", "file_name", "content").mapInArrow(parse, CELLS)


def table_rows(cells: DataFrame) -> DataFrame:
    """table_id, src_row and raw (column to text) of every row of the parsed tables."""
    entries = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "value"))), lambda s: F.struct(s["col_name"], s["value"])))
    return cells.filter("table_id is not null").groupBy("file_id", "file_name", "table_id", "sheet", "src_row").agg(entries.alias("raw"))


def headers(cells: DataFrame) -> DataFrame:
    """table_id and its column names in order (columns with any value)."""
    names = F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "col_name"))), lambda s: s["col_name"])
    return cells.filter("table_id is not null").groupBy("file_id", "file_name", "table_id").agg(names.alias("columns"))
