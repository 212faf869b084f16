"""Grids out of positioned words: lines, columns, titles and scores of pages. A page is a group of words; what is
sequential within a page (a line is compared with its first word) runs as a grouped map, pages in parallel."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text

# Names of weekdays by which a page looks like a schedule.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def line_numbers(tops: list[float], tolerance: float = 3.0) -> list[int]:
    """The line of each word, words by top: a new line begins where a word is over ``tolerance`` below the line's first."""
    out, number, first = [], -1, None
    for y in tops:
        if first is None or y - first > tolerance:
            number, first = number + 1, y
        out.append(number)
    return out


def column_bounds(spans: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    """Corridors of x: spans merged wherever less than ``gap`` lies between them."""
    out: list[list[float]] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] < gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def words_to_cells(words: DataFrame, gap_share: float = 0.6, tolerance: float = 3.0) -> DataFrame:
    """words(page, x0, x1, top, size, word) to (page, line, col, cell): words of a line and corridor joined by spaces."""

    def page(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["top", "x0"], kind="stable")
        df["line"] = line_numbers(df["top"].tolist(), tolerance)
        bounds = column_bounds(list(zip(df["x0"], df["x1"], strict=True)), gap_share * float(df["size"].median()))
        df["col"] = [next(i for i, (a, b) in enumerate(bounds) if a <= x <= b) for x in df["x0"]]
        df = df.sort_values(["line", "col", "x0"], kind="stable")
        out = df.groupby(["page", "line", "col"], as_index=False)["word"].agg(" ".join)
        return out.rename(columns={"word": "cell"})

    return words.groupBy("page").applyInPandas(page, "page long, line int, col int, cell string")


def grid_scores(cells: DataFrame, header_words: list[str]) -> DataFrame:
    """page and score: share of header cells that are known words, times share of body cells that are shift tokens or names, times
    share of lines as wide as the widest."""
    lines = cells.groupBy("page", "line").agg(F.count("*").alias("w"))
    widest = lines.groupBy("page").agg(F.max("w").alias("most"))
    shape = lines.join(widest, "page").groupBy("page").agg(F.avg((F.col("w") == F.col("most")).cast("double")).alias("shape"))
    known = text.clean(F.col("cell")).isin(*header_words) | F.lower(F.substring("cell", 1, 3)).isin(*WEEKDAYS)
    head = cells.filter("line = 0").groupBy("page").agg(F.avg(known.cast("double")).alias("head"))
    valid = text.parse_shift(F.col("cell"))["kind"].isNotNull() | F.col("cell").rlike(r"^[\p{L}'., -]+$")
    body = cells.filter("line > 0").groupBy("page").agg(F.avg(valid.cast("double")).alias("body"))
    return head.join(body, "page", "left").join(shape, "page").select("page", F.round(F.col("head") * F.coalesce("body", F.lit(0.0)) * F.col("shape"), 6).alias("score"))


def looks_like_schedule(page_text: str) -> bool:
    """Three different weekdays, or three shift tokens."""
    found = {w[:3] for w in re.findall(r"[a-z]+", page_text.lower()) if w[:3] in WEEKDAYS}
    return len(found) >= 3 or len(re.findall(r"\b\d{1,2}(?::\d{2})?[ap]m?\s*[-–]\s*\d{1,2}(?::\d{2})?[ap]m?\b", page_text.lower())) >= 3


def blank_pages(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages of a document that gave no table: they stay visible as empty ones."""
    return pages.join(tables.select("file_id", "page").distinct(), ["file_id", "page"], "left_anti")


def page_contexts(lines: list[tuple[int, str]], tables: list[tuple[int, int]]) -> list[dict[str, str | None]]:
    """Title and footnote of each table (first and last line) of a page: the last two lines above it not of another table, and the lines
    after it up to the next; a table without a title has the one before's."""
    out: list[dict[str, str | None]] = []
    before = None
    for k, (first, last) in enumerate(tables):
        start = tables[k - 1][1] if k else -1
        stop = tables[k + 1][0] if k + 1 < len(tables) else 10**9
        above = [t for n, t in lines if start < n < first and not t.lower().startswith(("legend", "note", "*"))]
        below = [t for n, t in lines if last < n < stop]
        notes = [t for t in below if k + 1 == len(tables) or t.lower().startswith(("legend", "note", "*")) or re.search(r"\bhours?\b", t)]
        title = above[-2] if len(above) > 1 else above[-1] if above else before
        out.append({"title": title, "subtitle": above[-1] if len(above) > 1 else None, "footnote": " ".join(notes) or None})
        before = title
    return out
