"""Files to grids to raw tables, as pure functions over bytes: what a source parser does inside a task."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from xml.etree import ElementTree

DELIMITERS = (",", ";", "\t", "|")
HEAD_BYTES = 64 * 1024


@dataclass
class RawTable:
    """A table of text: unique column names, rows, and the source line of each row."""

    sheet: str | None
    columns: list[str]
    rows: list[list[str | None]]
    lines: list[int]
    notes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Bid:
    parser: str
    score: float
    reason: str


def decode(data: bytes) -> str:
    """Text by byte order mark (UTF-8's only if the body is UTF-8), else UTF-8, Windows-1252, Latin-1."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if data.startswith(mark):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                data = data.removeprefix(mark)
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def find_delimiter(text: str) -> tuple[str, float] | None:
    """The delimiter whose records most often have their usual width (two at least), and that share; ties go to more columns."""
    best = None
    for d in DELIMITERS:
        widths = [len(r) for _, r in zip(range(200), csv.reader(io.StringIO(text), delimiter=d), strict=False) if any(c.strip() for c in r)]
        if not widths:
            continue
        width, n = Counter(widths).most_common(1)[0]
        if width >= 2 and (best is None or (n / len(widths), width) > (best[1], best[2])):
            best = (d, n / len(widths), width)
    return best[:2] if best else None


def sniff_csv(head: bytes) -> Bid:
    if head.startswith((b"%PDF", b"PK")) or (b"\0" in head and not head.startswith((b"\xff\xfe", b"\xfe\xff"))):
        return Bid("csv", 0.0, "not text")
    if len(head) >= HEAD_BYTES:  # the window may end within a line, or within a letter
        head = head[: head.rfind(b"\n") + 1] or head
    text = decode(head)
    if text.lstrip()[:1] in ("{", "["):
        return Bid("csv", 0.0, "looks like JSON")
    found = find_delimiter(text)
    return Bid("csv", 0.5 + 0.5 * found[1], f"delimiter {found[0]!r}") if found else Bid("csv", 0.0, "no delimiter")


def sniff_json(head: bytes) -> Bid:
    """A table needs an object: a list's first item, a list's first item under a key, or a line of its own."""
    text = decode(head).lstrip()
    tabular = re.match(r'\[\s*\{|\{\s*\}?\s*$|\{[^\n]*\}\s*(\n\s*\{|$)', text) or (text[:1] == "{" and re.search(r'"\s*:\s*\[\s*\{', text))
    return Bid("json", 0.95, "JSON objects") if tabular else Bid("json", 0.0, "no JSON objects")


def sniff_xlsx(head: bytes) -> Bid:
    return Bid("xlsx", 0.98, "spreadsheet archive") if head.startswith(b"PK") and (b"xl/" in head or b"[Content_Types].xml" in head) else Bid("xlsx", 0.0, "no archive")


PARSERS = {}


def register_parser(name: str, sniff, extract) -> None:
    """Adds a format: ``sniff(head) -> Bid`` and ``extract(data) -> list[RawTable]``. Ties of an auction go to the first added."""
    PARSERS[name] = (sniff, extract)


def run_auction(head: bytes, least: float = 0.5) -> tuple[str | None, list[Bid]]:
    """All parsers' bids, best first, and the winner if it bids enough; a parser that fails bids 0."""
    bids = []
    for name, (sniff, _) in PARSERS.items():
        try:
            bids.append(sniff(head[:HEAD_BYTES]))
        except Exception as e:
            bids.append(Bid(name, 0.0, f"failed: {e}"))
    bids.sort(key=lambda b: -b.score)
    return (bids[0].parser if bids and bids[0].score >= least else None), bids


_NUMBER = re.compile(r"^[-+]?[\d,]*\.?\d+$|^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$")


def header_row(rows: list[list[str]], most: int = 20) -> int:
    """Among the first rows the first that is at least half the usual width, all text, mostly unique, and has a number or date
    below it soon; else the first of the usual width; else the first."""
    filled = [[c.strip() for c in r] for r in rows]
    widths = [sum(bool(c) for c in r) for r in filled]
    usual = Counter(w for w in widths if w).most_common(1)
    if not usual:
        return 0
    usual = usual[0][0]
    for i in range(min(most, len(filled))):
        cells = [c for c in filled[i] if c]
        if len(cells) * 2 >= usual and cells and not any(_NUMBER.match(c) for c in cells) and len(set(cells)) >= 0.7 * len(cells):
            if any(_NUMBER.match(c) for r in filled[i + 1 : i + 6] for c in r):
                return i
    return next((i for i in range(min(most, len(filled))) if widths[i] >= usual), 0)


def unique_columns(names: list[str]) -> list[str]:
    seen: Counter = Counter()
    out = []
    for i, n in enumerate(names):
        n = n.strip() or f"column_{i + 1}"
        seen[n] += 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def build_table(grid: list[list[str]], lines: list[int], sheet: str | None = None) -> RawTable | None:
    """A raw table from a grid: header found, cells stripped and wrapped hyphens rejoined, empty rows, nameless empty columns and
    repeated header rows dropped."""
    if not grid:
        return None
    width = max(map(len, grid))
    at = header_row(grid)
    head = [c.strip() for c in grid[at]] + [""] * (width - len(grid[at]))
    rows, kept = [], []
    for r, line in zip(grid[at + 1 :], lines[at + 1 :], strict=True):
        cells = [re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "-", c).strip() for c in r] + [""] * (width - len(r))
        if any(cells) and cells != head:
            rows.append(cells)
            kept.append(line)
    use = [i for i in range(width) if head[i] or any(r[i] for r in rows)]
    names = unique_columns([head[i] for i in use])
    return RawTable(sheet, names, [[r[i] or None for i in use] for r in rows], kept)


def merge_unquoted_names(grid: list[list[str]]) -> list[list[str]]:
    """Rows one cell too wide because of an unquoted 'LAST, FIRST', rejoined if at least 3 and four fifths of them split alike."""
    if len(grid) < 2:
        return grid
    at = header_row(grid)
    width, body = len(grid[at]), grid[at + 1 :]
    wide = [r for r in body if len(r) == width + 1]
    places = [{i for i in range(width) if r[i + 1].startswith(" ") and r[i].strip()} for r in wide]
    shared = set.intersection(*places) if places else set()
    if len(wide) < 3 or len(wide) < 0.8 * len(body) or len(shared) != 1:
        return grid
    k = shared.pop()
    return [*grid[: at + 1], *([*r[:k], f"{r[k]},{r[k + 1]}", *r[k + 2 :]] if len(r) == width + 1 else r for r in body)]


def extract_csv(data: bytes) -> list[RawTable]:
    text = decode(data)
    found = find_delimiter(text)
    reader = csv.reader(io.StringIO(text), delimiter=found[0] if found else ",")
    grid, lines, before = [], [], 0
    for r in reader:
        grid.append(r)
        lines.append(before + 1)  # the line where the record begins, also of quoted fields over several lines
        before = reader.line_num
    out = build_table(merge_unquoted_names(grid), lines)
    return [out] if out else []


def _flat(value, prefix: str = "") -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= _flat(v, f"{prefix}{k}.")
        elif isinstance(v, list):
            out[prefix + k] = json.dumps(v, ensure_ascii=False)
        elif v is None or (isinstance(v, str) and not v.strip()):
            out[prefix + k] = None
        else:
            out[prefix + k] = v if isinstance(v, str) else json.dumps(v)
    return out


def extract_json(data: bytes) -> list[RawTable]:
    """A list of objects, an object of such lists (a table each), or an object a line."""
    text = decode(data)
    try:
        value = json.loads(text)
    except ValueError:
        value = [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(value, dict):
        lists = {k: v for k, v in value.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
        tables = lists or {None: [value]}
    else:
        tables = {None: [x for x in value if isinstance(x, dict)]}
    out = []
    for name, items in tables.items():
        flat = [_flat(x) for x in items]
        names = list(dict.fromkeys(k for f in flat for k in f))
        if names:
            out.append(RawTable(name, names, [[f.get(n) for n in names] for f in flat], list(range(1, len(flat) + 1))))
    return out


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def extract_xlsx(data: bytes) -> list[RawTable]:
    """A table for each sheet with cells; numbers as text without a needless fraction, dates as ISO days by the cell's number format."""
    from datetime import date, timedelta

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        shared = read("xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in shared.findall("m:si", _NS)] if shared is not None else []
        styles, dated = read("xl/styles.xml"), set()
        if styles is not None:
            own = {n.get("numFmtId"): n.get("formatCode", "") for n in styles.iter(f"{{{_NS['m']}}}numFmt")}
            xfs = styles.find("m:cellXfs", _NS)
            for i, xf in enumerate(xfs if xfs is not None else []):
                number = int(xf.get("numFmtId", 0))
                if 14 <= number <= 22 or re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(str(number), "")).lower()):
                    dated.add(str(i))
        links = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in read("xl/workbook.xml").find("m:sheets", _NS):
            target = links[sheet.get(_REL)].lstrip("/")
            root = read(target if target.startswith("xl/") else f"xl/{target}")
            grid, lines = [], []
            for row in root.iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str] = {}
                for c in row.findall("m:c", _NS):
                    v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    kind = c.get("t")
                    text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else (v.text or "") if v is not None else ""
                    if kind == "s" and text:
                        text = strings[int(text)]
                    elif kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif kind in (None, "n") and text:
                        x = float(text)
                        if c.get("s") in dated:
                            text = (date(1899, 12, 30) + timedelta(days=int(x))).isoformat()
                        elif x == int(x):
                            text = str(int(x))
                    cells[_column_number(c.get("r", "A1"))] = text
                if cells:
                    grid.append([cells.get(i, "") for i in range(max(cells) + 1)])
                    lines.append(int(row.get("r", len(lines) + 1)))
            built = build_table(grid, lines, sheet.get("name"))
            if built:
                out.append(built)
        return out


register_parser("csv", sniff_csv, extract_csv)
register_parser("json", sniff_json, extract_json)
register_parser("xlsx", sniff_xlsx, extract_xlsx)
