"""Which column is which field: validators over all values, header similarity, optimal assignment, templates, contracts.

Value shares are one aggregation over the long cell table; what is left are matrices of at most a hundred columns, which the
driver solves."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates, text
from tallyforge.functions.similarity import jaro_winkler, token_sort_ratio

ABBREVIATIONS = {"no": "number", "num": "number", "exp": "expiration", "dt": "date", "emp": "employee", "hrs": "hours", "lic": "license", "nbr": "number"}


def validator(f, aliases: list[tuple[str, str]]) -> Column:
    """Whether ``value`` may be of a pack's field."""
    v = F.trim(F.col("value"))
    if f.pattern:
        return F.upper(v).rlike(f"^(?:{f.pattern})$")
    if f.kind == "vocab":
        return text.clean(v).isin(*{re.sub(r"[\W_]+", " ", a.lower()).strip() for a, _ in aliases})
    if f.kind == "number":
        number = text.parse_number(v)
        return number.isNotNull() & (F.abs(number) <= 10 * (f.most or 1e12))
    if f.kind == "date":
        return dates.parse_any(v).isNotNull()
    if f.kind == "phone":
        return text.normalize_phone(v).isNotNull()
    if f.kind == "email":
        return v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    if f.kind == "person_name":
        return v.rlike(r"^[\p{L}'’.\- ]+(,\s*[\p{L}'’.\- ]+)?$") & v.rlike(r"[ ,]")
    if f.kind == "name_part":
        return v.rlike(r"^[\p{L}'’.\- ]+$") & ~v.rlike(r"\d")
    if f.kind == "shift_cell":
        return text.parse_shift(v)["kind"].isNotNull()
    return v != ""


def value_shares(cells: DataFrame, pack) -> DataFrame:
    """table_id, col_idx, col_name, n, type and the share of values valid for each field (columns v0, v1, ... by the pack's order)."""
    # fields of one rule share a column, and each rule is judged once a value
    rule = lambda f: (f.pattern, f.kind, f.vocab, f.most)
    rules = list(dict.fromkeys(rule(f) for f in pack.fields.values()))
    first = {rule(f): f for f in reversed(pack.fields.values())}
    judged = {f"r{i}": F.coalesce(validator(first[r], pack.aliases(r[2]) if r[2] else []), F.lit(False)) for i, r in enumerate(rules)}
    hits = [F.sum(F.col(f"r{rules.index(rule(f))}").cast("int")).alias(f"h{i}") for i, f in enumerate(pack.fields.values())]
    v = F.trim(F.col("value"))
    number, day = f"r{[r[1] for r in rules].index('number')}" if any(r[1] == "number" for r in rules) else None, f"r{[r[1] for r in rules].index('date')}" if any(r[1] == "date" for r in rules) else None
    kinds = {"integer": v.rlike(r"^[-+]?\d+$"), "number": F.col(number) if number else v.rlike(r"^[-+]?[\d.,]+$"), "bool": F.lower(v).isin("true", "false", "yes", "no", "y", "n"), "date": (F.col(day) & ~v.rlike(r"^\d{5}$")) if day else F.lit(False)}
    alls = [F.every(c).alias(f"all_{k}") for k, c in kinds.items()]
    cells = cells.withColumns(judged)
    grouped = cells.filter("table_id is not null").groupBy("table_id", "col_idx", "col_name").agg(F.count("*").alias("n"), *hits, *alls)
    kind = F.coalesce(*[F.when(F.col(f"all_{k}"), k) for k in kinds], F.lit("string"))
    return grouped.select("table_id", "col_idx", "col_name", "n", kind.alias("type"), *[(F.col(f"h{i}") / F.greatest(F.col("n"), F.lit(2))).alias(f"v{i}") for i in range(len(hits))])


def header_similarity(name: str, synonyms: tuple[str, ...]) -> float:
    plain = lambda s: " ".join(ABBREVIATIONS.get(t, t) for t in re.sub(r"[\W_]+", " ", s.lower()).split())
    return max((max(token_sort_ratio(plain(name), plain(s)) / 100, jaro_winkler(plain(name), plain(s))) for s in synonyms), default=0.0)


FITS = {"number": {"integer", "number"}, "date": {"date", "integer"}}


def match_score(header: float, value: float, type_fits: bool, real_validator: bool) -> float:
    """0.45 header, 0.45 values, 0.10 type; without half of the values at most 0.4; a validator that takes any text only counts with a clear header."""
    if not real_validator and header < 0.8:
        value = 0.0
    score = 0.45 * header + 0.45 * value + 0.10 * type_fits
    return min(score, 0.4) if value < 0.5 else score


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            row = owner[at]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], at
            free = np.where(done[1:], np.inf, least[1:])
            following = int(free.argmin()) + 1
            step = free[following - 1]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = following
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


@dataclass
class Mapping:
    template: str | None
    confidence: float
    columns: dict[str, str]
    coverage: float


def map_table(columns: list[tuple[str, str, list[float]]], pack, no_field: float = 0.35) -> Mapping:
    """The best template of a table of (name, type, value shares) and its column map. Confidence is coverage of what the template
    needs, times mean score, times the share of columns explained; under 0.5 no template is named."""
    names, best = list(pack.fields), Mapping(None, 0.0, {}, 0.0)
    for template in pack.templates:
        fields = list(template.fields)
        score = np.zeros((len(columns), len(fields)))
        for i, (name, kind, shares) in enumerate(columns):
            for j, f in enumerate(fields):
                spec = pack.fields[f]
                real = bool(spec.pattern or spec.kind != "string")
                score[i, j] = match_score(header_similarity(name, spec.synonyms), shares[names.index(f)], kind in FITS.get(spec.kind, {"string", "integer", "number", "bool", "date"}), real)
        cost = 1 - np.concatenate([score, np.full((len(columns), len(columns)), no_field)], axis=1)
        chosen = {fields[j]: (columns[i][0], score[i, j]) for i, j in enumerate(assign(cost)) if j < len(fields) and score[i, j] > no_field}
        needed = [f in chosen for f in template.required] + ([any(all(f in chosen for f in g) for g in template.one_of)] if template.one_of else [])
        coverage = sum(needed) / max(len(needed), 1)
        quality = float(np.mean([s for _, s in chosen.values()])) if chosen else 0.0
        confidence = coverage * quality * (0.5 + 0.5 * len(chosen) / max(len(columns), 1))
        if (confidence, coverage) > (best.confidence, best.coverage):
            best = Mapping(template.name, confidence, {c: f for f, (c, _) in chosen.items()}, coverage)
    return best if best.confidence >= 0.5 else Mapping(None, best.confidence, {}, best.coverage)


def contract_id(columns: list[str]) -> str:
    """Of a header, digits collapsed and in any order: the same export has it every week."""
    return hashlib.sha1("|".join(sorted(re.sub(r"\d+", "0", text.clean_text(c)) for c in columns)).encode()).hexdigest()


def header_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of column names, digits collapsed."""
    a, b = (F.transform(x, text.header_form) for x in (a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def map_tables(cells: DataFrame, pack, contracts: dict[str, Mapping] | None = None, auto: float = 0.8, gray: float = 0.5) -> list[tuple[str, list[str], Mapping, str]]:
    """(table_id, columns, mapping, status) of every table: 'contract' (a remembered map whose values still fit), 'mapped', 'review' or 'unknown'.
    New maps of enough confidence are remembered in ``contracts``; tables are metadata, a few rows each."""
    contracts = {} if contracts is None else contracts
    tables: dict[str, list] = {}
    for r in value_shares(cells, pack).orderBy("table_id", "col_idx").collect():
        tables.setdefault(r["table_id"], []).append((r["col_name"], r["type"], [r[f"v{i}"] for i in range(len(pack.fields))]))
    out, names = [], list(pack.fields)
    for table_id, columns in tables.items():
        heads = [c for c, _, _ in columns]
        key = contract_id(heads)
        known = contracts.get(key)
        if known:
            shares = {c: s for c, _, s in columns}
            fits = all(shares[c][names.index(f)] >= 0.5 for c, f in known.columns.items() if c in shares)
            if fits:
                out.append((table_id, heads, known, "contract"))
                continue
        found = map_table(columns, pack)
        status = "mapped" if found.confidence >= auto else "review" if found.template else "unknown"
        if status == "mapped":
            contracts[key] = found
        out.append((table_id, heads, found, status))
    return out
