"""Numbers, phones, licences, vocabularies, shift tokens and ids out of text, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import indel_ratio


def clean(value: Column) -> Column:
    """Lower case, runs of anything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def parse_number(value: Column) -> Column:
    """36,5 is 36.5; 1,036 is 1036; a unit of hours after it is dropped; anything else is null."""
    body = F.regexp_extract(F.trim(value), r"^([-+]?[0-9][0-9,]*(?:\.[0-9]+)?|[-+]?\.[0-9]+)\s*(?i:h|hr|hrs|hour|hours)?\.?$", 1)
    body = F.when(body.rlike(r"^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(body, F.lit(","), F.lit(""))).when(body.rlike(r"^[-+]?\d+,\d{1,2}$"), F.replace(body, F.lit(","), F.lit("."))).otherwise(body)
    return body.try_cast("double")


def normalize_phone(value: Column) -> Column:
    """+1 and ten digits of a North American number; an extension is dropped; null otherwise."""
    main = F.regexp_replace(F.lower(value), r"\s*(x|ext\.?|extension)\s*\d+\s*$", "")
    digits = F.regexp_replace(main, r"\D", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    return F.when(ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+1"), ten))


def canonical_license(value: Column) -> Column:
    """rn 551203 is RN-551203; other forms are upper case without spaces; blank is null."""
    upper = F.upper(F.trim(value))
    form = r"^([A-Z]{1,5})[^A-Z0-9]*([0-9]{3,10})$"
    out = F.when(upper.rlike(form), F.regexp_replace(upper, form, "$1-$2")).otherwise(F.regexp_replace(upper, r"\s+", ""))
    return F.when(out != "", out)


def employee_id(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"\s+", ""))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def short_hash(*parts: Column) -> Column:
    """sha1 over the parts joined by '|'; null is the text None."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def header_form(name: Column) -> Column:
    """A column's name with its words cleaned and digits collapsed: 'Mon 09/14' and 'Mon 09/21' are one column."""
    return F.regexp_replace(clean(name), r"[0-9]+", "0")


def header_fingerprint(names: Column) -> Column:
    """Of an array of column names, in any order."""
    return F.sha1(F.array_join(F.array_sort(F.transform(names, header_form)), "|"))


_OFF = r"^(off|o|x|-|—|–|pto|vac|lv|)$"
_TIME = r"(\d{1,2})(?::(\d{2}))?\s*([ap])?m?"
_SPAN = rf"^{_TIME}\s*(?:-|–|—|to)\s*{_TIME}"


def _minutes(token: Column, at: int) -> Column:
    hour, minute, half = (F.regexp_extract(token, _SPAN, at + k) for k in range(3))
    h = hour.try_cast("int")
    h = F.when(half == "a", F.when(h == 12, 0).otherwise(h)).when(half == "p", F.when(h == 12, 12).otherwise(h + 12)).otherwise(h)
    ok = F.when(half != "", hour.try_cast("int").between(1, 12)).otherwise((minute != "") & (hour.try_cast("int") < 24))
    m = F.coalesce(minute.try_cast("int"), F.lit(0))
    return F.when(ok & (m < 60), h * 60 + m)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it: a plan would write its expression out each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_shift(value: Column) -> Column:
    """A cell of a schedule: struct(kind 'shift', 'off' or null, start_min, end_min, hours, note).

    7a-3p, 07:00-15:00, 7a to 3p; a second span after '/' that begins where the first ends makes a double; what follows
    in brackets or as '*' is the note. Times without a or p need minutes. Equal ends are 24 hours."""
    def parts(text: Column) -> Column:
        first, second = F.trim(F.split_part(text, F.lit("/"), F.lit(1))), F.trim(F.split_part(text, F.lit("/"), F.lit(2)))
        return F.struct(text.rlike(_OFF).alias("off"), first.alias("first"), second.alias("second"))

    def spans(p: Column) -> Column:
        first, second = p["first"], p["second"]
        rest = F.trim(F.regexp_replace(F.when(second != "", second).otherwise(first), _SPAN, ""))
        whole = first.rlike(_SPAN) & ((second == "") | second.rlike(_SPAN)) & rest.rlike(r"^(\*+|\(.*\))?$")
        ends = [_minutes(c, at).alias(n) for n, c, at in (("start", first, 1), ("end", first, 4), ("start2", second, 1), ("end2", second, 4))]
        return F.struct(p["off"].alias("off"), (second != "").alias("double"), rest.alias("rest"), whole.alias("whole"), *ends)

    def shift(s: Column) -> Column:
        last = F.when(s["double"], s["end2"]).otherwise(s["end"])
        good = ~s["off"] & s["whole"] & s["start"].isNotNull() & last.isNotNull() & (~s["double"] | (s["start2"] == s["end"]))
        hours = F.when(good, F.when(last == s["start"], 24.0).otherwise(F.pmod(last - s["start"], F.lit(1440)) / 60.0))
        note = F.when(good & s["double"], "double").when(good & (s["rest"] != ""), s["rest"])
        return F.struct(F.when(good, "shift").when(s["off"], "off").alias("kind"), F.when(good, s["start"]).alias("start_min"), F.when(good, last).alias("end_min"), hours.alias("hours"), note.alias("note"))

    return _let(_let(_let(F.lower(F.trim(F.coalesce(value, F.lit("")))), parts), spans), shift)


def shift_text(start_min: Column, end_min: Column) -> Column:
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))
    return F.concat(clock(start_min), F.lit("-"), clock(end_min))


def fuzzy_code(cleaned: Column, aliases: list[tuple[str, str]], least: float = 90.0) -> Column:
    """The code of the alias (alias, code) most like a cleaned text, if their ratio is at least ``least``; the first of equals. The aliases
    are a pack's few; each distinct text of a batch is compared once."""
    @F.pandas_udf("string")
    def nearest(texts: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        for t in texts.dropna().unique():
            best = max(((indel_ratio(t, a), -i, c) for i, (a, c) in enumerate(aliases)), default=(0.0, 0, None)) if len(t) > 1 else (0.0, 0, None)
            known[t] = best[2] if best[0] >= least else None
        return texts.map(known)

    return nearest(cleaned)


def match_vocab(df: DataFrame, column: str, aliases: list[tuple[str, str]], out: str = "code", least: float = 90.0) -> DataFrame:
    """``df`` with the code of the alias that the cleaned text is, else of the one most like it, and whether it is only alike (``<out>_fuzzy``).

    Texts that are no alias are compared once each, however often they occur."""
    table: dict[str, str] = {}
    for alias, code in aliases:
        table.setdefault(clean_text(alias), code)
    named = df.withColumn("_clean", clean(F.col(column)))
    exact = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("_clean")] if table else F.lit(None).cast("string")
    named = named.withColumn("_exact", exact)
    other = named.filter("_exact is null and _clean is not null").select(F.col("_clean").alias("_other")).distinct()
    other = other.withColumn("_near", fuzzy_code(F.col("_other"), list(table.items()), least)).filter("_near is not null")
    joined = named.join(other, F.col("_exact").isNull() & (F.col("_clean") == F.col("_other")), "left")
    return joined.withColumn(out, F.coalesce("_exact", "_near")).withColumn(f"{out}_fuzzy", F.col("_near").isNotNull()).drop("_clean", "_exact", "_other", "_near")


def clean_text(value: str) -> str:
    """``clean`` of a text of the configuration."""
    return " ".join("".join(c if c.isalnum() else " " for c in value.lower()).split())


def alias_in_text(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """The code of the longest alias that stands in the text as whole words; of equal lengths the greatest code. The aliases
    are a pack's few, so they are part of the expression and no join is made."""
    padded = F.concat(F.lit(" "), clean(text), F.lit(" "))
    found = [F.when(F.instr(padded, f" {a} ") > 0, F.struct(F.lit(len(a)).alias("n"), F.lit(c).alias("c"))) for a, c in aliases]
    return F.array_max(F.array_compact(F.array(*found)))["c"]
