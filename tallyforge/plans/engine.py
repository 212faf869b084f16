"""From landed cells to issues: silver records, linked persons, golden values, gold views, checks, exports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import dates, text
from tallyforge.operators import checks, linking, ranking
from tallyforge.operators.graph import settled
from tallyforge.operators.intervals import day_parts, minutes_between, period_of_day
from tallyforge.operators.matching import Mapping

from .pack import Pack

CREDENTIAL = ["expires_on", "last_verified", "type", "number"]
PERSON = ["display_name", "role", "home_facility", "hire_date", "phone", "employee_id"]


AUTO = 0.95  # from this probability on a pair is a link


def _in(aliases: list[tuple[str, str]], value: Column) -> Column:
    """The code of an alias; a pack's aliases are few and part of the expression."""
    table = {}
    for alias, code in aliases:
        table.setdefault(text.clean_text(alias), code)
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[text.clean(value)] if table else F.lit(None).cast("string")


def normalise(field: Column, value: Column, pack: Pack, day: Column | None = None) -> Column:
    """A value in its field's form, as text; null where it can't be read. One expression a kind, not a field. ``day``: the date that its
    column's format gives."""
    out = F.trim(value)
    of = lambda kind: [f.name for f in pack.fields.values() if f.kind == kind] or [""]
    by = F.when(field.isin(*of("date")), (dates.parse_any(out) if day is None else day).cast("string")).when(field.isin(*of("number")), text.parse_number(out).cast("string")).when(field.isin(*of("phone")), text.normalize_phone(out))
    for vocab in pack.vocab:
        by = by.when(field.isin(*([f.name for f in pack.fields.values() if f.vocab == vocab] or [""])), _in(pack.aliases(vocab), out))
    by = by.when(field == "credential.number", text.canonical_license(out)).when(field == "person.employee_id", text.employee_id(out))
    return by.otherwise(F.when(out != "", out))


def _fuzzy_codes(long: DataFrame, pack: Pack) -> DataFrame:
    """(field, text, near): the code of the vocabulary's alias most like a value that is none, each distinct value once."""
    out = None
    for vocab in pack.vocab:
        names = [f.name for f in pack.fields.values() if f.vocab == vocab]
        if not names:
            continue
        unread = long.filter(F.col("field").isin(*names) & F.col("form").isNull() & (F.trim("value") != "")).select("field", text.clean(F.col("value")).alias("text")).distinct()
        aliases: dict[str, str] = {}
        for alias, code in pack.aliases(vocab):
            aliases.setdefault(text.clean_text(alias), code)
        found = unread.withColumn("near", text.fuzzy_code(F.col("text"), list(aliases.items()))).filter("near is not null")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else long.sparkSession.createDataFrame([], "field string, text string, near string")


def silver(spark: SparkSession, cells: DataFrame, maps: list[tuple[str, list[str], Mapping, str]], pack: Pack) -> DataFrame:
    """record_id, table_id, template, file_name, src_row, fields (map), parse_issues: the rows of mapped tables, normalised.

    Works on the long cell table, so tables of all shapes are one job. A date column is read by the format that reads most of it. Issues:
    'kind:field=text' for what can't be read, 'ambiguous_date:field' for a value off its column's format that reads both ways (and, on a table's
    first row, for a column that does), 'fuzzy_vocab:field=text' for a word only like an alias, 'row_incomplete:fields' for
    what the template needs, of the fields that the table has; of its groups one must be whole."""
    rows, needs = [], []
    for table_id, _, m, status in maps:
        if m.template and status in ("mapped", "contract"):
            rows += [(table_id, m.template, c, f) for c, f in m.columns.items()]
            template, held = next(t for t in pack.templates if t.name == m.template), set(m.columns.values())
            needs.append((table_id, [f for f in template.required if f in held], [list(g) for g in template.one_of if set(g) <= held]))
    names = spark.createDataFrame(rows, "table_id string, template string, col_name string, field string")
    needed = spark.createDataFrame(needs, "table_id string, required array<string>, groups array<array<string>>")  # a row a table
    kind = F.create_map(*[F.lit(x) for f in pack.fields.values() for x in (f.name, f.kind)])[F.col("field")]
    long = cells.join(names, ["table_id", "col_name"]).withColumn("kind", kind)
    long = long.withColumn("parsed", F.when(F.col("kind") == "date", dates.parsed_by_format(F.col("value"))))
    long = settled(long)  # each value is parsed once, for the column's format and for itself
    formats = dates.infer_formats(long.filter("kind = 'date'"), "value", ["table_id", "col_name"], "parsed").select("table_id", "col_name", "format", "ambiguous")
    long = long.join(formats, ["table_id", "col_name"], "left").withColumn("form", normalise(F.col("field"), F.col("value"), pack, dates.read_date(F.col("parsed"), F.col("format"))))
    long = settled(long)
    near = _fuzzy_codes(long, pack).withColumnRenamed("field", "_f")
    long = long.join(near, F.col("form").isNull() & (F.col("field") == F.col("_f")) & (text.clean(F.col("value")) == F.col("text")), "left").drop("_f", "text")
    long = long.withColumn("form", F.coalesce("form", "near"))
    of = lambda name: F.concat(F.lit(f"{name}:"), F.col("field"), F.lit("="), F.col("value"))
    first = F.col("src_row") == F.min("src_row").over(W.partitionBy("table_id", "col_name"))
    found = F.array_compact(F.array(
        F.when(F.col("form").isNull() & (F.trim("value") != ""), F.concat("kind", F.lit(":"), "field", F.lit("="), "value")),
        F.when(F.col("near").isNotNull(), of("fuzzy_vocab")),
        F.when((F.col("kind") == "date") & F.col("form").isNotNull() & (dates.ambiguous_off_format(F.col("value"), F.col("parsed"), F.col("format")) | (F.col("ambiguous") & first)), F.concat(F.lit("ambiguous_date:"), F.col("field"))),
    ))
    good = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("form").isNotNull(), F.struct("field", "form")))))
    out = long.withColumn("found", found).groupBy("table_id", "template", "file_name", "src_row").agg(good.alias("fields"), F.array_sort(F.flatten(F.collect_list("found"))).alias("parse_issues"))
    out = out.join(needed, "table_id")
    whole = (F.size("groups") == 0) | F.exists("groups", lambda g: F.size(F.array_except(g, F.map_keys("fields"))) == 0)
    lacking = F.concat(F.array_except("required", F.map_keys("fields")), F.when(whole, F.array().cast("array<string>")).otherwise(F.array_except(F.get("groups", F.lit(0)), F.map_keys("fields"))))
    issues = F.when(F.size(lacking) > 0, F.array_append("parse_issues", F.concat(F.lit("row_incomplete:"), F.array_join(lacking, ",")))).otherwise(F.col("parse_issues"))
    out = out.withColumn("parse_issues", issues).drop("required", "groups")
    return out.select(F.concat(F.lit("R-"), F.substring(F.sha1(F.concat_ws("|", "table_id", "src_row")), 1, 12)).alias("record_id"), "*")


def schedule_rows(grid: DataFrame, day_columns: dict[str, str], pack: Pack, name: str = "Staff", role: str = "Role", facility: str = "title") -> DataFrame:
    """Shifts out of a schedule grid (a row a person, a column a day): record_id, full_name, role, facility, work_date and the parsed token.

    ``day_columns``: column to ISO date."""
    pairs = F.array(*[F.struct(F.lit(d).cast("date").alias("work_date"), F.col(f"`{c}`").alias("cell")) for c, d in day_columns.items()])
    keyed = grid.withColumn("record_id", F.concat(F.lit("S-"), F.substring(F.sha1(F.concat_ws("|", F.col(facility), F.col(name))), 1, 12)))
    long = keyed.select("record_id", F.col(name).alias("full_name"), _in(pack.aliases("roles"), F.col(role)).alias("role"), text.alias_in_text(F.col(facility), [(" ".join(a.lower().split()), c) for a, c in pack.aliases("facilities")]).alias("facility"), F.explode(pairs).alias("p"))
    return long.select("record_id", "full_name", "role", "facility", "p.work_date", F.col("p.cell").alias("token"), text.parse_shift(F.col("p.cell")).alias("shift"))


def person_records(records: DataFrame, schedule: DataFrame | None, pack: Pack) -> DataFrame:
    """One row a record that names a person: record_id, table_id, template, is_hr, name, employee_id, credential_number,
    credential_type, role, facility."""
    f = lambda name: F.col("fields")[name]
    full = F.coalesce(f("person.full_name"), F.concat_ws(" ", f("person.given_name"), f("person.family_name")))
    out = records.filter(~is_organisation()).select("record_id", "table_id", "template", (F.col("template") == "hr_roster").alias("is_hr"), full.alias("name"), f("person.employee_id").alias("employee_id"), f("credential.number").alias("credential_number"), f("credential.type").alias("credential_type"), f("person.role").alias("role"), f("person.facility").alias("facility"))
    if schedule is not None:
        s = schedule.groupBy("record_id").agg(F.first("full_name").alias("name"), F.first("role").alias("role"), F.first("facility").alias("facility"))
        out = out.unionByName(s.select("record_id", F.lit("schedule").alias("table_id"), F.lit("schedule").alias("template"), F.lit(False).alias("is_hr"), "name", F.lit(None).cast("string").alias("employee_id"), F.lit(None).cast("string").alias("credential_number"), F.lit(None).cast("string").alias("credential_type"), "role", "facility"))
    return out.filter("coalesce(name, '') <> '' or employee_id is not null or credential_number is not null")


def is_organisation() -> Column:
    """Whether a silver record is an organisation's: it takes no part in linking persons."""
    return F.coalesce(F.col("fields")["org.name"], F.lit("")) != ""


def credential_id() -> Column:
    """A record's credential: its number; an organisation's has its name too, and the kind of document where it has no number."""
    f = F.col("fields")
    return F.when(is_organisation(), F.concat(F.lit("ORG:"), text.slug(f["org.name"]), F.lit(":"), F.coalesce(f["credential.number"], f["credential.doc_type"], F.lit("")))).otherwise(f["credential.number"])


def resolve(persons: DataFrame, pack: Pack, weights: linking.Weights = linking.Weights(), extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(record_id, person_id) and the links used: ``resolve_all`` without the pairs scored. Pairs that can't be links are left early."""
    return _resolve(persons, pack, weights, extra, AUTO)[:2]


def resolve_all(persons: DataFrame, pack: Pack, weights: linking.Weights = linking.Weights(), extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record_id, person_id), the links used, and all scored pairs with their zone.

    No two employee ids, name suffixes or licence numbers of one type meet in a person. A record without a full given name is
    never linked to another such; of the groups that the others form it joins the one that leads by the guard's margin, or none.
    ``extra`` (a, b, weight, prob, reasons) are links by people: they pass no guard, but the rules hold for them too."""
    return _resolve(persons, pack, weights, extra, None)


def _resolve(persons: DataFrame, pack: Pack, weights: linking.Weights, extra: DataFrame | None, auto: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``resolve_all``; with ``auto`` only pairs of at least that probability are scored to the end."""
    spark = persons.sparkSession
    nick = spark.createDataFrame(list(pack.nicknames) or [("", "")], "nickname string, formal string")
    keyed = linking.person_keys(persons.repartition("record_id"), "name", nick)  # names are parsed in all tasks, however few files there are
    keyed = keyed.withColumns({"soundex": F.col("key.soundex"), "family3": F.substring(F.regexp_replace("key.family", "[^a-z]", ""), 1, 3), "initial": F.col("key.initial"), "suffix": F.col("key.suffix")})
    typed = F.when(F.col("credential_type").isNotNull() & F.col("credential_number").isNotNull(), F.create_map("credential_type", "credential_number"))
    keyed = settled(keyed.withColumn("licence", typed).withColumn("_short", (F.coalesce("name", F.lit("")) != "") & F.col("key.given").isNull()))
    facts = ["employee_id", "suffix", "licence"]
    seen = keyed.withColumn("key", F.struct(*[F.col(f"key.{c}").alias(c) for c in ("family", "given", "initial", "suffix", "nick_key")]))
    rules, least = [list(r) for r in pack.blocking], None if auto is None else math.log2(auto / (1 - auto))
    if least is None:
        seen = seen.withColumn("words", linking.family_words(F.col("key.family")))
        pairs = linking.block_pairs(seen, rules, "record_id", "table_id", split="facility", keep=[*linking.SCORED, "words"], tasks=4 * spark.sparkContext.defaultParallelism)
    else:
        pairs = linking.near_pairs(seen, rules, "record_id", "table_id", weights, least, split="facility")
    links = settled(linking.zones(linking.score_joined(pairs, weights, least), auto=AUTO))
    sure = linking.key_links(keyed, "record_id", "table_id", "template", "credential_number").unionByName(linking.key_links(keyed, "record_id", "table_id", "template", "employee_id"))
    owners = keyed.filter("is_hr").select("record_id", F.coalesce("employee_id", "record_id").alias("owner"))
    strong = linking.guard_hr(links.filter("zone = 'auto'").select("a", "b", "weight", "prob", "reasons"), owners)
    used = strong.unionByName(sure)
    short = not keyed.filter("_short").isEmpty()
    full = keyed.filter("not _short")
    if short:
        for side in "ab":
            used = used.join(keyed.select(F.col("record_id").alias(side), F.col("_short").alias(f"_{side}")), side)
        used = used.filter("not (_a and _b)")
    used = settled(used)
    solid = linking.constrained_clusters(used.filter("not _a and not _b") if short else used, full, "record_id", facts)
    if short:
        groups = linking.person_ids(solid, full, "record_id").select("record_id", F.col("person_id").alias("owner"))
        used = linking.guard_hr(used.select("a", "b", "weight", "prob", "reasons"), groups)
    if extra is not None:
        for side in "ab":
            extra = extra.join(keyed.select(F.col("record_id").alias(side)), side, "left_semi")
        used = used.unionByName(extra.select("a", "b", "weight", "prob", "reasons"))
    best = used.withColumn("_n", F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("prob"), F.desc("weight")))).filter("_n = 1").drop("_n")
    if not short and extra is None:  # no link came or went since: these are the clusters
        return linking.person_ids(solid, keyed, "record_id"), best, links
    best = settled(best)
    clusters = linking.constrained_clusters(best, keyed, "record_id", facts)
    return linking.person_ids(clusters, keyed, "record_id"), best, links


def claims(records: DataFrame, owners: DataFrame, received: str | None = None) -> DataFrame:
    """Every value as a claim: entity_id, attribute, value, source (template), claim_id, record_id, src_row, observed_at."""
    rows = records.join(owners, "record_id", "left")
    f = lambda name: F.col("fields")[name]
    name = F.coalesce(F.concat_ws(" ", f("person.given_name"), f("person.family_name")), F.lit(""))
    person = [("display_name", F.when(name != "", name).otherwise(f("person.full_name"))), ("role", f("person.role")), ("home_facility", F.when(F.col("template") == "hr_roster", f("person.facility"))), ("hire_date", f("person.hire_date")), ("phone", f("person.phone")), ("employee_id", f("person.employee_id"))]
    credential = [("expires_on", f("credential.expires_on")), ("last_verified", f("credential.last_verified")), ("type", F.coalesce(f("credential.type"), F.when(F.col("template") == "hr_roster", f("person.role")), F.when(is_organisation(), f("credential.doc_type")))), ("number", F.when(is_organisation(), f("credential.number")))]
    items = [F.struct(F.lit("person").alias("kind"), F.col("person_id").alias("entity_id"), F.lit(a).alias("attribute"), v.alias("value")) for a, v in person]
    items += [F.struct(F.lit("credential").alias("kind"), credential_id().alias("entity_id"), F.lit(a).alias("attribute"), v.alias("value")) for a, v in credential]
    seen = F.lit(received).cast("timestamp") if received else F.lit(None).cast("timestamp")
    long = rows.select("record_id", "person_id", F.col("template").alias("source"), "src_row", seen.alias("observed_at"), F.explode(F.array(*items)).alias("c"))
    long = long.select("record_id", "person_id", "source", "src_row", "observed_at", "c.*").filter("entity_id is not null and value is not null and value <> ''")
    return long.withColumn("claim_id", F.concat(F.lit("C-"), F.substring(F.sha1(F.concat_ws("|", "entity_id", "attribute", "record_id")), 1, 10)))


def golden(all_claims: DataFrame, pack: Pack) -> DataFrame:
    """The golden value of each (kind, entity, attribute), by the priorities of the pack's field."""
    priorities = {"expires_on": pack.priorities.get("credential.expires_on", ()), "role": pack.priorities.get("person.role", ())}
    out = None
    for attribute in [*PERSON, *CREDENTIAL]:
        order = list(priorities.get(attribute, ())) or ["hr_roster", "license", "payroll"]
        part = ranking.survivorship(all_claims.filter(F.col("attribute") == attribute), ["kind", "entity_id", "attribute"], "value", "source", order, "observed_at", ["src_row"], "claim_id")
        out = part if out is None else out.unionByName(part)
    return out


def gold_views(spark: SparkSession, records: DataFrame, schedule: DataFrame | None, owners: DataFrame, persons: DataFrame, all_claims: DataFrame, best: DataFrame, pack: Pack, received: DataFrame | None = None) -> checks.Views:
    """The views that checks and exports read, rebuilt from silver and golden values.

    ``received`` (table_id, received): when a table's file came. Of rows that say the same - a pay period of a person and facility, a shift
    of a person, facility and times - the newest file's counts, then the least record. A pay id that another period has already
    gives way to the record's id. An organisation holds its credentials itself."""
    if received is None:
        received = spark.createDataFrame([], "table_id string, received timestamp")
    wide = lambda kind, names: best.filter(F.col("kind") == kind).groupBy("entity_id").agg(*[F.max(F.when(F.col("attribute") == a, F.col("golden"))).alias(a) for a in names])
    hr = owners.join(persons.select("record_id", "is_hr"), "record_id").groupBy("person_id").agg(F.bool_or("is_hr").alias("has_hr"))
    p = hr.join(wide("person", PERSON).withColumnRenamed("entity_id", "person_id"), "person_id", "left").withColumn("hire_date", F.col("hire_date").cast("date"))
    f = lambda name: F.col("fields")[name]
    holder = all_claims.filter("kind = 'credential'").groupBy("entity_id").agg(F.min("person_id").alias("holder_id"))
    org = F.col("entity_id").startswith("ORG:")
    c = wide("credential", CREDENTIAL).join(holder, "entity_id", "left").select(F.col("entity_id").alias("credential_id"), F.when(org, F.col("entity_id")).otherwise(F.col("holder_id")).alias("holder_id"), F.when(org, "organisation").otherwise("person").alias("holder_kind"), F.coalesce("type", F.regexp_extract("entity_id", "^([A-Z]+)-", 1)).alias("type"), F.when(org, F.col("number")).otherwise(F.col("entity_id")).alias("number"), F.col("expires_on").cast("date").alias("expires_on"), F.col("last_verified").cast("date").alias("last_verified"))
    pay = records.filter("template = 'payroll'").join(owners, "record_id").join(received, "table_id", "left").select(f("pay.payroll_id").alias("payroll_id"), "person_id", f("person.facility").alias("facility_id"), f("pay.period_start").cast("date").alias("period_start"), f("pay.period_end").cast("date").alias("period_end"), f("pay.hours_paid").cast("double").alias("hours_paid"), "record_id", "received")
    pay = ranking.newest_per_key(pay.filter("period_start is not null and period_end is not null"), ["person_id", "facility_id", "period_start", "period_end"], "received", "record_id")
    pay = ranking.unique_ids(pay, "payroll_id", "record_id", "received", "pay_id").select("pay_id", "person_id", "facility_id", "period_start", "period_end", "hours_paid")
    raw = records.join(owners, "record_id", "left").select("record_id", "template", "person_id", f("person.employee_id").alias("employee_id"), f("person.role").alias("role"), f("person.facility").alias("facility_id"), f("pay.payroll_id").alias("pay_id"), f("pay.period_start").cast("date").alias("period_start"), f("pay.period_end").cast("date").alias("period_end"), f("pay.hours_paid").cast("double").alias("hours_paid"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("content"))
    shifts = spark.createDataFrame([], "shift_id string, person_id string, facility_id string, role string, work_date date, start_ts timestamp_ntz, end_ts timestamp_ntz, hours double")
    if schedule is not None:
        s = schedule.filter("shift.kind = 'shift'").join(owners, "record_id", "left")
        s = s.join(received, "table_id", "left") if "table_id" in s.columns else s.withColumn("received", F.lit(None).cast("timestamp"))
        begin = F.col("work_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("shift.start_min"))
        s = s.select(F.concat_ws("-", "record_id", F.date_format("work_date", "yyyyMMdd")).alias("shift_id"), "person_id", F.col("facility").alias("facility_id"), "role", "work_date", begin.alias("start_ts"), (begin + F.make_dt_interval(mins=(F.col("shift.hours") * 60).cast("int"))).alias("end_ts"), F.col("shift.hours").alias("hours"), "received")
        alone = F.when(F.col("start_ts").isNull() | F.col("person_id").isNull(), F.col("shift_id"))  # such a shift is like no other
        s = ranking.newest_per_key(s.withColumn("_alone", alone), ["person_id", "facility_id", "work_date", "start_ts", "end_ts", "_alone"], "received", "shift_id").drop("received", "_alone")
        shifts = shifts.unionByName(s)
    scope = spark.createDataFrame(list(pack.role_scope), "role string, license_type string")
    return {"persons": p, "credentials": c, "pay_periods": pay, "records": raw, "shifts": shifts, "role_scope": scope}


def conflict_drafts(best: DataFrame, all_claims: DataFrame) -> DataFrame:
    """SRC-CONFLICT: expiry dates on which sources disagree."""
    holder = all_claims.filter("kind = 'credential'").groupBy("entity_id").agg(F.min("person_id").alias("holder"))
    rows = best.filter("kind = 'credential' and attribute = 'expires_on' and has_conflict").join(holder, "entity_id", "left")
    return checks.drafts(rows, F.array_compact(F.array("entity_id", "holder")), message=F.concat(F.lit("Sources differ; kept "), F.col("golden")), key=F.col("attribute"))


def fuzzy_link_drafts(links: DataFrame, persons: DataFrame) -> DataFrame:
    """ID-FUZZY-LINK: outside records linked by a nickname, a fuzzy name or an initial."""
    rows = linking.link_reason_records(links, persons, "record_id")
    return checks.drafts(rows, [F.col("record_id")], message=F.array_join("reasons", ", "), key=F.concat_ws("|", "a", "b"))


def pbj(v: checks.Views, pack: Pack, settings: checks.Settings) -> DataFrame:
    """The staffing export: a row a person, day and facility with hours cut at midnight, job code, and whether it is ready.

    Not ready: not on the roster, no job code, no payroll for the day, or hours out of tolerance - the first that applies."""
    parts = day_parts(v["shifts"].filter("start_ts is not null"), "start_ts", "end_ts").withColumn("h", minutes_between(F.col("part_start"), F.col("part_end")) / 60)
    whole = v["shifts"].filter("start_ts is null and hours is not null").select("person_id", "facility_id", "role", F.col("work_date").alias("day"), F.col("hours").alias("h"))
    daily = parts.select("person_id", "facility_id", "role", "day", "h").unionByName(whole).groupBy("person_id", "facility_id", "day").agg(F.sum("h").alias("hours"), F.min("role").alias("role"))
    totals = checks.scheduled_hours(v).select("pay_id", "person_id", "facility_id", "period_start", "period_end", "hours_paid", "scheduled")
    held = period_of_day(daily, totals, ["person_id"], "day", "period_start", "period_end", "facility_id", "pay_id")
    held = held.join(totals.select("pay_id", "hours_paid", "scheduled").dropDuplicates(["pay_id"]), "pay_id", "left").join(v["persons"].select("person_id", "has_hr", "employee_id"), "person_id", "left")
    code = F.create_map(*[F.lit(x) for kv in pack.job_codes.items() for x in kv])[F.col("role")] if pack.job_codes else F.lit(None).cast("int")
    off = F.abs(F.col("hours_paid") - F.col("scheduled")) > F.greatest(F.lit(settings.hours_tol_abs), F.col("hours_paid") * settings.hours_tol_rel)
    number = lambda c: F.regexp_replace(F.round(c, 2).cast("string"), r"\.0$", "")
    note = F.when(~F.coalesce("has_hr", F.lit(False)), "not on the roster").when(F.col("job_code").isNull(), "no job code").when(F.col("pay_id").isNull(), "no payroll for this day").when(off, F.concat(F.lit("paid "), number(F.col("hours_paid")), F.lit(", scheduled "), number(F.col("scheduled"))))
    out = held.withColumn("job_code", code).withColumn("note", note)
    return out.select("employee_id", "person_id", F.col("day").alias("work_date"), F.round("hours", 2).alias("hours"), "job_code", "facility_id", F.when(F.col("note").isNull(), "ready").otherwise("needs_signoff").alias("status"), "note")
