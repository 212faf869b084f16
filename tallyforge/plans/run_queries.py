"""Queries of what the whole run needs beside single operators - schedule days, legends, ids, contracts, holders, resolution - with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import checks, linking, ranking, sql_checks

from . import contracts, engine, schedules, serving
from .check_queries import SETTINGS
from .operator_queries import iso, query, table
from .pack import STAFFING
from .sample_views import bound_sql, duckdb_views, spark_views

_ANCHORS = (date(1996, 3, 4), date(1996, 9, 20))
# A header for each order: six forms of its day, the fourth with the weekday of the day after, the last none.
_HEADERS = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS form FROM orders"""


@query(f"""
    WITH h AS ({_HEADERS}),
    n AS (SELECT *, CASE form WHEN 0 THEN strftime(d, '%a %m/%d') WHEN 1 THEN strftime(d, '%m/%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN concat(strftime(d + 1, '%a'), strftime(d, ' %d %b')) WHEN 4 THEN strftime(d, '%b %d') ELSE 'Total' END AS header,
        CASE form WHEN 0 THEN isodow(d) WHEN 3 THEN isodow(d + 1) END AS dow FROM h),
    y AS (SELECT n.*, try_cast(concat(CAST(year AS VARCHAR), strftime(d, '-%m-%d')) AS DATE) AS c FROM n, (VALUES (1995), (1996), (1997)) AS t(year) WHERE form IN (0, 1, 3, 4)),
    r AS (SELECT o_orderkey, arg_min(c, abs(c - DATE '1996-09-20')) FILTER (WHERE isodow(c) = dow AND abs(c - DATE '1996-09-20') <= 183) AS fits, min(struct_pack(o := abs(c - DATE '1996-09-20'), c := c)).c AS near FROM y WHERE c IS NOT NULL GROUP BY o_orderkey),
    f AS (SELECT n.*, CASE WHEN form = 2 THEN d WHEN form <> 5 THEN coalesce(fits, near) END AS day FROM n LEFT JOIN r USING (o_orderkey))
    SELECT o_orderkey, header, CAST(day AS VARCHAR) AS day, CASE WHEN day IS NULL THEN concat('schedule_dates:', header) WHEN isodow(day) <> dow THEN concat('day_mismatch:', header) END AS issue FROM f""")
def schedule_days(spark, sf_dir):
    """Days of schedule columns: of the year in which the weekday fits nearest to the latest pay period, else of the nearest."""
    h, d = bound_sql(spark, sf_dir, _HEADERS), F.col("d")
    forms = [F.date_format(d, "EEE MM/dd"), F.date_format(d, "MM/dd"), iso(d), F.concat(F.date_format(F.date_add(d, 1), "EEE"), F.date_format(d, " dd MMM")), F.date_format(d, "MMM dd"), F.lit("Total")]
    named = h.withColumn("header", F.element_at(F.array(*forms), (F.col("form") + 1).cast("int")))
    found = named.withColumn("s", dates.schedule_day(F.col("header"), F.array(*[F.lit(a) for a in _ANCHORS])))
    return found.select("o_orderkey", "header", iso("s.day").alias("day"), F.col("s.issue").alias("issue"))


@query("""
    SELECT concat('T', CAST(o_orderkey AS VARCHAR)) AS table_id, 420 AS start_min, CAST(900 + o_custkey % 3 * 60 AS INTEGER) AS end_min, CAST(CASE o_custkey % 2 WHEN 0 THEN 8 ELSE 7.5 END AS DOUBLE) AS hours FROM orders
    UNION ALL SELECT concat('T', CAST(o_orderkey AS VARCHAR)), 1380, 420, 10.0 FROM orders WHERE o_orderkey % 4 <> 0""")
def legend_hours(spark, sf_dir):
    """Hours by token out of a footnote for each order."""
    first = F.concat(F.lit("Day 7a-"), (F.col("o_custkey") % 3 + 3).cast("string"), F.lit("p is "), F.when(F.col("o_custkey") % 2 == 0, "8").otherwise("7.5"), F.lit(" hours. "))
    notes = table(spark, sf_dir, "orders").select(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("table_id"), F.concat(first, F.when(F.col("o_orderkey") % 4 != 0, "11p-7a: 10 hrs").otherwise("Ask the office")).alias("note"))
    return schedules.legends(notes)


@query("""
    WITH n AS (SELECT o_orderkey, concat('R', CAST(o_orderkey AS VARCHAR)) AS record_id, CASE WHEN o_orderkey % 5 <> 0 THEN concat('Y', CAST(o_custkey AS VARCHAR)) END AS wanted, CAST(o_orderdate AS DATE) AS received FROM orders)
    SELECT record_id, CASE WHEN wanted IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.wanted = n.wanted AND (m.received > n.received OR m.received = n.received AND m.record_id < n.record_id)) THEN wanted ELSE record_id END AS pay_id FROM n""")
def pay_id_unique(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("record_id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Y"), F.col("o_custkey").cast("string"))).alias("wanted"), F.col("o_orderdate").cast("date").alias("received"))
    return ranking.unique_ids(rows, "wanted", "record_id", "received", "pay_id").select("record_id", "pay_id")


@query("""
    WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_discount AS prob FROM lineitem UNION ALL SELECT concat('p', CAST(l_partkey AS VARCHAR)), l_discount FROM lineitem)
    SELECT CAST(c_custkey AS VARCHAR) AS record_id, CAST(coalesce((SELECT max(prob) FROM e WHERE k = CAST(c_custkey AS VARCHAR)), 1) AS DOUBLE) AS link_prob FROM customer""")
def link_prob(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), F.col("l_discount").cast("double").alias("prob"))
    return linking.best_prob(links, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id")), "record_id")


def _sources(spark, sf_dir) -> DataFrame:
    """A source for each customer: template and header, the same for many."""
    c = table(spark, sf_dir, "customer")
    heads = F.array(F.lit("Id"), F.concat(F.lit("Week "), (F.col("c_custkey") % 53).cast("string")), F.concat(F.lit("col "), F.substring(F.lit("abcdefg"), (F.col("c_custkey") % 7 + 1).cast("int"), F.lit(1))))
    return c.select(F.format_string("%08d", "c_custkey").alias("table_id"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("template"), heads.alias("columns"))


@query("""
    SELECT format('{:08d}', c_custkey) AS table_id, concat('t', CAST(c_nationkey AS VARCHAR)) AS template,
        CAST(CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey % 4 ELSE 0 END + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS version,
        c_nationkey % 4 > 0 AND c_nationkey % 7 <> c_custkey % 7 AS drift
    FROM customer""")
def contract_versions(spark, sf_dir):
    """The version that each new source's contract gets, and whether it is a changed form of one known: two of four columns shared."""
    nations = table(spark, sf_dir, "nation").withColumn("version", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n_nationkey") % 4, F.lit(1)).cast("int")))).filter("n_nationkey % 4 > 0")
    heads = F.array(F.lit("id"), F.lit("week 0"), F.concat(F.lit("Col "), F.substring(F.lit("abcdefg"), (F.col("n_nationkey") % 7 + 1).cast("int"), F.lit(1))))
    old = nations.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("template"), "version", heads.alias("columns"))
    sources = _sources(spark, sf_dir)
    made = contracts.new_versions(old, sources).select("table_id", "template", "version")
    return made.join(contracts.drifted(sources, old).select("table_id", "drift"), "table_id")


@query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('RN-', CAST(s_suppkey AS VARCHAR)) WHEN 1 THEN concat('ORG:supplier-', CAST(s_suppkey AS VARCHAR), '-co:D-', CAST(s_suppkey AS VARCHAR)) WHEN 2 THEN concat('ORG:supplier-', CAST(s_suppkey AS VARCHAR), '-co:insurance') END AS credential_id,
        s_suppkey % 4 IN (1, 2) AS organisation
    FROM supplier""")
def credential_holders(spark, sf_dir):
    """Ids of credentials of persons and organisations, with a number or only a kind of document."""
    k, form = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    name = F.when(form.isin(1, 2), F.concat(F.lit("Supplier "), k, F.lit(" & Co.")))
    number = F.when(form == 0, F.concat(F.lit("RN-"), k)).when(form == 1, F.concat(F.lit("D-"), k))
    fields = F.map_filter(F.create_map(F.lit("org.name"), name, F.lit("credential.number"), number, F.lit("credential.doc_type"), F.when(form == 2, "insurance")), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", fields.alias("fields"))
    return rows.select("s_suppkey", engine.credential_id().alias("credential_id"), engine.is_organisation().alias("organisation"))


_SQL_FILE = """-- id: WEEKEND-LOAD
-- severity: LOW
-- title: Long shift on a weekend
SELECT array(person_id, NULL) AS entity_ids, facility_id, work_date AS period_start, work_date AS period_end, CAST(NULL AS STRING) AS message, shift_id AS key, CASE WHEN hours > 11 THEN 'MEDIUM' END AS severity
FROM {shifts} WHERE weekday(work_date) > 4 AND hours > 8 AND work_date <= :as_of"""


@query(f"""{duckdb_views("shifts")}
    SELECT person_id AS entities, facility_id, CAST(work_date AS VARCHAR) AS period_start, CASE WHEN hours > 11 THEN 'MEDIUM' ELSE 'LOW' END AS severity, concat('Long shift on a weekend: ', person_id) AS message, shift_id AS key
    FROM shifts WHERE isodow(work_date) > 5 AND hours > 8 AND work_date <= DATE '1998-01-01'""")
def sql_check_file(spark, sf_dir):
    """A check given as the text of an SQL file."""
    name, made = sql_checks.sql_check(_SQL_FILE)
    found = checks.run_checks(spark_views(spark, sf_dir), SETTINGS, only=[name], more={name: made}, apart=False)
    return found.select(F.array_join("entity_ids", ",").alias("entities"), "facility_id", iso("period_start").alias("period_start"), "severity", "message", "key")


_SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se".split()


def _word(number: F.Column) -> F.Column:
    return F.initcap(F.concat(*[F.element_at(F.array(*[F.lit(s) for s in _SYLLABLES]), (F.floor(number / 30**j) % 30 + 1).cast("int")) for j in range(4)]))


@query("""
    SELECT concat(t, CAST(c_custkey AS VARCHAR)) AS record_id, concat('P-E', CAST(c_custkey AS VARCHAR)) AS person_id FROM customer, (VALUES ('h'), ('p'), ('q'), ('l')) AS f(t)""")
def resolution(spark, sf_dir):
    """Four records of every customer - roster, payroll in capitals, another list, a licence - linked from names, places and numbers alone; the
    SQL is the truth."""
    k = F.col("c_custkey")
    given, family = _word(k * 7919 + 11 + F.floor(k / 30**4) * 471_037), _word(k * 104_729 + 5)  # names of four syllables repeat: a repeated family name has another given name
    null = F.lit(None).cast("string")
    role = F.element_at(F.array(F.lit("RN"), F.lit("LPN"), F.lit("CNA")), (k % 3 + 1).cast("int"))
    row = lambda t, template, hr, name, number, eid: F.struct(F.concat(F.lit(t), k.cast("string")).alias("record_id"), F.lit(t).alias("table_id"), F.lit(template).alias("template"), F.lit(hr).alias("is_hr"), name.alias("name"), eid.alias("employee_id"), number.alias("credential_number"), F.when(number.isNotNull(), role).alias("credential_type"))
    number, eid = F.concat(role, F.lit("-"), (k + 500_000).cast("string")), F.concat(F.lit("E"), k.cast("string"))
    forms = F.array(
        row("h", "hr_roster", True, F.concat_ws(" ", given, family), number, eid), row("p", "payroll", False, F.upper(F.concat_ws(", ", family, given)), null, null),
        row("q", "list", False, F.concat_ws(" ", given, family), null, null), row("l", "license", False, F.concat_ws(", ", family, given), number, null),
    )
    records = table(spark, sf_dir, "customer").select(F.explode(forms).alias("r"), role.alias("role"), F.concat(F.lit("F"), (k % 50).cast("string")).alias("facility")).select("r.*", "role", "facility")
    return engine.resolve(records, STAFFING)[0].select("record_id", "person_id")


@query(f"""{duckdb_views("persons", "credentials")}
    SELECT credential_id, CAST(expires_on - DATE '1998-01-01' AS INTEGER) AS days_left, display_name FROM credentials JOIN persons ON holder_id = person_id WHERE holder_id = 'P8'""")
def person_credentials(spark, sf_dir):
    """The credentials in the detail of one person."""
    views = spark_views(spark, sf_dir)
    empty = lambda schema: spark.createDataFrame([], schema)
    parts = serving.person_detail("P8", views, empty("fingerprint string, check_id string, severity string, status string, entity_ids array<string>, active boolean"), empty("entity_id string, attribute string, observed_at timestamp, claim_id string, source string, value string"), empty("entity_id string, attribute string"), empty("a string, b string"), empty("person_id string, record_id string"), SETTINGS.as_of)
    return parts["credentials"].join(parts["person"].select(F.col("person_id").alias("holder_id"), "display_name"), "holder_id").select("credential_id", "days_left", "display_name")
