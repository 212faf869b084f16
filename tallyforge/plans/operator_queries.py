"""One query for each operator over the driver's tables, with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import dates, similarity, text
from tallyforge.operators import checks, graph, intervals, issues, linking, ranking, reshape

from tallyforge.operators.matching import Mapping

from . import engine, serving
from .check_queries import SETTINGS
from .pack import STAFFING, Field, Pack, Template
from .sample_views import bound_sql, duckdb_views, spark_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under the function's name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- joins and aggregates ---------------------------------------------------------------------------------------------


@query(f"""{duckdb_views("shifts", "pay_periods")}
    SELECT p.pay_id, p.person_id, p.facility_id, CAST(coalesce(sum(hours), 0) AS DOUBLE) AS scheduled, CAST(count(hours) AS BIGINT) AS n_shifts, CAST(hours_paid AS DOUBLE) AS hours_paid
    FROM pay_periods p LEFT JOIN shifts s ON p.person_id = s.person_id AND p.facility_id IS NOT DISTINCT FROM s.facility_id AND work_date BETWEEN period_start AND period_end
    GROUP BY p.pay_id, p.person_id, p.facility_id, period_start, period_end, hours_paid""")
def paid_vs_scheduled(spark, sf_dir):
    out = checks.scheduled_hours(spark_views(spark, sf_dir))
    return out.select("pay_id", "person_id", "facility_id", F.col("scheduled").cast("double").alias("scheduled"), "n_shifts", F.col("hours_paid").cast("double").alias("hours_paid"))


@query("""
    SELECT c_custkey, c_nationkey, count(*) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS order_keys
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey HAVING count(*) > 1""")
def ordered_lists(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string"))
    grouped = joined.groupBy("c_custkey", "c_nationkey").agg(F.count("*").alias("n"), iso(F.min("o_orderdate")).alias("first_day"), iso(F.max("o_orderdate")).alias("last_day"), F.array_join(keys, ",").alias("order_keys"))
    return grouped.filter("n > 1")


@query("""
    SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS total, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_type,
        CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases
    FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING sum(value) > 16""")
def daily_excess(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    only = F.when(F.count_distinct("event_type") == 1, F.min("event_type"))
    out = e.groupBy("user_id", "day").agg(F.sum("value").alias("s"), only.alias("only_type"), F.count_if(F.col("event_type") == "purchase").alias("purchases")).filter("s > 16")
    return out.select("user_id", iso("day").alias("day"), F.round("s", 4).alias("total"), "only_type", "purchases")


@query("""
    SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
        AND a.ts < b.ts + to_microseconds(CAST(floor(b.value * 60) AS BIGINT) * 1000000) AND b.ts < a.ts + to_microseconds(CAST(floor(a.value * 60) AS BIGINT) * 1000000)
        AND floor(a.value * 60) > 0 AND floor(b.value * 60) > 0""")
def interval_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("until", F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 60).cast("decimal(18,6)"))).filter("ts < until")
    out = intervals.overlapping_pairs(e, ["user_id"], "event_id", "ts", "until", bucket_seconds=3600)
    return out.select("user_id", F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("""
    SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(DISTINCT o_orderkey) > 1""")
def duplicate_period(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    out = o.groupBy("o_custkey", "d").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("k"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities")).filter("k > 1")
    return out.select("o_custkey", iso("d").alias("day"), "n", "priorities")


@query("""
    SELECT c_custkey, CAST(least((SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey),
        (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)) AS VARCHAR) AS first_activity
    FROM customer""")
def first_activity(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ordered = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.to_date("o_orderdate")).alias("a"))
    shipped = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.to_date("l_shipdate")).alias("b"))
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(ordered, "k", "left").join(shipped, "k", "left")
    return both.select(F.col("k").alias("c_custkey"), iso(F.least("a", "b")).alias("first_activity"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS newest FROM orders GROUP BY ALL""")
def dashboard_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@query("""
    SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%17%' AND c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate BETWEEN DATE '1994-01-01' AND DATE '1997-12-31')""")
def people_search(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).select("o_custkey")
    wanted = {"c_mktsegment": "BUILDING"}
    condition = F.col("c_name").ilike("%17%")
    for name, value in wanted.items():
        condition = condition & (F.col(name) == value)
    return table(spark, sf_dir, "customer").filter(condition).join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
    SELECT p.c_custkey, l.o_orderkey FROM customer p LEFT JOIN LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = p.c_custkey AND CAST(o.o_orderdate AS DATE) <= DATE '1996-06-01'
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) l ON TRUE""")
def lateral_top1(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.to_date("o_orderdate") <= F.lit("1996-06-01").cast("date"))
    top = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


# --- windows ----------------------------------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT event_type, CAST(d AS DATE) AS day, greatest(ts, d) AS a, least(u, d + INTERVAL 1 DAY) AS b FROM (
            SELECT *, unnest(generate_series(date_trunc('day', ts), date_trunc('day', u - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS d
            FROM (SELECT event_type, ts, ts + to_microseconds(CAST(floor(value * 60) AS BIGINT) * 1000000) AS u FROM events WHERE floor(value * 60) > 0))),
    i AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY event_type, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM p),
    j AS (SELECT *, sum(new) OVER (PARTITION BY event_type, day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM i)
    SELECT event_type, CAST(day AS VARCHAR) AS day, round(max(m), 4) AS covered_minutes FROM (SELECT event_type, day, island, (epoch_us(max(b)) - epoch_us(min(a))) / 60000000.0 AS m FROM j GROUP BY ALL) GROUP BY event_type, day""")
def longest_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("until", F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 60).cast("decimal(18,6)")))
    out = intervals.longest_coverage(e, ["event_type"], "ts", "until")
    return out.select("event_type", iso("day").alias("day"), F.round("covered_minutes", 4).alias("covered_minutes"))


@query(f"""{duckdb_views("shifts")}
    SELECT person_id, CAST(CAST(d AS DATE) AS VARCHAR) AS day, CAST(sum((epoch_us(least(end_ts, d + INTERVAL 1 DAY)) - epoch_us(greatest(start_ts, d))) / 3600000000.0) AS DOUBLE) AS hours
    FROM (SELECT *, unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS d FROM shifts) GROUP BY person_id, d""")
def midnight_split(spark, sf_dir):
    parts = intervals.day_parts(spark_views(spark, sf_dir)["shifts"], "start_ts", "end_ts")
    return parts.groupBy("person_id", "day").agg((F.sum(intervals.minutes_between(F.col("part_start"), F.col("part_end"))) / 60).alias("hours")).withColumn("day", iso("day"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_quantity) = 1""")
def newest_per_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return ranking.newest_per_key(li, ["l_partkey", "l_suppkey"], "l_shipdate", "row").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders),
    g AS (SELECT o_custkey, o_orderstatus AS golden, o_orderkey AS golden_claim, o_orderpriority AS golden_source FROM r WHERE n = 1)
    SELECT g.*, CAST(count(r.o_orderkey) AS BIGINT) AS n_conflicts, coalesce(string_agg(CAST(r.o_orderkey AS VARCHAR), ',' ORDER BY n), '') AS conflicts
    FROM g LEFT JOIN r ON g.o_custkey = r.o_custkey AND r.o_orderstatus <> g.golden GROUP BY ALL""")
def survivorship(spark, sf_dir):
    out = ranking.survivorship(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority", ["1-URGENT", "3-MEDIUM", "2-HIGH"], "o_orderdate", [], "o_orderkey")
    return out.select("o_custkey", "golden", "golden_claim", "golden_source", F.size("conflict_ids").cast("long").alias("n_conflicts"), F.array_join(F.col("conflict_ids").cast("array<string>"), ",").alias("conflicts"))


@query("""
    WITH b AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS best FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS n, best - lead(best) OVER w AS lead FROM b WINDOW w AS (PARTITION BY l_partkey ORDER BY best DESC, l_suppkey))
    SELECT l_partkey, CASE WHEN NOT coalesce(lead < 2, FALSE) THEN l_suppkey END AS l_suppkey, best, lead, coalesce(lead < 2, FALSE) AS ambiguous FROM r WHERE n = 1""")
def one_to_one_guard(spark, sf_dir):
    return ranking.one_to_one_guard(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", 2.0)


@query(f"""{duckdb_views("shifts", "pay_periods")},
    d AS (SELECT DISTINCT person_id, facility_id, work_date FROM shifts WHERE facility_id IS NOT NULL)
    SELECT d.person_id, d.facility_id, CAST(d.work_date AS VARCHAR) AS work_date, l.pay_id FROM d LEFT JOIN LATERAL (
        SELECT pay_id FROM pay_periods p WHERE p.person_id = d.person_id AND d.work_date BETWEEN p.period_start AND p.period_end
        ORDER BY coalesce(p.facility_id = d.facility_id, FALSE) DESC, p.period_start, p.pay_id LIMIT 1) l ON TRUE""")
def period_of_day(spark, sf_dir):
    v = spark_views(spark, sf_dir)
    days = v["shifts"].filter("facility_id is not null").select("person_id", "facility_id", "work_date").distinct()
    periods = v["pay_periods"].select("person_id", "facility_id", "pay_id", "period_start", "period_end").withColumn("facility_id", F.coalesce("facility_id", F.lit("")))
    out = intervals.period_of_day(days, periods, ["person_id"], "work_date", "period_start", "period_end", "facility_id", "pay_id")
    return out.select("person_id", "facility_id", iso("work_date").alias("work_date"), "pay_id")


@query("""SELECT user_id, event_id, concat(event_type, CASE WHEN n > 1 THEN concat('_', CAST(n AS VARCHAR)) ELSE '' END) AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)""")
def unique_names(spark, sf_dir):
    return ranking.unique_names(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", F.col("event_type").alias("name"))


# --- reshaping --------------------------------------------------------------------------------------------------------


@query("""
    SELECT c_custkey AS entity_id, 'name' AS attribute, c_name AS value FROM customer WHERE c_name <> '' UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment <> ''
    UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey IS NOT NULL""")
def claims_unpivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return reshape.unpivot_claims(c, "c_custkey", ["name", "segment", "nation"])


@query("""SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def wide_from_eav(spark, sf_dir):
    return reshape.pivot_wide(claims_unpivot(spark, sf_dir), ["name", "segment", "nation"])


@query("""
    SELECT event_type, user_id, string_agg(concat(CAST(day AS VARCHAR), '=', CAST(n AS VARCHAR)), ';' ORDER BY day) AS days FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type, user_id""")
def shift_grid(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return reshape.shift_grid(daily, ["event_type", "user_id"], "day", "n")


@query("""
    WITH l AS (SELECT unnest([{'c': 'lang', 'v': lang}, {'c': 'source', 'v': source}, {'c': 'n_chars', 'v': CAST(n_chars AS VARCHAR)}]) AS p FROM documents)
    SELECT 'documents' AS table_id, p.c AS "column", count(*) AS n_rows, CAST(count(*) - count(p.v) AS BIGINT) AS n_null, count(DISTINCT p.v) AS n_distinct,
        round(count(*) FILTER (WHERE regexp_full_match(p.v, '[0-9]+')) / greatest(count(p.v), least(2, count(*))), 6) AS share_integer,
        round(count(*) FILTER (WHERE regexp_full_match(p.v, '[a-z]{2}')) / greatest(count(p.v), least(2, count(*))), 6) AS share_code
    FROM l GROUP BY p.c""")
def profile(spark, sf_dir):
    return reshape.profile(table(spark, sf_dir, "documents"), "documents", ["lang", "source", "n_chars"], {"integer": "[0-9]+", "code": "[a-z]{2}"})


@query("""SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, CAST(json_array_length(json_keys(props)) AS BIGINT) AS n_keys FROM events""")
def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


# --- scalars ----------------------------------------------------------------------------------------------------------

_RAW_DATE = """CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d-%b-%Y') WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y')
    WHEN 4 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T00:00:00') WHEN 5 THEN CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) WHEN 6 THEN strftime(o_orderdate, '%m/%d/%y') ELSE 'n/a' END"""


def raw_dates(spark, sf_dir) -> DataFrame:
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "d-MMM-yyyy"), F.date_format(d, "MMM d, yyyy"), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00")), F.datediff(d, F.lit("1899-12-30")).cast("string"), F.date_format(d, "MM/dd/yy"), F.lit("n/a")]
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("raw"))


@query(f"""
    SELECT o_orderkey, raw, CASE WHEN raw <> 'n/a' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM (SELECT o_orderkey, o_orderdate, {_RAW_DATE} AS raw FROM orders)""")
def date_formats(spark, sf_dir):
    return raw_dates(spark, sf_dir).select("o_orderkey", "raw", iso(dates.parse_any(F.col("raw"))).alias("day"))


@query("""
    WITH v AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_custkey % 3 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS raw FROM orders),
    n AS (SELECT o_custkey, count(try_strptime(raw, '%Y-%m-%d')) AS iso, count(try_strptime(raw, '%m/%d/%Y')) AS us, count(try_strptime(raw, '%d/%m/%Y')) AS eu, count(*) FILTER (WHERE try_strptime(raw, '%m/%d/%Y') <> try_strptime(raw, '%d/%m/%Y')) AS differ FROM v GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN iso > 0 THEN '%Y-%m-%d' WHEN us >= eu THEN '%m/%d/%Y' ELSE '%d/%m/%Y' END AS format, greatest(iso, us, eu) AS n_parsed, iso = 0 AND us = eu AND differ > 0 AS ambiguous FROM n""")
def date_infer(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_custkey") % 3
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return dates.infer_formats(table(spark, sf_dir, "orders").withColumn("raw", raw), "raw", ["o_custkey"])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 90 AS DOUBLE) + 0.5 WHEN 1 THEN CAST(1000 + o_orderkey % 9000 AS DOUBLE) WHEN 2 THEN CAST(o_orderkey % 60 AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(-(o_orderkey % 7) AS DOUBLE) END AS number FROM orders""")
def number_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    big = F.concat(F.substring((1000 + k % 9000).cast("string"), 1, 1), F.lit(","), F.substring((1000 + k % 9000).cast("string"), 2, 3))
    forms = [F.concat((k % 90).cast("string"), F.lit(",5")), big, F.concat((k % 60).cast("string"), F.lit(" hrs")), F.lit("about 7"), F.concat(F.lit(" -"), (k % 7).cast("string"), F.lit(" "))]
    raw = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (text.parse_number(raw) + 0.0).alias("number"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE concat('+1718555', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS phone FROM customer""")
def phone_norm(spark, sf_dir):
    last = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    forms = [F.concat(F.lit("718-555-"), last), F.concat(F.lit("1 (718) 555 "), last), F.concat(F.lit("+1 718.555."), last, F.lit(" x45")), F.concat(F.lit("555-"), last)]
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_phone(F.element_at(F.array(*forms), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("phone"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN concat('X', CAST(c_custkey AS VARCHAR), 'Y') ELSE concat('RN-', CAST(100000 + c_custkey AS VARCHAR)) END AS license FROM customer""")
def license_canon(spark, sf_dir):
    n = (100000 + F.col("c_custkey")).cast("string")
    forms = [F.concat(F.lit("rn "), n), F.concat(F.lit(" RN#"), n), F.concat(F.lit("Rn-"), n), F.concat(F.lit("x "), F.col("c_custkey").cast("string"), F.lit(" y"))]
    return table(spark, sf_dir, "customer").select("c_custkey", text.canonical_license(F.element_at(F.array(*forms), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("license"))


@query("""SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS cleaned FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN 'off' WHEN o_orderkey % 6 <> 5 THEN 'shift' END AS kind, CAST(CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 11 + 1) * 60 WHEN 1 THEN o_orderkey % 24 * 60 + 30 WHEN 2 THEN 420 WHEN 3 THEN 1380 END AS INTEGER) AS start_min,
        CASE o_orderkey % 6 WHEN 0 THEN (15 - (o_orderkey % 11 + 1)) * 1.0 WHEN 1 THEN CASE WHEN o_orderkey % 24 * 60 + 30 < 480 THEN (480 - o_orderkey % 24 * 60 - 30) / 60.0 ELSE (1920 - o_orderkey % 24 * 60 - 30) / 60.0 END WHEN 2 THEN 16.0 WHEN 3 THEN 8.0 END AS hours,
        CASE o_orderkey % 6 WHEN 2 THEN 'double' WHEN 3 THEN '*' END AS note FROM orders""")
def shift_token(spark, sf_dir):
    k = F.col("o_orderkey")
    forms = [F.concat((k % 11 + 1).cast("string"), F.lit("a-3p")), F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30–08:00")), F.lit("7a-3p/3p-11p"), F.lit("11p to 7a*"), F.lit(" PTO "), F.lit("7-3 hello")]
    s = text.parse_shift(F.element_at(F.array(*forms), (k % 6 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.kind", "s.start_min", "s.hours", "s.note")


ALIASES = [("RN", "r.n."), ("RN", "registered nurse"), ("LPN", "LVN"), ("CNA", "nurse aide")]


@query("""SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'RN' WHEN 1 THEN 'RN' WHEN 2 THEN 'LPN' WHEN 3 THEN 'CNA' WHEN 5 THEN 'RN' WHEN 6 THEN 'CNA' WHEN 7 THEN 'RN' END AS code, c_custkey % 9 IN (5, 6, 7) AS code_fuzzy FROM customer""")
def vocab_match(spark, sf_dir):
    """Aliases, near misses of at least nine tenths, and what is neither (two typing errors in ten letters are too many)."""
    forms = F.array(*[F.lit(x) for x in ("R.N.", "Registered  Nurse", "lvn", "NURSE-AIDE", "banana", "Registerd Nurse", "nurse aid", "Regstered Nurse.", "norse aade")])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(forms, (F.col("c_custkey") % 9 + 1).cast("int")).alias("title"))
    return text.match_vocab(c, "title", [(a, c) for c, a in ALIASES]).select("c_custkey", "code", "code_fuzzy")


_PERSONS = [
    ("Łukasz Strauß", "strauss", "lukasz", "l", None), ("BELL JR, MARCUS T", "bell", "marcus", "m", "jr"), ("Al Smith", "smith", "al", "a", None), ("Maria de la Cruz", "de la cruz", "maria", "m", None),
    ("Dr. M. Øster (night)", "oster", None, "m", None), ("Jr", "jr", None, None, None), ("Zoë Washington- Greene III", "washington-greene", "zoe", "z", "iii"), ("O’Hara, Ana [temp] Lee", "o'hara", "ana", "a", None),
]


@query("SELECT c_custkey, p.family, p.given, p.initial, p.suffix FROM (SELECT c_custkey, [" + ", ".join("{'family': %s, 'given': %s, 'initial': %s, 'suffix': %s}" % tuple("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in r[1:]) for r in _PERSONS) + "][CAST(c_custkey % 8 AS INTEGER) + 1] AS p FROM customer)")
def person_names(spark, sf_dir):
    """Names with letters to fold, notes, particles, suffixes and titles, in either order."""
    name = F.element_at(F.array(*[F.lit(r[0]) for r in _PERSONS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    keyed = linking.person_keys(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), "name")
    return keyed.select("c_custkey", "key.family", "key.given", "key.initial", "key.suffix")


@query("""
    SELECT doc_id, CASE WHEN t LIKE '% with the %' THEN 'WT' WHEN t LIKE '% from %' THEN 'FR' WHEN t LIKE '% und %' THEN 'UN' WHEN t LIKE '% les %' THEN 'LE' END AS code
    FROM (SELECT doc_id, concat(' ', trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS t FROM documents)""")
def facility_in_text(spark, sf_dir):
    found = text.alias_in_text(F.col("text"), [("with the", "WT"), ("from", "FR"), ("und", "UN"), ("les", "LE")])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("code"))


@query("""SELECT o_orderkey, sha1(concat_ws('|', CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE o_orderstatus END, o_orderpriority)) AS id FROM orders""")
def fingerprint(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_hash(F.col("o_custkey"), status, F.col("o_orderpriority")).alias("id"))


@query("""SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS monday, CASE WHEN n < 0 THEN 'overdue' WHEN n <= 30 THEN '0-30' WHEN n <= 60 THEN '31-60' WHEN n <= 90 THEN '61-90' END AS band
    FROM (SELECT *, datediff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders)""")
def week_and_band(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", iso(dates.week_bounds(day)[0]).alias("monday"), dates.days_left_band(F.datediff(day, F.lit(SETTINGS.as_of))).alias("band"))


ROSTER = Pack(
    fields={"person.employee_id": Field("person.employee_id"), "person.hire_date": Field("person.hire_date", "date"), "person.role": Field("person.role", "vocab", vocab="roles")},
    templates=(Template("roster", required=("person.employee_id", "person.hire_date"), optional=("person.role",)),),
    vocab={"roles": {"RN": ("registered nurse",), "CNA": ("nurse aide",)}},
)


@query("""
    WITH t AS (SELECT *, o_custkey % 3 AS t, CAST(o_orderdate AS DATE) AS d, o_orderkey % 10 = 3 AND o_custkey % 3 = 1 AS off, o_orderkey % 25 = 7 AS bad FROM orders),
    i AS (SELECT *, off AND NOT bad AND day(d) <= 12 AND day(d) <> month(d) AS twice FROM t)
    SELECT concat('T', CAST(t AS VARCHAR)) AS table_id, o_orderkey AS src_row, CASE WHEN NOT bad THEN CAST(d AS VARCHAR) END AS hire_date, CASE o_orderkey % 4 WHEN 0 THEN 'RN' WHEN 1 THEN 'RN' WHEN 2 THEN 'CNA' END AS role,
        concat_ws(' | ', CASE WHEN twice THEN 'ambiguous_date:person.hire_date' END, CASE WHEN bad THEN 'date:person.hire_date=n/a' END, CASE o_orderkey % 4 WHEN 1 THEN 'fuzzy_vocab:person.role=Registerd Nurse' WHEN 3 THEN 'vocab:person.role=clerk' END,
            CASE WHEN bad THEN 'row_incomplete:person.hire_date' END) AS issues
    FROM i""")
def silver_columns(spark, sf_dir):
    """Cells of three tables to silver records: a day-first, an ISO (some values month first) and a month-first column, alias and near alias."""
    d, k, t = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey") % 3
    us = F.date_format(d, "MM/dd/yyyy")
    day = F.when(k % 25 == 7, "n/a").when((k % 10 == 3) & (t == 1), us).when(t == 0, F.date_format(d, "dd/MM/yyyy")).when(t == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(us)
    role = F.element_at(F.array(*[F.lit(x) for x in ("RN", "Registerd Nurse", "Nurse Aide", "clerk")]), (k % 4 + 1).cast("int"))
    cells = F.array(*[F.struct(F.lit(n).alias("col_name"), v.cast("string").alias("value")) for n, v in (("id", k), ("hired", day), ("title", role))])
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("T"), t.cast("string")).alias("table_id"), F.lit("f").alias("file_name"), k.alias("src_row"), F.explode(cells).alias("c")).select("table_id", "file_name", "src_row", "c.*")
    maps = [(f"T{i}", ["id", "hired", "title"], Mapping("roster", 1.0, {"id": "person.employee_id", "hired": "person.hire_date", "title": "person.role"}, 1.0), "mapped") for i in range(3)]
    out = engine.silver(spark, rows, maps, ROSTER)
    return out.select("table_id", "src_row", F.col("fields")["person.hire_date"].alias("hire_date"), F.col("fields")["person.role"].alias("role"), F.array_join("parse_issues", " | ").alias("issues"))


# --- exports and serving ----------------------------------------------------------------------------------------------


@query(f"""{duckdb_views("shifts", "pay_periods", "persons")},
    t AS (SELECT p.pay_id, p.person_id, p.facility_id, period_start, period_end, hours_paid, coalesce(sum(hours), 0) AS scheduled FROM pay_periods p
        LEFT JOIN shifts s ON p.person_id = s.person_id AND p.facility_id IS NOT DISTINCT FROM s.facility_id AND work_date BETWEEN period_start AND period_end GROUP BY ALL),
    d AS (SELECT person_id, facility_id, CAST(dd AS DATE) AS day, sum((epoch_us(least(end_ts, dd + INTERVAL 1 DAY)) - epoch_us(greatest(start_ts, dd))) / 3600000000.0) AS hours, min(role) AS role
        FROM (SELECT *, unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS dd FROM shifts) GROUP BY person_id, facility_id, dd),
    x AS (SELECT d.*, l.pay_id, l.hours_paid, l.scheduled FROM d LEFT JOIN LATERAL (SELECT * FROM t WHERE t.person_id = d.person_id AND d.day BETWEEN t.period_start AND t.period_end
        ORDER BY coalesce(t.facility_id = d.facility_id, FALSE) DESC, t.period_start, t.pay_id LIMIT 1) l ON TRUE),
    n AS (SELECT employee_id, x.person_id, CAST(day AS VARCHAR) AS work_date, round(hours, 2) AS hours, CASE x.role WHEN 'RN' THEN 7 WHEN 'LPN' THEN 9 WHEN 'CNA' THEN 10 END AS job_code, facility_id,
        CASE WHEN NOT coalesce(has_hr, FALSE) THEN 'not on the roster' WHEN x.role IS NULL THEN 'no job code' WHEN pay_id IS NULL THEN 'no payroll for this day'
            WHEN abs(hours_paid - scheduled) > greatest(2.0, 0.05 * hours_paid) THEN 'paid' END AS note FROM x LEFT JOIN persons p ON p.person_id = x.person_id)
    SELECT *, CASE WHEN note IS NULL THEN 'ready' ELSE 'needs_signoff' END AS status FROM n""")
def pbj_export(spark, sf_dir):
    """The staffing export over all shifts; of a note on hours only its first word is compared."""
    out = engine.pbj(spark_views(spark, sf_dir), STAFFING, SETTINGS)
    return out.withColumn("work_date", iso("work_date")).withColumn("note", F.when(F.col("note").startswith("paid"), "paid").otherwise(F.col("note")))


_ISSUES = """SELECT concat('I', CAST(o_orderkey AS STRING)) AS fingerprint, concat('C', CAST(o_custkey % 7 AS STRING)) AS check_id, CASE o_orderkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity,
    CASE WHEN o_orderstatus = 'F' THEN 'open' ELSE 'accepted' END AS status, o_orderkey % 6 <> 0 AS active, concat('P-', CAST(o_custkey AS STRING)) AS person, o_orderpriority AS message FROM orders"""


def _issues(spark, sf_dir) -> DataFrame:
    rows = bound_sql(spark, sf_dir, _ISSUES)
    return rows.withColumns({"entity_ids": F.array("person", F.concat(F.lit("C-"), "fingerprint")), "evidence_text": F.array(F.concat(F.lit("orders: "), "fingerprint"), F.lit("note"))})


@query(f"""SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, check_id, fingerprint) AS BIGINT) AS line,
    concat_ws(',', fingerprint, check_id, severity, status, message, concat(person, '; C-', fingerprint), concat('orders: ', fingerprint, ' | note')) AS row FROM ({_ISSUES}) WHERE active""")
def issues_export(spark, sf_dir):
    """The issues file, line by line in its order; lines are numbered by range, so no task holds them all."""
    out = issues.issues_csv(_issues(spark, sf_dir))
    numbered = out.withColumn("at", F.monotonically_increasing_id())
    numbered = graph.settled(numbered)
    sizes = [(r["p"], r["n"]) for r in numbered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
    base = spark.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes] or [(0, 0)], "p long, before long")
    line = numbered.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(base), "p").withColumn("line", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return line.select("line", F.concat_ws(",", "fingerprint", "check_id", "severity", "status", "message", "entities", "evidence").alias("row"))


@query(f"""SELECT severity, status, count(*) AS n FROM ({_ISSUES}) WHERE active GROUP BY ALL""")
def issue_summary(spark, sf_dir):
    return serving.summary(_issues(spark, sf_dir))


@query(f"""SELECT i.fingerprint, i.severity, c_name AS display_name FROM ({_ISSUES}) i LEFT JOIN customer ON concat('P-', CAST(c_custkey AS VARCHAR)) = i.person WHERE active AND status = 'open'""")
def issue_listing(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("P-"), F.col("c_custkey").cast("string")).alias("person_id"), F.col("c_name").alias("display_name"))
    return serving.issue_list(_issues(spark, sf_dir), people, status="open").select("fingerprint", "severity", "display_name")


@query(f"""{duckdb_views("shifts", "persons")},
    a AS (SELECT 'FAC-MISMATCH' AS check_id, person_id AS entities, string_agg(concat('shifts:', shift_id), ' ' ORDER BY work_date, shift_id) AS evidence FROM shifts JOIN persons USING (person_id) WHERE facility_id <> home_facility GROUP BY person_id, facility_id),
    b AS (SELECT 'HRS-DAILY-EXCESS' AS check_id, person_id AS entities, string_agg(concat('shifts:', shift_id), ' ' ORDER BY shift_id) AS evidence FROM shifts GROUP BY person_id, work_date HAVING sum(hours) > 16),
    c AS (SELECT 'SHIFT-OVERLAP' AS check_id, a.person_id AS entities, concat('shifts:', a.shift_id, ' shifts:', b.shift_id) AS evidence FROM shifts a JOIN shifts b ON a.person_id = b.person_id AND a.shift_id < b.shift_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def check_evidence(spark, sf_dir):
    """The rows that three of the checks name for each of their findings."""
    found = checks.run_checks(spark_views(spark, sf_dir), SETTINGS, only=["FAC-MISMATCH", "HRS-DAILY-EXCESS", "SHIFT-OVERLAP"])
    return found.select("check_id", F.array_join("entity_ids", ",").alias("entities"), F.array_join("evidence", " ").alias("evidence"))


# --- linking ----------------------------------------------------------------------------------------------------------


def part_records(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("t"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("split"))


@query("""
    SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_partkey % 3 <> b.p_partkey % 3
        AND ((a.p_brand = b.p_brand AND a.p_size = b.p_size) OR (a.p_type = b.p_type AND a.p_size = b.p_size))""")
def blocking_pairs(spark, sf_dir):
    return linking.block_pairs(part_records(spark, sf_dir), [["brand", "size"], ["type", "size"]], "id", "t", cap=1_000_000)


@query("""
    WITH r AS (SELECT p_partkey AS id, p_partkey % 3 AS t, p_brand AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS s, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.k = b.k AND a.id < b.id AND a.t <> b.t AND (a.n <= 20 OR a.s IS NOT DISTINCT FROM b.s)""")
def blocking_capped(spark, sf_dir):
    return linking.block_pairs(part_records(spark, sf_dir), [["brand"]], "id", "t", cap=20, split="split")


@query("""
    SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS similarity FROM part a JOIN part b
    ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def pair_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b = (p.select("p_brand", "p_size", F.col("p_partkey").alias(s), F.col("p_name").alias(f"n{s}")) for s in "ab")
    pairs = a.join(b, ["p_brand", "p_size"]).filter("a < b")
    return similarity.similarity(pairs, "na", "nb", "s").select("a", "b", F.round("s", 6).alias("similarity"))


@query("""
    WITH RECURSIVE l AS (SELECT CAST(l_orderkey * 10 AS VARCHAR) AS a, CAST(l_partkey * 10 + 1 AS VARCHAR) AS b FROM lineitem), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(node, component) USING KEY (node) AS (
        SELECT a, least(a, min(b)) FROM e GROUP BY a
        UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS k ON k.node = e.b WHERE r.component < k.component GROUP BY e.b)
    SELECT node, component FROM r""")
def components(spark, sf_dir):
    return graph.components(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10).alias("a"), (F.col("l_partkey") * 10 + 1).alias("b")))


@query()
def constrained_clusters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    links = li.select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), (F.col("l_quantity") / 50).alias("prob"))
    nodes = links.select(F.col("a").alias("id"), F.col("a").alias("fact")).union(links.select("b", F.lit(None).cast("string"))).distinct()
    return linking.constrained_clusters(links, nodes, "id", ["fact"])


_SOUNDS = [("Robert", "R163"), ("Rupert", "R163"), ("Rubin", "R150"), ("Ashcraft", "A261"), ("Tymczak", "T522"), ("Pfister", "P236"), ("Honeyman", "H555"), ("Lee", "L000")]


@query("SELECT c_custkey, [" + ", ".join(f"'{s}'" for _, s in _SOUNDS) + "][CAST(c_custkey % 8 AS INTEGER) + 1] AS soundex FROM customer")
def soundex_block(spark, sf_dir):
    name = F.concat(F.lit("Ann "), F.element_at(F.array(*[F.lit(n) for n, _ in _SOUNDS]), (F.col("c_custkey") % 8 + 1).cast("int")))
    keyed = linking.person_keys(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), "name")
    return keyed.select("c_custkey", "key.soundex")


# --- issues -----------------------------------------------------------------------------------------------------------

# Run 1 has the events to January 20, run 2 those from January 11: together all. Findings by hour of day are met in one run or both.
_RUNS = {"known": "CAST(ts AS DATE) < DATE '2024-01-21'", "found": "CAST(ts AS DATE) >= DATE '2024-01-11'"}
_FOUND_BY_HOUR = """SELECT concat(event_type, '-', CAST(user_id AS STRING), '-', CAST(hour(ts) AS STRING)) AS fingerprint, event_type AS check_id, CASE WHEN max(value) > 80 THEN 'HIGH' ELSE 'LOW' END AS severity, CAST(count(*) AS STRING) AS message FROM events WHERE {run} GROUP BY event_type, user_id, hour(ts)"""


@query(f"""
    WITH k AS ({_FOUND_BY_HOUR.format(run=_RUNS["known"])}), f AS ({_FOUND_BY_HOUR.format(run=_RUNS["found"])})
    SELECT coalesce(f.fingerprint, k.fingerprint) AS fingerprint, coalesce(f.check_id, k.check_id) AS check_id, coalesce(f.severity, k.severity) AS severity, coalesce(f.message, k.message) AS message,
        CASE WHEN k.fingerprint IS NOT NULL THEN 'accepted' ELSE 'open' END AS status, CASE WHEN k.fingerprint IS NOT NULL THEN 'ann' END AS owner, NULL AS note,
        CASE WHEN k.fingerprint IS NOT NULL THEN 'r1' ELSE 'r2' END AS first_seen_run, CASE WHEN f.fingerprint IS NOT NULL THEN 'r2' ELSE 'r1' END AS last_seen_run, f.fingerprint IS NOT NULL AS active
    FROM k FULL JOIN f ON k.fingerprint = f.fingerprint""")
def issue_merge(spark, sf_dir):
    known = bound_sql(spark, sf_dir, _FOUND_BY_HOUR.format(run=_RUNS["known"])).select("*", F.lit("accepted").alias("status"), F.lit("ann").alias("owner"), F.lit(None).cast("string").alias("note"), F.lit("r1").alias("first_seen_run"), F.lit("r1").alias("last_seen_run"), F.lit(True).alias("active"))
    found = bound_sql(spark, sf_dir, _FOUND_BY_HOUR.format(run=_RUNS["found"])).withColumn("seq", F.lit(1))
    return issues.merge_issues(known, found, "r2")


@query("""
    WITH i AS (SELECT o_custkey AS issue_id, list(o_orderkey ORDER BY o_orderkey) AS refs FROM orders GROUP BY o_custkey),
    x AS (SELECT issue_id, unnest(refs) AS ref FROM i)
    SELECT issue_id, string_agg(CASE WHEN l.n IS NULL THEN concat(CAST(ref AS VARCHAR), ':note') ELSE concat(CAST(ref AS VARCHAR), ':record:', CAST(l.n AS VARCHAR)) END, ' | ' ORDER BY ref) AS evidence
    FROM x LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = ref GROUP BY issue_id""")
def evidence_enrich(spark, sf_dir):
    """All orders and all of lineitem; orders without lines are the notes."""
    return _evidence(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _evidence(orders: DataFrame, lines: DataFrame) -> DataFrame:
    found = orders.groupBy(F.col("o_custkey").alias("issue_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("refs")).withColumn("refs", F.col("refs").cast("array<string>"))
    records = lines.groupBy(F.col("l_orderkey").cast("string").alias("ref")).agg(F.count("*").cast("string").alias("locator")).select("ref", F.lit("lineitem").alias("source"), "locator", F.lit(None).cast("string").alias("raw"))
    rows = issues.enrich_evidence(found, records)
    line = F.transform("evidence", lambda e: F.concat_ws(":", e["ref"], e["kind"], e["locator"]))
    return rows.select("issue_id", F.array_join(line, " | ").alias("evidence"))


@query("""
    SELECT CAST(window_start AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events) GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.groupBy(F.window(F.col("ts"), "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query("""
    WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM m)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.groupBy("user_id", F.session_window(F.col("ts"), "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("""SELECT CAST(row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS BIGINT) AS place, o_orderkey FROM orders ORDER BY place LIMIT 25""")
def ordered_top(spark, sf_dir):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    top = table(spark, sf_dir, "orders").orderBy(urgent, F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.withColumn("place", F.row_number().over(W.orderBy(urgent, F.desc("o_totalprice"), "o_orderkey")).cast("long")).select("place", "o_orderkey")
