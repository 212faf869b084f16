"""The engine's gold views over the driver's tables, in SQL that Spark and DuckDB read alike ({ts}: naive timestamp type)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "role_scope": """
        SELECT * FROM (VALUES ('RN', 'RN'), ('LPN', 'LPN'), ('LPN', 'RN'), ('CNA', 'CNA')) AS t(role, license_type)
    """,
    "persons": """
        SELECT concat('P', CAST(c_custkey AS STRING)) AS person_id, c_custkey % 10 <> 0 AS has_hr, concat('F', CAST(c_nationkey % 5 AS STRING)) AS home_facility,
            CASE c_custkey % 3 WHEN 0 THEN 'RN' WHEN 1 THEN 'LPN' ELSE 'CNA' END AS role,
            CASE WHEN c_custkey % 7 <> 0 THEN CAST('1995-01-01' AS DATE) + CAST(c_custkey % 1500 AS INT) END AS hire_date, c_name AS display_name,
            concat('e', CAST(c_custkey % 1200 AS STRING)) AS employee_id
        FROM customer
    """,
    "shifts": """
        SELECT concat('S', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS shift_id, concat('P', CAST(o_custkey AS STRING)) AS person_id,
            CASE WHEN l_suppkey % 11 <> 0 THEN concat('F', CAST(l_suppkey % 5 AS STRING)) END AS facility_id,
            CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'RN' WHEN l_partkey % 3 = 1 THEN 'LPN' ELSE 'CNA' END AS role,
            CAST(l_shipdate AS DATE) AS work_date, CAST(CAST(l_shipdate AS DATE) AS {ts}) + CAST(l_linenumber * 5 % 24 AS INT) * INTERVAL '1' HOUR AS start_ts,
            CAST(CAST(l_shipdate AS DATE) AS {ts}) + CAST(l_linenumber * 5 % 24 + 4 + CAST(l_quantity AS INT) % 9 AS INT) * INTERVAL '1' HOUR AS end_ts,
            CAST(4 + CAST(l_quantity AS INT) % 9 AS DOUBLE) AS hours
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "pay_periods": """
        SELECT concat('Y', CAST(o_orderkey AS STRING)) AS pay_id, concat('P', CAST(o_custkey AS STRING)) AS person_id,
            CASE WHEN o_orderkey % 7 <> 0 THEN concat('F', CAST(o_orderkey % 5 AS STRING)) END AS facility_id,
            CAST(o_orderdate AS DATE) AS period_start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 18 - 1 AS INT) AS period_end,
            CASE WHEN o_orderkey % 19 <> 0 THEN floor(o_totalprice) % 260 - 20 END AS hours_paid
        FROM orders
    """,
    "credentials": """
        SELECT concat('C', CAST(c_custkey AS STRING), '-', CAST(k AS STRING)) AS credential_id,
            CASE WHEN c_custkey % 23 <> 0 THEN concat('P', CAST(c_custkey AS STRING)) END AS holder_id,
            CASE WHEN c_custkey % 23 <> 0 THEN 'person' ELSE 'organisation' END AS holder_kind,
            CASE (c_custkey + k) % 4 WHEN 0 THEN 'RN' WHEN 1 THEN 'LPN' WHEN 2 THEN 'CNA' ELSE 'OTHER' END AS type,
            concat(CASE c_custkey % 3 WHEN 0 THEN 'RN-' WHEN 1 THEN 'LPN-' ELSE 'X' END, CAST(100 + c_custkey % 600 + k * 5000 AS STRING)) AS number,
            CASE WHEN (c_custkey + k) % 9 <> 0 THEN CAST('1995-06-01' AS DATE) + CAST((c_custkey * 37 + k * 400) % 1500 AS INT) END AS expires_on,
            CASE WHEN c_custkey % 4 <> 1 THEN CAST('1996-01-01' AS DATE) + CAST(c_custkey % 700 AS INT) END AS last_verified
        FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS ks WHERE c_custkey % 6 <> 0
    """,
    "records": """
        SELECT concat('R', CAST(o_orderkey AS STRING)) AS record_id, 'payroll' AS template, concat('P', CAST(o_custkey % 300 AS STRING)) AS person_id, CAST(NULL AS STRING) AS employee_id,
            CASE o_orderkey % 4 WHEN 0 THEN 'RN' WHEN 1 THEN 'LPN' WHEN 2 THEN 'CNA' END AS role, concat('F', CAST(o_orderkey % 2 AS STRING)) AS facility_id,
            CASE WHEN o_orderkey % 9 <> 4 THEN concat('Y', CAST(o_orderkey % 50 AS STRING)) END AS pay_id, CASE WHEN o_orderkey % 31 <> 0 THEN CAST('1996-01-01' AS DATE) + CAST(o_orderkey % 40 * 7 AS INT) END AS period_start,
            CAST('1996-01-07' AS DATE) + CAST(o_orderkey % 40 * 7 AS INT) AS period_end, floor(o_totalprice) % 3 AS hours_paid, CAST(NULL AS STRING) AS content
        FROM orders
        UNION ALL
        SELECT concat('H', CAST(c_custkey AS STRING)), 'hr_roster', concat('P', CAST(c_custkey AS STRING)), concat('e', CAST(c_custkey % 1200 AS STRING)), NULL, NULL, NULL, NULL, NULL, NULL, concat(c_mktsegment, CAST(c_nationkey % 2 AS STRING))
        FROM customer
    """,
}


def bound_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement over the tables of a folder; the tables are bound to it alone, so no session view is left or overwritten."""
    used = set()

    def bind(m: re.Match) -> str:
        used.add(m[2])
        return f"{m[1]} {{{m[2]}}}"

    text = re.sub(r"\b(FROM|JOIN) (customer|orders|lineitem|events)\b", bind, sql)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def spark_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: bound_sql(spark, sf_dir, sql.format(ts="TIMESTAMP_NTZ")) for name, sql in VIEWS.items()}


def duckdb_views(*names: str) -> str:
    """The named views as a WITH list for an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(ts='TIMESTAMP')})" for n in names)
