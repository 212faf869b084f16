"""Every query of the reconciliation engine by name, and the same in DuckDB's SQL."""

from . import check_queries, operator_queries, run_queries  # noqa: F401 - run_queries registers with operator_queries

QUERIES: dict = {**operator_queries.QUERIES, **check_queries.QUERIES}
ORACLE_SQL: dict = {**operator_queries.ORACLE_SQL, **check_queries.ORACLE_SQL}
