"""All process-analytics queries over the test tables, with their SQL."""

from __future__ import annotations

from caseweave.plans import agent_queries, interval_queries, log_queries, model_queries, source_queries, statistics_queries

QUERIES = log_queries.QUERIES | model_queries.QUERIES | source_queries.QUERIES | agent_queries.QUERIES | interval_queries.QUERIES | statistics_queries.QUERIES
ORACLE_SQL = log_queries.ORACLE_SQL | model_queries.ORACLE_SQL | source_queries.ORACLE_SQL | agent_queries.ORACLE_SQL | interval_queries.ORACLE_SQL | statistics_queries.ORACLE_SQL
