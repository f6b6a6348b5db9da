"""Registered queries, each with the SQL that must give the same rows.

One query per operator, over the whole event table or what Spark derives from
it. Queries without SQL are those of the fitted forest, which no SQL expresses.
"""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
