"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from cohortloom.plans import reference_queries, statistics_queries, study_queries, training_core

__all__ = ["QUERIES", "SQL", "statistics_queries", "study_queries"]
_PARTS = (reference_queries, training_core)  # statistics_queries and study_queries register theirs with reference_queries

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
