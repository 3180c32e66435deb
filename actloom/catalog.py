"""All queries of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from actloom.plans import corpus_queries, diff_queries, more_queries, report_queries, text_queries  # noqa: F401
from actloom.plans.registry import QUERIES, SQL

FLAGSHIP = "D13_version_diff"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
